"""Worked examples of scalar functions, checks, candidates and layout."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import numbers as N
from ledgerspark.functions import text as X
from ledgerspark.operators import candidates as C
from ledgerspark.operators import checks as K
from ledgerspark.operators import codes
from ledgerspark.operators import layout as L


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("reader, raw, want", [
    (N.mixed, "3,271,845", 3271845), (N.mixed, "2.871.845,00", 2871845), (N.mixed, "1,452,300.00", 1452300), (N.mixed, "1.920", 1920), (N.mixed, ".", None), (N.mixed, "x1", None),
    (N.simple, "15.00", 15), (N.simple, "1,920.00", 1920), (N.simple, "1.920,00", 1920), (N.simple, "1.920", 1.92), (N.simple, "1.920.000", None),
    (N.receipt_quantity, "1,920.00", 1920), (N.receipt_quantity, "1.920,00", 1.92),
    (N.portal_amount, "COP $ 4.118.250,00", 4118250), (N.portal_amount, "1.347.288.00", 1347288), (N.portal_amount, "2.651.400 00", 2651400), (N.portal_amount, "1,234,567.00", None), (N.portal_amount, "1,920.00", 1.92),
    (N.form_quantity, "1,920.00", 1.92), (N.form_quantity, "1.920,00", 1920),
])
def test_number_readers(spark, reader, raw, want):
    assert value(spark, reader(F.lit(raw))) == want


def test_text_functions(spark):
    v = lambda c: value(spark, c)
    lit = F.lit
    assert v(N.portal_shape(lit("1.452.00.00"))) is False
    assert v(X.same_tax_id(lit("900.123.456-0"), lit("900123456"))) and not v(X.same_tax_id(lit(""), lit("9"))) and not v(X.same_tax_id(lit("123"), lit("124")))
    assert [v(X.whole_number(lit(x))) for x in ("FC91", "FCHA24381", "00000004719", "000", "")] == ["91", "24381", "4719", "0", ""]
    assert all(v(lit(t).rlike("900") & F.regexp_like(lit(t), X.tax_id_pattern(lit("900123456")))) for t in ("nit 900.123.456", "900,123,456-0", "900123456 0"))
    assert v(X.bank_date(lit("4 Sep2026"))) == v(X.bank_date(lit("04/09/2026"))) == "2026-09-04"
    assert v(X.order_date(lit("14/07/2026"))) == v(X.order_date(lit("2026/07/14"))) == "2026-07-14"
    assert v(X.account(lit("477 -857143 -72"))) == "477-857143-72"
    assert v(X.same_party(lit("VIDRIOS S A S"), lit("VIDRIOS SAS"))) and not v(X.same_party(lit("CAMARA DE ARTES DE CALI"), lit("COOPERATIVA DE PINTORES")))
    assert v(X.differing(lit("127333397"), lit("157333397"))) == 1 and v(X.differing(lit("1"), lit("12"))) == 99
    assert v(X.clean_tax_id(lit("900,555,111-8"))) == "900555111" and v(X.clean_invoice(lit("00000000091-001"))) == "91"
    assert v(X.spelled_out(lit("R E V I S A D O"))) and not v(X.spelled_out(lit("revisado por Ana")))
    assert v(X.party_name(lit("HIERROS DEL SUR LTDA"))) and not v(X.party_name(lit("Total 3")))
    assert v(X.qr_fields(lit("NumFac: FV12\nNitFac=900\nNumFac: X"))) == {"numfac": "FV12", "nitfac": "900"}
    assert v(X.invoice_hash(lit("CUFE: " + "a1" * 48))) == "a1" * 48
    assert v(X.safe_name(lit("../a b/ñ factura"))) == "factura.pdf" or v(X.safe_name(lit("../a b/ñ factura"))).endswith(".pdf")
    assert v(X.pack_factor(lit("CINTA x 4 ROLLOS"))) == 4 and v(X.pack_factor(lit("TORNILLO"))) is None


def test_amounts_need_the_right_neighbours():
    assert [a[1] for a in C.amounts_of("Aprobada por $ 73,041 nit 900.555.111-8 en 2026/07/24 y 1,768.00ROL")] == [73041]
    assert [a[:3] for a in C.amounts_of("por 150 mil pesos, 3 millones de pesos y $ 73,041")] == [("$ 73,041", 73041.0, True), ("150 mil pesos", 150000.0, True), ("3 millones de pesos", 3000.0, True)]
    assert [a[1:3] for a in C.amounts_of("saldo 1.452.300,00CR y $ 2026 y 2.026 y 15.000")] == [(1452300.0, True), (15000.0, False)]


MAILS = {
    ("a", "p1"): "Desde: Ana Ruiz <ana@x.co>\nEnviado: 4 Sep 2026\nAprobada por $ 73,041\nSaludos",
    ("b", "p1"): "Desde: Luis Paz\npor favor su aprobación por $ 150,000\nOk procedamos por $150.000",
    ("c", "p2"): "De: Eva\nAprobadas:\nHILOS DEL RIO S A S\nToner negro HP\nFRA 5151 valor $ 1.700.000,00\nCANTIDAD VALOR TOTAL\nFRA 6161 valor $ 2.800.000,00",
    ("d", "p3"): "Desde: Rey\nsaldo de $ 900.000\nTel 605.123.4567\nsolicito su visto bueno por 3.000.000",
    ("e", "p1"): "Desde: Ana Ruiz <ana@x.co>\nAprobada por $ 73,041",
    ("f", "p4"): "nada que aprobar",
    ("g", "p5"): "Fecha Mar 01/09/2026\nAprobados:\nFecha factura\nPara la planta\n150 mil pesos y 3 millones de pesos\nEVA Y ANA LTDA:\nSuma 5.000.000",
}


def test_classes_and_verdict(spark):
    lines = spark.createDataFrame([(doc, 1, i, line, p) for (doc, p), t in MAILS.items() for i, line in enumerate(t.split("\n"))], "doc string, page int, line_no int, line string, payment string")
    kinds = {(r.doc, r.line_no): r.kind for r in lines.select("doc", "line_no", C.class_of(F.col("line")).alias("kind")).collect()}
    assert kinds["a", 2] == "acto" and kinds["b", 1] == "solicitud" and kinds["b", 2] == "acto" and kinds["d", 1] == "informativo"
    cands = C.with_invoices(C.candidates(lines)).cache()
    found = {r.payment: r for r in C.verdict(C.chosen(cands)).collect()}
    assert (found["p1"].total, found["p1"].split, found["p1"].confidence) == (223041.0, True, "alta")
    assert found["p2"].total == 4500000.0 and found["p3"].confidence == "baja" and "p4" not in found
    told = {(r.doc, r.value): (r.header, r.party, r.author, r.date, r.kind, r.invoice) for r in cands.collect()}
    assert told["c", 1700000.0] == ("Aprobadas:", "HILOS DEL RIO S A S", "Eva", "", "acto", "5151")  # "Toner" is no addressee
    assert told["c", 2800000.0] == ("Aprobadas:", "HILOS DEL RIO S A S", "Eva", "", "acto", "6161")  # a table's head is nobody
    assert told["a", 73041.0][2:4] == ("Ana Ruiz", "4 Sep 2026")
    assert told["g", 150000.0][0] is None and told["g", 3000.0][0] is None  # "Para la planta" is a header of mail, "Fecha factura" is none
    assert told["g", 5000000.0][:2] == ("EVA Y ANA LTDA:", None)


def test_invoices_of_a_mail_are_in_order_of_their_numbers(spark):
    lines = spark.createDataFrame([("a", 1, 0, "FRA 1004612 y FRA 904612"), ("a", 1, 1, "FRA 904612 por $ 1.500.000")], "doc string, page int, line_no int, line string")
    assert C.summaries(lines, C.candidates(lines)).first().invoices == ["904612", "1004612"]


def test_mails_are_written_by_all_tasks_and_texts_folded_once(spark):
    from ledgerspark.plans import mails

    made = mails._mails(spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString()
    lines = spark.createDataFrame([("a", 1, 0, "Aprobada por $ 1.500.000")], "doc string, page int, line_no int, line string")
    plan = C.candidates(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(lower(") < 20  # once for each of some seventy words before


def test_portal_labels_are_told_without_loops(spark):
    from ledgerspark.operators import portal as P

    said = ["Razón social", "Versic", "version", "Ve", "ALFA SAS", "", "  ", "Acuse de recibo", "estatus legal:", "elrazonsocialx"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").select("i", P.is_label(F.col("t")).alias("is"))
    plain = lambda t: (lambda c: c == "" or any(k in c or len(c) >= 5 and c in k for k in P.LABELS))("".join(x for x in t.lower().replace("ó", "o") if x.isalnum()))
    assert [r["is"] for r in df.orderBy("i").collect()] == [plain(t) for t in said]
    assert "exists(" not in df._jdf.queryExecution().optimizedPlan().toString()


WORDS = [
    ("w1", 1, 1, "Valor", 10.0, 40.0, 10.0, 20.0), ("w1", 1, 2, "Titular", 100.0, 150.0, 11.0, 21.0),
    ("w1", 1, 3, "4.118.250,00", 10.0, 60.0, 40.0, 50.0), ("w1", 1, 4, "ACEROS", 100.0, 140.0, 42.0, 52.0), ("w1", 1, 5, "NORTE", 145.0, 180.0, 41.0, 51.0),
    ("w1", 1, 6, "661.300,00", 10.0, 60.0, 70.0, 80.0), ("w1", 1, 7, "VIDRIOS", 100.0, 160.0, 71.0, 81.0),
    ("w2", 1, 1, "Auxiliar", 10.0, 60.0, 200.0, 210.0), ("w2", 1, 2, "Pedro", 70.0, 100.0, 201.0, 211.0), ("w2", 1, 3, "Supervisor", 200.0, 260.0, 200.0, 210.0), ("w2", 1, 4, "Marta", 205.0, 240.0, 230.0, 240.0),
]
ROWS = [("w1", 1, 45.0), ("w1", 1, 75.0)]
COLUMNS = [("w1", 1, "valor", 35.0), ("w1", 1, "titular", 130.0)]
LABELS = [("w2", 1, "auxiliar", 10.0, 60.0, 200.0, 210.0), ("w2", 1, "supervisor", 200.0, 260.0, 200.0, 210.0), ("w3", 1, "auxiliar", 10.0, 60.0, 200.0, 210.0)]
IMAGES = [("w2", 1, 20.0, 80.0, 180.0), ("w2", 1, 300.0, 340.0, 190.0)]
SCANNED = [("w3", 1)]
PACKS = [
    ("a", [10.0, 5.0], [4, None], [40.0, 5.0], 30.0), ("b", [10.0], [4], [41.0], 30.0), ("c", [40.0], [4], [10.0], -30.0),
    ("d", [2.0, 2.0, 3.0], [5, 5, 3], [10.0, 9.0], 8.0), ("e", [], [], [], 0.0),
]



def test_pack_conversions(spark):
    found = {r.doc: r["items"] for r in K.pack_conversions(spark.createDataFrame(PACKS, "doc string, quantities array<double>, factors array<int>, received array<double>, gap double")).collect()}
    assert found == {"a": [0], "b": None, "c": [0], "d": [1], "e": None}
    assert K.smallest_conversion([1.0] * 15, [2] * 15, [2.0], 1.0) is None


def test_pack_conversions_are_those_of_all_ways():
    r = random.Random(6)
    for _ in range(200):
        n = r.randint(1, 6)
        q, f = [float(r.randint(1, 12)) for _ in range(n)], [r.choice([None, 1, 2, 3, 4]) for _ in range(n)]
        got = [x * y for x, y in zip(q, f) if y and r.random() < 0.8] + [x / y for x, y in zip(q, f) if y and r.random() < 0.5]
        ways = [[None] + [(i, y - x) for y, ok in ((x * k, True), (x / k, x % k == 0)) if ok and round(y, 2) in {round(g, 2) for g in got}] if k and k > 1 else [None] for i, (x, k) in enumerate(zip(q, f))]
        picks = [[p for p in way if p] for way in itertools.product(*ways)]
        gap = sum(d for _, d in r.choice(picks)) + r.choice([0, 0, 0.3])
        good = [[i for i, _ in p] for p in picks if p and abs(sum(d for _, d in p) - gap) < 0.01]
        assert K.smallest_conversion(q, f, got, gap) == (min(good, key=len) if good else None)


def test_layout(spark):
    words = spark.createDataFrame(WORDS, "doc string, page int, word_no int, text string, x0 double, x1 double, y0 double, y1 double")
    labels = spark.createDataFrame(LABELS, "doc string, page int, label string, x0 double, x1 double, y0 double, y1 double")
    lines = sorted((r.doc, r.line_no, r.text) for r in L.line_texts(L.visual_lines(words)).collect())
    assert lines[:3] == [("w1", 0, "Valor Titular"), ("w1", 1, "4.118.250,00 ACEROS NORTE"), ("w1", 2, "661.300,00 VIDRIOS")]
    table = L.table_cells(words, spark.createDataFrame(ROWS, "doc string, page int, y double"), spark.createDataFrame(COLUMNS, "doc string, page int, name string, x double"))
    cells = {(r["row"], r["name"]): r["text"] for r in table.collect() if r["row"] == 2}
    assert cells[2, "valor"] == "661.300,00" and cells[2, "titular"] == "VIDRIOS"
    signed = L.signatures(labels, spark.createDataFrame(IMAGES, "doc string, page int, x0 double, x1 double, bottom double"), spark.createDataFrame(SCANNED, "doc string, page int"))
    assert {(r.doc, r.label): r.signed for r in signed.collect()} == {("w2", "auxiliar"): True, ("w2", "supervisor"): False, ("w3", "auxiliar"): None}
    assert {r.label: r.value for r in L.value_beside(words, labels).collect()} == {"auxiliar": "Pedro", "supervisor": "Marta"}


def test_repeated_pages_change_nothing(spark):
    pages = spark.createDataFrame([("d", 1, "a\na"), ("d", 2, "b"), ("d", 3, "a\na")], "doc string, page int, text string")
    assert sorted(r.page for r in L.without_repeated_pages(pages).collect()) == [1, 2]


def test_codes_by_shape():
    r = np.random.default_rng(1)
    draw = lambda a: (np.ascontiguousarray(a, np.uint8).tobytes(), a.shape[1], a.shape[0])
    code = np.kron(r.integers(0, 2, (45, 45)), np.ones((6, 6))) * 200 + 20
    logo = np.zeros((150, 150)) + 255
    logo[40:110, 30:60] = 0
    assert codes.looks_like_code(*draw(code)) and codes.looks_like_code(*draw(code[::2, ::3]))
    assert not codes.looks_like_code(*draw(logo)) and not codes.looks_like_code(*draw(np.full((60, 60), 7))) and not codes.looks_like_code(*draw(code[:40, :40])) and not codes.looks_like_code(None, 60, 60)
