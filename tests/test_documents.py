"""Extractors against the worked examples of their documents."""

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import documents as D
from ledgerspark.operators import matching as M
from ledgerspark.operators import pages as G

TEXTS = [
    ("g1", "EMPRESA EJEMPLO S.A.S. NIT : 900123456 -0\nTRANSFERENCIAS BANCARIAS G-002-00202609003\n| Girado a : PROVEEDOR TRES SAS       FECHA : 2026/09/01 |\n| NIT : 901,333,444-5 |\n| Banco : BANCOLOMBIA CTA CTE No. 000-00  C.Costo : 0001 |\n| LA SUMA DE : SETECIENTOS SESENTA Y SEIS MIL | |\n| | 415,320.00 |\n| 2205050100 - CANCELA FACTURA No. 00000000091-001 | 415,320.00 |\n| Girado : | 415,320.00 |"),
    ("p1", "OTRAS COMPRAS P-003-00202506191\nA Favor de : SERVICIOS UNO SAS | Fecha : 2026/06/01\nCédula / NIT : 860.111.222-3\nFact. No.: 003-00202506191\nRETFTE FACT 18091\nO.C. 20260777 Orden : 608008\nT o t a l | 1,200.00\nT o t a l | 1,250.00"),
    ("y1", "ORDEN DE COMPRA MATERIAL NACIONAL 00020260777\n| Señores : PROVEEDOR UNO S.A. 860111222-3 | Fecha: 2026/07/14 |\n| Fec.Ent. : 2026/09/22 |\n|0050007000044 | CILINDRO ARGON |PZ | 80.00| 164,835.00| 13,186,800.00|\n|ENTREGAS: 21/07: 20 CIL / 04/08: 15 CIL\n| Neto a Pagar | 15,692,292.00|"),
    ("y2", "ORDEN DE SERVICIO 00202601069\n" + "|0050007000045 | SERVICIO |UN | 1.00| 10.00| 10.00|\n" * 4 + "ORDEN DE SERVICIO 00202601069\n" + "|0050007000045 | SERVICIO |UN | 1.00| 10.00| 10.00|\n" * 4),
    ("e1", "ENTRADA DE ALMACEN No. E-001-00202607001\nNIT : 900123456-0\nSEÑORES : X NIT : 860111222-3\nEntra 15.00PZ\nEntra 1,920.00ROL\nEntra 40.0OROL\n0.C. 20260777 FRA FC91\nREVISADO POR COSTOS ANA RUIZ 05-08-2026"),
    ("m1", "Asunto: RE: APROBACION OC 20260354 ASEO\nfavor orden de compra No. 20260999"),
    ("f1", "CLIENTE EMPRESA EJEMPLO NIT: 900.123.456-0\nProveedor ACME N.I.T. 860.111.222-3\nnumeración autorizada desde FV 1 hasta FV 5000\nFactura No. FV 2295"),
    ("r1", "Acuse de recibo ... Recibo del bien o Prestación del servicio ... Aceptación expresa"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc string, text string")


def rows(df):
    return {r.doc: r for r in df.collect()}


def test_voucher(docs):
    r = rows(D.vouchers(docs))["g1"]
    assert (r.payee, r.payer_id, r.payee_id, r.value, r.date, r.invoices) == ("PROVEEDOR TRES SAS", "900123456", "901333444", 415320.0, "2026-09-01", ["91"])
    line = rows(D.voucher_lines(docs.where("doc = 'g1'")))["g1"]
    assert (line.invoice, line.value) == ("91", 415320.0)


def test_purchase_entry(docs):
    r = rows(D.purchase_entries(docs))["p1"]
    assert (r.total, r.invoice, r.order_no, r.inner_order, r.tax_id) == (1250.0, "18091", "20260777", "608008", "860111222")


def test_orders(docs):
    r = rows(D.purchase_orders(docs))
    assert (r["y1"].number, r["y1"].tax_id, r["y1"].date, r["y1"].quantity, r["y1"].net, r["y1"].deliveries) == ("20260777", "860111222", "2026-07-14", 80.0, 15692292.0, "21/07:20, 04/08:15")
    assert r["y2"].quantity == 4.0  # four equal lines count, the repeated page does not


def test_receipt(docs):
    r = rows(D.receipts(docs))["e1"]
    assert (r.quantity, r.units, r.order_no, r.invoice, r.signed, r.tax_ids) == (1975.0, ["PZ", "ROL"], "20260777", "FC91", True, ["900123456", "860111222"])
    assert (r.party, r.tax_id) == ("X", "860111222")


def test_stamps(spark):
    cases = {
        "REVISADO POR COSTOS\nANA RUIZ PAZ 05-08-2026": (True, "REVISADO POR COSTOS", "ANA RUIZ PAZ", "05-08-2026"),
        "R E V I S A D O P O R C O S T O S\nE V A P A Z 2 3 - 0 7 - 2 0 2 6\nREVISADO POR COSTOS\nEVA PAZ 23-07-2026": (True, "R E V I S A D O P O R C O S T O S", "EVA PAZ", "23-07-2026"),
        "Vo Bo\nMARIA LOPEZ": (True, "Vo Bo", "MARIA LOPEZ", ""), "nada": (False, "", "", ""),
        "APROBADO POR X\n" + "." * 200 + "\nLUZ DIAZ GIL 01/02/2026": (True, "APROBADO POR X", "LUZ DIAZ GIL", "01/02/2026"),
    }
    got = {r["t"]: tuple(r["s"]) for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", D.stamp_of(F.col("t")).alias("s")).collect()}
    assert got == cases


def test_concepts_are_twelve_at_most(spark):
    text = "\n".join(f"| concepto numero {k} | {k}.00 |" for k in range(20)) + "\n| corto | 1.00 |\n | sangrado largo | 2.00 |"
    got = D.voucher_concepts(spark.createDataFrame([("v", text)], "doc string, text string")).orderBy("n").collect()
    assert [r.value for r in got] == [float(k) for k in range(1, 13)]


def test_mail_ranges_ids_events(spark, docs):
    assert rows(docs.select("doc", D.mail_orders(F.col("text")).alias("orders")))["m1"].orders == ["20260354"]
    assert rows(D.issuer_and_buyer(D.tax_ids(docs), docs.select("doc", F.lit("900123456").alias("own_id"))))["g1"].issuer == "9013334445"
    assert rows(D.event_logs(docs))["r1"].present == ["acuse", "recibo", "aceptacion"]


def test_ranges_of_any_width(spark):
    points = spark.createDataFrame([("A", n) for n in (0, 1, 2, 63, 64, 65, 99_999_999, 100_000_000, 10**12)] + [("B", 5)], "prefix string, n long")
    ranges = spark.createDataFrame([("A", 1, 99_999_999, "wide"), ("A", 64, 64, "one"), ("A", 63, 65, "three"), ("A", 10**12 - 1, 10**13, "far"), ("A", 9, 3, "none")], "prefix string, low long, high long, name string")
    brute = lambda inside: sorted((n, x) for p, n in points.collect() for q, lo, hi, x in ranges.collect() if p == q and inside(lo, n, hi))
    got = lambda **k: sorted((r.n, r.name) for r in M.range_join(points, ranges, **k).collect())
    assert got() == brute(lambda lo, n, hi: lo <= n <= hi) and got(inclusive=False) == brute(lambda lo, n, hi: lo < n < hi)


def test_ranges_of_a_document_do_not_repeat_its_points(spark):
    points = spark.createDataFrame([(d, p, n) for d in (1, 2) for p, n in (("A", 5), ("A", 10), ("B", 6))], "doc int, prefix string, n long")
    ranges = spark.createDataFrame([(1, "A", 5, 12), (2, "A", 6, 7), (2, "B", 5, 7), (1, "B", 9, 3)], "doc int, prefix string, low long, high long")
    met = M.range_join(points, ranges, inclusive=False, own=("doc",))
    assert sorted((r.doc, r.prefix, r.n) for r in met.collect()) == [(1, "A", 10), (2, "B", 6)]
    assert "Generate" not in met._jdf.queryExecution().toString().replace("LogicalRDD", "")


def test_names_meet_on_a_word(spark):
    a = spark.createDataFrame([(1, "HILOS DEL RIO S A S"), (1, "GRUPO SAS"), (2, "TUBOS Y CODOS")], "n int, a string")
    b = spark.createDataFrame([(1, "HILOS RIO LTDA"), (1, "GRUPO SAS"), (1, "TUBOS Y CODOS SAS"), (2, "CODOS UNO DOS TRES CUATRO")], "n int, b string")
    assert sorted((r.a, r.b) for r in M.party_pairs(a, b, ["n"]).collect()) == [("HILOS DEL RIO S A S", "HILOS RIO LTDA"), ("TUBOS Y CODOS", "CODOS UNO DOS TRES CUATRO")]


def test_every_pair_of_names_has_its_verdict(spark):
    a = spark.createDataFrame([(1, "HILOS DEL RIO S A S"), (1, "HILOS DEL RIO S A S"), (1, "GRUPO SAS"), (2, "TUBOS Y CODOS")], "n int, a string")
    b = spark.createDataFrame([(1, "HILOS RIO LTDA"), (1, "GRUPO SAS"), (2, "ACEROS")], "n int, b string")
    got = sorted((r.a, r.b, r.same) for r in M.party_verdicts(a, b, "n").collect())
    assert got == sorted([("HILOS DEL RIO S A S", "HILOS RIO LTDA", True)] * 2 + [("HILOS DEL RIO S A S", "GRUPO SAS", False)] * 2 + [("GRUPO SAS", "HILOS RIO LTDA", False), ("GRUPO SAS", "GRUPO SAS", False), ("TUBOS Y CODOS", "ACEROS", False)])


def test_splice_of_images(spark):
    def loop(lines, read):
        out, known = [x for x, _ in lines], [(top, x) for x, top in lines]
        for top, x in sorted(read, key=lambda r: r[0]):
            above = [k for k in known if k[0] < top]
            at = len(out)
            if above:
                high = max(t for t, _ in above)
                at = out.index(next(s for t, s in above if t == high)) + 1
            out.insert(at, x)
            known.append((top, x))
        return out

    cases = {
        "a": ([("uno", 10.0), ("dos", 30.0), ("tres", 50.0)], [(20.0, "r1"), (22.0, "r2"), (55.0, "r3"), (31.0, "r4")]),
        "b": ([("uno", 10.0), ("uno", 30.0), ("tres", 50.0)], [(35.0, "r1"), (36.0, "r2"), (60.0, "r3")]), "c": ([("uno", 10.0)], [(5.0, "r1"), (6.0, "r2"), (12.0, "r3")]), "d": ([("uno", 10.0), ("dos", 20.0)], [(15.0, "r1"), (15.0, "r2"), (25.0, "r3")]),
    }
    lines = spark.createDataFrame([(d, 1, i, x, top) for d, (ls, _) in cases.items() for i, (x, top) in enumerate(ls)], "doc string, page int, line_no int, line string, top double")
    read = spark.createDataFrame([(d, 1, i, top, x) for d, (_, rs) in cases.items() for i, (top, x) in enumerate(rs)], "doc string, page int, read_no int, top double, line string")
    got = {}
    for r in G.spliced(lines, read).orderBy("doc", "line_no").collect():
        got.setdefault(r.doc, []).append(r.line)
    assert got == {d: loop(*x) for d, x in cases.items()}


def test_glued_words(spark):
    df = spark.createDataFrame([("Aprobadapor$785.400",), ("importancia",), ("FC91 va",), (None,)], "t string")
    assert [r[0] for r in df.select(D.unglue(F.col("t"))).collect()] == ["Aprobada por $785.400", "importancia", "FC91 va", None]
    labels = spark.createDataFrame([("titulr del pago",), ("corto",)], "t string").select(D.nearest_label(F.col("t"), ["titular del pago", "valor"]))
    assert [r[0] for r in labels.collect()] == ["titular del pago", None]


def test_parts_of_an_order_are_read_once(spark):
    """Amounts and days of deliveries are not read anew for each delivery, and not at all where a text has none; the first of a day counts."""
    docs = spark.createDataFrame([(1, "ORDEN DE COMPRA 123456\nEntregas: 21/07: 20 CIL / 04/08: 15 CIL / 21/07: 9 CIL"), (2, "ORDEN DE COMPRA 123457\n21/07: 20 CIL")], "doc long, text string")
    out = D.purchase_orders(docs)
    assert [r.deliveries for r in out.orderBy("doc").collect()] == ["21/07:20, 04/08:15", ""]
    assert out._jdf.queryExecution().optimizedPlan().toString().count(D.DELIVERY) == 2
