"""Bank captures: worked examples beyond what the written captures of the queries hold."""

import difflib
import random

from pyspark.sql import functions as F

from ledgerspark.functions import text as X
from ledgerspark.operators import captures as C

WORD = "doc string, page int, word_no int, text string, x0 double, x1 double, y0 double, y1 double"


def words(spark, docs):
    """docs: name -> list of (text, x0, x1, y)."""
    rows = [(d, 1, i, t, float(a), float(b), float(y), float(y) + 10) for d, ws in docs.items() for i, (t, a, b, y) in enumerate(ws)]
    return spark.createDataFrame(rows, WORD)


TITLES = [("Destinatario", 10, 60, 0), ("Documento", 100, 150, 0), ("Valor", 200, 230, 0), ("Referencia", 300, 350, 0)]


def test_labels_are_those_of_a_plain_loop(spark):
    """Likeness agrees with difflib on labels that were damaged at random, and the edit bound leaves none out."""
    r = random.Random(2)
    said = []
    for label in list(C.LABELS) * 12:
        t = list(label)
        for _ in range(r.randint(0, 6)):
            k = r.randrange(len(t))
            t[k:k + 1] = r.choice([[], ["i"], [t[k], "x"], ["o"]])
            t = t or ["x"]
        said.append("".join(t))
    docs = {str(i): [(s, 0, 100, 0), ("value", 0, 50, 30)] for i, s in enumerate(said)}
    got = {r["doc"]: r["field"] for r in C.label_hits(C.capture_lines(words(spark, docs))).collect()}
    for i, s in enumerate(said):
        key = " ".join(s.split()).strip(" .:")
        near = difflib.get_close_matches(key, list(C.LABELS), 1, C.LIKE) if len(key) >= 8 else []
        assert got.get(str(i)) == C.LABELS.get(key, C.LABELS[near[0]] if near else None), s


def test_labels_are_looked_for_once(spark):
    heads = C.head_fields(C.capture_lines(words(spark, {"a": [("Producto a debitar", 20, 120, 0), ("uno", 20, 30, 20)]})))
    assert "levenshtein" not in heads._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.field, r.value) for r in heads.collect()] == [("account", "uno")]


def test_values_below_labels(spark):
    label = ("Producto a debitar", 20, 120, 0)
    docs = {
        "three": [label, ("a", 20, 30, 20), ("b", 20, 30, 40), ("c", 20, 30, 60), ("d", 20, 30, 80)],
        "gap": [label, ("z", 900, 910, 20), ("z", 900, 910, 40), ("a", 20, 30, 60), ("z", 900, 910, 80), ("b", 20, 30, 100)],
        "far": [label, ("z", 900, 910, 20), ("z", 900, 910, 40), ("z", 900, 910, 60), ("a", 20, 30, 80)],
        "stop": [label, ("Nombre del pago", 500, 600, 20), ("a", 20, 30, 40)],
        "twice": [label, ("Producto a debitar", 20, 120, 20), ("a", 20, 30, 40)],
        "button": [label, ("Cambiar", 20, 60, 20), ("a", 20, 30, 40)],
        "none": [("a", 20, 30, 0)],
    }
    got = {(r["doc"], r["field"]): r["value"] for r in C.head_fields(C.capture_lines(words(spark, docs))).collect()}
    assert got == {("three", "account"): "a b c", ("gap", "account"): "a", ("twice", "account"): "a", ("button", "account"): "a"}


def test_rows_by_titles(spark):
    row = lambda y, name, doc, value: [(name, 10, 90, y), (doc, 100, 160, y), (value, 190, 240, y), ("F 11 222", 300, 350, y)]
    docs = {
        "plain": [*TITLES, *row(30, "Uno", "900.1", "COP $ 1.000,00"), *row(60, "Dos", "900.2", "COP $ 2.000,00"), ("Mostrando 1-2 de 2 pagos", 10, 90, 90), *row(120, "Tres", "900.3", "COP $ 3.000,00")],
        "no value": [("Destinatario", 10, 60, 0), ("Documento", 100, 150, 0), ("Referencia", 300, 350, 0), ("Uno", 10, 60, 30), ("COP $ 10.000,00", 190, 240, 30)],
        "digits": [("Destinatario 1234", 10, 60, 0), ("Documento", 100, 150, 0), ("Valor", 200, 230, 0), ("Uno", 10, 60, 30), ("COP $ 10.000,00", 190, 240, 30)],
        "stacked": [("Tipo de", 10, 40, 0), ("Destinatario", 100, 150, 0), ("Valor", 200, 230, 0), ("transaccion", 10, 60, 12), ("Abono", 10, 50, 40), ("Uno", 100, 130, 40), ("5.000,00", 200, 240, 40), ("S A S", 100, 130, 52)],
    }
    got = sorted((r["doc"], r["row"], r["payee"], r["document"], r["value"], r["kind"]) for r in C.capture_rows(C.capture_lines(words(spark, docs))).collect())
    assert got == [("digits", 1, "Destinatario Documento Uno", "", "COP $ 10.000,00", ""), ("plain", 1, "Uno", "900.1", "COP $ 1.000,00", ""), ("plain", 2, "Dos", "900.2", "COP $ 2.000,00", ""), ("stacked", 1, "Uno S A S", "", "5.000,00", "Abono")]


def test_rows_by_content(spark):
    docs = {"a": [
        ("Nada", 10, 40, 0), ("Registros agregados", 10, 90, 20), ("Abono a cuenta", 10, 90, 50), ("Hilos y", 100, 150, 50), ("Lanas", 100, 150, 62), ("900.123.456", 200, 260, 50), ("12 - 34", 300, 340, 50), ("Ahorros", 300, 340, 62),
        ("C0P $ 7.500,00", 400, 460, 55), ("F 77", 500, 540, 55), ("Sin documento", 100, 180, 120), ("COP 900", 400, 460, 120)]}
    got = [tuple(r) for r in C.capture_rows(C.capture_lines(words(spark, docs))).orderBy("row").select("payee", "document", "account", "value", "reference").collect()]
    assert got == [("Hilos y Lanas", "900.123.456", "12 - 34 Ahorros", "C0P $ 7.500,00", "F 77"), ("Sin documento", "", "", "COP 900", "")]


def test_batches(spark):
    row = lambda y, name, doc, value, ref: [(name, 10, 90, y), (doc, 100, 160, y), (value, 190, 240, y), (ref, 300, 350, y)]
    head = [("Nombre del pago", 10, 100, 0), ("Quincena", 10, 60, 20), ("nota", 900, 930, 35)]
    shift = lambda ws, by: [(t, a, b, y + by) for t, a, b, y in ws]
    docs = {
        "late": [*TITLES, *row(30, "Dos", "900.2", "COP $ 2.000,00", "F 22"), *row(60, "Tres", "900.3", "COP $ 3.000,00", "F 33")],
        "first": [*head, *shift(TITLES, 60), *row(90, "Uno", "900.1", "COP $ 1.000,00", "F 11"), *row(120, "Dos", "900.2", "COP $ 2.000,00", "F 22")],
        "blank": [*TITLES, *row(30, "Nadie", ".", "COP $ 0.00.00.0", ".")[:3], *row(60, "Nadie", ".", "COP $ 0.00.00.0", ".")[:3]],
        "empty": [("¿Necesitas ayuda?", 10, 50, 0)],
    }
    captures = spark.createDataFrame([("b1", "late", 0, "l"), ("b1", "first", 1, "f"), ("b2", "blank", 0, "x"), ("b3", "empty", 0, "e"), ("b3", "gone", 1, "g")], "batch string, doc string, arrival int, name string")
    summary, paid = C.batches(captures, words(spark, docs))
    got = [(r["batch"], r["n"], r["payee"], r["value"]) for r in paid.orderBy("batch", "n").collect()]
    assert got == [("b1", 1, "Uno", 1000.0), ("b1", 2, "Dos", 2000.0), ("b1", 3, "Tres", 3000.0), ("b2", 1, "Nadie", None), ("b2", 2, "Nadie", None)]
    s = {r["batch"]: r for r in summary.collect()}
    assert (s["b1"]["payment_name"], s["b1"]["sum"], s["b1"]["captures"], s["b1"]["records"]) == ("Quincena", 6000.0, 2, None)
    assert s["b1"]["warnings"] == ["1 fila(s) venian repetidas en dos capturas y se contaron una sola vez"]
    assert s["b3"]["error"] == "No se pudo leer ninguna de las imagenes" and s["b3"]["warnings"] is None and s["b2"]["error"] is None


def test_pages_stand_below_each_other(spark):
    w = spark.createDataFrame([("d", 2, 1, "b", 0.0, 1.0, 5.0, 15.0), ("d", 1, 1, "a", 0.0, 1.0, 5.0, 15.0), ("d", 3, 1, "c", 0.0, 1.0, 5.0, 15.0), ("e", 1, 1, "x", 0.0, 1.0, 5.0, 15.0)], WORD)
    h = spark.createDataFrame([("d", 1, 100.0), ("d", 2, 50.0), ("d", 3, 70.0)], "doc string, page int, height double")
    assert sorted((r["text"], r["y0"]) for r in C.stacked(w, h).collect()) == [("a", 5.0), ("b", 105.0), ("c", 155.0), ("x", 5.0)]
    assert [r["said"] for r in C.capture_lines(w, h).where("doc = 'd'").orderBy("line_no").collect()] == ["a", "b", "c"]


def test_payee_names_against_a_loop(spark):
    import re

    r = random.Random(9)
    vocab = ["y", "E", "e", "S", "Ñu", "de", "la", "Banco", "cop", "Aceros", "O'Neil", "R&D", "á", "cuenta", "a", "12.5", "Y"]
    texts = [" ".join(r.choices(vocab, k=r.randint(0, 9))) for _ in range(300)] + [None, ""]
    fold = str.maketrans("áéíóúñ", "aeioun")

    def loop(t, noise):
        out = []
        for w in re.findall(r"[A-Za-zÁÉÍÓÚÑáéíóúñ][A-Za-zÁÉÍÓÚÑáéíóúñ&']*", t or ""):
            low = w.lower().translate(fold)
            if low in noise or len(low) == 1 and not (low in "ye" and out):
                continue
            out.append(w)
        while out and out[-1].lower() in "ye":
            out.pop()
        return " ".join(out)

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.payee_name(F.col("t")).alias("a"), X.payee_name(F.col("t"), X.NAME_COLUMN_WORDS).alias("b"))
    for row in df.collect():
        assert row["a"] == loop(row["t"], X.FORM_WORDS) and row["b"] == loop(row["t"], X.NAME_COLUMN_WORDS)
