"""Captures read as documents: the same as the functions over lines, without moving words or lines."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerspark import catalog
from ledgerspark.functions import text as X
from ledgerspark.operators import capture_documents as R
from ledgerspark.operators import captures as C

WORD = "doc string, page int, word_no int, text string, x0 double, x1 double, y0 double, y1 double"
SAID = [
    "Destinatario", "Va1or", "Valor", "Referencla", "tipo de documento", "Documento", "Transacci0n", "Registros agregados", "Registros", "agregados", "Mostrando 1-4 de 12 pagos", "Mostrando  1-2 de x pagos", "COP $ 1.000,00", "C0P 77", "12.345,6", "900.123.456",
    "900.123.456\n", "47 - 11", "Hilos y", "Lanas", "R&D", "F 1234", "Nombre del pago", "Producto a debltar", "Fecha de", "aplicación", "Cambiar", "¿Necesitas ayuda?", " ", None, "a  b", "Cantidad de reglstros :", "Numero", "#", "no", "ÁÉÑ ünd", "Otra columna"]


def _documents(spark, n=250):
    r = random.Random(11)
    rows = []
    for d in range(n):
        titled, wide = r.random() < 0.6, r.random() < 0.3
        words = [(t, x, x + 60.0, y) for t, x, y in [("Destinatario", 0.0, 40.0), ("Documento", 100.0, 40.0), ("Valor", 200.0, 41.0), (r.choice(["Referencia", "Valor", "Otra columna"]), 300.0, 40.0)]] if titled else []
        words += [(r.choice(r.choice([SAID, ["COP $ 1.000,00", "12.345,6", "900.123.456"]])), x, x + r.choice([20.0, 60.0, 90.0 if wide else 30.0]), float(r.randrange(r.choice([0, 56, 56, 56]), 200, 8))) for x in (float(r.randrange(0, 400, 20)) for _ in range(r.choice([0, 3, 12, 40])))]
        if r.random() < 0.2:
            words = [(t, r.choice([x, None]), x1, r.choice([y, y, None])) for t, x, x1, y in words]
        rows += [(f"d{d}", r.choice([1, 1, 2]), r.randint(0, 60), t, x, x1, y, None if y is None else y + r.choice([10.0, 14.0])) for t, x, x1, y in words]
    heights = [(f"d{d}", page, 90.0) for d in range(0, n, 3) for page in (1, 2)]
    return spark.createDataFrame(rows, WORD), spark.createDataFrame(heights, "doc string, page int, height double")


def _plain(rows):
    return sorted(map(str, rows))


def test_documents_are_read_as_lines_are(spark):
    words, heights = _documents(spark)
    words.cache()
    lines = C.capture_lines(words, heights).cache()
    read = R.read_captures(R.documents_of(words, heights)).cache()
    assert _plain(tuple(r) for r in read.where("lines > 0").select("doc", *[f"head.{f}" for f in C.LABELS.values()], "declared").collect()) == _plain(tuple(r) for r in C.capture_heads(lines).collect())
    marks = C.table_marks(lines).cache()
    columns = [(r.doc, r.column, r.field, r.low, r.high) for r in C.title_columns(lines, marks).collect()]
    assert _plain((r.doc, r.k + 1, *r.c) for r in read.select("doc", F.posexplode("columns").alias("k", "c")).collect()) == _plain(columns)
    fields = ["doc", "row", *C.FIELDS, "said"]
    got = R.rows_of(read, "doc").where("row IS NOT NULL").select(*fields).collect()
    assert len(got) > 200 and {r.doc for r in got} & {r[0] for r in columns} and {r.doc for r in got} - {r[0] for r in columns}
    assert _plain(map(tuple, got)) == _plain(tuple(r) for r in C.capture_rows(lines).select(*fields).collect())


def test_texts_fold_as_columns_do(spark):
    letters = [chr(i) for i in range(1, 0x2000) if i not in (0x1C89, 0x1C8A)]  # these are too new for Java
    texts = [c + "x" for c in letters]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_replace(X.fold(F.col("t")), r"\s+", " ").alias("f"), X.tolerant(F.col("t")).alias("l")).collect()
    odd = [r.t for r in rows if R._folded(r.t) != r.f or R._liked(r.t.lower().translate(R._FOLD)) != r.l]
    assert not odd, odd


@pytest.mark.parametrize("name,most", [("filas_con_titulos", 1), ("lote_registros", 2), ("lote_banco", 2)])
def test_words_of_captures_are_not_moved(spark, name, most, tmp_path):
    """Orders come together as numbers and read payments by batch; words and lines are neither shuffled nor written."""
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    df = catalog.queries()[name](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert 0 < len(moved) <= most and "capture-lines" not in plan, moved
