"""Title lines of captures: look-alikes of a line fall together once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.functions import text as X
from ledgerspark.operators import captures as C


def _lines(spark, texts):
    rows = [("a", i, [(0.0, 1, 9.0, 10.0 * i, 10.0 * i + 8, t)], 10.0 * i, 10.0 * i + 8) for i, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, "doc string, line_no int, ws array<struct<x0: double, word_no: int, x1: double, y0: double, y1: double, text: string>>, y0 double, y1 double")
    return lines.withColumn("said", X.normalise(C.joined(F.col("ws"))))


def test_marks_of_misread_titles(spark):
    read = lambda texts: tuple(C.table_marks(_lines(spark, texts)).first())[1:]
    assert read(["Pago", "Registros agregados", "Va1or De5tinatario", "Referencla 12", "nada"]) == (1, 2, 3)
    assert read(["Valor Destinatario Tipo", "Registros agregados", "Valor 123 Destinatario Tipo", "Destinatario"]) == (1, None, None)
    assert read(["Valor Tipo", "otra", "Destinatario"]) == (0, None, None)


def test_texts_are_folded_once_for_ten_titles(spark):
    plan = C.table_marks(_lines(spark, ["Valor"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(translate(lower(") <= 2 and "exists(" not in plan


def test_buttons_of_the_screen(spark):
    said = ["Cambiar", "¿Necesitas ayuda?", "AYUDA ?", "Cambiar cuenta", "necesitas", "ayudas", "no necesitas  ayuda hoy", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in said], "t string").select(X.screen_noise(F.col("t"))).collect()]
    assert got == [True, True, True, False, True, False, True, None]
