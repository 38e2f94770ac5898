"""Quantities under a title: a document's words are shuffled once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.operators import layout as L


def test_words_of_a_page_are_shuffled_once(spark):
    at = lambda text, x, y: F.struct(F.lit(text).alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(x + 20)).alias("x1"), F.lit(float(y)).alias("y0"), F.lit(float(y + 10)).alias("y1"))
    words = spark.range(6).select(F.col("id").cast("string").alias("doc"), F.lit(1).alias("page"), F.posexplode(F.array(at("Cantidad", 200, 10), at("TUBO", 10, 40), at("7", 205, 40), at("9", 205, 400))).alias("word_no", "w")).select("doc", "page", "word_no", "w.*")
    pages = spark.range(6).select(F.col("id").cast("string").alias("doc"), F.lit(1).alias("page"), F.lit(300.0).alias("height"))
    out = L.column_quantity(words, pages)
    assert {tuple(r) for r in out.collect()} == {(str(i), "Cantidad", 7.0, 1) for i in range(6)}
    assert L.column_quantity(words, pages)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
