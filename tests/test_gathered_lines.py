"""Lines gathered by one stream: the same as numbering words and grouping them, with one shuffle."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerspark.operators import captures as C
from ledgerspark.operators import layout as L

WORD = "doc string, page int, word_no int, text string, x0 double, x1 double, y0 double, y1 double"


def _words(spark):
    r = random.Random(5)
    odd = lambda x: r.choice([x] * 9 + [None])
    rows = []
    for d in range(12):
        for i in range(r.choice([1, 2, 9, 40])):
            x, y = float(r.randrange(0, 200, 10)), float(r.randrange(0, 60, 4))
            rows.append((f"d{d}", r.randint(1, 2), i, f"w{i}", r.choice([x] * 9 + [None, float("nan")]), x + 5, odd(y), odd(y + 10)))
    return spark.createDataFrame(rows, WORD).repartition(5)


def test_gathered_lines_are_grouped_visual_lines(spark):
    words = _words(spark)
    order = Window.partitionBy("doc").orderBy("page", "word_no")
    lined = L.visual_lines(words.withColumn("word_no", F.row_number().over(order)).withColumn("page", F.lit(0)))
    word = F.struct("x0", "word_no", "x1", "y0", "y1", "text")
    expected = lined.groupBy("doc", "line_no").agg(F.sort_array(F.collect_list(word)).alias("ws"), F.min("y0").alias("y0"), F.max("y1").alias("y1")).orderBy("doc", "line_no").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = L.gathered_lines(words).orderBy("doc", "line_no").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert str([tuple(r) for r in got]) == str([tuple(r) for r in expected])


def test_words_of_captures_are_shuffled_once(spark):
    plan = C.capture_lines(_words(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
