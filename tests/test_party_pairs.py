"""All pairs of names of a group: dealt over all tasks, with the verdict of the plain function."""

import random

from pyspark.sql import functions as F

from ledgerspark.functions import text as X
from ledgerspark.operators import matching as M


def _names(spark, column, seed):
    r = random.Random(seed)
    words = [f"W{i:03}" for i in range(150)] + ["SAS", "DE", "ÑANDÚ", "y"]
    rows = [(r.choice([1, 1, 1, 2, None]), " ".join(r.choices(words, k=r.randint(0, 5))) if r.random() < 0.95 else None) for _ in range(120)]
    return spark.createDataFrame(rows, f"n int, {column} string")


def test_verdicts_are_those_of_the_plain_function(spark):
    a, b = _names(spark, "a", 1), _names(spark, "b", 2)
    want = a.join(b, "n").select("a", "b", X.same_party(F.col("a"), F.col("b")).alias("same")).collect()
    got = M.party_verdicts(a, b, "n").collect()
    assert {r.same for r in want} == {True, False} and sorted(map(str, got)) == sorted(map(str, want))


def test_small_tables_are_not_one_task(spark, tmp_path):
    """Pairs of two small files were made by the one task that read the larger one."""
    for c in ("a", "b"):
        _names(spark, c, 3).coalesce(1).write.parquet(f"{tmp_path}/{c}")
    pairs = M.party_verdicts(spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/b"), "n")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("REPARTITION_BY_NUM") >= 2
    assert pairs.select(F.spark_partition_id().alias("p")).distinct().count() > 2
