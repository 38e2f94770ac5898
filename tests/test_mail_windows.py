"""Candidates of mails: lines are shuffled once, reaches of headers and parties, and what is left over."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.operators import candidates as C

SCHEMA = "doc string, page int, line_no int, line string"


def test_lines_of_mails_are_shuffled_once(spark):
    lines = spark.range(50).select(F.col("id").cast("string").alias("doc"), F.lit(1).alias("page"), F.lit(0).alias("line_no"), F.lit("Aprobada por $ 1.500.000").alias("line"))
    plan = C.chosen(C.with_invoices(C.listed(C.candidates(lines))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_header_counts_nineteen_lines_above_and_a_party_seven(spark):
    rows = [("a", 1, 0, "Desde: Eva"), ("a", 1, 1, "Aprobadas:"), ("a", 1, 2, "HILOS DEL RIO")] + [("a", 1, 3 + i, f"cosa por $ 1.{100 + i}.000") for i in range(20)]
    told = {r.line_no: (r.header, r.party) for r in C.candidates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {n for n, (h, _) in told.items() if h} == set(range(3, 21)) and {n for n, (_, p) in told.items() if p} == set(range(3, 10))


def test_unchosen_amounts_are_the_discarded_ones(spark):
    rows = [("a", 1, 0, "Aprobada por $ 1.500.000 y $ 2.500.000"), ("a", 1, 1, "saldo de $ 900.000"), ("a", 1, 2, "solicito su aprobación por $ 2.500.000"), ("b", 1, 0, "solicito su aprobación por $ 700.000"), ("b", 1, 1, "presupuesto $ 800.000")]
    found = C.candidates(spark.createDataFrame(rows, SCHEMA))
    want = sorted(map(tuple, C.discarded(found, C.chosen(found)).collect()), key=str)
    assert want and sorted(map(tuple, C.unchosen(found).select("doc", "rank", "value", "kind", "reason").collect()), key=str) == want
