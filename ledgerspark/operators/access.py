"""Locked accounts in a table of login attempts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FAILURES, MINUTES = 5, 5


def lockouts(attempts: DataFrame, failures: int = FAILURES, minutes: int = MINUTES) -> DataFrame:
    """attempts (user_id, at, place, ok) -> a row for each lock: user_id, locked_at, until.

    Failures in a row lock an account for some minutes; a success or a lock sets the count back and nothing counts during a lock.
    Only runs that are long enough to lock reach Python, sorted by user and time and read as a stream: a user of any
    size takes one row of memory. place tells attempts of one time apart; rows without a time don't count; a null ok is a failure.
    """
    w = Window.partitionBy("user_id").orderBy("at", "place")
    fails = ~F.coalesce("ok", F.lit(False))
    timed = attempts.where("at IS NOT NULL").withColumns({"fails": fails, "run": F.sum((~fails).cast("int")).over(w)}).where("fails")
    long_runs = timed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id", "run"))).where(F.col("n") >= failures)
    rows = long_runs.select("user_id", "run", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), "place")
    span = minutes * 60_000_000

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user = run = None
        count, until = 0, None
        for batch in batches:
            locks = []
            for who, which, us in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if who != user:
                    user, until = who, None
                    run = None
                if which != run:
                    run, count = which, 0
                if until is not None and us < until:
                    continue
                count += 1
                if count == failures:
                    count, until = 0, us + span
                    locks.append((who, us, until))
            yield pa.RecordBatch.from_arrays([pa.array([l[i] for l in locks], t) for i, t in enumerate((batch.schema.field(0).type, pa.int64(), pa.int64()))], ["user_id", "us", "end"])

    kind = attempts.schema["user_id"].dataType.simpleString()
    found = rows.repartition("user_id").sortWithinPartitions("user_id", "us", "place").mapInArrow(step, f"user_id {kind}, us long, end long")
    return found.select("user_id", F.timestamp_micros("us").alias("locked_at"), F.timestamp_micros("end").alias("until"))
