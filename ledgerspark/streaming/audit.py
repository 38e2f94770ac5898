"""Audit events and login lockout as streams: appended files are read as they come, late rows wait for a watermark."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
FAILURES, BLOCK_MS = 5, 5 * 60 * 1000
#: The setting that a stream of lockouts needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def event_stream(spark: SparkSession, folder: str, schema: str = EVENTS, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by window and type; a window closes once the watermark has passed it."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")


class Locks(StatefulProcessor):
    """State of one user: attempts that wait for the watermark, the failures in a row so far, and the end of the lock.

    Attempts are counted in order of time once the watermark has passed them, whatever batch they came in; later ones were dropped by then.
    A user without failures since the last success, whose lock is over, has no state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, place long, ok boolean")
        self.count = handle.getValueState("count", "failures int, until long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(int(at.timestamp() * 1000), int(place), bool(ok)) for batch in rows for at, place, ok in zip(batch["at"], batch["place"], batch["ok"])]
        if new:
            self.waiting.appendList(new)
            for ms in {x[0] for x in new}:
                self.handle.registerTimer(ms + 1)
        yield pd.DataFrame(columns=["user_id", "locked_at", "until"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs()
        waiting = sorted(tuple(x) for x in self.waiting.get())
        due, rest = [x for x in waiting if x[0] < passed], [x for x in waiting if x[0] >= passed]
        failures, until = self.count.get() if self.count.exists() else (0, 0)
        locks = []
        for ms, _, ok in due:
            if ms < until:
                continue
            failures = 0 if ok else failures + 1
            if failures == FAILURES:
                failures, until = 0, ms + BLOCK_MS
                locks.append((key[0], pd.Timestamp(ms, unit="ms"), pd.Timestamp(until, unit="ms")))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if failures or until > passed:
            self.count.update((failures, until))
            if not failures:
                self.handle.registerTimer(until)  # nothing is left to know by then
        else:
            self.count.clear()
        yield pd.DataFrame(locks, columns=["user_id", "locked_at", "until"])

    def close(self) -> None:
        pass


def lockouts(logins: DataFrame, late: str = "10 minutes") -> DataFrame:
    """logins (user_id, at, place, ok) -> a row for each lock: five failures in a row lock an account for five minutes.

    A success or a lock sets the count back; attempts during a lock don't count. Attempts may come out of order by as much as ``late``: an event-time timer counts
    each when the watermark has passed it, so that a stream gives the locks of the whole table. The stream needs the RocksDB state store (``STATE_STORE``).
    """
    timed = logins.select("user_id", F.col("at").cast("timestamp").alias("at"), "place", F.coalesce("ok", F.lit(False)).alias("ok")).where("at IS NOT NULL").withWatermark("at", late)
    return timed.groupBy("user_id").transformWithStateInPandas(Locks(), "user_id long, locked_at timestamp, until timestamp", "append", "EventTime")
