"""Sharding by Hilbert-curve order, so that shards prune on several metadata columns at once.

Source and language are quantised by the order of their distinct values, spread over all levels so that each dimension
cuts as deep as the others, the size by its logarithm; a Hilbert index over these levels orders the rows and equal runs are cut as shards. Law ``rows``: shard counts differ by one at
most. No global sort and no hot task: curve cells are counted, cells are split into hash buckets, and a row's rank
is the sum of the rows in cells before, buckets before and rows before in its bucket.

Defined results: null text has size 8 and crc 0; null source or language have a level of their own, the lowest; ties on the curve go by id
hash, id and crc; repeated rows take slots of their own; an empty table gives an empty result; other columns are
dropped, so that names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 6
BUCKETS = 16
#: Doublings of the size, from 8 bytes, that the levels tell apart.
OCTAVES = 20


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of points given as integer columns (rows x dims), by undoing the curve's rotations bit by bit."""
    x = axes.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[:, i] & q) != 0
            x[hit, 0] ^= p
            swap = np.where(hit, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= swap
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[:, i] >> b) & 1)
    return out


def hilbert(cols: list[Column], bits: int) -> Column:
    @F.pandas_udf("long")
    def index(points: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(points.to_numpy(), bits), dtype="int64")

    return index(F.struct(*[c.cast("int").alias(f"d{i}") for i, c in enumerate(cols)]))


def level_bounds(df: DataFrame, column: str, levels: int) -> list[str]:
    """At most levels - 2 values of a text column that cut its distinct values into nearly even runs; no task sees them all."""
    kinds = df.where(F.col(column).isNotNull()).select(column).distinct()
    runs = kinds.repartitionByRange(levels - 1, column).groupBy(F.spark_partition_id().alias("p")).agg(F.max(column).alias("last"))
    return sorted(r["last"] for r in runs.collect())[:-1]


def level(column: Column, bounds: list, levels: int) -> Column:
    """Levels spread over the whole range, whatever the number of distinct values; null has the lowest for itself."""
    place = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<string>"), lambda b: column > b)) + 1
    return F.floor(F.when(column.isNull(), 0).otherwise(place) * levels / (len(bounds) + 2)).cast("int")


def hilbert_shards(docs: DataFrame, *, shards: int = 24, bits: int = BITS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, source, lang, curve, shard and slot of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "source", "lang")
    levels = 1 << bits
    n = docs.count()
    octave = F.floor(F.log2(F.col("size") / 8) * levels / OCTAVES)
    dims = [level(F.col("source"), level_bounds(rows, "source", levels), levels), level(F.col("lang"), level_bounds(rows, "lang", levels), levels), F.least(octave, F.lit(levels - 1))]
    rows = rows.withColumn("curve", hilbert(dims, bits)).withColumn("h", F.xxhash64("doc_id"))
    parts = buckets * max(1, n // 50_000_000)
    rows = rows.withColumn("b", F.pmod("h", F.lit(parts)))
    counts = rows.groupBy("curve", "b").agg(F.count(F.lit(1)).alias("c"))
    cells = counts.groupBy("curve").agg(F.sum("c").alias("cc"))
    before = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("curve", F.coalesce(F.sum("cc").over(before), F.lit(0)).alias("cell_start"))
    within = Window.partitionBy("curve").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("in_cell", F.coalesce(F.sum("c").over(within), F.lit(0))).join(cells, "curve").select("curve", "b", (F.col("in_cell") + F.col("cell_start")).alias("start"))
    mine = Window.partitionBy("curve", "b").orderBy("h", "doc_id", "text_crc32")
    ranked = rows.join(starts, ["curve", "b"]).withColumn("rank", F.col("start") + F.row_number().over(mine) - 1)
    shard = F.expr(f"CAST((rank * {shards}L) DIV {max(n, 1)}L AS INT)")
    first = F.expr(f"(shard * {n}L + {shards - 1}L) DIV {shards}L")
    return ranked.withColumn("shard", shard).withColumn("slot", (F.col("rank") - first).cast("long")).select("doc_id", "size", "text_crc32", "source", "lang", "curve", "shard", "slot")
