"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a hash of their id. A document's virtual finish time is the cumulative
size of its source up to it, with half its own size, divided by the source's target (the half centres the error
that whole documents leave: each source ends within half a document of its target); later passes over the source (at most
``max_repeats`` in all) add the source's whole size. All (document, pass) pairs are taken in order of finish
time until the total budget is used up.

Hot sources never meet in one task: running sums come from hash buckets (a few thousand rows each) whose totals
are summed first, and the cut is found from counted slices of finish time, of which one is ordered.

Defined results: null texts have size 0; the null source is a source of its own, last in order; documents of size
0 are never taken; equal finish times go by source order, document hash, id, then pass; repeated rows are separate rows. An
empty table gives an empty result. Of extra columns those named in ``keep`` are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, word_count, written

#: Rows that one hash bucket of a source, or one slice of finish time, holds at most on average.
ROWS_PER_BUCKET = 500
#: Most buckets of a source: their totals are summed in one task, a few MB; beyond it buckets hold more rows.
MAX_BUCKETS = 1 << 17


def targets(sizes: DataFrame, weights: list[int], max_repeats: int) -> DataFrame:
    """One row per source: ``place``, ``weight``, ``source_size``, ``target``.

    Targets share the total size by weight; a source stops at max_repeats times its size and the excess goes to
    the others by weight. With sources sorted by cap over weight, those that stop are a prefix; its end is where
    the share per weight of what is left first stays under the next cap. Rows here are sources, not documents.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") % len(weights)) + 1).cast("int"))
    one = sizes.withColumn("place", (F.row_number().over(everything) - 1).cast("long")).withColumn("weight", w.cast("long"))
    by_cap = Window.orderBy((F.col("source_size") * max_repeats / F.col("weight")).asc(), F.col("place").asc())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    one = (
        one.withColumn("_cap", F.col("source_size") * max_repeats)
        .withColumn("_total", F.sum("source_size").over(whole))
        .withColumn("_left_w", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_per", F.col("_left") / F.col("_left_w"))
        .withColumn("_open", F.col("_per") * F.col("weight") <= F.col("_cap"))
    )
    level = F.max(F.when(F.col("_open"), F.struct((-F.col("_cap") / F.col("weight")).alias("a"), (-F.col("place")).alias("b"), F.col("_per").alias("per")))).over(whole)
    share = F.coalesce(level["per"] * F.col("weight"), F.col("_cap").cast("double"))
    return one.withColumn("target", F.least(share, F.col("_cap").cast("double"))).select("source", "place", "weight", "source_size", "target")


def mix(docs: DataFrame, *, weights: list[int] = (1, 2, 3), max_repeats: int = 3, seed: str = "mix", rows_per_bucket: int = ROWS_PER_BUCKET, keep: list[str] = ()) -> DataFrame:
    """Rows of docs (doc_id, source, text and the columns to keep) with size, source_size, target, passes (times taken), taken and first_time.

    first_time is the virtual finish time of the first pass: the order of the mix.
    """
    weights = list(weights)
    n = docs.count()
    buckets = min(MAX_BUCKETS, max(1, -(-n // rows_per_bucket)))
    kept = [F.col(f"`{c}`").alias(f"keep.{c}") for c in keep]  # names with a dot clash with none of ours
    carried = [F.col(f"`keep.{c}`") for c in keep]
    named = [F.col(f"`keep.{c}`").alias(c) for c in keep]
    base = docs.select("doc_id", "source", *kept, word_count(F.col("text")).alias("size"), F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h"))
    base = base.withColumn("b", (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("int"))
    base = written(base, "mix-sizes")  # texts are counted once
    sums = base.groupBy("source", "b").agg(F.sum("size").alias("bs"))
    goal = targets(sums.groupBy("source").agg(F.sum("bs").alias("source_size")), weights, max_repeats)
    ahead = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sums.withColumn("start", F.coalesce(F.sum("bs").over(ahead), F.lit(0))).alias("s")
        .join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")))
        .select(F.col("s.source").alias("source"), "b", "start", "place", "source_size", "target")
    )
    inside = Window.partitionBy("d.source", "d.b").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        base.alias("d").join(starts.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.b") == F.col("t.b")))
        .withColumn("upto", F.sum("size").over(inside) + F.col("start"))
        .select("doc_id", F.col("d.source").alias("source"), *carried, "size", "source_size", "target", "upto", "place", "h")
    )
    placed = placed.withColumn("times", F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda k: (F.col("upto") - F.col("size") / 2 + k * F.col("source_size")) / F.col("target")))
    # Slices of finish time: the budget ends in one of them, and only that one is ordered.
    slices = 4 * buckets
    cap = 2 * slices
    slice_of = lambda t: F.least(F.floor(t * slices), F.lit(cap)).cast("long")
    flat = placed.where(F.col("size") > 0).select("size", F.explode("times").alias("time")).groupBy(slice_of(F.col("time")).alias("sl")).agg(F.sum("size").alias("ss"))
    running = Window.orderBy("sl").rowsBetween(Window.unboundedPreceding, 0)
    if n == 0:
        return placed.select("doc_id", "source", *named, "size", "source_size", "target", F.lit(0).alias("passes"), F.lit(0).cast("long").alias("taken"), F.lit(None).cast("double").alias("first_time"))
    cut = (
        flat.withColumn("upto", F.sum("ss").over(running)).crossJoin(F.broadcast(goal.agg(F.sum("source_size").alias("budget"))))
        .where(F.col("upto") >= F.col("budget")).agg(F.min_by(F.struct("sl", (F.col("budget") - F.col("upto") + F.col("ss")).alias("left")), "sl").alias("c")).first()["c"]
    )
    cut_slice, left = (cap + 1, 0) if cut is None else (cut["sl"], cut["left"])
    edge = (
        placed.where(F.col("size") > 0)
        .select("place", "h", "doc_id", "size", F.posexplode("times").alias("k", "time"))
        .where(slice_of(F.col("time")) == cut_slice)
    )
    order = Window.orderBy("time", "place", "h", "doc_id", "k").rowsBetween(Window.unboundedPreceding, 0)
    last = edge.withColumn("upto", F.sum("size").over(order)).where(F.col("upto") <= left).agg(F.max(F.struct("time", "place", "h", "doc_id", "k")).alias("m")).first()["m"]
    def taken(k, t):
        sure = slice_of(t) < cut_slice
        if last is None:
            return sure
        key = F.struct(t.alias("time"), F.col("place").alias("place"), F.col("h").alias("h"), F.col("doc_id").alias("doc_id"), k.cast("int").alias("k"))
        end = F.struct(F.lit(last["time"]).alias("time"), F.lit(last["place"]).cast("long").alias("place"), F.lit(last["h"]).alias("h"), F.lit(last["doc_id"]).cast("long").alias("doc_id"), F.lit(last["k"]).cast("int").alias("k"))
        return sure | ((slice_of(t) == cut_slice) & (key <= end))
    passes = F.size(F.filter(F.transform("times", lambda t, k: taken(k, t)), lambda x: x))
    out = placed.withColumn("passes", F.when(F.col("size") > 0, passes).otherwise(0))
    return out.select("doc_id", "source", *named, "size", "source_size", "target", "passes", (F.col("passes") * F.col("size")).cast("long").alias("taken"), F.col("times")[0].alias("first_time"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; all columns pass, whatever their names.

    Rows get a number and are written once; the mix is made of numbers, ids, sources and sizes, so that texts are shuffled once.
    """
    row = free_name(docs, "_row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    plain = rows.select("doc_id", "source", "text", F.col(row).alias("row"))
    taken = mix(plain, keep=["row"], **options).where("passes > 0").select(F.col("row").alias(row), F.explode(F.sequence(F.lit(1), F.col("passes"))).alias(free_name(rows, "_pass")))
    return rows.join(taken, row).select(*[F.col(f"`{c}`") for c in docs.columns])


#: The mix of the ``documents`` table with the default parameters, in DuckDB's SQL.
SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
 w AS (SELECT *, [1, 2, 3][place % 3 + 1] AS weight, 3 * source_size AS cap FROM p),
 l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS per FROM w WINDOW b AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 v AS (SELECT arg_min(per, {'a': cap / weight, 'b': place}) AS level FROM l WHERE per * weight <= cap),
 g AS (SELECT source, place, source_size, least(coalesce(level * weight, cap), cap) AS target FROM l, v),
 r AS (SELECT doc_id, size, h, place, source_size, target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
 x AS (SELECT *, (upto - size / 2 + k * source_size) / target AS t FROM r, (VALUES (0), (1), (2)) k(k) WHERE size > 0),
 c AS (SELECT *, sum(size) OVER (ORDER BY t, place, h, doc_id, k ROWS UNBOUNDED PRECEDING) AS upto_all FROM x),
 a AS (SELECT doc_id, count(*) AS n FROM c WHERE upto_all <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, CAST(coalesce(n, 0) * size AS BIGINT) AS taken, CAST(coalesce(n, 0) AS INTEGER) AS passes FROM r LEFT JOIN a USING (doc_id)
"""
