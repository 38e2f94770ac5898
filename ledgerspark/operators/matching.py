"""Joins on near-equal keys, written so that Spark plans equi-joins: ids with or without check digit, numbers with up to two
wrong digits, numbers in authorised ranges, and evidence sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def tax_id_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """left (a_key, a_id), right (b_key, b_id) -> pairs whose ids are equal up to a check digit.

    Each id goes under its digits and under its digits less the last; pairs meet on a key and are checked.
    """
    def keyed(df: DataFrame, c: str) -> DataFrame:
        d = X.digits(F.col(c))
        return df.where(d != "").withColumn("key", F.explode(F.array_distinct(F.array(d, F.substring(d, F.lit(1), F.length(d) - 1))))).where("key <> ''")

    pairs = keyed(left, "a_id").join(keyed(right, "b_id"), "key").where(X.same_tax_id(F.col("a_id"), F.col("b_id")))
    return pairs.select("a_key", "b_key").distinct()


def near_numbers(read: DataFrame, listed: DataFrame, most: int = 2) -> DataFrame:
    """read (doc, batch, number), listed (batch, position, invoice) -> the listed invoice of each document.

    An exact match comes first, in list order; then one of equal length with at most ``most`` other digits. Numbers are cut into
    ``most`` + 1 segments, one of which agrees in any match, and meet on batch, length and segment, so that a large batch isn't compared with itself
    in full; documents without a match keep a null invoice.
    """
    mine, theirs = X.whole_number(F.col("number")), X.whole_number(F.col("invoice"))
    r = read.withColumn("n", mine).withColumn("size", F.length("n"))
    l = listed.withColumn("m", theirs).withColumn("size", F.length("m")).where("m <> ''")
    at = lambda i: F.floor(i * F.col("size") / (most + 1)).cast("int")
    cut = lambda n: F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.substring(n, at(F.lit(i)) + 1, at(F.lit(i + 1)) - at(F.lit(i))).alias("s")) for i in range(most + 1)]))
    cand = r.where("n <> ''").withColumn("part", cut("n")).join(l.withColumn("part", cut("m")), ["batch", "size", "part"]).withColumn("gap", X.differing(F.col("n"), F.col("m"))).where(F.col("gap") <= most)
    best = cand.groupBy("doc").agg(F.min(F.struct((F.col("gap") > 0).alias("inexact"), "position", "invoice", "gap")).alias("best"))
    return read.join(best, "doc", "left").select("doc", "number", F.col("best.invoice").alias("invoice"), F.coalesce(~F.col("best.inexact"), F.lit(False)).alias("exact"), F.coalesce("best.gap", F.lit(-1)).alias("gap"))


def range_join(points: DataFrame, ranges: DataFrame, inclusive: bool = True, own: tuple[str, ...] = ()) -> DataFrame:
    """points (prefix, n), ranges (prefix, low, high) of whole numbers -> points within a range of their prefix.

    own: columns of both (a document) that a range holds for alone. What has them in common is little, so points and ranges meet on them, and neither is repeated. Else a
    range lies in two neighbouring blocks at most of the power of two that is no shorter than itself, however wide it is; points meet it on prefix, power and
    block, and the ends are checked. Points are repeated for the powers that there are ranges of, 63 at most.
    """
    ok = F.col("n").between(F.col("low"), F.col("high")) if inclusive else (F.col("n") > F.col("low")) & (F.col("n") < F.col("high"))
    if own:
        return points.join(ranges.where("low <= high"), [*own, "prefix"]).where(ok)
    power = F.ceil(F.log2((F.col("high") - F.col("low") + 1).cast("double"))).cast("int")
    sized = ranges.where("low <= high").withColumn("power", F.greatest(power, F.lit(0)))
    laid = sized.withColumn("block", F.explode(F.array_distinct(F.array(F.expr("shiftright(CAST(low AS LONG), power)"), F.expr("shiftright(CAST(high AS LONG), power)")))))
    powers = sorted(r[0] for r in sized.select("power").distinct().collect())  # 63 values at most
    if not powers:
        return points.join(ranges, "prefix").where("false")
    met = points.withColumn("power", F.explode(F.array(*map(F.lit, powers)))).withColumn("block", F.expr("shiftright(CAST(n AS LONG), power)"))
    return met.join(laid, ["prefix", "power", "block"]).where(ok).drop("power", "block")


def party_pairs(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left (a, on...) and right (b, on...) -> distinct pairs of names that are the same party: they meet on a telling word that they share."""
    worded = lambda df, c: df.withColumn("word", F.explode(X.name_words(F.col(c))))
    met = worded(left, "a").join(worded(right, "b"), [*on, "word"]).select(*on, "a", "b").distinct()
    return met.where(X.same_party(F.col("a"), F.col("b")))


def party_verdicts(left: DataFrame, right: DataFrame, on: str, parts: int = 32) -> DataFrame:
    """left (a, on) and right (b, on) -> a, b and same (whether the names are the same party) of all pairs that share on.

    Words of a name are told once, not for each of its pairs, and so are bits of them: names without a common bit share no word. A value of on may have many rows, so the right rows of each are dealt
    into parts by their name and the left ones go to all of them. Pairs are many more than rows, so both sides are dealt over all tasks, however few files hold them and however small
    they are, and neither is broadcast.
    """
    spark = left.sparkSession
    tasks = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) // 4)
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))
    bits = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda m, w: m.bitwiseOR(bit(w)))
    worded = lambda df, c, words, mask: df.select(on, c, X.name_words(F.col(c)).alias(words)).withColumn(mask, bits(F.col(words)))
    l = worded(left, "a", "x", "p").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    r = worded(right, "b", "y", "q").withColumn("part", F.pmod(F.xxhash64("b"), F.lit(parts)).cast("int"))
    met = l.repartition(tasks, on, "part").join(r.repartition(tasks, on, "part").hint("merge"), [on, "part"])
    return met.select("a", "b", F.when(F.col("p").bitwiseAND(F.col("q")) == 0, False).otherwise(X.shares_words(F.col("x"), F.col("y"))).alias("same"))


def best_evidence(evidence: DataFrame, least: int = 2) -> DataFrame:
    """evidence (doc, candidate, points, position) -> the candidate with most points, the earliest of equals, if it has enough."""
    sums = evidence.groupBy("doc", "candidate").agg(F.sum("points").alias("points"), F.min("position").alias("position"))
    top = sums.groupBy("doc").agg(F.max_by(F.struct("candidate", "points"), F.struct("points", -F.col("position"), F.col("candidate"))).alias("t"))
    return top.select("doc", F.when(F.col("t.points") >= least, F.col("t.candidate")).otherwise("").alias("candidate"), F.col("t.points").alias("points"))
