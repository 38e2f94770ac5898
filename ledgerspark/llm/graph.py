"""Connected components over edge tables of any size, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lean, trimmed, written


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b) of longs -> (node, root): root is the least node reachable. Nodes without edges don't appear.

    Loops, repeated and two-way edges are allowed; null ends are dropped. Each round is checkpointed in the shared
    folder, so that a lost executor costs one round at most. Hubs are aggregated before they are shuffled.
    """
    e = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    e = checkpointed(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u != v").distinct()
        e = checkpointed(small)
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())



#: Keys that a task gathers before it deals them out, and blocks that they are dealt into for each shuffle partition.
GATHERED, BLOCKS = 1_000_000, 4


def _chained(key: np.ndarray, id_: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows by key, in an order that is dealt anew for each key, once each with the bits of all their sides; and which row has the key of the one before it."""
    deal = (key.view(np.uint64) ^ (id_.view(np.uint64) * np.uint64(0x2545F4914F6CDD1D))) * np.uint64(0x9E3779B97F4A7C15)
    deal ^= deal >> np.uint64(29)
    order = np.lexsort((deal, key))
    key, id_, side = key[order], id_[order], side[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (id_[1:] != id_[:-1])
    at = np.flatnonzero(fresh)
    key, id_, side = key[at], id_[at], np.bitwise_or.reduceat(side, at) if len(at) else side
    follows = np.zeros(len(key), bool)
    follows[1:] = key[1:] == key[:-1]
    return key, id_, side, follows


def gathered_keys(source: DataFrame, make: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], gathered: int = GATHERED) -> DataFrame:
    """Keys (arrays of key, id and side, longs and bytes) that make finds in source's batches -> key, id, side and mate of the ids whose key others have, too.

    Sides are bits: a pair under a key counts where one has bit 1 and the other bit 2. A mate is another id of the key (null for the first); mates connect all ids of
    a key, and their order is dealt anew for each key, so that they differ by key. A row may come more than once, with the bits that one place knows of.

    A task puts the keys of many batches in order at once. Ids that share a key there have their mates at once, and one id a key stands for them
    from then on; so a key that all rows have comes to one row a gathering, however crowded it is. What is left is dealt into blocks as packed arrays, a few rows for
    Spark to move, and each block is put in order again. A block's keys are what a task holds.
    """
    blocks = BLOCKS * int(source.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))

    def deal(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, id_, side, follows = _chained(*(np.concatenate(x) for x in zip(*parts)))
        block = (key.view(np.uint64) >> np.uint64(20)) % np.uint64(blocks)
        crowded = follows.copy()
        crowded[:-1] |= follows[1:]
        mate = np.r_[np.zeros(min(1, len(id_)), np.int64), id_[:-1]]
        packs: dict[int, list[bytes]] = {}
        for rows, columns in ((np.flatnonzero(~follows), (key, id_, side)), (np.flatnonzero(crowded), (key, id_, side, mate, follows.view(np.int8)))):
            rows = rows[np.argsort(block[rows], kind="stable")]
            names, first = np.unique(block[rows], return_index=True)
            cuts = np.r_[first, len(rows)]
            sorted_ = [c[rows] for c in columns]
            for k, name in enumerate(names.tolist()):
                lo, hi = int(cuts[k]), int(cuts[k + 1])
                packs.setdefault(name, [b"", b""])[len(columns) > 3] = b"".join(c[lo:hi].tobytes() for c in sorted_)
        names = list(packs)
        for lo in range(0, len(names), 512):
            some = names[lo:lo + 512]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([packs[n][0] for n in some], pa.binary()), pa.array([packs[n][1] for n in some], pa.binary())], names=["block", "ones", "shared"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        parts, n = [], 0
        for batch in batches:
            for found in make(batch):
                parts.append(found)
                n += len(found[0])
                if n >= gathered:
                    yield from deal(parts)
                    parts, n = [], 0
        if n:
            yield from deal(parts)
        parts = []
        trimmed()

    def unpacked(raw: bytes, width: int) -> tuple[np.ndarray, ...]:
        n = len(raw) // width
        longs = 2 if width == 17 else 3
        out = [np.frombuffer(raw, np.int64, n, 0), np.frombuffer(raw, np.int64, n, 8 * n), np.frombuffer(raw, np.int8, n, 16 * n)]
        if longs == 3:
            out += [np.frombuffer(raw[17 * n:25 * n], np.int64), np.frombuffer(raw, np.int8, n, 25 * n)]
        return tuple(out)

    def rows(key, id_, side, mate, linked) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(id_), pa.array(side), pa.array(mate, mask=~linked)], names=["key", "id", "side", "mate"])

    def meet(held: list[bytes]) -> pa.RecordBatch:
        key, id_, side, follows = _chained(*(np.concatenate(x) for x in zip(*(unpacked(r, 17) for r in held))))
        mate = np.r_[np.zeros(min(1, len(id_)), np.int64), id_[:-1]]
        some = follows.copy()
        some[:-1] |= follows[1:]
        at = np.flatnonzero(some)
        return rows(key[at], id_[at], side[at], mate[at], follows[at])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            for name, ones, shared in zip(*(batch.column(c).to_pylist() for c in ("block", "ones", "shared"))):
                if name != block and held:
                    yield meet(held)
                    held = []
                block = name
                held.append(ones)
                if shared:
                    key, id_, side, mate, linked = unpacked(shared, 26)
                    yield rows(key, id_, side, mate, linked.view(bool))
        if held:
            yield meet(held)
        trimmed()

    dealt = source.mapInArrow(gather, "block int, ones binary, shared binary").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(join, "key long, id long, side byte, mate long")


def linked_under_keys(shared: DataFrame, verified: Callable[[DataFrame], DataFrame], marks: DataFrame, may: str = "true", links: DataFrame | None = None) -> DataFrame:
    """Links (a, b) whose components are those of all verified pairs of ids that share a key.

    Pairs within a large group of linked ids are never listed: each id is first verified against one mate under
    each key, and only pairs of different components of these links follow, for keys under which there are any. Their
    number is bounded by group size times ids under the key that are not linked to the group. No link between components
    is lost. ``verified`` keeps of pairs (a, b) those that are linked. marks (id, ...) has columns for the condition
    ``may`` on x and y, which all linked pairs under a key fulfil. links: pairs (a, b) known before, counted as verified.
    """
    met = shared.where("mate IS NOT NULL").select(F.least("id", "mate").alias("a"), F.greatest("id", "mate").alias("b")).distinct()
    found = verified(met)
    found = written(found if links is None else found.unionByName(links), "first-links")
    roots = components(found).withColumnRenamed("node", "id")
    each = shared.groupBy("key", "id").agg(F.bit_or("side").alias("side"))
    told = written(each.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "shared-roots")
    open_keys = told.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    rest = told.join(open_keys, "key", "left_semi").join(marks, "id")
    pairs = rest.alias("x").join(rest.alias("y"), F.expr(f"x.key = y.key AND x.root < y.root AND ((x.side & 1) * (y.side & 2) + (x.side & 2) * (y.side & 1) > 0) AND ({may})"))
    more = verified(pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
    return written(found.unionByName(more), "links")


def with_inner_links(links: DataFrame, shared: DataFrame, verified: Callable[[DataFrame], DataFrame], marks: DataFrame, may: str = "true") -> DataFrame:
    """links of ``linked_under_keys`` and all others: those between ids of one component, which its links needn't name. Arguments as there.

    Pairs of a component that share a key are listed, so their number grows with the square of a group of ids that are near one another, as the links do. They
    are moved in pieces: an id's pairs are a stream of the join, and nothing is gathered for a key or a component.
    """
    roots = components(links).withColumnRenamed("node", "id")
    each = shared.groupBy("key", "id").agg(F.bit_or("side").alias("side"))
    told = written(each.join(roots, "id").join(marks, "id"), "inner-roots")
    pairs = told.alias("x").join(told.alias("y"), F.expr(f"x.key = y.key AND x.root = y.root AND x.id < y.id AND ((x.side & 1) * (y.side & 2) + (x.side & 2) * (y.side & 1) > 0) AND ({may})"))
    rest = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct().join(links, ["a", "b"], "left_anti")
    return written(links.unionByName(verified(rest)).distinct(), "all-links")
