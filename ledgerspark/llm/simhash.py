"""SimHash near-duplicates found with BK-trees.

Texts get 64-bit fingerprints of their word shingles. Equal fingerprints are one class. Classes are dealt into
shards by pigeonhole: of ``blocks`` bit blocks, ``blocks - radius`` agree in any linked pair, so each class goes to
one shard for each choice of that many blocks (more blocks for larger tables, so that shards stay small). A task
builds a BK-tree for each of its shards: children are keyed by their integer distance to the parent, and a search
follows only the edges within the radius of the query's own distance. Each shard gives a spanning forest of its
links, never all pairs, and components join the forests.

The trees together grow with the corpus, so each is built where its shard lies instead of being broadcast. A tree search
visits a growing share of a crowded shard's nodes, so a shard of over ``max_shard`` classes never becomes one tree: its classes are linked through their one-bit neighbours
(two fingerprints differ in at most two bits exactly if they share such a neighbour), 65 rows a class, all exact.

Defined results: null or blank texts have fingerprint 0 and link like any other; fewer words than a shingle are one
shingle; a component's id is its smallest doc_id; null doc_ids join components but never name one unless no other
does; repeated rows are rows of one class; other columns of the input are dropped by ``near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import log2

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, written
from .graph import components

SEED = 42
#: Classes of a shard up to which it is a BK-tree.
MAX_SHARD = 2048
#: Rows over this share of all make a fingerprint hot; there are at most as many hot ones.
HOT_SHARE = 1000


def codes_of(text: str | None, shingle: int) -> np.ndarray:
    """The 64-bit hash of each word shingle, in the order of the text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "<u8")
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]][:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1:] - 1).tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(line[a:b], SEED) for a, b in zip(starts, stops)), "<u8", n)


def print_of(codes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(codes), 1 << 14):
        ones += np.unpackbits(codes[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(codes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int) -> int:
    return print_of(codes_of(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long)."""
    return mapped(docs, "text", ["doc_id"], [T.StructField("fp", T.LongType())], lambda texts: [np.fromiter((fingerprint(t, shingle) for t in texts), "u8", len(texts)).view("i8")])


class BKTree:
    """Distinct fingerprints; each child hangs on the edge of its distance to the parent."""

    def __init__(self) -> None:
        self.codes: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, code: int) -> int:
        """The node of code, new or found."""
        me = len(self.codes)
        at = 0
        while me:
            d = (self.codes[at] ^ code).bit_count()
            if d == 0:
                return at
            if d not in self.edges[at]:
                self.edges[at][d] = me
                break
            at = self.edges[at][d]
        self.codes.append(code)
        self.edges.append({})
        return me

    def within(self, code: int, radius: int) -> list[int]:
        found, stack = [], [0] if self.codes else []
        while stack:
            at = stack.pop()
            d = (self.codes[at] ^ code).bit_count()
            if d <= radius:
                found.append(at)
            for k, child in self.edges[at].items():
                if abs(k - d) <= radius:
                    stack.append(child)
        return found


def forest(codes: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges that join the codes linked within the radius: a spanning forest, built along the tree's searches."""
    tree, root, out = BKTree(), [], []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for code in codes:
        near = tree.within(code, radius)
        me = tree.add(code)
        if me == len(root):
            root.append(me)
        for other in near:
            a, b = top(me), top(other)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((code, tree.codes[other]))
    return out


def _masks(blocks: int, radius: int) -> list[int]:
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def blocks_for(rows: int, radius: int) -> int:
    """The fewest blocks with which random shards hold about one class."""
    blocks = radius + 1
    while 64 * (blocks - radius) // blocks < log2(max(rows, 2)) - 1 and blocks < radius + 6:
        blocks += 1
    return blocks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(classes: DataFrame, *, radius: int = 2, max_shard: int = MAX_SHARD, blocks: int | None = None) -> DataFrame:
    """classes (fp, distinct) -> edges (a, b) whose components are those of all pairs within the radius."""
    if not 1 <= radius <= 2:
        raise ValueError("the radius is 1 or 2")
    masks = _masks(blocks or blocks_for(classes.count(), radius), radius)
    keyed = classes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("k", "key"))
    counted = keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k", "key"))).where("n > 1")

    def trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, codes = None, []
        out: list[tuple[int, int]] = []
        for batch in batches:  # rows of a shard follow each other
            for k, key, fp in zip(batch["k"].tolist(), batch["key"].tolist(), batch["fp"].tolist()):
                if (k, key) != at:
                    out += forest(codes, radius)
                    at, codes = (k, key), []
                codes.append(fp & (1 << 64) - 1)
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        yield _edges(out + forest(codes, radius))

    cold = counted.where(F.col("n") <= max_shard).select("k", "key", "fp").mapInPandas(trees, "a long, b long")
    hot = counted.where(F.col("n") > max_shard).select("fp").distinct()
    flips = hot.select("fp", F.expr("explode(transform(sequence(-1, 63), i -> CASE WHEN i < 0 THEN fp ELSE fp ^ shiftleft(1L, i) END))").alias("mid"))
    if radius == 2:
        heads = flips.groupBy("mid").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
        exact = flips.join(heads, "mid").where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b").distinct()
    else:
        exact = flips.join(hot.select(F.col("fp").alias("mid")), "mid").where(F.col("fp") != F.col("mid")).select(F.col("fp").alias("a"), F.col("mid").alias("b"))
    return cold.unionByName(exact)


def _edges(pairs: list[tuple[int, int]]) -> pd.DataFrame:
    a = np.array(pairs, "u8").reshape(-1, 2).view("i8")
    return pd.DataFrame({"a": a[:, 0], "b": a[:, 1]})


def near_duplicates(docs: DataFrame, *, shingle: int = 3, radius: int = 2, max_shard: int = MAX_SHARD) -> DataFrame:
    """doc_id, fp, fingerprint (hex) and component_id of each row."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(links(classes.select("fp"), radius=radius, max_shard=max_shard))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    # hot fingerprints (equal texts, the empty one) are few by their bound, and are joined by broadcast
    total = prints.count()
    hot = F.broadcast(prints.groupBy("fp").count().where(F.col("count") > total // HOT_SHARE + 1000).select("fp").join(named, "fp"))
    joined = prints.join(hot.select("fp"), "fp", "left_anti").join(named, "fp").unionByName(prints.join(hot, "fp"))
    return joined.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
