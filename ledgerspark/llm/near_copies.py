"""Near-copies by shingle similarity: SimHash BK-tree links, completed by a banded MinHash join with exact verification.

Texts are sets of word shingles (64-bit hashes); two are linked when their Jaccard similarity is at least 4/5. SimHash alone does
not reach that: such pairs differ in up to 14 bits. Rows with equal sets are one class, and classes whose fingerprints lie within
two bits are found by the BK-trees of ``simhash``. For the others each class gets ``BANDS`` keys of ``ROWS`` MinHash values each: a pair
with similarity s shares none of them with probability (1 - s^ROWS)^BANDS, under one in 10^9 at 0.8. Pairs from
either way count when their shingle sets, compared in full, are similar enough. Pairs inside large groups of near-copies are never
listed (``graph.linked_under_keys``).

Defined results: null or blank texts have an empty set and are copies of each other; fewer words than a shingle are one
shingle; a component's first row is that of the smallest doc_id, rows without one last; shingle hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filtered, free_name, id_filter, mapped, written
from .graph import components, gathered_keys, linked_under_keys
from .simhash import codes_of, links, print_of

BANDS, ROWS = 30, 3
#: 64-bit words of a sketch.
SKETCH = 16


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Distinct shingle hashes as signed longs, in order."""
    return np.unique(codes_of(text, shingle).view("i8"))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(11)
    n = BANDS * ROWS
    return r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)


BY, PLUS = _multipliers()


def band_keys(kinds: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of 64-bit hashes; the band's number is part of a key."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    codes = kinds.view(np.uint64)
    codes = codes ^ (codes >> np.uint64(32))
    for lo in range(0, len(codes), 512):
        np.minimum(least, (codes[lo:lo + 512, None] * BY + PLUS).min(axis=0), out=least)
    mixed = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        mixed = (mixed ^ row) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def sketch(kinds: np.ndarray) -> np.ndarray:
    """SKETCH longs: parities of the hashes' remainders. Two sets differ in no fewer hashes than their sketches in bits."""
    odd = np.bincount(kinds.view(np.uint64) % np.uint64(64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def with_features(docs: DataFrame, shingle: int, row: str, near: str) -> DataFrame:
    """docs with a row number and a struct: set hash h, SimHash fp, set size n and MinHash keys."""
    kinds = T.StructType([T.StructField(k, T.LongType()) for k in ("h", "fp", "n")] + [T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(texts: list) -> list:
        h, fp, n, keys = [], [], [], []
        for t in texts:
            codes = codes_of(t, shingle)
            kind = np.unique(codes.view("i8"))
            h.append(np.uint64(xxhash.xxh64_intdigest(kind.tobytes())).view("i8").item())
            fp.append(np.uint64(print_of(codes)).view("i8").item())
            n.append(len(kind))
            keys.append(band_keys(kind) if len(kind) else np.zeros(0, np.int64))
        return [pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (h, fp, n)] + [pa.array(keys, pa.list_(pa.int64()))], names=["h", "fp", "n", "keys"])]

    return mapped(docs, "text", docs.columns, [T.StructField(near, kinds)], run, limit=1_000_000).withColumn(row, F.monotonically_increasing_id())


def similar_links(rows: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """rows (id, fp, n, keys), one for each set, and texts (id, text) of these and other ids -> (node, root) of the components of all similar pairs."""
    def make(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        keys = batch.column("keys")
        key = keys.flatten().to_numpy()
        yield key, np.repeat(batch.column("id").to_numpy(), pc.list_value_length(keys).to_numpy()), np.full(len(key), 3, np.int8)

    shared = written(gathered_keys(rows.select("id", "keys"), make), "shingle-keys")
    heads = rows.groupBy("fp").agg(F.min("id").alias("head"))
    near = links(heads.select("fp")).join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    # equal fingerprints: each against the first of them
    same = rows.select("fp", F.col("id").alias("b")).join(heads, "fp").where("b <> head").select(F.col("head").alias("a"), "b")
    printed = written(near.unionByName(same).distinct(), "print-links")
    some = written(shared.select("id").unionByName(printed.select(F.explode(F.array("a", "b")).alias("id"))).distinct(), "shingle-ids")
    fields = [T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("n", T.LongType())] + [T.StructField(f"s{i}", T.LongType()) for i in range(SKETCH)]

    def sets_of(ts: list) -> list:
        codes = [shingle_set(t, shingle) for t in ts]
        return [codes, [len(c) for c in codes], *np.array([sketch(c) for c in codes]).T]

    wanted = filtered(texts, "id", id_filter(some))
    sets = written(mapped(wanted, "text", ["id"], fields, sets_of).join(some, "id", "left_semi"), "shingle-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("id").alias("a"), F.col("codes").alias("x"))
        right = sets.select(F.col("id").alias("b"), F.col("codes").alias("y"))
        return pairs.join(left, "a").join(right, "b").where("9 * size(array_intersect(x, y)) >= 4 * (size(x) + size(y))").select("a", "b")

    apart = " + ".join(f"bit_count(x.s{i} ^ y.s{i})" for i in range(SKETCH))
    return components(linked_under_keys(shared, verified, sets.drop("codes"), f"5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n) AND 9 * ({apart}) <= x.n + y.n", verified(printed)))


def without_near_copies(docs: DataFrame, *, shingle: int = 5) -> DataFrame:
    """docs with the first row of each component of near-copies; other rows of it go."""
    row, near = free_name(docs, "_row"), free_name(docs, "_near")
    rows = written(with_features(docs, shingle, row, near), "shingles")
    part = lambda k: F.col(f"{near}.{k}").alias(k)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col(row).alias("row"))
    classes = written(rows.select(part("h"), F.col(row).alias("id"), order.alias("first")).groupBy("h").agg(F.min("id").alias("id"), F.min("first").alias("first")), "shingle-classes")
    one = written(rows.select(F.col(row).alias("id"), part("fp"), part("n"), part("keys")).join(classes.select("id"), "id", "left_semi").where("n > 0"), "shingle-heads")
    roots = similar_links(one, rows.select(F.col(row).alias("id"), "text"), shingle).withColumnRenamed("node", "id")
    named = classes.join(roots, "id", "left").select(F.coalesce("root", "id").alias("root"), "first")
    stay = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    gone = written(rows.select(row).join(stay, row, "left_anti"), "near-copies")
    # only rows that pass a filter over the rows that go are joined with them; the texts of the others aren't shuffled
    shared, whole = id_filter(gone, row), rows.drop(near)
    out = filtered(whole, row, shared, hit=False).unionByName(filtered(whole, row, shared).join(gone, row, "left_anti"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
