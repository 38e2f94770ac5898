"""Ranked lexical search over a clustered index whose documents are ordered by recursive graph bisection.

Index. Bisection splits documents into halves so that each term's postings gather in one of them: swaps go on while they lower the
estimated bits of the postings' gaps, and both halves are split again. It is run on a sample of ``SAMPLE`` documents, the
least by hash, whole texts, and leaves 2^``LEVELS`` clusters in tree order; every document of the table then goes down the tree by the same cost, each time to the
half that takes its terms with fewer bits. Clusters are cut into shards of about ``SHARD`` documents (or ``SHARD_BYTES`` of terms), so that a crowded one,
such as copies of one text, is spread. A shard holds a list of its documents and a row for each term: slots, impacts and the best impact.
All rows with a term are indexed; a text without one can't be found.

Search. A shard's bound for an item is the sum of weight times best impact over the item's terms. Items visit their shards in
order of the bounds, in growing rounds, and stop exactly: a shard is left out only if its bound lies under the score of the item's
last document so far (an equal bound is visited, as ties go to the smaller doc_id). Within a shard scores are added up by slots, which are mapped back
to doc_ids before ties are broken. Items are dealt in blocks of ``ITEMS``, so that none of the tasks holds all of them.

Scores are those of the contract, in 64-bit integers; the weight's logarithm is in doubles.

Defined results: null texts have no terms; rows that share a doc_id are documents of their own; a null doc_id comes after all others in a tie; rows of
items that share an item_id (or have none) are one item with the terms of all; items without a term in any document have no
rows; empty tables give none; other columns are dropped.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, written

#: Documents that the bisection is fitted on, its levels and the most rounds of swaps at each.
SAMPLE, LEVELS, SWAPS = 4096, 6, 12
#: About how many documents, and bytes of their terms, a shard has.
SHARD, SHARD_BYTES = 2048, 8_000_000
#: Items that are searched together in a shard, and shards that an item visits in the first round (four times as many in each that follows).
ITEMS, FIRST = 2000, 4
#: Rows of distinct query terms up to which they are broadcast; beyond, both sides are shuffled.
BROADCAST = 100_000
TOP = 50

# Fixed by the contract: a term is a maximal run of other bytes than these, A-Z lower-cased (all of UTF-8 beyond ASCII belongs to terms).
_SPLIT = bytearray(range(256))
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _SPLIT[_lo:_hi + 1] = b" " * (_hi + 1 - _lo)
_SPLIT[65:91] = bytes(range(97, 123))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(bytes(_SPLIT)).split()


def bits(d: np.ndarray, n: int) -> np.ndarray:
    """Estimated bits of the gaps of terms with d postings among n documents."""
    return d * np.log2(max(n, 1) / (d + 1.0))


@dataclass
class Tree:
    """terms: number of a term in the sample; lean: for each of them and each inner node (heap order) the bits that the left half costs more than the right."""

    levels: int
    terms: dict[bytes, int]
    lean: np.ndarray

    def leaf(self, terms: list[bytes]) -> int:
        """The leaf for a document with these different terms, from the left."""
        if not self.levels:
            return 0
        ids = [i for i in map(self.terms.get, terms) if i is not None]
        lean = self.lean[ids].sum(axis=0)
        node = 0
        for _ in range(self.levels):
            node = 2 * node + (2 if lean[node] > 0 else 1)
        return node - (1 << self.levels) + 1


def halves(terms: np.ndarray, owner: np.ndarray, n: int, swaps: int = SWAPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Splits n documents, given as pairs of term and document: the side of each document, and postings of each term left and right."""
    side = np.arange(n) >= (n + 1) // 2
    kinds = int(terms.max()) + 1 if len(terms) else 0
    for k in range(swaps + 1):
        right = np.bincount(terms[side[owner]], minlength=kinds)
        left = np.bincount(terms, minlength=kinds) - right
        n_left, n_right = n - int(side.sum()), int(side.sum())
        now = bits(left, n_left) + bits(right, n_right)
        if k == swaps:
            break
        to_right = now - bits(np.maximum(left - 1, 0), n_left) - bits(right + 1, n_right)
        to_left = now - bits(left + 1, n_left) - bits(np.maximum(right - 1, 0), n_right)
        gain = np.bincount(owner, np.where(side[owner], to_left[terms], to_right[terms]), n)
        a, b = np.flatnonzero(~side), np.flatnonzero(side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        pays = gain[a[:m]] + gain[b[:m]] > 1e-9
        m = int(pays.argmin()) if not pays.all() else m
        if not m:
            break
        side[a[:m]], side[b[:m]] = True, False
    return side, left, right


def bisected(docs: list[list[bytes]], levels: int = LEVELS) -> Tree:
    """The tree of a sample, given as the different terms of each document. Terms of one document tell nothing."""
    seen = Counter(t for d in docs for t in d)
    number = {t: i for i, t in enumerate(sorted((t for t, n in seen.items() if n > 1), key=lambda t: (seen[t], t)))}  # rarest first
    while levels and len(docs) < 4 << levels:  # a leaf has four documents of the sample at least
        levels -= 1
    lean = np.zeros((len(number), (1 << levels) - 1), np.float32)
    ids = [np.array([number[t] for t in d if t in number], np.int64) for d in docs]
    # similar texts begin near each other: by their rarest shared term
    first = [min(x.tolist(), default=0) for x in ids]
    nodes = [sorted(range(len(docs)), key=first.__getitem__)]
    for node in range((1 << levels) - 1):
        own = nodes[node]
        sizes = np.array([len(ids[d]) for d in own])
        terms = np.concatenate([ids[d] for d in own])
        kinds, local = np.unique(terms, return_inverse=True)
        side, left, right = halves(local, np.repeat(np.arange(len(own)), sizes), len(own))
        n = len(own) / 2
        lean[kinds, node] = (bits(left + 1, n) - bits(left, n)) - (bits(right + 1, n) - bits(right, n))
        nodes += [[d for d, s in zip(own, side) if not s], [d for d, s in zip(own, side) if s]]
    return Tree(levels, number, lean)


def vectors(docs: DataFrame, tree: Tree) -> DataFrame:
    """doc_id, leaf, n (terms with repeats), terms (different ones, a space between) and tf (32-bit integers) of the rows with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(tree)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for part in slices(whole, "text", 4_000_000):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    count = Counter(terms_of(text))
                    if count:
                        rows.append((doc, own.leaf(list(count)), count.total(), b" ".join(count), np.fromiter(count.values(), "<i4", len(count)).tobytes()))
                cols = list(zip(*rows)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "leaf", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, leaf int, n long, terms binary, tf binary")


INDEX = "shard int, term binary, df long, best long, slots binary, impacts binary, ids array<long>"


def postings(group: pa.Table, documents: int, total: int) -> pa.Table:
    """A shard's rows of the index; the row without a term lists its documents. documents: N of the contract, total: L."""
    group = group.sort_by([("leaf", "ascending"), ("doc_id", "ascending")])
    n = group.column("n").to_numpy()
    m = 50 + 50 * n * documents // total
    tf = np.frombuffer(b"".join(group.column("tf").to_pylist()), "<i4").astype(np.int64)
    lists = group.column("terms").to_pylist()
    coded = pa.array(b" ".join(lists).split(b" "), pa.binary()).dictionary_encode()
    codes = coded.indices.to_numpy()
    slot = np.repeat(np.arange(len(n)), [x.count(b" ") + 1 for x in lists])
    impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[slot])
    order = np.argsort(codes, kind="stable")
    df = np.bincount(codes, minlength=len(coded.dictionary))
    starts = np.r_[0, np.cumsum(df)]
    best = np.maximum.reduceat(impact[order], starts[:-1])
    by_name = pc.array_sort_indices(coded.dictionary)
    at = by_name.to_numpy()

    def cells(values: np.ndarray, kind: str) -> pa.Array:
        raw = np.ascontiguousarray(values[order], kind)
        offsets = (starts * raw.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(df), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).take(by_name)

    shard, rows = group.column("shard")[0].as_py(), len(df)
    head = [[shard], [None], [len(n)], [0], [None], [None], [group.column("doc_id").to_pylist()]]
    kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    body = [pa.array(np.full(rows, shard, np.int32)), coded.dictionary.take(by_name), pa.array(df[at]), pa.array(best[at]), cells(slot, "<u2" if len(n) <= 1 << 16 else "<u4"), cells(impact, "<i4"), pa.nulls(rows, kinds[-1])]
    return pa.table([pa.chunked_array([pa.array(h, k), b]) for h, b, k in zip(head, body, kinds)], names=["shard", "term", "df", "best", "slots", "impacts", "ids"])


@dataclass
class Index:
    """rows: a table in the shared folder (see ``INDEX``); documents with a term, and their terms with repeats."""

    rows: DataFrame
    documents: int
    total: int
    shards: int


def sampled(docs: DataFrame, size: int = SAMPLE) -> list[list[bytes]]:
    """The different terms of each document of the sample."""
    texts = docs.where(F.col("text").isNotNull())
    # only about as many rows as are wanted are put in order, whatever the number of tasks
    least = F.lit(-2.0**63 + 2.0**64 * min(1.0, 1.2 * size / max(1, texts.count())))
    drawn = texts.select("text", F.xxhash64("text", "doc_id").alias("draw")).where(F.col("draw").cast("double") <= least)
    some = drawn.orderBy("draw").limit(size).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b" ".join(sorted(set(terms_of(t)))) for t in batch.column("text").to_pylist()], pa.binary())], names=["terms"])

    return [bytes(r["terms"]).split() for r in some.mapInArrow(run, "terms binary").collect()]  # size rows


def build_index(docs: DataFrame, *, sample: int = SAMPLE, levels: int = LEVELS, shard: int = SHARD) -> Index | None:
    """An index of all rows of docs (doc_id, text); None if there is no term."""
    rows = written(vectors(docs, bisected(sampled(docs, sample), levels)), "term-vectors")
    sizes = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"), F.sum(F.length("terms")).alias("bytes")).collect()  # a row for each leaf
    if not sizes:
        return None
    documents, total = sum(r["docs"] for r in sizes), sum(r["n"] for r in sizes)
    parts = {r["leaf"]: max(1, math.ceil(r["docs"] / shard), math.ceil(r["bytes"] / SHARD_BYTES)) for r in sizes}
    first, shards = {}, 0
    for leaf in sorted(parts):
        first[leaf], shards = shards, shards + parts[leaf]
    of = lambda d: F.element_at(F.array(*[F.lit(d.get(k, 0)) for k in range(max(d) + 1)]), F.col("leaf") + 1)
    dealt = rows.withColumn("shard", (of(first) + F.pmod(F.xxhash64(F.monotonically_increasing_id()), of(parts))).cast("int"))
    index = dealt.groupBy("shard").applyInArrow(lambda g: postings(g, documents, total), INDEX)
    return Index(written(index, "index"), documents, total, shards)


def query_terms(items: DataFrame) -> DataFrame:
    """item (a number), item_id and terms (different ones) of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])

    each = items.select("item_id", "text").mapInArrow(run, items.select("item_id").schema.add("terms", T.ArrayType(T.BinaryType())))
    grouped = each.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).where(F.size("terms") > 0)
    return written(grouped.withColumn("item", F.monotonically_increasing_id()), "items")


def search(index: Index | None, items: DataFrame, *, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best documents of each item (item_id, text)."""
    spark = items.sparkSession
    asked = query_terms(items)
    n_items = asked.count()
    if index is None or not n_items:
        return items.select("item_id").where("false").select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    pairs = asked.select("item", F.explode("terms").alias("term"))
    kinds = pairs.select("term").distinct()
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST else df
    held = written(index.rows.where("term IS NOT NULL").drop("ids").join(small(kinds, kinds.count()), "term"), "postings")
    weight = F.floor(1000 * F.log((2.0 * index.documents + 2) / (2.0 * F.col("df") + 1)))
    weights = held.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.cast("long").alias("w")).where("w > 0")
    weighted = written(pairs.join(weights, "term"), "weights")
    # what each shard can give an item at most, best first
    bounds = held.select("shard", "term", "best").join(small(weighted, weighted.count()), "term").groupBy("item", "shard").agg(F.sum(F.col("w") * F.col("best")).alias("bound")).where("bound > 0")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "shard")
    bounds = written(bounds.withColumn("turn", F.row_number().over(order)), "bounds")
    packed = weighted.groupBy("item").agg(F.collect_list(F.struct("term", "w")).alias("query"))
    blocks = math.ceil(n_items / ITEMS)
    found, last, size = None, 0, FIRST
    while last < index.shards:
        ahead = bounds.where((F.col("turn") > last) & (F.col("turn") <= last + size))
        if found is not None:
            # the score of an item's last document, if it has all of them
            bar = found.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).where(F.col("n") == top)
            ahead = ahead.join(bar, "item", "left").where("low IS NULL OR bound >= low").select("item", "shard")
        ahead = written(ahead.select("item", "shard", F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")), "visits")
        if not ahead.head(1):
            break  # bounds only fall from here on
        new = visited(index.rows, held, ahead.join(packed, "item"), blocks, top)
        new = new if found is None else new.unionByName(found)
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = written(new.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).drop("rank"), "found")
        last, size = last + size, size * 4
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best))
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def visited(rows: DataFrame, held: DataFrame, visits: DataFrame, blocks: int, top: int) -> DataFrame:
    """item, doc_id and score of the best documents of each visit (item, shard, block, query)."""
    shards = visits.select("shard", "block").distinct()
    heads = rows.where("term IS NULL").select("shard", F.lit(None).cast("binary").alias("term"), F.lit(None).cast("binary").alias("slots"), F.lit(None).cast("binary").alias("impacts"), "ids")
    lists = held.select("shard", "term", "slots", "impacts", F.lit(None).cast("array<long>").alias("ids")).unionByName(heads).join(shards, "shard")

    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        by_term = {}
        ids: list = []
        for term, slots, impacts, some in zip(*(index.column(c).to_pylist() for c in ("term", "slots", "impacts", "ids"))):
            if term is None:
                ids = some
            else:
                by_term[term] = slots, np.frombuffer(impacts, "<i4")
        known = np.array([i is not None for i in ids], bool)
        number = np.array([i or 0 for i in ids], np.int64)
        for item, query in zip(asked.column("item").to_pylist(), asked.column("query").to_pylist()):
            total = np.zeros(len(ids), np.int64)
            for q in query:
                if q["term"] in by_term:
                    slots, impacts = by_term[q["term"]]
                    total[np.frombuffer(slots, f"<u{len(slots) // len(impacts)}")] += q["w"] * impacts.astype(np.int64)
            at = np.flatnonzero(total)
            if len(at) > top:
                at = at[total[at] >= np.partition(total[at], len(at) - top)[len(at) - top]]
            at = at[np.lexsort((number[at], ~known[at], -total[at]))][:top]
            out[0] += [item] * len(at)
            out[1] += [ids[i] for i in at]
            out[2] += total[at].tolist()
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["item", "doc_id", "score"])

    asked = visits.select(F.col("shard").alias("at"), F.col("block").alias("part"), "item", "query")
    return lists.groupBy("shard", "block").cogroup(asked.groupBy("at", "part")).applyInArrow(run, "item long, doc_id long, score long")


SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS d, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents
), lengths AS (
  SELECT d, doc_id, len(ts)::BIGINT AS n FROM texts WHERE len(ts) > 0
), totals AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM lengths
), tfs AS (
  SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(ts) AS term FROM texts) GROUP BY d, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, totals GROUP BY term, docs
), queries AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), scored AS (
  SELECT item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM queries JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (d), totals GROUP BY item_id, d, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, d))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= 50
"""
