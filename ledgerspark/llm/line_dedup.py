"""Line dedup by a segment-partition edit join.

Lines with a word are classed by their hash. Edits are counted in characters for lines under ``LONG`` words, and in words
for pairs with a longer line, where one replaced word alone would be too many characters. A pair takes the tolerance t of
its longer line: in characters ``min(2, n // 10)``, in words ``min(3, n // 16)``. The shorter line is split into t + 1 even
segments, one of which must occur unchanged in the longer line, at a place shifted by at most the edits left over.
Segments are indexed by (unit, tolerance, length, segment number, content) and probed with the substrings that the longer
line can hold there. Keys are 64-bit hashes, cut out of running polynomial hashes in numpy, so a segment's cost doesn't grow with
its length. Candidates are verified by a banded bit-parallel edit distance over characters or words.

Near-copies in a group of any size are linked through one mate under each key, and only lines of different components
that share a key are compared in full (``graph.linked_under_keys``): work grows with the group, not with its square. Where links are
counted, the other pairs of a component follow (``graph.with_inner_links``), whose number is that of the near pairs.
Linked lines form classes; the first occurrence of a class, by doc_id and line number, stays.

Defined results: lines without a word are never counted, linked or dropped; null texts have no lines; lines under 10
characters are equal or different; lines with the same words are linked from ``LONG`` words on, whatever the white space; an occurrence
without doc_id is first only when no other exists; rows that share doc_id, line number and line share decisions (as wholly
repeated rows do: each keeps a first occurrence), other rows of the doc_id don't; ties go to the smaller line number. n_links counts all
lines within the limits of a line. Line hashes have 64 bits: two different lines in
10^9 collide with probability 3 %.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, id_filter, mapped, passes, released, slices, trimmed, written
from .graph import components, gathered_keys, linked_under_keys, with_inner_links

#: Words from which a line's edits are counted in words.
LONG = 32
#: Most edits, and units for each edit, by unit.
CHARS, WORDS = (2, 10), (3, 16)
#: Different words that characters can stand for.
NAMED = 1_000_000
#: Occurrences over this share of all make a line hot; there are at most as many hot lines.
HOT_SHARE = 1000

def edit_distance(a: str | list, b: str | list, most: int) -> int:
    """Edit distance of strings or lists if at most ``most``, else most + 1. A band of 2 * most + 1 rows slides along the diagonal in one integer."""
    lo, hi = 0, min(len(a), len(b))
    if abs(len(a) - len(b)) > most:
        return most + 1
    while lo < hi:  # common prefix by halving
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    a, b = a[lo:], b[lo:]
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[len(a) - mid:] == b[len(b) - mid:] else (lo, mid - 1)
    a, b = a[:len(a) - lo], b[:len(b) - lo]
    if not a or not b:
        return max(len(a), len(b))
    if most == 0:
        return 1
    m, n, k = len(a), len(b), most
    places: dict[object, int] = defaultdict(int)
    for i, ch in enumerate(a):
        places[ch] |= 1 << i
    band = 2 * k + 1
    full, bottom = (1 << band) - 1, 1 << 2 * k
    up, down, score = full & ~((1 << k) - 1), 0, min(k, m)
    for j in range(1, n + 1):
        shift = j - k - 1  # the band's lowest bit is row j - k, character j - k - 1
        match = places.get(b[j - 1], 0)
        match = (match >> shift if shift >= 0 else match << -shift) & full
        same = ((((match & up) + up) ^ up) | match | down) & full
        grow, fall = (down | ~(same | up)) & full, same & up
        if j + k <= m:
            score += not same & bottom
        else:
            row = 1 << (m - j + k)
            score += bool(grow & row) - bool(fall & row)
        up, down = (fall | ~((same >> 1) | grow)) & full, (same >> 1) & grow
        if score > most + n - max(j, m - k):
            return most + 1
    return min(score, most + 1)


def tolerance(n: int, unit: tuple[int, int]) -> int:
    return min(unit[0], n // unit[1])


def near(a: str, b: str, *, chars: tuple[int, int] = CHARS, words: tuple[int, int] = WORDS, long: int = LONG) -> bool:
    """Whether two lines are linked."""
    x, y = a.encode("utf-8", "surrogatepass").split(), b.encode("utf-8", "surrogatepass").split()
    n = max(len(x), len(y))
    if n < long:
        most = tolerance(max(len(a), len(b)), chars)
        return edit_distance(a, b, most) <= most
    most = tolerance(n, words)
    if abs(len(x) - len(y)) > most:
        return False
    ids: dict[bytes, int] = {}
    for w in (*x, *y):
        ids.setdefault(w, len(ids))
    if len(ids) > NAMED:  # more different words than there are characters to name them: the words themselves are compared
        return edit_distance(x, y, most) <= most
    one = lambda ws: "".join([chr(0x10000 + ids[w]) for w in ws])
    return edit_distance(one(x), one(y), most) <= most


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit integers spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running(symbols: np.ndarray) -> np.ndarray:
    return np.r_[np.zeros(1, np.uint64), np.cumsum(symbols * powers(len(symbols) + 1)[0][:len(symbols)], dtype=np.uint64)]


def cut(run: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the symbols from lo to hi, wherever they stand."""
    return (run[hi] - run[lo]) * powers(len(run))[1][lo]


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def segment_keys(run: np.ndarray, start: np.ndarray, size: np.ndarray, limits: tuple[int, int], unit: int, probes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(key, row, side) of the lines given by start and size in a running hash; probes: which lines may be the longer one."""
    most, per = limits
    own = np.minimum(most, size // per)
    widest = np.minimum(most, (size + most) // per)

    def keys(rows: np.ndarray, t: int, n: np.ndarray, i: int, shift: int) -> np.ndarray:
        lo, hi = i * n // (t + 1), (i + 1) * n // (t + 1)
        at = start[rows] + lo + shift
        tag = ((n.astype(np.uint64) * np.uint64(8) + np.uint64(t)) * np.uint64(8) + np.uint64(i)) * np.uint64(2) + np.uint64(unit)
        return mixed(cut(run, at, at + hi - lo) + mixed(tag))

    for t in range(1, most + 1):
        longer = np.flatnonzero((own == t) & probes)
        index = np.flatnonzero((own <= t) & (t <= widest) & ~((own == t) & probes))
        for i in range(t + 1):
            yield keys(index, t, size[index], i, 0), index, 1
            yield keys(longer, t, size[longer], i, 0), longer, 3
            for d in range(t + 1):
                n = size[longer] - d
                for s in range(max(-i, d - t + i), min(i, d + t - i) + 1):
                    if d or s:
                        lo, hi = i * n // (t + 1) + s, (i + 1) * n // (t + 1) + s
                        ok = (n > 0) & (lo >= 0) & (hi <= size[longer])
                        yield keys(longer[ok], t, n[ok], i, s), longer[ok], 2


def line_keys(lines: list[str], *, chars: tuple[int, int] = CHARS, words: tuple[int, int] = WORDS, long: int = LONG) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, line hashes and sides of a list of lines with a word each."""
    coded = [x.encode("utf-8", "surrogatepass") for x in lines]
    h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in coded), np.uint64, len(coded)).view(np.int64)
    text = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    space = IS_SPACE[text]
    first = np.flatnonzero(~space & np.r_[True, space[:-1]])
    after = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    run = running(text.astype(np.uint64) + np.uint64(1))
    word_run = running(mixed(cut(run, first, after)))
    ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) + 1)
    bound = np.searchsorted(first, np.r_[0, ends])
    start, count = bound[:-1], np.diff(bound)
    some = np.flatnonzero(count >= long - words[0])
    found = [(k, some[row], side) for k, row, side in segment_keys(word_run, start[some], count[some], words, 1, count[some] >= long)]
    short = np.flatnonzero(count < long)
    points = np.frombuffer("".join([lines[i] for i in short]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter((len(lines[i]) for i in short), np.int64, len(short))
    found += [(k, short[row], side) for k, row, side in segment_keys(running(mixed(points + np.uint64(1))), np.cumsum(size) - size, size, chars, 0, np.ones(len(short), bool))]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)
    rows = np.concatenate([r for _, r, _ in found])
    return np.concatenate([k for k, _, _ in found]).view(np.int64), h[rows], np.repeat(np.array([s for *_, s in found], np.int8), [len(r) for _, r, _ in found])


def words_lines(text: str | None) -> list[str]:
    """The lines of a text that have a word."""
    return [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]


def lines_of(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, line_no (from 0), line and its hash h, for lines with a word; and the columns to keep."""
    return (
        docs.select("doc_id", *keep, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("h", F.xxhash64("line"))
    )


def shared_lines(docs: DataFrame) -> DataFrame:
    """key, id (line hash), side and mate of lines that share a key with another one; within a slice of texts each different line counts once."""

    def make(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for part in slices(batch, "text", 500_000):
            yield line_keys(list({x: None for t in part.column("text").to_pylist() for x in words_lines(t)}))

    return gathered_keys(docs.select("text"), make)


def wanted_lines(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and line of the lines whose hashes are in ids (id). A filter of fixed size spares the others the shuffle."""
    shared = id_filter(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", 500_000):
                lines = list({x: None for t in part.column("text").to_pylist() for x in words_lines(t)})
                h = np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42) for x in lines), np.uint64, len(lines)).view(np.int64)
                hit = np.flatnonzero(passes(shared.value, h))
                yield pa.RecordBatch.from_arrays([pa.array(h[hit]), pa.array([lines[i] for i in hit], pa.string())], names=["id", "line"])
        trimmed()

    found = docs.select("text").mapInArrow(run, "id long, line string")
    return found.join(ids, "id", "left_semi").groupBy("id").agg(F.min("line").alias("line"))


def edit_links(docs: DataFrame, every: bool = False) -> DataFrame:
    """Verified links (a, b) between different lines (by hash), whose components are those of all pairs within the limits; with every all those pairs."""
    shared = written(shared_lines(docs), "line-keys")
    released(docs.sparkSession)  # the shuffle of all keys is the largest; what is left of it is written
    fields = [T.StructField(c, T.LongType()) for c in SKETCH]
    texts = written(mapped(wanted_lines(docs, shared.select("id").distinct()), "line", ["id", "line"], fields, sketches), "key-lines")

    def verified(pairs: DataFrame) -> DataFrame:
        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = pa.array([near(x, y) for x, y in zip(batch.column("line_a").to_pylist(), batch.column("line_b").to_pylist())], pa.bool_())
                yield batch.filter(ok).select(["a", "b"])
            trimmed()

        both = pairs.join(texts.alias("x"), F.col("a") == F.col("x.id")).join(texts.alias("y"), (F.col("b") == F.col("y.id")) & F.expr(may_link()))
        return both.select("a", "b", F.col("x.line").alias("line_a"), F.col("y.line").alias("line_b")).mapInArrow(check, "a long, b long")

    marks = texts.drop("line")
    links = linked_under_keys(shared, verified, marks, may_link())
    return with_inner_links(links, shared, verified, marks, may_link()) if every else links


#: Longs of parities of single symbols and of pairs of neighbours: with fewer, lines just beyond the limits look like lines within them.
SINGLE, PAIRED = 2, 4
#: What a line shows of itself: characters and words, and the parities of its single ones and of its pairs of neighbours.
SKETCH = ["n_chars", "n_words", *[f"{unit}_{what}{k}" for unit in ("chars", "words") for what, n in (("one", SINGLE), ("two", PAIRED)) for k in range(n)]]


def may_link() -> str:
    """A condition on the sketches of x and y that all linked lines fulfil.

    Within t edits, d of which are a difference in length at least, a replaced symbol flips two parities of symbols and four of pairs, any other edit one and three.
    """
    def within(unit: str, limits: tuple[int, int]) -> str:
        t, d = f"least({limits[0]}, greatest(x.n_{unit}, y.n_{unit}) div {limits[1]})", f"abs(x.n_{unit} - y.n_{unit})"
        one, two = (" + ".join(f"bit_count(x.{c} ^ y.{c})" for c in SKETCH if c.startswith(f"{unit}_{what}")) for what in ("one", "two"))
        return f"({d} <= {t} AND {one} <= 2 * {t} - {d} AND {two} <= 4 * {t} - {d})"

    long = f"greatest(x.n_words, y.n_words) >= {LONG}"
    return f"CASE WHEN {long} THEN {within('words', WORDS)} ELSE {within('chars', CHARS)} END"


def parities(symbols: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each stretch of symbols (none is empty) SINGLE and PAIRED longs: whether symbols, and pairs of neighbours, with each hash modulo their bits occur an odd number of times."""
    last = np.zeros(len(symbols), bool)
    last[np.r_[starts[1:], len(symbols)] - 1] = True  # has no neighbour in its line
    out = []
    for hashes, longs, none in ((mixed(symbols), SINGLE, None), (mixed(symbols * np.uint64(BASE) + np.r_[symbols[1:], symbols[:1]]), PAIRED, last)):
        bit, part = np.uint64(1) << (hashes & np.uint64(63)), (hashes >> np.uint64(6)) % np.uint64(longs)
        if none is not None:
            bit[none] = 0
        out += [np.bitwise_xor.reduceat(np.where(part == k, bit, np.uint64(0)), starts).view(np.int64) for k in range(longs)]
    return out


def sketches(lines: list[str]) -> list:
    """SKETCH of lines with a word each. Lines that are no part of a pair which counts words have no parities of words."""
    if not lines:
        return [[] for _ in SKETCH]
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    split = [x.encode("utf-8", "surrogatepass").split() for x in lines]
    count = np.fromiter(map(len, split), np.int64, len(lines))
    some = np.flatnonzero(count >= LONG - WORDS[0])
    words = np.zeros((SINGLE + PAIRED, len(lines)), np.int64)
    if len(some):
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for i in some for w in split[i]), np.uint64, int(count[some].sum()))
        words[:, some] = parities(hashes, np.cumsum(count[some]) - count[some])
    return [pa.array(c) for c in (size, count, *parities(points, np.cumsum(size) - size), *words)]


def line_classes(docs: DataFrame, *keep: str, every: bool = True) -> DataFrame:
    """One row per distinct line: h, n (occurrences), n_links, and its class's first occurrence (first: doc_id, the columns to keep, line_no, h).

    n_links counts all lines within the limits of the line; without every only those that tell its class.
    """
    links = edit_links(docs, every)
    degree = links.select(F.explode(F.array("a", "b")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n_links"))
    linked = components(links).withColumnRenamed("node", "h").join(degree, "h", "left")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *keep, "line_no", "h")
    own = lines_of(docs, *keep).groupBy("h").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    classed = own.join(linked, "h", "left").select("h", "first", "n", "root", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # Most classes are one line; only linked lines meet to find the first of their class.
    many = classed.where("root IS NOT NULL")
    named = many.join(many.groupBy("root").agg(F.min("first").alias("class_first")), "root").select("h", "n", "n_links", F.col("class_first").alias("first"))
    return classed.where("root IS NULL").select("h", "n", "n_links", "first").unionByName(named)


def with_classes(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """Lines (h, ...) with the columns of their classes. Hot lines, of which there is a bounded number, are joined by broadcast."""
    total = classes.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > total // HOT_SHARE + 1000
    few = F.broadcast(classes.where(hot))  # under HOT_SHARE rows
    return lines.join(few.select("h"), "h", "left_anti").join(classes.where(~hot), "h").unionByName(lines.join(few, "h"))


def dedup_lines(docs: DataFrame, *keep: str, every: bool = True) -> DataFrame:
    """One row per line with a word: doc_id, line_no, class_doc_id and class_line_no (the class's first occurrence), n_links, dropped.

    Columns of docs to keep identify rows within a doc_id, and come along.
    """
    classes = written(line_classes(docs, *keep, every=every), "line-classes")
    same = F.col("h") == F.col("first.h")
    for c in ("doc_id", *keep, "line_no"):
        same &= F.col(c).eqNullSafe(F.col(f"first.{c}"))
    return with_classes(lines_of(docs, *keep).select("doc_id", *keep, "line_no", "h"), classes).select(
        "doc_id", *keep, F.col("line_no").cast("long").alias("line_no"), F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").cast("long").alias("class_line_no"), "n_links", (~same).alias("dropped"))


def without_dropped_lines(docs: DataFrame) -> DataFrame:
    """docs with dropped lines cut out of the texts; documents that lose all their lines go, those without lines stay.

    Rows are told apart by a number of their own, so that rows which share a doc_id, or have none, keep their own lines.
    """
    row, drop, left = (free_name(docs, x) for x in ("_row", "_drop", "_left"))
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    lines = dedup_lines(rows.select("doc_id", row, "text"), row, every=False)  # links are not counted here
    # lines without a word follow no class; they are false in the row's flags, which line up with the split text
    blank = rows.select(row, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(~F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    flags = lines.select(row, F.col("line_no").cast("int").alias("line_no"), "dropped").unionByName(blank.select(row, "line_no", F.lit(False).alias("dropped")))
    kept = flags.groupBy(row).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("line_no", "dropped"))), lambda x: x["dropped"]).alias(drop), F.bool_or("dropped").alias("_some"))
    kept = kept.where("_some").drop("_some")
    whole = lines.groupBy(row).agg(F.bool_and("dropped").alias(left)).where(left).select(row)  # all lines with a word are dropped
    text = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.col(drop)[i]), "\n")
    joined = rows.join(whole, row, "left_anti").join(kept, row, "left")
    return joined.select(*[F.when(F.col(drop).isNotNull(), text).otherwise(F.col("text")).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
