"""Phrase collocations by suffix sorting (suffix-sigma).

Every place of a text gives the suffix of its piece that starts there, cut after ``max_n`` words. Suffixes are dealt by language
and first word and sorted within a partition in reverse lexicographic order; one stack of ``max_n`` open prefixes
then counts all their prefixes, that is all phrases, in a single pass. The counts of a phrase's parts are joined afterwards.

* Equal suffixes of a slice of texts are added up before they are shuffled.
* A phrase with ``least`` occurrences has no word with fewer, so a suffix ends before the first word that is rarer in its
  language. Which words are common enough is told by a filter of fixed size (8 MB) over the hashes of all of them; a word that it lets
  through by mistake costs rows, never a count.
* A prefix that starts over one in ``hot`` suffixes is dealt by its next word, too, so that no partition gets all of them.
  Such prefixes are found exactly where they matter: one that has a share of 1 / hot in all has half of it in slices in which its share is
  1 / (2 * hot) or more, and slices report those. Counts of a prefix that was dealt out are added up after the stack.

Words and languages go as bytes; languages are escaped, so that any name is told apart. Counts are longs and scores decimals.

Defined results: null texts are empty, null languages are ``und`` (as one with that name); repeated rows count as often as they occur; ties
of a score go to the higher count, then to the phrase that comes first in byte order; ties between cuts to the shorter first part; an
empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote_from_bytes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_filter, passes, slices, trimmed, written

MAX_N, LEAST, KEEP, TOP = 4, 30, 80, 2000
#: Bytes of text that are counted together.
SLICE = 4_000_000

# Fixed by the contract: what ends a piece, and what separates words in it.
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
NOTHING = pa.scalar(b"", pa.large_binary())
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_KIND = np.zeros(256, np.uint8)
_KIND[list(GAPS)] = 1
_KIND[list(ENDS)] = 2


def escaped(lang: str | None) -> bytes:
    """A language's name without spaces and line ends."""
    return quote_from_bytes(("und" if lang is None else lang).encode("utf-8", "surrogatepass")).encode()


def words_of(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of all texts in byte order, the word at each place (its number), and how many places are left in its piece, itself included."""
    raw = b"\n".join((t or "").encode("utf-8", "surrogatepass") for t in texts).translate(_LOWER) + b"\n"
    kind = _KIND[np.frombuffer(raw, np.uint8)]
    inside = kind == 0
    starts = np.flatnonzero(inside & np.r_[True, ~inside[:-1]])
    n = len(starts)
    if not n:
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters = np.frombuffer(raw, np.uint8)[inside]
    offsets = np.r_[0, np.cumsum(np.flatnonzero(inside & np.r_[~inside[1:], True]) + 1 - starts)]
    array = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    coded = array.dictionary_encode()
    kinds = coded.dictionary
    order = pc.array_sort_indices(kinds).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    words = rank[coded.indices.to_numpy()]
    # the piece that a word is in ends at the last word before the next mark
    marks = np.searchsorted(np.flatnonzero(kind == 2), starts)
    last = np.r_[marks[1:] != marks[:-1], True]
    ends = np.flatnonzero(last)
    left = np.repeat(ends, np.diff(np.r_[-1, ends])) - np.arange(n) + 1
    return kinds.take(pa.array(order)), words, left


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list]]:
    texts: dict[str | None, list] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        texts.setdefault(lang, []).append(text)
    for lang, some in texts.items():
        yield escaped(lang), some


def joined(kinds: pa.Array, codes: list[np.ndarray], head: bytes = b"") -> pa.Array:
    """head, then words with a space after each; codes of -1 are none."""
    spaced = pc.binary_join_element_wise(kinds, pa.scalar(b" ", pa.large_binary()), NOTHING)
    spaced = pa.concat_arrays([spaced, pa.array([b""], pa.large_binary())])  # the last stands for none
    parts = [spaced.take(pa.array(np.where(c < 0, len(kinds), c))) for c in codes]
    return pc.binary_join_element_wise(*([pa.scalar(head, pa.large_binary())] if head else []), *parts, NOTHING)


def runs(columns: list[np.ndarray], weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows that stand for each different combination of the columns, in order, and how often it occurs."""
    n = len(columns[0])
    order = np.lexsort(columns[::-1])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    at = np.flatnonzero(new)
    w = np.ones(n, np.int64) if weight is None else weight[order]
    return order[at], np.add.reduceat(w, at) if n else np.zeros(0, np.int64)


def packed(words: np.ndarray, left: np.ndarray, size: int) -> list[np.ndarray]:
    """The next ``size`` words from each place, two to a long, with 0 where there is none (words count from 1)."""
    n, out = len(words), []
    for k in range(0, size, 2):
        pair = np.zeros(n, np.int64)
        for j in (k, k + 1):
            word = np.zeros(n, np.int64)
            if j < size and n > j:
                word[:n - j] = np.where(left[:n - j] > j, words[j:] + 1, 0)
            pair = pair << 32 | word
        out.append(pair)
    return out


def unpacked(pairs: list[np.ndarray], rows: np.ndarray, size: int) -> list[np.ndarray]:
    return [((pairs[j // 2][rows] >> (0 if j % 2 else 32)) & 0xFFFFFFFF) - 1 for j in range(size)]


def word_and_prefix_counts(docs: DataFrame, hot: int, max_n: int) -> DataFrame:
    """lang, words (with a space after each), size and n: all words (size 1), and longer prefixes that are frequent in a slice (their counts are partial)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", SLICE):
                for lang, texts in by_language(part):
                    kinds, words, left = words_of(texts)
                    if not len(words):
                        continue
                    n = np.bincount(words, minlength=len(kinds))
                    out = [(joined(kinds, [np.arange(len(kinds))]), 1, n)]
                    at = np.arange(len(words))
                    for size in range(2, max_n):  # places where the shorter prefix is frequent
                        at = at[left[at] >= size]
                        if not len(at):
                            break
                        next_word = packed(words, left, size)
                        rows, count = runs([c[at] for c in next_word])
                        many = count * 2 * hot >= len(words)
                        if not many.any():
                            break
                        codes = unpacked([c[at] for c in next_word], rows[many], size)
                        out.append((joined(kinds, codes), size, count[many]))
                        keys = {tuple(x) for x in np.stack([c[at][rows[many]] for c in next_word], axis=1).tolist()}
                        at = at[np.isin(next_word[0][at], [x[0] for x in keys])]
                        if size > 2:
                            at = at[[x in keys for x in zip(*(c[at].tolist() for c in next_word))]]
                    for text, size, count in out:
                        for lo in range(0, len(text), 50_000):
                            some = text.slice(lo, 50_000).cast(pa.binary())
                            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.binary()), some, pa.array([size] * len(some), pa.int32()), pa.array(count[lo:lo + 50_000])], names=["lang", "words", "size", "n"])
        trimmed()

    return docs.select("lang", "text").mapInArrow(run, "lang binary, words binary, size int, n long")


def word_key(lang: bytes, word: bytes) -> int:
    """Spark's xxhash64 of a language and a word with its space."""
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang, 42))


def suffixes(docs: DataFrame, common, hot: dict[bytes, set[bytes]], max_n: int) -> DataFrame:
    """part (what a suffix is dealt by), suffix (language, line end, words with a space after each) and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for one in slices(whole, "text", SLICE):
                for lang, texts in by_language(one):
                    kinds, words, left = words_of(texts)
                    if not len(words):
                        continue
                    spaced = joined(kinds, [np.arange(len(kinds))]).to_pylist()
                    own = np.fromiter((word_key(lang, w) for w in spaced), np.uint64, len(spaced)).view(np.int64)
                    ok = passes(common.value, own)[words]
                    # a rare word ends what stands before it, and starts nothing
                    rare = np.flatnonzero(~ok)
                    upto = np.r_[rare, len(words)][np.searchsorted(rare, np.arange(len(words)))] - np.arange(len(words))
                    pairs = packed(words, np.minimum(left, upto), max_n)
                    at = np.flatnonzero(ok)
                    if not len(at):
                        continue
                    rows, count = runs([p[at] for p in pairs])
                    codes = unpacked(pairs, at[rows], max_n)
                    part = own[codes[0]].copy()
                    prefixes = hot.get(lang, ())
                    inside = np.arange(len(rows))
                    for size in range(1, max_n):  # hot prefixes are dealt by one word more
                        if not prefixes or not len(inside):
                            break
                        inside = inside[codes[size][inside] >= 0]
                        text = joined(kinds, [c[inside] for c in codes[:size]])
                        some = pc.is_in(text, value_set=pa.array(list(prefixes), pa.large_binary())).to_numpy(zero_copy_only=False) if len(inside) else np.zeros(0, bool)
                        inside = inside[some]
                        part[inside] = (part[inside] ^ own[codes[size][inside]]) * np.int64(0x1E3779B97F4A7C15) + size
                    for lo in range(0, len(rows), 50_000):
                        full = joined(kinds, [c[lo:lo + 50_000] for c in codes], lang + b"\n").cast(pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(part[lo:lo + 50_000]), full, pa.array(count[lo:lo + 50_000])], names=["part", "suffix", "n"])
        trimmed()

    return docs.select("lang", "text").mapInArrow(run, "part long, suffix binary, n long")


class Stack:
    """Open prefixes of the suffixes seen last, with their counts so far; suffixes come in reverse lexicographic order."""

    def __init__(self, max_n: int, least: int, hot: set[bytes]) -> None:
        self.max_n, self.least, self.hot = max_n, least, hot
        self.split_hot = [h[:-1].split(b" ") for h in hot]
        self.words: list[bytes] = []
        self.counts: list[int] = []

    def close(self, size: int) -> list[tuple[bytes, int, int]]:
        """Pops prefixes of more than ``size`` words."""
        out = []
        while len(self.words) > size:
            phrase, n, k = b" ".join(self.words) + b" ", self.counts.pop(), len(self.words)
            self.words.pop()
            if n >= self.least or phrase in self.hot:
                out.append((phrase, k, n))
        return out

    def push(self, suffix: pa.Array, n: np.ndarray) -> list[tuple[bytes, int, int]]:
        """Takes a batch of suffixes; returns prefixes that are counted to the end, with their sizes and counts.

        Words become numbers, so that neighbours are compared in numpy; only runs that end with enough occurrences are looked at one by one.
        """
        size = len(suffix)
        if not size:
            return []
        parts = pc.split_pattern(suffix.cast(pa.large_string()) if pa.types.is_large_binary(suffix.type) else suffix.cast(pa.string()), " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        many = np.diff(offsets) - 1  # an empty string follows the last space
        coded = parts.values.dictionary_encode()
        kinds, codes = coded.dictionary, coded.indices.to_numpy()
        table = np.full((size, self.max_n), -1, np.int64)
        for k in range(self.max_n):
            has = many > k
            table[has, k] = codes[offsets[:-1][has] + k]
        word = lambda i, k: kinds[int(table[i, k])].as_py().encode()
        # how much of the open prefixes goes on with the first suffix
        same = 0
        while same < min(len(self.words), int(many[0])) and self.words[same] == word(0, same):
            same += 1
        out = self.close(same)
        fresh = np.zeros(size, bool)  # whether a prefix of the size at hand is new in a row
        number = {x.encode(): i for i, x in enumerate(kinds.to_pylist())} if self.hot else {}
        hot_here = [[number[w] for w in ws] for ws in self.split_hot if all(w in number for w in ws)]
        carried = list(self.counts)
        self.words, self.counts = [], []
        for k in range(self.max_n):
            fresh[1:] |= table[1:, k] != table[:-1, k]
            starts = np.flatnonzero(np.r_[True, fresh[1:]])
            sums = np.add.reduceat(np.where(many > k, n, 0), starts)
            if k < same:
                sums[0] += carried[k]
            alive = table[starts, k] >= 0
            if alive[-1] and many[-1] > k:
                self.words.append(word(size - 1, k))
                self.counts.append(int(sums[-1]))
                alive[-1] = False
            done = alive & (sums >= self.least)
            for codes_hot in hot_here:
                if len(codes_hot) == k + 1:
                    done |= alive & (table[starts, :k + 1] == codes_hot).all(axis=1)
            for i in np.flatnonzero(done):
                out.append((b" ".join(word(starts[i], j) for j in range(k + 1)) + b" ", k + 1, int(sums[i])))
        return out


def counted(dealt: DataFrame, hot: list[bytes], max_n: int, least: int) -> DataFrame:
    """phrase (language, line end, words), size and a, for partitions of sorted suffixes; counts of hot prefixes are partial."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = Stack(max_n, least, set(hot))
        for batch in batches:
            yield table(stack.push(batch.column("suffix"), batch.column("n").to_numpy()))
        yield table(stack.close(0))

    def table(rows: list) -> pa.RecordBatch:
        phrase, size, n = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(phrase, pa.binary()), pa.array(size, pa.int32()), pa.array(n, pa.int64())], names=["phrase", "size", "a"])

    return dealt.mapInArrow(run, "phrase binary, size int, a long")


def frequencies(docs: DataFrame, *, max_n: int = MAX_N, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, n): all words of a language; (lang, words, size, a): phrases of up to max_n words with ``least`` occurrences, words an array."""
    spark = docs.sparkSession
    hot_share = max(1000, 2 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    told = word_and_prefix_counts(docs, hot_share, max_n).groupBy("lang", "words", "size").agg(F.sum("n").alias("n"))
    told = written(told, "words")
    totals = told.where("size = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    everything = totals.agg(F.sum("n")).first()[0] or 0
    common = id_filter(told.where((F.col("size") == 1) & (F.col("n") >= least)).select(F.xxhash64("lang", "words").alias("id")))
    # reported counts of longer prefixes are half the true ones at least; no more than 2 * hot_share prefixes of a size can pass
    floor = F.when(F.col("size") == 1, everything / hot_share).otherwise(everything / (2 * hot_share))
    hot: dict[bytes, set[bytes]] = {}
    for r in told.where(F.col("n") > floor).collect():
        hot.setdefault(bytes(r["lang"]), set()).add(bytes(r["words"]))
    heads = [lang + b"\n" + words for lang, some in hot.items() for words in some]
    dealt = suffixes(docs, common, hot, max_n).repartition("part").select("suffix", "n").sortWithinPartitions(F.desc("suffix"))
    parts = counted(dealt, heads, max_n, least)
    text = F.col("phrase").cast("string")
    sums = parts.groupBy("phrase", "size").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return totals, sums.select(F.substring_index(text, "\n", 1).alias("lang"), F.split(F.rtrim(F.substring_index(text, "\n", -1)), " ").alias("words"), "size", "a")


def phrase_of(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(docs: DataFrame, *, max_n: int = MAX_N, least: int = LEAST, keep: int = KEEP, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases.

    A phrase of 2 to max_n words with ``least`` occurrences scores floor(2000000 * a / (l + r)) at its worst cut into a first part (l
    occurrences) and a rest (r). It is left out if a longer one, at least ``keep`` hundredths as frequent, contains it.
    """
    totals, found = frequencies(docs, max_n=max_n, least=least)
    found = written(found, "phrases")
    whole = found.where("size > 1")
    parts = found.select("lang", F.col("words").alias("part"), F.col("a").alias("n_part"))
    cuts = whole.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"), "size")
    cuts = cuts.select("lang", "words", "a", "cut", F.slice("words", F.lit(1), F.col("cut")).alias("head"), F.slice("words", F.col("cut") + 1, F.col("size") - F.col("cut")).alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("head"), F.col("n_part").alias("l")), ["lang", "head"]).join(parts.select("lang", F.col("part").alias("rest"), F.col("n_part").alias("r")), ["lang", "rest"])
    score = F.expr("CAST((2000000 * CAST(a AS DECIMAL(20, 0))) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0))) AS LONG)")
    worst = cuts.withColumn("score", score).groupBy("lang", "words", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w"))
    within = whole.where("size > 2").select("lang", F.col("a").alias("longer"), F.explode(F.expr("flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1), i -> slice(words, i, k))))")).alias("words"))
    within = within.groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    free = worst.join(within, ["lang", "words"], "left").where("longer IS NULL OR CAST(100 AS DECIMAL(20, 0)) * longer < CAST(%d AS DECIMAL(20, 0)) * a" % keep)
    free = free.select("lang", phrase_of(F.col("words")).alias("phrase"), "a", "w.l", "w.r", "w.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    best = best.join(totals.select(F.col("lang").cast("string").alias("lang"), "n"), "lang")
    return best.select(F.url_decode("lang").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT d, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) AS p FROM (SELECT d, lang, regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]') AS ps FROM texts)
), words AS (
  SELECT d, lang, p, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT d, lang, p, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces)
), next AS (
  SELECT lang, w AS g1, w || ' ' || lead(w) OVER o AS g2, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g3,
         w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS g4
  FROM words WINDOW o AS (PARTITION BY d, p ORDER BY i)
), grams AS (
  SELECT lang, 1 AS k, g1 AS phrase FROM next UNION ALL SELECT lang, 2, g2 FROM next WHERE g2 IS NOT NULL
  UNION ALL SELECT lang, 3, g3 FROM next WHERE g3 IS NOT NULL UNION ALL SELECT lang, 4, g4 FROM next WHERE g4 IS NOT NULL
), counts AS (
  SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT *, string_split(phrase, ' ') AS ws FROM counts WHERE k > 1 AND a >= 30
), cuts AS (
  SELECT lang, phrase, a, ws, k, c, array_to_string(ws[1:c], ' ') AS head, array_to_string(ws[c + 1:k], ' ') AS rest
  FROM candidates, (VALUES (1), (2), (3)) t(c) WHERE c < k
), scored AS (
  SELECT x.lang, x.phrase, x.a, x.c, h.a AS l, t.a AS r, (2000000::HUGEINT * x.a) // (h.a + t.a) AS score
  FROM cuts x JOIN counts h ON h.lang = x.lang AND h.phrase = x.head JOIN counts t ON t.lang = x.lang AND t.phrase = x.rest
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), free AS (
  SELECT * FROM worst w WHERE NOT EXISTS (
    SELECT 1 FROM candidates q WHERE q.lang = w.lang AND len(q.ws) > len(string_split(w.phrase, ' ')) AND 100::HUGEINT * q.a >= 80::HUGEINT * w.a
    AND contains(' ' || q.phrase || ' ', ' ' || w.phrase || ' '))
)
SELECT f.lang, row_number() OVER (PARTITION BY f.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM free f JOIN totals USING (lang) QUALIFY rank <= 2000
"""
