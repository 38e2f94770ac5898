"""Captures read as documents: a capture is one row with its words before and after, so neither words nor lines are shuffled or written.

Places decide what is a label's value, a column and a payment's row; a loop over one capture's lines at a time finds these, inside Arrow batches. What the texts mean
is told by column expressions. The rules are those of the functions over lines in ``captures``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import captures as C
from .documents import nearest
from .layout import TOLERANCE, _order, numbered_words

NAN, INF = float("nan"), float("inf")
#: Captures that are held as lists at once.
SLICE = 512
_FOLD, _LIKE = str.maketrans(X.MARKED, X.PLAIN), str.maketrans("l105", "iios")
_TITLES = [t.translate(_LIKE) for t in C.TITLES]
_CAPTION, _BIT = C.TABLE.split()[0], {t: 1 << i for i, t in enumerate(C.TITLES)}
_BLANKS, _THREE, _DIGIT = re.compile("[ \t\n\x0b\f\r]+"), re.compile("[0-9]{3}"), re.compile("[0-9]")
_ANCHOR, _AMOUNT, _DECLARED = re.compile(C.ANCHOR), re.compile(C.AMOUNT_MARK, re.ASCII), re.compile(C.DECLARED, re.ASCII)
_DOTTED = re.compile(C.DOTTED_ID[:-1] + r"(?:\r\n|[\n\r\x85\u2028\u2029])?\Z")  # what $ is in a column expression
# a ratio of LIKE leaves room for this share of letters that no label has
_LETTERS, _SHARE = re.compile(f"[^{''.join(sorted(set(''.join(C.LABELS))))}]+"), C.LIKE / (2 - C.LIKE) - 1e-9
_LONGEST = max(map(len, C.LABELS)) * (2 - C.LIKE) / C.LIKE + 1e-9


Fact = tuple[str, int]  # folded text, flags
DIGITS, MARKED = 1 << len(C.TITLES), 2 << len(C.TITLES)  # flags beside those of title words: three digits, and a word of the caption or the foot
_BLOCK = DIGITS - 1


def _folded(text: str) -> str:
    low = text.lower()
    low = low if low.isascii() else low.translate(_FOLD)
    return low if "  " not in low and low.isprintable() else _BLANKS.sub(" ", low)


def _liked(folded: str) -> str:
    return folded.replace("l", "i").replace("1", "i").replace("0", "o").replace("5", "s")


_NOISE = ("cambiar", "ayuda", "necesitas")
_SIGNS = re.compile("|".join([*_TITLES, *map(_liked, [*_NOISE, C.FOOT, _CAPTION])]))  # few texts have one of these


@lru_cache(50_000)
def fact(text: str | None) -> Fact | None:
    """What a word's text tells; None for a blank text and for noise of the screen."""
    if text is None or not text.strip(" "):
        return None
    folded = _folded(text)
    flags = DIGITS if _THREE.search(text) else 0
    like = _liked(folded)
    if _SIGNS.search(like):
        shown = folded.strip(" .:").strip("?¿ ")
        if shown in _NOISE or "necesitas ayuda" in shown:
            return None
        flags |= sum([1 << i for i, t in enumerate(_TITLES) if t in like]) | (MARKED if C.FOOT in folded or _CAPTION in folded else 0)
    return folded, flags


@lru_cache(50_000)
def measured(folded: str) -> tuple[int, int, int]:
    """A text's length, that without dots at its ends, and how many letters of labels it has."""
    return len(folded), len(folded.strip(" .:")), len(_LETTERS.sub("", folded))


_like = lru_cache(50_000)(lambda key: C.LABELS.get(nearest(key, list(C.LABELS), C.LIKE)))


@lru_cache(50_000)
def _field_of(key: str) -> str | None:
    near = 8 <= len(key) <= _LONGEST and len(_LETTERS.sub("", key)) >= _SHARE * len(key)
    return C.LABELS.get(key) or (_like(key) if near else None)


Word = tuple[float, int, float, float, float, str, Fact, int, int]  # x0, number, x1, y0, y1, text, fact, runs that may be labels, place from top to bottom, then left to right
Line = tuple[int, list[Word]]  # flags of any word, words from left to right


def label_runs(size: np.ndarray, bare: np.ndarray, letters: np.ndarray, left: np.ndarray) -> list[int]:
    """For each word the runs of up to ``SPAN`` words of its line that may be a label, as bits: left tells how many words the line has from there on.

    Others are too long or too short, or hold too few letters of labels.
    """
    at, out = np.arange(len(size)), np.zeros(len(size), np.int64)
    sums = [np.append(0, np.cumsum(v)) for v in (size + 1, bare, bare > 0, letters + 1)]
    for n in range(1, C.SPAN + 1):
        stop = np.minimum(at + n, len(size))
        long, short, filled, good = (v[stop] - v[at] for v in sums)
        least = short + np.maximum(filled - 1, 0)
        out |= ((n <= left) & (long > 8) & (least <= _LONGEST) & (good - 1 >= _SHARE * least)).astype(np.int64) << (n - 1)
    return out.tolist()


def label_fields(words: list[Word]) -> list[tuple[str, float, float]]:
    """``captures.label_hits`` of one line: field, left, right."""
    taken, at, stop = [], 0, len(words)
    while at < stop:
        runs = [at + n for n in range(C.SPAN, 0, -1) if words[at][7] >> (n - 1) & 1] if words[at][7] else []
        for end in runs:
            key = " ".join([w[6][0] for w in words[at:end]])
            field = _field_of((re.sub(" +", " ", key) if "  " in key else key).strip(" .:"))
            if field:
                taken.append((field, words[at][0], words[end - 1][2]))
                at = end - 1
                break
        at += 1
    starts = [left for _, left, _ in taken[1:]]
    return [(field, left - 12, starts[i] - 5 if i < len(starts) and starts[i] == starts[i] else end + C.REACH) for i, (field, left, end) in enumerate(taken)]


_PLACE = itemgetter(8)


def _first(v: float) -> float:
    return v if v == v else -INF


def _edge(v: float, other: float) -> float:
    return v if v == v else other


def _by_place(words: list[Word]) -> str:
    return words[0][5] if len(words) == 1 else " ".join([w[5] for w in sorted(words, key=_PLACE)])


def head_values(lines: list[Line]) -> dict[str, str]:
    """``captures.head_fields`` of one capture."""
    hits = [(i, found) for i, (_, ws) in enumerate(lines) if (found := label_fields(ws))]
    out: dict[str, str] = {}
    for j, (i, found) in enumerate(hits):
        stop = min(hits[j + 1][0] if j + 1 < len(hits) else len(lines), i + 1 + C.VALUE_LINES + C.BLANK_LINES, len(lines))
        for field, left, right in found:
            if field in out:
                continue
            parts = [" ".join([w[5] for w in lines[k][1] if w[0] < right and w[2] > left]) for k in range(i + 1, stop)]
            first = next((k for k, p in enumerate(parts) if p), None)
            if first is None or first > C.BLANK_LINES:
                continue
            some = parts[first:first + C.VALUE_LINES]
            value = " ".join(some[:some.index("")] if "" in some else some).strip(" ")
            if value:
                out[field] = value
    return out


def table_place(lines: list[Line], said: dict[int, str]) -> tuple[int, int | None, int | None]:
    """``captures.table_marks`` of one capture: start, and the first and last line of its titles."""
    start = next((i for i, s in said.items() if C.TABLE in s), 0)
    titles = [0 if flags & DIGITS else flags & _BLOCK for flags, _ in lines]
    for i in range(start, len(lines)):
        if titles[i]:
            last = i
            block = titles[i]
            while last < min(i + 2, len(lines) - 1) and titles[last + 1]:
                last += 1
                block |= titles[last]
            if block.bit_count() >= 3 and block & (_BIT["valor"] | _BIT["referencia"]) and block & (_BIT["destinatario"] | _BIT["documento"]):
                return start, i, last
    return start, None, None


@lru_cache(10_000)
def column_field(title: str) -> str:
    """``text.column_field`` of a title."""
    like = _liked(title)
    says = lambda word: _liked(word) in like
    if title.strip(" ") in ("#", "n", "no"):
        return "nro"
    if says("documento"):
        return "document_kind" if says("tipo") else "document"
    return next((field for word, field in X.COLUMN_WORDS.items() if says(word)), "")


def columns_of(block: list[Word]) -> tuple[tuple[str, float, float], ...]:
    """``captures.title_columns`` of the words of one capture's titles: field, low, high from left to right."""
    return _columns(tuple([(w[0], w[2], w[5]) for w in sorted(block, key=_PLACE)]))


@lru_cache(5_000)
def _columns(words: tuple[tuple[float, float, str], ...]) -> tuple[tuple[str, float, float], ...]:
    """Columns of titles (x0, x1, text) from top to bottom; captures of one screen have the same."""
    low_of, high_of = (lambda a, b: a if b != b else b if a != a else min(a, b)), (lambda a, b: a if b != b else b if a != a else max(a, b))
    groups: list[tuple[float, float, list[int]]] = []
    end = NAN
    for i in sorted(range(len(words)), key=lambda i: (_first(words[i][0]), _first(words[i][1]))):
        x0, x1, _ = words[i]
        if end != end or x0 > end + 6.0:
            groups.append((x0, x1, [i]))
        else:
            left, right, own = groups[-1]
            groups[-1] = (low_of(left, x0), high_of(right, x1), [*own, i])
        end = high_of(end, x1)
    groups = [(left, right, inside) for left, right, own in groups if (inside := sorted(i for i in own if words[i][0] >= left and words[i][1] <= right))]
    out = []
    for k, (left, right, own) in enumerate(groups):
        title = _folded(" ".join([words[i][2] for i in own])).strip(" .:")
        low, high = (groups[k - 1][1] + left) / 2 if k else -INF, (right + groups[k + 1][0]) / 2 if k + 1 < len(groups) else INF
        out.append((column_field(title) or title, low, high))
    return tuple(out)


Row = tuple[int, str, str, str, str, str, str, str]  # row, FIELDS, said


def titled_rows(lines: list[Line], said: dict[int, str], last: int, columns: tuple[tuple[str, float, float], ...]) -> list[Row]:
    """``captures.titled_rows`` of one capture."""
    value = next((k for k, c in enumerate(columns) if c[0] == "value"), None)
    if value is None:
        return []
    bottom = lambda i: max([w[4] for w in lines[i][1] if w[4] == w[4]], default=NAN)
    foot = next((i for i, s in said.items() if i > last and C.FOOT in s), len(lines))
    lows, body, anchors = [low for _, low, _ in columns], [], []
    for i in range(last + 1, foot):
        ws = lines[i][1]
        celled, middle = [], (min([w[3] for w in ws if w[3] == w[3]], default=NAN) + bottom(i)) / 2
        for w in ws:
            centre = (w[0] + w[2]) / 2
            k = bisect_right(lows, centre) - 1  # columns meet, so one takes the word
            if k >= 0 and lows[k] <= centre < columns[k][2]:
                celled.append((k, w))
        body.append((middle, i, celled))
        if any([k == value and _ANCHOR.search(w[5]) for k, w in celled]):
            anchors.append(middle)
    halves = [(a + b) / 2 for a, b in zip(anchors, anchors[1:])]
    ceiling, floor = bottom(last), bottom(foot - 1) + 40
    out = []
    for r in range(len(anchors)):
        low, high = _edge(halves[r - 1], ceiling) if r else ceiling, _edge(halves[r], floor) if r < len(halves) else floor
        own: dict[int, list[Word]] = {}
        seen: dict[int, tuple[int, float]] = {}
        for middle, i, celled in body:
            if low <= middle < high:
                for k, w in celled:
                    own.setdefault(k, []).append(w)
                    seen.setdefault(k, (i, _first(w[0])))
        if not own:
            continue
        latest = {columns[k][0]: k for k in sorted(own, key=seen.__getitem__)}  # of columns with one field, the one that starts last
        out.append((r + 1, *[_by_place(own[latest[f]]) if f in latest else "" for f in C.FIELDS], _by_place([w for ws in own.values() for w in ws])))
    return out


def untitled_rows(lines: list[Line], start: int) -> list[Row]:
    """``captures.untitled_rows`` of one capture; the payee is all of the text where the name stands."""
    words = sorted((((w[3] + w[4]) / 2, i, w) for i, (_, ws) in enumerate(lines) if start == 0 or i > start for w in ws), key=lambda x: (_first(x[0]), x[1], _first(x[2][0]), x[2][1]))
    amounts = [(c, w) for c, _, w in words if _AMOUNT.search(w[5]) and _DIGIT.search(w[5])]
    placed = lambda ws: sorted(ws, key=_PLACE)
    text = lambda ws: " ".join([w[5] for w in ws])
    halves = [(a + b) / 2 for (a, _), (b, _) in zip(amounts, amounts[1:])]
    out = []
    for r, (_, m) in enumerate(amounts):
        low, high = _edge(halves[r - 1], -INF) if r else -INF, _edge(halves[r], INF) if r < len(halves) else INF
        near = placed(w for c, _, w in words if low <= c < high)
        if not near:
            continue
        others = [w for w in near if w[1] != m[1]]
        left, right = [w for w in others if w[2] <= m[0] + 2], [w for w in others if w[0] >= m[2] - 2]
        tax = next((w for w in left if _DOTTED.search(w[5].replace(" ", ""))), None)
        name = left if tax is None else [w for w in left if w[2] <= tax[0] + 2]
        account = [] if tax is None else [w for w in left if w[0] >= tax[2] - 2 and w[1] != tax[1]]
        out.append((r + 1, text(name), tax[5] if tax else "", text(account), m[5], "", text(right), text(near if len(others) < len(near) else placed([*near, m]))))
    return out


ROW = "struct<row: int, " + ", ".join(f"{f}: string" for f in [*C.FIELDS, "said"]) + ">"
HEAD = "struct<" + ", ".join(f"{f}: string" for f in C.LABELS.values()) + ">"
COLUMN = "struct<field: string, low: double, high: double>"
NONE = [""] * len(C.LABELS)


def _lists(groups: list[list[tuple]], fields: list[tuple[str, pa.DataType]]) -> pa.ListArray:
    flat = [r for g in groups for r in g]
    values = [pa.array([r[i] for r in flat], t) for i, (_, t) in enumerate(fields)]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, groups)]), pa.int32()), pa.StructArray.from_arrays(values, [k for k, _ in fields]))


def _plain(column: pa.ChunkedArray) -> list[float]:
    """Numbers that compare as those of columns do: nothing compares with a null, and NaN is above all others."""
    value = pc.fill_null(column, 0.0).to_numpy()
    return np.where(pc.is_null(column).to_numpy(), NAN, np.where(np.isnan(value), INF, value)).tolist()


def _captures(words: pa.ListArray, heads: bool) -> list[list[Line]]:
    """The lines of each capture; see ``layout.gathered_lines``."""
    size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    flat = words.flatten()
    table = pa.Table.from_arrays(flat.flatten(), names=[f.name for f in flat.type])
    texts = table["text"].to_numpy().tolist()
    facts = list(map(fact, texts))
    real = np.fromiter((f is not None for f in facts), bool, len(facts))
    if not real.any():
        return [[] for _ in range(len(size))]
    doc, table, place = np.repeat(np.arange(len(size)), size)[real], table.drop_columns(["text"]).filter(pa.array(real)), np.flatnonzero(real)
    order, line, number = numbered_words(table, doc, TOLERANCE)
    doc, table, place = doc[order], table.take(pa.array(order)).combine_chunks(), place[order].tolist()
    texts, facts = [texts[i] for i in place], [facts[i] for i in place]
    flags = np.array([f[1] for f in facts], np.int64)
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])][:len(doc)])
    starts, stops = first.tolist(), np.append(first[1:], len(doc))
    runs = label_runs(*np.array([measured(f[0]) for f in facts], np.int64).T, np.repeat(stops, stops - first) - np.arange(len(doc))) if heads else [0] * len(doc)
    place = np.empty(len(doc), np.int64)
    place[np.lexsort([number, *_order(table["x0"]), *_order(table["y0"]), doc])] = np.arange(len(doc))
    each = list(zip(_plain(table["x0"]), number.tolist(), *(_plain(table[c]) for c in ("x1", "y0", "y1")), texts, facts, runs, place.tolist()))
    flags = np.bitwise_or.reduceat(flags, first).tolist()
    lines = [(g, each[a:b]) for g, a, b in zip(flags, starts, stops.tolist())]
    ends = np.searchsorted(doc[first], np.arange(len(size) + 1)).tolist()
    return [lines[a:b] for a, b in zip(ends, ends[1:])]


def _read(lines: list[Line], heads: bool, rows: bool, kinds: tuple[bool, ...]) -> tuple:
    said = {i: _BLANKS.sub(" ", " ".join([w[6][0] for w in ws])).strip(" .:") for i, (flags, ws) in enumerate(lines) if flags & MARKED}
    declared = next((int(m[1]) for s in said.values() if (m := _DECLARED.search(s)) and int(m[1]) < 2 ** 63), 0)
    head = head_values(lines) if heads else {}
    start, first, last = table_place(lines, said)
    columns = columns_of([w for _, ws in lines[first:last + 1] for w in ws]) if first is not None else ()
    found = [] if not rows or (first is not None) not in kinds else untitled_rows(lines, start) if first is None else titled_rows(lines, said, last, columns)
    return len(lines), declared, [head.get(f, "") for f in C.LABELS.values()], first is not None, columns, found


def stacked_words(words: Column, heights: Column) -> Column:
    """``captures.stacked`` of a document's arrays."""
    above = lambda w: F.aggregate(F.filter(heights, lambda h: h["page"] < w["page"]), F.lit(0.0), lambda s, h: s + F.coalesce(h["height"], F.lit(0.0)))
    known = lambda w: F.exists(heights, lambda h: h["page"] == w["page"])
    moved = lambda w: X.let(F.when(F.coalesce(known(w), F.lit(False)), above(w)).otherwise(0.0), lambda by: w.withField("y0", w["y0"] + by).withField("y1", w["y1"] + by))
    return F.when(F.size(heights) > 0, F.transform(words, moved)).otherwise(words)


def read_captures(docs: DataFrame, heads: bool = True, rows: bool = True, kinds: tuple[bool, ...] = (True, False)) -> DataFrame:
    """docs (words: array of page, word_no, text, x0, x1, y0, y1; heights: array of page, height of pages that stand below each other; more columns) -> the other columns, lines (their number), declared,
    head (a field for each label), titled, columns (field, low, high) and rows (row, FIELDS, said).

    heads and rows tell what is looked for, kinds whether rows of tables with titles (True) or without; what isn't is blank.
    """
    types = {f.name: f.dataType.simpleString() for f in docs.schema if f.name not in ("words", "heights")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = [("row", pa.int32()), *[(f, pa.string()) for f in [*C.FIELDS, "said"]]]
        column = [("field", pa.string()), ("low", pa.float64()), ("high", pa.float64())]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                read = [_read(lines, heads, rows, kinds) for lines in _captures(part.column("words"), heads)]
                size, declared, head, titled, columns, found = map(list, zip(*read))
                fields = pa.StructArray.from_arrays([pa.array(v, pa.string()) for v in zip(*head)], list(C.LABELS.values()))
                out = [pa.array(size, pa.int32()), pa.array(declared, pa.int64()), fields, pa.array(titled), _lists(columns, column), _lists(found, row)]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in types], *out], [*types, "lines", "declared", "head", "titled", "columns", "rows"])

    said = "".join(f"`{k}` {t}, " for k, t in types.items())
    given = docs.select(*types, stacked_words(F.col("words"), F.col("heights")).alias("words"))
    return given.mapInArrow(run, f"{said}lines int, declared long, head {HEAD}, titled boolean, columns array<{COLUMN}>, rows array<{ROW}>")


def rows_of(read: DataFrame, *more: str) -> DataFrame:
    """more columns, titled, row, FIELDS and said of each payment's row, and opens, the first row of its capture; names of tables without titles lose the words that are none. A capture without rows is one line without any."""
    each = read.select(*more, "titled", F.get("rows", 0)["row"].alias("opens"), F.explode_outer("rows").alias("r")).select(*more, "titled", "opens", "r.*")
    return each.withColumn("payee", F.when(F.col("titled"), F.col("payee")).otherwise(X.payee_name(F.col("payee"), X.NAME_COLUMN_WORDS)))


def documents_of(words: DataFrame, heights: DataFrame | None = None) -> DataFrame:
    """words (doc, page, word_no, text, x0, x1, y0, y1) and heights (doc, page, height) -> doc, words and heights as ``read_captures`` takes them."""
    listed = lambda *cs: F.collect_list(F.struct(*[F.col(c).cast(t).alias(c) for c, t in cs]))
    place = [(c, "double") for c in ("x0", "x1", "y0", "y1")]
    docs = words.groupBy("doc").agg(listed(("page", "int"), ("word_no", "int"), ("text", "string"), *place).alias("words"))
    none = F.array().cast("array<struct<page: int, height: double>>")
    return docs.withColumn("heights", none) if heights is None else docs.join(heights.groupBy("doc").agg(listed(("page", "int"), ("height", "double")).alias("heights")), "doc", "left").withColumn("heights", F.coalesce("heights", none))
