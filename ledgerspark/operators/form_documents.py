"""Places of a form's words: labels with what stands at their right, columns under titles, items and signatures, for a document that is one row.

The rules are those of the functions over rows in ``warehouse``; a loop over one document's lines at a time finds the places, inside Arrow batches. What the texts mean is told by column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions import text as X
from . import warehouse as W
from .layout import TOLERANCE, numbered_pages

NAN, INF = float("nan"), float("inf")
#: Documents that are held as lists at once.
SLICE = 512
_FOLD, _BLANKS = str.maketrans(X.MARKED, X.PLAIN), re.compile("[ \t\n\x0b\f\r]+")
_FORM, _HEADS, _MORE, _FOOT = (re.compile(p) for p in (W.IS_FORM, "|".join(W.HEAD), "|".join(W.MORE_TITLES), "|".join(W.SIGNED)))


@lru_cache(50_000)
def _folded(text: str) -> str:
    low = text.lower()
    return _BLANKS.sub(" ", low if low.isascii() else low.translate(_FOLD))


def _openers(labels: dict[str, str]):
    """Tells whether a label may start with a word."""
    @lru_cache(50_000)
    def opens(text: str) -> bool:
        start = _folded(text).strip(" .:")
        return any(label.startswith(start) for label in labels)

    return opens


_OPENS_HEAD, _OPENS_SIGNED = _openers(W.HEAD), _openers(W.SIGNED)


class Line(NamedTuple):
    """A line's number, its folded and its normalised text, and its words from left to right: texts and places."""

    number: int
    whole: str
    said: str
    texts: list[str]
    x0: list[float]
    x1: list[float]
    y0: list[float]


class Span(NamedTuple):
    field: str
    x0: float
    x1: float
    y0: float


def _known(values: list[float]) -> list[float]:
    return [v for v in values if v == v]


def spans_of(line: Line, labels: dict[str, str], opens) -> list[Span]:
    """``warehouse.label_spans`` of one line."""
    hits = []
    for i, text in enumerate(line.texts):
        if opens(text):
            for n in range(min(W.LONGEST_LABEL, len(line.texts) - i), 0, -1):
                key = " ".join(map(_folded, line.texts[i:i + n]))
                field = labels.get((_BLANKS.sub(" ", key) if "  " in key else key).strip(" .:"))
                if field:
                    hits.append((i, i + n, field))
                    break
    free = [(i, stop, field) for k, (i, stop, field) in enumerate(hits) if not any(end > i for _, end, _ in hits[:k])]
    return [Span(field, line.x0[i], max(_known(line.x1[i:stop]), default=NAN), min(_known(line.y0[i:stop]), default=NAN)) for i, stop, field in free]


def head_of(lines: list[Line]) -> dict[str, str]:
    """``warehouse.head_fields`` of one document."""
    out: dict[str, str] = {}
    for line in lines:
        if _HEADS.search(line.said):
            spans = spans_of(line, W.HEAD, _OPENS_HEAD)
            for j, s in enumerate(spans):
                if s.field not in out:
                    stop = spans[j + 1].x0 if j + 1 < len(spans) and spans[j + 1].x0 == spans[j + 1].x0 else INF
                    out[s.field] = " ".join([t for t, a, b in zip(line.texts, line.x0, line.x1) if a >= s.x1 - 1 and b <= stop + 1]).strip(" ")
    return out


Columns = list[tuple[str, float, float]]  # name, low, high


def columns_of(lines: list[Line], edges: list[float]) -> tuple[int, Columns] | None:
    """``warehouse.title_columns`` of one page: the number of the titles' last line, and columns; edges are the drawn lines from left to right."""
    start = next((i for i, l in enumerate(lines) if "codigo" in l.said and "cantidad" in l.said), None)
    if start is None:
        return None
    last = start
    while last < min(start + 3, len(lines) - 1) and _MORE.search(lines[last + 1].said):
        last += 1
    return lines[last].number, _columns(tuple([w for l in lines[start:last + 1] for w in zip(l.y0, l.x0, l.texts, l.x1)]), tuple(edges))


@lru_cache(5_000)
def _columns(words: tuple[tuple[float, float, str, float], ...], edges: tuple[float, ...]) -> Columns:
    """Columns of the titles' words (y0, x0, text, x1); forms of one print have the same."""
    first = lambda v: v if v == v else -INF
    if len(edges) >= 3:
        spans = list(zip(edges, edges[1:]))
    else:
        groups: list[list[float]] = []
        end = NAN
        for _, x0, _, x1 in sorted(words, key=lambda w: (first(w[1]), first(w[3]))):
            if end != end or x0 > end + W.GAP:
                groups.append([x0, x1])
            else:
                groups[-1] = [min(_known([groups[-1][0], x0]), default=NAN), max(_known([groups[-1][1], x1]), default=NAN)]
            end = max(_known([end, x1]), default=NAN)
        halves = [((a[1] + b[0]) / 2) for a, b in zip(groups, groups[1:])]
        edge = lambda v, other: v if v == v else other
        spans = list(zip([-INF, *[edge(h, -INF) for h in halves]], [*[edge(h, INF) for h in halves], INF]))
    out = []
    for i, (low, high) in enumerate(spans):
        inside = sorted([w for w in words if low <= (w[1] + w[3]) / 2 < high], key=lambda w: (first(w[0]), first(w[1])))  # words of a line come in order
        said = _folded(" ".join([w[2] for w in inside])).strip(" .:")
        name = next((v for k, v in W.COLUMNS.items() if k in said), said or f"col{i}")
        out.append((name, -INF if i == 0 else low, INF if i == len(spans) - 1 else high))
    return out


def items_of(pages: list[tuple[list[Line], list[float]]]) -> list[tuple[str, str]]:
    """``warehouse.item_rows`` of one document's pages (lines, edges): description and text of the quantity of each item."""
    columns: Columns | None = None
    out = []
    for lines, edges in pages:
        titles = columns_of(lines, edges)
        last, columns = titles or (-1, columns)
        if columns is None:
            continue
        own = [[(low, high) for name, low, high in columns if name == wanted] for wanted in ("description", "quantity")]
        for line in lines:
            if line.number > last:
                if _FOOT.search(line.said):
                    return out
                words = list(zip(line.texts, [(a + b) / 2 for a, b in zip(line.x0, line.x1)]))
                description, quantity = (" ".join([t for t, m in words if spans[0][0] <= m < spans[0][1]] if len(spans) == 1 else [t for t, m in words if any([low <= m < high for low, high in spans])]) for spans in own)
                if description or quantity:
                    out.append((description, quantity))
    return out


def signed_of(paged: list[tuple[int | None, Line]], images: list[dict], scanned: list[int], above: float = 70.0, under: float = 6.0) -> list[bool | None]:
    """``layout.signatures`` of the last page that has each label of ``SIGNED``: null without one and on a scanned page."""
    marks = [(page, s) for page, line in paged if _FOOT.search(line.said) for s in spans_of(line, W.SIGNED, _OPENS_SIGNED)]
    out: list[bool | None] = []
    for name in W.SIGNED.values():
        mine = [(page, s) for page, s in marks if s.field == name and page is not None]
        last = max((page for page, _ in mine), default=None)
        if last is None or last in scanned:
            out.append(None)
        else:
            out.append(any(i["page"] == last and i["x0"] < s.x1 and i["x1"] > s.x0 and s.y0 - above <= i["bottom"] <= s.y0 + under for page, s in mine if page == last for i in images))
    return out


def _number(v: float | None) -> float:
    """A number that compares as that of a column does: nothing compares with a null, and NaN is above all others."""
    return NAN if v is None else INF if v != v else v


def _documents(words: pa.ListArray) -> list[list[tuple[int | None, Line]]]:
    """Pages with their lines of each document, in order; words without a text are none."""
    size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    flat = words.flatten()
    table = pa.Table.from_arrays(flat.flatten(), names=[f.name for f in flat.type])
    real = pc.is_valid(table["text"])
    doc, table = np.repeat(np.arange(len(size)), size)[real.to_numpy()], table.filter(real)
    out: list[list[tuple[int | None, Line]]] = [[] for _ in range(len(size))]
    if not len(doc):
        return out
    order, line, first = numbered_pages(table, doc, TOLERANCE)
    table = table.take(pa.array(order)).combine_chunks()
    texts = table["text"].to_numpy().tolist()

    def places(name: str) -> list[float]:
        value = pc.fill_null(table[name], 0.0).to_numpy()
        return np.where(pc.is_null(table[name]).to_numpy(), NAN, np.where(np.isnan(value), INF, value)).tolist()

    x0, x1, y0 = places("x0"), places("x1"), places("y0")
    pages = table["page"].take(pa.array(first)).to_pylist()
    starts = first.tolist()
    for d, page, number, a, b in zip(doc[order][first].tolist(), pages, line[first].tolist(), starts, [*starts[1:], len(texts)]):
        said = texts[a:b]
        whole = _folded(" ".join(said))
        out[d].append((page, Line(number, whole, whole.strip(" .:"), said, x0[a:b], x1[a:b], y0[a:b])))
    return out


def _read(paged: list[tuple[int | None, Line]], images: list[dict], scanned: list[int], edges: list[dict]) -> tuple | None:
    """Head, items and signatures of one document; None if it is no form."""
    whole = " ".join([l.whole for _, l in paged])
    if not _FORM.search(_BLANKS.sub(" ", whole) if "  " in whole else whole):
        return None
    lines: dict[int | None, list[Line]] = {}
    for page, line in paged:
        lines.setdefault(page, []).append(line)
    drawn = lambda page: sorted({_number(e["x"]) for e in edges if e["page"] == page and e["x"] is not None})
    head = head_of([l for _, l in paged])
    placed = [{k: v if k == "page" else _number(v) for k, v in i.items()} for i in images]
    return [head.get(f, "") for f in W.HEAD.values()], items_of([(ls, drawn(page)) for page, ls in lines.items() if page is not None]), signed_of(paged, placed, scanned)


def read_forms(docs: DataFrame) -> DataFrame:
    """docs as for ``warehouse.form_documents`` -> doc, head (a field for each label), items (description, quantity_text) and signed (a field for each label) of those that are forms."""
    head, signed = list(W.HEAD.values()), list(W.SIGNED.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rest = zip(*(part.column(k).to_pylist() for k in ("images", "scanned", "edges")))
                read = [_read(lines, *more) for lines, more in zip(_documents(part.column("words")), rest)]
                forms = [r for r in read if r]
                fields = pa.StructArray.from_arrays([pa.array([r[0][i] for r in forms], pa.string()) for i in range(len(head))], head)
                flat = [item for r in forms for item in r[1]]
                items = pa.StructArray.from_arrays([pa.array([item[i] for item in flat], pa.string()) for i in range(2)], ["description", "quantity_text"])
                listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(r[1]) for r in forms]]), pa.int32()), items)
                marks = pa.StructArray.from_arrays([pa.array([r[2][i] for r in forms], pa.bool_()) for i in range(len(signed))], signed)
                yield pa.RecordBatch.from_arrays([part.column("doc").filter(pa.array([r is not None for r in read])), fields, listed, marks], ["doc", "head", "items", "signed"])

    fields = lambda names, t: ", ".join(f"{f}: {t}" for f in names)
    given = docs.select("doc", "words", "images", "scanned", "edges")
    return given.mapInArrow(run, f"doc string, head struct<{fields(head, 'string')}>, items array<struct<description: string, quantity_text: string>>, signed struct<{fields(signed, 'boolean')}>")
