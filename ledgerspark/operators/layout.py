"""Words with coordinates: visual lines, columns, bands, labels with their values, and signatures.

Joins on positions are bounded by page: one page's words meet, never a document's or a table's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _line_numbers(page: list[tuple], tolerance: float) -> list[int]:
    """The line of each word (y0 and y1 last) of a page in order of (y0, x0).

    Words come downwards, so a line whose reach ends above a word's top takes no later word either: only the lines still in reach are looked at.
    """
    tops: list[float] = []
    bottoms: list[float] = []
    reach: list[float] = []
    live: list[int] = []
    at = []
    for *_, y0, y1 in page:
        k = None
        known = y0 is not None and y1 is not None
        if known:
            low, middle, near = min(y0, y1), (y0 + y1) / 2, []
            for i in live:
                centre = (tops[i] + bottoms[i]) / 2
                if centre + reach[i] >= low:
                    near.append(i)
                    if k is None and abs(middle - centre) <= reach[i]:
                        k = i
            live = near
        if k is None:
            k = len(tops)
            tops.append(y0 if known else float("inf"))
            bottoms.append(y1 if known else float("inf"))
            reach.append(max(tolerance, (y1 - y0) / 2) if known else float("inf"))
            live += [k] * known
        else:
            tops[k], bottoms[k] = min(tops[k], y0), max(bottoms[k], y1)
        at.append(k)
    rank = {k: i for i, k in enumerate(sorted(range(len(tops)), key=lambda i: (tops[i], i)))}
    return [rank[k] for k in at]


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Places at which the keys of a sorted table change; the first row is one."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for key in keys:
        code = pc.fill_null(pc.dictionary_encode(table[key].combine_chunks()).indices, -1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """A sorted stream as tables in which no group of equal keys is cut, with the places at which groups start."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = _starts(pa.Table.from_batches([batch]), keys)[-1]
        goes_on = held and all(held[-1][k][-1] == batch[k][0] or not (held[-1][k][-1].is_valid or batch[k][0].is_valid) for k in keys)
        if last or (held and not goes_on):
            table = pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
            yield table, _starts(table, keys)
        else:
            held.append(batch)
    if held:
        table = pa.Table.from_batches(held)
        yield table, _starts(table, keys)


def _numbered(table: pa.Table, starts: np.ndarray, tolerance: float) -> np.ndarray:
    """The line of each word of pages that start at the given places.

    Words in a row with one top and one bottom, which is no higher, go to one line, so that they are placed once.
    """
    edges = [c.combine_chunks() for c in (table["y0"], table["y1"])]
    top, bottom = (pc.fill_null(c, np.nan).to_numpy(zero_copy_only=False) for c in edges)
    new = np.ones(len(top), bool)
    new[1:] = ~((top[1:] == top[:-1]) & (bottom[1:] == bottom[:-1]) & (bottom[1:] >= top[1:]))
    new[starts] = True
    first = np.flatnonzero(new)
    heights = list(zip(*(c.take(pa.array(first)).to_pylist() if c.null_count else v[first].tolist() for c, v in zip(edges, (top, bottom)))))
    pages = np.searchsorted(first, starts).tolist()
    at = np.array([k for a, b in zip(pages, [*pages[1:], len(heights)]) for k in _line_numbers(heights[a:b], tolerance)], np.int32)
    return np.repeat(at, np.diff(np.append(first, len(top))))


TOLERANCE = 6.0
SCHEMA = "doc string, page int, word_no int, text string, x0 double, x1 double, y0 double, y1 double"


def _typed(words: DataFrame) -> DataFrame:
    return words.select(*[F.col(part.split()[0]).cast(part.split()[1]) for part in SCHEMA.split(", ")])


def visual_lines(words: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """words (doc, page, word_no, text, x0, x1, y0, y1) -> words with their line number on the page.

    In order of (y0, x0) a word joins the first line whose centre, the middle between its words' top and bottom, is within the tolerance or half the
    first word's height; else it opens a line. A word without a height has a line of its own, after the others. The order matters, so the
    words are read as a stream sorted by page, and one page at a time is held.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole(batches, ["doc", "page"]):
            yield from table.append_column("line_no", pa.array(_numbered(table, starts, tolerance))).combine_chunks().to_batches()

    return _typed(words).repartition("doc", "page").sortWithinPartitions("doc", "page", "y0", "x0", "word_no").mapInArrow(fold, SCHEMA + ", line_no int")


def _order(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Keys for ``np.lexsort``, less important first, that order numbers as Spark does: nulls first, NaN last."""
    null = pc.is_null(column).to_numpy()
    value = np.where(null, 0, pc.fill_null(column, 0).to_numpy())
    return [value, ~null]


def numbered_words(table: pa.Table, doc: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of documents whose pages are stacked, doc the place of each word's document -> the words' order by document, line and place from left to right, and in that order their lines and numbers.

    Lines and numbers are those of ``gathered_lines``.
    """
    down = np.lexsort([*_order(table["word_no"]), *_order(table["page"]), *_order(table["x0"]), *_order(table["y0"]), doc])
    doc, table = doc[down], table.take(pa.array(down)).combine_chunks()
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]][:len(doc)])
    line = _numbered(table, starts, tolerance)
    number, first = np.empty(len(doc), np.int32), np.repeat(starts, np.diff(np.append(starts, len(doc))))
    placed = np.lexsort([*_order(table["word_no"]), *_order(table["page"]), doc])
    number[placed] = np.arange(len(doc)) - first[placed] + 1
    along = np.lexsort([number, *_order(table["x0"]), line, doc])
    return down[along], line[along], number[along]


def gathered_lines(words: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """words as for ``visual_lines``, of documents whose pages are stacked -> doc, line_no, y0 and y1 (its top and bottom), ws: the line's words from left to right.

    word_no becomes the word's number in the document by page and number. The stream that numbers the lines gathers them, too, so words are shuffled once.
    """
    word = "x0 double, word_no int, x1 double, y0 double, y1 double, text string"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole(batches, ["doc"]):
            n = table.num_rows
            doc = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
            line = _numbered(table, starts, tolerance)
            number = np.empty(n, np.int32)
            placed = np.lexsort([*_order(table["word_no"]), *_order(table["page"]), doc])
            number[placed] = np.arange(n) - starts[doc[placed]] + 1
            along = np.lexsort([number, *_order(table["x0"]), line, doc])
            doc, line, table = doc[along], line[along], table.take(pa.array(along)).combine_chunks()
            first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])))
            one = {c: table[c].combine_chunks() for c in ("doc", "x0", "x1", "y0", "y1", "text")}
            fields = [("x0", one["x0"]), ("word_no", pa.array(number[along])), ("x1", one["x1"]), ("y0", one["y0"]), ("y1", one["y1"]), ("text", one["text"])]
            ws = pa.ListArray.from_arrays(pa.array(np.append(first, n), pa.int32()), pa.StructArray.from_arrays([a for _, a in fields], [k for k, _ in fields]))

            def edge(name: str, best: np.ufunc, none: float) -> pa.Array:
                null = pc.is_null(one[name]).to_numpy(zero_copy_only=False)
                return pa.array(best.reduceat(np.where(null, none, pc.fill_null(one[name], 0.0).to_numpy()), first), mask=np.logical_and.reduceat(null, first))

            top, bottom = edge("y0", np.fmin, np.nan), edge("y1", np.maximum, -np.inf)  # NaN is the largest number in Spark
            yield pa.RecordBatch.from_arrays([one["doc"].take(pa.array(first)), pa.array(line[first]), ws, top, bottom], ["doc", "line_no", "ws", "y0", "y1"])

    placed = _typed(words).repartition("doc").sortWithinPartitions("doc", "y0", "x0", "page", "word_no")
    return placed.mapInArrow(fold, f"doc string, line_no int, ws array<struct<{', '.join(w.replace(' ', ': ') for w in word.split(', '))}>>, y0 double, y1 double")


def numbered_pages(table: pa.Table, doc: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of documents, doc the place of each word's document -> the words' order by document, page, line and place from left to right, in that order their lines, and where lines start.

    Lines are those of ``visual_lines``.
    """
    down = np.lexsort([*_order(table["word_no"]), *_order(table["x0"]), *_order(table["y0"]), *_order(table["page"]), doc])
    placed = table.take(pa.array(down)).combine_chunks()
    page = pc.fill_null(placed["page"], -1).to_numpy()
    starts = np.flatnonzero(np.r_[True, (doc[down][1:] != doc[down][:-1]) | (page[1:] != page[:-1])][:len(doc)])
    line = _numbered(placed, starts, tolerance)
    along = np.lexsort([*_order(placed["word_no"]), *_order(placed["x0"]), line, page, doc[down]])
    order, line, page = down[along], line[along], page[along]
    new = np.r_[True, (doc[order][1:] != doc[order][:-1]) | (page[1:] != page[:-1]) | (line[1:] != line[:-1])][:len(doc)]
    return order, line, np.flatnonzero(new)


def line_texts(words: DataFrame) -> DataFrame:
    """Words with line numbers -> one text per line, words from left to right."""
    return words.groupBy("doc", "page", "line_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "word_no", "text"))), lambda w: w["text"]), " ").alias("text"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))


def raw_lines(chars: DataFrame) -> DataFrame:
    """Letters (doc, page, top, x0, ch) joined in print order, by thirds of their top: lines without the spaces that a reader invents. Blank ones go."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "ch"))), lambda c: c["ch"]), "")
    rows = chars.groupBy("doc", "page", F.bround(F.col("top") / 3).cast("int").alias("bucket")).agg(F.regexp_replace(F.trim(text), " {2,}", " ").alias("text"))
    return rows.where("text <> ''")


def merge_intervals(df: DataFrame, keys: list[str], slack: float) -> DataFrame:
    """x0, x1 -> groups of intervals that touch within the slack: the running end of earlier ones tells where a group starts."""
    w = Window.partitionBy(*keys).orderBy("x0", "x1")
    end = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(end.isNull() | (F.col("x0") > end + slack), 1).otherwise(0))
    return marked.withColumn("grp", F.sum("_new").over(w)).groupBy(*keys, "grp").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count(F.lit(1)).alias("n"))


def bands(anchors: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Anchors -> the stretch that each owns: from halfway to the one before to halfway to the one after."""
    w = Window.partitionBy(*keys).orderBy(at)
    low = (F.lag(at).over(w) + F.col(at)) / 2
    high = (F.lead(at).over(w) + F.col(at)) / 2
    return anchors.withColumns({"low": F.coalesce(low, F.lit(float("-inf"))), "high": F.coalesce(high, F.lit(float("inf"))), "band": F.row_number().over(w)})


def table_cells(words: DataFrame, row_anchors: DataFrame, column_anchors: DataFrame) -> DataFrame:
    """Words fall into row bands by the middle of their height and into column bands by the middle of their width."""
    rows = bands(row_anchors, ["doc", "page"], "y").select("doc", "page", F.col("band").alias("row"), F.col("low").alias("row_low"), F.col("high").alias("row_high"))
    cols = bands(column_anchors, ["doc", "page"], "x").select("doc", "page", "name", F.col("low").alias("col_low"), F.col("high").alias("col_high"))
    y, x = (F.col("y0") + F.col("y1")) / 2, (F.col("x0") + F.col("x1")) / 2
    in_row = words.join(rows, ["doc", "page"]).where((y >= F.col("row_low")) & (y < F.col("row_high")))
    cell = in_row.join(cols, ["doc", "page"]).where((x >= F.col("col_low")) & (x < F.col("col_high")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y0", "x0", "text"))), lambda w: w["text"]), " ")
    return cell.groupBy("doc", "page", "row", "name").agg(text.alias("text"))


def value_beside(words: DataFrame, labels: DataFrame, reach: float = 70.0, by: tuple[str, ...] = ()) -> DataFrame:
    """labels (doc, page, label, x0, x1, y0, y1) -> the value of each; by names more columns that tell equal labels of a page apart.

    A label without a colon takes the highest word that starts at its left edge, up to 2.5 of its heights below it. Else, and where there is
    none, the first word to its right on its height counts, then the highest below it within reach.
    """
    l = labels.select("doc", "page", "label", *by, *[F.col(c).alias("l" + c) for c in ("x0", "x1", "y0", "y1")])
    j = words.join(l, ["doc", "page"]).withColumn("tall", F.greatest(F.col("ly1") - F.col("ly0"), F.lit(1.0)))
    drop = F.col("y0") - F.col("ly1")
    aligned = ~F.rtrim("label").endswith(":") & (drop >= 0) & (drop < 2.5 * F.col("tall")) & (F.abs(F.col("x0") - F.col("lx0")) < 0.8 * F.col("tall"))
    right = (F.col("x0") > F.col("lx1") - 5) & (F.col("y0") < F.col("ly1")) & (F.col("y1") > F.col("ly0"))
    below = (drop >= -4) & (drop < reach) & (F.col("x0") < F.col("lx1") + 40) & (F.col("x1") > F.col("lx0") - 40)
    rank = lambda way, by: F.struct(F.lit(way).alias("way"), F.col(by).alias("at"), F.col("word_no"))
    place = F.when(aligned, rank(0, "y0")).when(right, rank(1, "x0")).when(below, rank(2, "y0"))
    return j.withColumn("p", place).where("p IS NOT NULL").groupBy("doc", "page", "label", *by).agg(F.min_by("text", "p").alias("value"))


def signatures(labels: DataFrame, images: DataFrame, scanned: DataFrame, above: float = 70.0, under: float = 6.0) -> DataFrame:
    """Whether an image stands over each label; unknown on scanned pages. scanned: doc, page."""
    i = images.select("doc", "page", F.col("x0").alias("ix0"), F.col("x1").alias("ix1"), F.col("bottom"))
    over = (F.col("ix0") < F.col("x1")) & (F.col("ix1") > F.col("x0")) & (F.col("bottom") >= F.col("y0") - above) & (F.col("bottom") <= F.col("y0") + under)
    seen = labels.join(i, ["doc", "page"]).where(over).select("doc", "page", "label").distinct().withColumn("seen", F.lit(True))
    flat = scanned.select("doc", "page").distinct().withColumn("flat", F.lit(True))
    out = labels.join(seen, ["doc", "page", "label"], "left").join(flat, ["doc", "page"], "left")
    return out.select("doc", "page", "label", F.when(F.col("flat"), F.lit(None).cast("boolean")).otherwise(F.coalesce("seen", F.lit(False))).alias("signed"))


def page_signature(lines: Column) -> Column:
    return F.sha2(F.array_join(lines, "\n"), 256)


def without_repeated_pages(pages: DataFrame) -> DataFrame:
    """Pages (doc, page, text) less those whose whole text equals an earlier page of the document; equal lines stay."""
    first = Window.partitionBy("doc", F.sha2("text", 256)).orderBy("page")
    return pages.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


# A quantity column's title, rows that end the items, and reaches in points.
QUANTITY_TITLE = r"(?i)^(?:cant|cantidad|cant\.|qty)"
ITEMS_END = r"(?i)^(?:subtotal|total|totales|son|valor\s+en\s+letras|impuestos|iva|retefuente|reteiva|reteica|descuento|redondeo|base|observaciones)\b"
QUANTITY_REACH, ROW_STEP = 45.0, 4.0


def quantity_rows(words: DataFrame, pages: DataFrame) -> DataFrame:
    """words (doc, page, word_no, text, x0, x1, y0, y1) and pages (doc, page, height) -> doc, page, row, header, raw, quantity, description.

    Numbers under the page's first title of a quantity column count, within reach of its centre, down to the first row that opens with a total. Of several in a row the
    one nearest to the centre counts. The description is the rest of the row without codes and amounts.
    """
    from ..functions.numbers import simple

    t, page = F.trim("text"), Window.partitionBy("doc", "page")
    placed = words.withColumns({"bucket": F.bround(F.col("y0") / ROW_STEP).cast("long"), "centre": (F.col("x0") + F.col("x1")) / 2, "height": F.lit(None).cast("double"), "is_word": F.lit(True)})
    placed = placed.withColumn("title", F.when(t.rlike(QUANTITY_TITLE) & ~F.lower(t).startswith("cantidades"), F.struct(t.alias("header"), F.col("centre").alias("at"), F.col("y1").alias("under"))))
    # a document's words come together once, with its pages' heights; pages, rows and repeated pages are windows and groups inside it
    both = placed.unionByName(pages.select("doc", "page", F.col("height").cast("double").alias("height")), allowMissingColumns=True).where("doc IS NOT NULL AND page IS NOT NULL").repartition("doc")
    first = F.min_by("title", F.when(F.col("title").isNotNull(), F.col("word_no"))).over(page)
    both = both.withColumns({"h": first, "height": F.max("height").over(page)}).where("is_word AND h IS NOT NULL")
    word = F.struct("x0", "word_no", "text", "y0", "centre")
    rows = both.groupBy("doc", "page", "bucket").agg(F.sort_array(F.collect_list(word)).alias("ws"), F.first("h").alias("h"), F.first("height").alias("height"))
    rows = rows.withColumns({"opens": F.get("ws", 0)["y0"], "said": F.array_join(F.transform("ws", lambda w: w["text"]), " ")})
    under = F.col("h.under")
    end = F.min(F.when((F.col("opens") > under + 10) & F.trim("said").rlike(ITEMS_END), F.col("opens"))).over(page)
    rows = rows.withColumn("limit", F.least(end, F.col("height")))
    far = lambda w: F.abs(w["centre"] - F.col("h.at"))
    counts = lambda w: (w["y0"] > under + 1) & (F.col("limit").isNull() | (w["y0"] < F.col("limit"))) & (far(w) <= QUANTITY_REACH) & w["text"].rlike("^[0-9.,]+$")
    near = F.transform(F.filter("ws", counts), lambda w: F.struct(far(w).alias("far"), w["word_no"].alias("word_no"), w["text"].alias("text")))
    out = rows.withColumn("near", near).where("size(near) > 0").withColumns({"n": F.array_min("near"), "first": F.array_min(F.col("near")["word_no"])})
    rest = F.filter("ws", lambda w: (w["word_no"] != F.col("n.word_no")) & ~w["text"].rlike("^[0-9]{7,}$") & ~w["text"].rlike(r"^\$?[0-9.,]*[.,][0-9.,]*$"))
    out = out.withColumn("quantity", simple(F.col("n.text"))).where("quantity > 0")
    number = F.row_number().over(page.orderBy("first"))
    return out.select("doc", "page", number.alias("row"), F.col("h.header").alias("header"), F.col("n.text").alias("raw"), "quantity", F.left(F.array_join(F.transform(rest, lambda w: w["text"]), " "), F.lit(160)).alias("description"))


def column_quantity(words: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, header, quantity (sum) and rows of ``quantity_rows``; a page that repeats an earlier one's quantities, all of them, is not counted again."""
    rows = quantity_rows(words, pages)
    page = rows.groupBy("doc", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "raw"))), lambda r: r["raw"]).alias("signature"), F.sum("quantity").alias("q"), F.count(F.lit(1)).alias("n"), F.min("header").alias("header"))
    first = page.groupBy("doc", "signature").agg(F.min(F.struct("page", "q", "n", "header")).alias("p"))
    return first.groupBy("doc").agg(F.min_by("p.header", "p.page").alias("header"), F.round(F.sum("p.q"), 2).alias("quantity"), F.sum("p.n").alias("rows"))
