"""Text of pages from what a reader found on them: boxes of a scan, letters in print order, and images that are stuck into a page with text.

All joins and windows stay inside a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .documents import unglue
from .layout import line_texts, raw_lines, visual_lines

# The smallest image that is read (points), the least confidence of boxes of a portal and of a receipt.
IMAGE_WIDTH, IMAGE_HEIGHT = 120.0, 18.0
PORTAL_CONFIDENCE, RECEIPT_CONFIDENCE = 0.5, 0.4


def readable(boxes: DataFrame, least: float, shortest: int = 1) -> DataFrame:
    """Boxes (text, confidence as text, ...) that count: confident enough, or of unknown confidence, and with enough characters."""
    sure = F.col("confidence").cast("string").try_cast("double")
    return boxes.withColumn("text", F.btrim("text", F.lit(" \t\r\n"))).where((F.isnull(sure) | F.isnan(sure) | (sure >= least)) & (F.length("text") >= shortest))


def box_lines(boxes: DataFrame) -> DataFrame:
    """boxes (doc, page, box_no, text, x0, x1, y0, y1) -> doc, page, line_no (from 1), line: rows of a scan.

    Boxes come by the middle of their height. A box joins the row before it if it is as high as the mean of that row's boxes, up to half the tallest box's height (six
    points at least); only then rows are read from left to right.
    """
    box = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("middle"), "box_no", "x0", (F.col("y1") - F.col("y0")).alias("tall"), "text")
    page = boxes.groupBy("doc", "page").agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    start = F.struct(F.lit(0).alias("row"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0.0).alias("tall"), F.array().cast("array<int>").alias("rows"))

    def take(s: Column, b: Column) -> Column:
        fits = (s["n"] > 0) & (F.abs(b["middle"] - s["sum"] / s["n"]) <= F.greatest(F.lit(6.0), 0.5 * F.greatest(b["tall"], s["tall"])))
        row = s["row"] + F.when(fits, 0).otherwise(1)
        return F.struct(
            row.alias("row"), F.when(fits, s["sum"] + b["middle"]).otherwise(b["middle"]).alias("sum"), F.when(fits, s["n"] + 1).otherwise(1).alias("n"),
            F.when(fits, F.greatest(s["tall"], b["tall"])).otherwise(b["tall"]).alias("tall"), F.array_append(s["rows"], row).alias("rows"))

    rows = page.withColumn("rows", F.aggregate("boxes", start, take, lambda s: s["rows"]))
    each = rows.select("doc", "page", F.explode(F.arrays_zip("boxes", "rows")).alias("b")).select("doc", "page", F.col("b.rows").alias("line_no"), "b.boxes.*")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "middle", "box_no", "text"))), lambda b: b["text"]), " ")
    return each.groupBy("doc", "page", "line_no").agg(text.alias("line"))


def squeezed(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s|_]+", "")


def with_raw_lines(lines: DataFrame, chars: DataFrame) -> DataFrame:
    """lines (doc, page, line_no, line) and the letters of the pages (doc, page, top, x0, ch) -> doc, text.

    A stamp may come out letter by letter. The lines that the same letters make in print order, and only of spelled-out lines, are added at the end of the
    text, so that nothing is read twice.
    """
    spelled = lines.where(X.spelled_out(F.col("line"))).select("doc", squeezed(F.col("line")).alias("key")).distinct()
    raw = raw_lines(chars).where(~X.spelled_out(F.col("text"))).withColumn("key", squeezed(F.col("text"))).join(spelled, ["doc", "key"], "left_semi")
    order = lambda d, more: d.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct(*more))), lambda x: x[more[-1]]).alias("ls"))
    own = order(lines, ["page", "line_no", "line"])
    added = order(raw, ["page", "bucket", "text"]).withColumnRenamed("ls", "more")
    return own.join(added, "doc", "left").select("doc", F.array_join(F.concat("ls", F.coalesce("more", F.array().cast("array<string>"))), "\n").alias("text"))


def image_lines(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """boxes (doc, page, word_no, text, x0, x1, y0, y1) and images (doc, page, x0, x1, y0, y1) -> doc, page, read_no, top, line.

    Only boxes whose centre lies in an image count, and only images of a size that isn't an icon's. Lost spaces are put back.
    """
    big = images.where((F.col("x1") - F.col("x0") >= IMAGE_WIDTH) & (F.col("y1") - F.col("y0") >= IMAGE_HEIGHT))
    i = big.select("doc", "page", *[F.col(c).alias("i" + c) for c in ("x0", "x1", "y0", "y1")])
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = x.between(F.col("ix0"), F.col("ix1")) & y.between(F.col("iy0"), F.col("iy1"))
    held = boxes.where(F.trim("text") != "").join(i, ["doc", "page"]).where(inside).select(boxes.columns).dropDuplicates(["doc", "page", "word_no"])
    return line_texts(visual_lines(held)).select("doc", "page", F.col("line_no").alias("read_no"), F.col("y0").alias("top"), unglue(F.col("text")).alias("line"))


def spliced(lines: DataFrame, read: DataFrame) -> DataFrame:
    """lines (doc, page, line_no, line, top) with lines read in images (doc, page, read_no, top, line) put between them: doc, page, line_no, line.

    A read line goes below the line that is nearest above it, be it the page's or read before it; below the first line with that text, if there are several. One
    with nothing above it goes to the end of the page.
    """
    first = F.min("line_no").over(Window.partitionBy("doc", "page", F.trim("line")))
    text = lines.withColumn("first_no", first).select("doc", "page", "top", F.lit(None).cast("int").alias("read_no"), "line", F.struct("top", (-F.col("line_no")).alias("back"), "first_no").alias("t"), "line_no")
    both = text.unionByName(read.select("doc", "page", "top", "read_no", "line"), allowMissingColumns=True)
    above = Window.partitionBy("doc", "page").orderBy((F.col("top") * 1000).cast("long")).rangeBetween(Window.unboundedPreceding, -1)
    seen = both.withColumns({"anchor": F.max("t").over(above), "before": F.max(F.when(F.col("read_no").isNotNull(), F.col("top"))).over(above)})
    own = seen.where("read_no IS NULL").select("doc", "page", "line", F.struct(F.col("line_no").cast("long").alias("a"), F.lit(0).alias("b"), F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("d"), F.lit(0).alias("e")).alias("place"))
    opens = F.col("before").isNull() | (F.col("anchor.top") >= F.col("before"))
    along = Window.partitionBy("doc", "page").orderBy("top", "read_no")
    new = seen.where("read_no IS NOT NULL").withColumn("opens", F.coalesce(opens, F.lit(False)).cast("int"))
    new = new.withColumn("chain", F.sum("opens").over(along))
    chain = Window.partitionBy("doc", "page", "chain")
    at = F.first(F.when(F.col("opens") == 1, F.col("anchor.first_no")), ignorenulls=True).over(chain)
    new = new.withColumn("at", at)
    # what is put below one line later stands above what was put there before
    turn = F.when(F.col("at").isNull(), F.col("chain")).otherwise(-F.col("chain"))
    new = new.select("doc", "page", "line", F.struct(F.coalesce("at", F.lit(1 << 40)).cast("long").alias("a"), F.lit(1).alias("b"), turn.cast("long").alias("c"), F.col("top").cast("double").alias("d"), (-F.col("read_no")).alias("e")).alias("place"))
    return own.unionByName(new).select("doc", "page", F.row_number().over(Window.partitionBy("doc", "page").orderBy("place")).alias("line_no"), "line")


def page_texts(pages: DataFrame, lines: DataFrame, read: DataFrame, boxes: DataFrame) -> DataFrame:
    """pages (doc, page) with their text lines, lines read in images (see ``spliced``) and boxes of a scan (see ``image_lines``) -> doc, page, text, scanned.

    A page without text in its lines takes the rows of its scan, with lost spaces put back; scanned tells that its text comes from there, and is worth a second look. A page with neither is
    blank. Images are read only on pages that have text.
    """
    joined = lambda d: d.groupBy("doc", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    own = joined(lines).where(F.regexp_replace("text", r"\s", "") != "").select("doc", "page")
    with_text = joined(spliced(lines.join(own, ["doc", "page"], "left_semi"), read.join(own, ["doc", "page"], "left_semi")))
    rest = pages.select("doc", "page").join(own, ["doc", "page"], "left_anti")
    rows = line_texts(visual_lines(boxes.where(F.trim("text") != "").join(rest, ["doc", "page"], "left_semi")))
    seen = joined(rows.select("doc", "page", "line_no", unglue(F.col("text")).alias("line"))).withColumnRenamed("text", "seen")
    out = pages.select("doc", "page").join(with_text, ["doc", "page"], "left").join(seen, ["doc", "page"], "left")
    return out.select("doc", "page", F.coalesce("text", "seen", F.lit("")).alias("text"), (F.coalesce("seen", F.lit("")) != "").alias("scanned"))
