"""The warehouse's form of received goods: head fields, item table and signatures from words with places.

Spans of words, columns and rows come from windows and joins that stay inside a page. ``forms`` gives each document as one row: what the steps do over rows, it does
over the document's arrays, so that its words are moved once at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from .layout import merge_intervals

# Labels with their fields, words of column titles with theirs, signature labels, and what tells a form.
HEAD = {"fecha de recibo": "received_on", "proveedor": "supplier", "factura": "invoice", "orden de compra": "order_no", "numero de ingreso": "entry_no", "nacional": "national", "importado": "imported"}
COLUMNS = {"codigo": "code", "siigo": "code", "descripcion": "description", "um": "unit", "cantidad": "quantity", "recibida": "quantity", "observaciones": "remarks"}
MORE_TITLES = ["descripcion", "siigo", "recibida", "observaciones"]
SIGNED = {"auxiliar de almacen": "helper", "supervisor de almacen": "supervisor"}
IS_FORM = "relacion de mercancia recibida|f-co-110"
LONGEST_LABEL, GAP = 4, 8.0


def label_spans(words: DataFrame, labels: dict[str, str]) -> DataFrame:
    """words with line_no -> the labels in their lines: doc, page, line_no, field, x0, x1, y0, y1.

    At each word the longest label of up to four words that starts there counts, unless an earlier label took the word.
    """
    along = Window.partitionBy("doc", "page", "line_no").orderBy("x0", "word_no")
    span = along.rowsBetween(0, LONGEST_LABEL - 1)
    near = F.collect_list(F.struct("text", "x1", "y0", "y1")).over(span)
    field_of = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    said = F.transform(F.sequence(F.size("near"), F.lit(1)), lambda n: X.normalise(F.array_join(F.transform(F.slice("near", F.lit(1), n), lambda w: w["text"]), " ")))
    rows = words.withColumns({"at": F.row_number().over(along), "near": near}).withColumn("said", said)
    known = F.filter(F.transform("said", lambda s, i: F.struct((F.size("near") - i).alias("n"), field_of[s].alias("field"))), lambda o: o["field"].isNotNull())
    hit = rows.withColumn("hit", F.get(known, 0)).where("hit IS NOT NULL")
    before = F.max(F.col("at") + F.col("hit.n")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    free = hit.withColumn("end", before).where(F.col("end").isNull() | (F.col("at") >= F.col("end")))
    used = F.slice("near", 1, F.col("hit.n"))
    return free.select("doc", "page", "line_no", F.col("hit.field").alias("field"), "x0", F.array_max(F.transform(used, lambda w: w["x1"])).alias("x1"), F.array_min(F.transform(used, lambda w: w["y0"])).alias("y0"), F.array_max(F.transform(used, lambda w: w["y1"])).alias("y1"))


def head_fields(lined: DataFrame) -> DataFrame:
    """Each label keeps the words at its right up to the next label of its line; of a repeated field the first counts. doc, field, value."""
    spans = label_spans(lined, HEAD).withColumn("stop", F.coalesce(F.lead("x0").over(Window.partitionBy("doc", "page", "line_no").orderBy("x0")), F.lit(float("inf"))))
    s = spans.select("doc", "page", "line_no", "field", F.col("x0").alias("lx0"), F.col("x1").alias("lx1"), "stop")
    words = lined.select("doc", "page", "line_no", "word_no", "text", "x0", "x1")
    inside = (F.col("x0") >= F.col("lx1") - 1) & (F.col("x1") <= F.col("stop") + 1)
    j = s.join(words, ["doc", "page", "line_no"]).where(inside).groupBy("doc", "page", "line_no", "field", "lx0").agg(F.sort_array(F.collect_list(F.struct("x0", "word_no", "text"))).alias("w"))
    found = s.join(j, ["doc", "page", "line_no", "field", "lx0"], "left").select("doc", "field", F.struct("page", "line_no", "lx0").alias("at"), F.coalesce(F.array_join(F.transform("w", lambda w: w["text"]), " "), F.lit("")).alias("value"))
    return found.groupBy("doc", "field").agg(F.trim(F.min_by("value", "at")).alias("value"))


def title_columns(lined: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Columns of the item table: doc, page, last (last line of the titles), column, name, x0, x1, low, high.

    The titles are the first line of a page with "codigo" and "cantidad" and up to three lines after it that hold more title words. Words
    that touch within 8 points are one title; a column reaches halfway to its neighbours. edges (doc, page, x), the vertical
    lines drawn at the height of the first item, set the columns instead where a page has three or more. The outer columns reach to the page's ends.
    """
    line = lined.groupBy("doc", "page", "line_no").agg(X.normalise(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "word_no", "text"))), lambda w: w["text"]), " ")).alias("said"))
    page = Window.partitionBy("doc", "page").orderBy("line_no")
    more = F.col("said").rlike("|".join(MORE_TITLES)).cast("int")
    line = line.withColumns({"start": F.col("said").contains("codigo") & F.col("said").contains("cantidad"), **{f"m{i}": F.coalesce(F.lead(more, i).over(page), F.lit(0)) for i in (1, 2, 3)}})
    extra = F.col("m1") + F.col("m1") * F.col("m2") + F.col("m1") * F.col("m2") * F.col("m3")
    first = line.where("start").groupBy("doc", "page").agg(F.min_by(F.struct(F.col("line_no").alias("start"), (F.col("line_no") + extra).alias("last")), "line_no").alias("t")).select("doc", "page", "t.*")
    titles = lined.join(first, ["doc", "page"]).where(F.col("line_no").between(F.col("start"), F.col("last")))
    between = Window.partitionBy("doc", "page").orderBy("x0", "x1")
    groups = merge_intervals(titles, ["doc", "page", "last"], GAP).withColumns({"low": F.coalesce((F.lag("x1").over(between) + F.col("x0")) / 2, F.lit(float("-inf"))), "high": F.coalesce((F.lead("x0").over(between) + F.col("x1")) / 2, F.lit(float("inf")))})
    spans = groups.select("doc", "page", "last", "low", "high")
    if edges is not None:
        e = edges.select("doc", "page", F.col("x").alias("low")).distinct().withColumns({"high": F.lead("low").over(Window.partitionBy("doc", "page").orderBy("low")), "drawn": F.count(F.lit(1)).over(Window.partitionBy("doc", "page"))}).where("drawn >= 3 AND high IS NOT NULL")
        drawn = e.join(first.select("doc", "page", "last"), ["doc", "page"]).select("doc", "page", "last", "low", "high")
        spans = spans.join(drawn.select("doc", "page").distinct(), ["doc", "page"], "left_anti").unionByName(drawn)
    middle = (F.col("t.x0") + F.col("t.x1")) / 2
    t = titles.select("doc", "page", F.struct("text", "x0", "x1", "y0", "word_no").alias("t"))
    word = F.when((middle >= F.col("low")) & (middle < F.col("high")), F.struct("t.y0", "t.x0", "t.word_no", "t.text"))
    said = spans.join(t, ["doc", "page"]).groupBy("doc", "page", "last", "low", "high").agg(X.normalise(F.array_join(F.transform(F.sort_array(F.collect_list(word)), lambda w: w["text"]), " ")).alias("said"))
    name = F.coalesce(*[F.when(F.col("said").contains(k), v) for k, v in COLUMNS.items()], F.nullif(F.col("said"), F.lit("")))
    number = F.row_number().over(Window.partitionBy("doc", "page").orderBy("low"))
    outer = said.withColumns({"column": number, "columns": F.count(F.lit(1)).over(Window.partitionBy("doc", "page"))})
    low, high = F.when(F.col("column") == 1, float("-inf")).otherwise(F.col("low")), F.when(F.col("column") == F.col("columns"), float("inf")).otherwise(F.col("high"))
    return outer.select("doc", "page", "last", "column", F.coalesce(name, F.concat(F.lit("col"), (F.col("column") - 1).cast("string"))).alias("name"), low.alias("low"), high.alias("high"))


def item_rows(lined: DataFrame, columns: DataFrame) -> DataFrame:
    """doc, page, line_no, code, description, unit, quantity_text, quantity of the lines from the first titles to the signatures, over all pages; lines with neither description nor quantity go.

    A page without titles goes on with the columns of the last page that had any.
    """
    line = lined.groupBy("doc", "page", "line_no").agg(X.normalise(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "word_no", "text"))), lambda w: w["text"]), " ")).alias("said"))
    titled = columns.groupBy("doc", "page").agg(F.max("last").alias("last"))
    pages = lined.select("doc", "page").distinct().join(titled, ["doc", "page"], "left")
    source = F.last(F.when(F.col("last").isNotNull(), F.col("page")), ignorenulls=True).over(Window.partitionBy("doc").orderBy("page"))
    pages = pages.withColumn("source", source).where("source IS NOT NULL").select("doc", "page", "source", F.coalesce("last", F.lit(-1)).alias("last"))
    under = line.join(pages, ["doc", "page"]).where(F.col("line_no") > F.col("last"))
    at = F.struct("page", "line_no")
    foot = under.where(F.col("said").rlike("|".join(SIGNED))).groupBy("doc").agg(F.min(at).alias("foot"))
    body = under.join(foot, "doc", "left").where(F.col("foot").isNull() | (at < F.col("foot"))).select("doc", "page", "line_no", "source")
    columns = columns.withColumnRenamed("page", "source")
    middle = (F.col("x0") + F.col("x1")) / 2
    cells = lined.join(body, ["doc", "page", "line_no"]).join(columns.select("doc", "source", "name", "low", "high"), ["doc", "source"]).where((middle >= F.col("low")) & (middle < F.col("high")))
    cell = lambda n: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("name") == n, F.struct("x0", "word_no", "text")))), lambda w: w["text"]), " ")
    rows = cells.groupBy("doc", "page", "line_no").agg(cell("code").alias("code"), cell("description").alias("description"), cell("unit").alias("unit"), cell("quantity").alias("quantity_text"))
    return rows.where("description <> '' OR quantity_text <> ''").withColumn("quantity", N.form_quantity(F.col("quantity_text")))


def form_documents(docs: DataFrame) -> DataFrame:
    """docs (doc, words: array of page, word_no, text, x0, x1, y0, y1; images: array of page, x0, x1, bottom; scanned: array of pages; edges: array of page, x) -> ``forms`` of them.

    A document is one row in every step, so its words are neither shuffled nor written.
    """
    from .form_documents import read_forms

    plain = lambda c: F.regexp_replace(c, "[^0-9A-Za-z-]", "")
    read = read_forms(docs).select(
        "doc", "head.received_on", F.regexp_replace("head.supplier", r"\s+", " ").alias("supplier"), plain(F.col("head.invoice")).alias("invoice"), plain(F.col("head.order_no")).alias("order_no"), "head.entry_no",
        F.transform("items", lambda r: N.form_quantity(r["quantity_text"])).alias("items"), "signed.*")
    total = lambda qs: F.aggregate(qs, F.lit(None).cast("double"), lambda a, q: F.coalesce(a + q, a, q))
    return read.select("doc", "received_on", "supplier", "invoice", "order_no", "entry_no", F.size("items").cast("long").alias("items"), total(F.col("items")).alias("quantity"), *SIGNED.values())


def forms(words: DataFrame, images: DataFrame, scanned: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """words (doc, page, word_no, text, x0, x1, y0, y1), images (doc, page, x0, x1, bottom), scanned (doc, page) -> one row per form.

    Documents without the form's title give no row. Head fields that are not there are blank; quantity is the sum of the items' readable
    quantities, null where there is none; a signature is unknown without its label or on a scanned page.
    """
    typed = lambda *cs: F.collect_list(F.struct(*[F.col(c).cast(t).alias(c) for c, t in cs]))
    page, place = ("page", "int"), [(c, "double") for c in ("x0", "x1")]
    docs = words.groupBy(F.col("doc").cast("string").alias("doc")).agg(typed(page, ("word_no", "int"), ("text", "string"), *place, ("y0", "double"), ("y1", "double")).alias("words"))
    docs = docs.join(images.groupBy("doc").agg(typed(page, *place, ("bottom", "double")).alias("images")), "doc", "left").join(scanned.groupBy("doc").agg(F.collect_list(F.col("page").cast("int")).alias("scanned")), "doc", "left")
    drawn = F.array().cast("array<struct<page: int, x: double>>")
    docs = docs.withColumn("edges", drawn) if edges is None else docs.join(edges.groupBy("doc").agg(typed(page, ("x", "double")).alias("edges")), "doc", "left").withColumn("edges", F.coalesce("edges", drawn))
    none = {"images": "array<struct<page: int, x0: double, x1: double, bottom: double>>", "scanned": "array<int>"}
    return form_documents(docs.withColumns({k: F.coalesce(k, F.array().cast(t)) for k, t in none.items()}))
