"""Captures of a bank's portal: head fields under their labels, payment rows with or without column titles, and captures joined to batches.

A capture is one document of words with places. Windows, joins and arrays stay inside a capture, which is a screen or a few pages;
captures of a batch meet only as rows of payments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..sources.shared import kept
from .documents import nearest
from .layout import gathered_lines, merge_intervals

# Labels of the head with their fields, words of column titles, marks of the table's start and end.
LABELS = {
    "tipo de pago": "payment_kind", "nombre del pago": "payment_name", "producto a debitar": "account", "fecha de aplicacion": "applied_on",
    "cantidad de registros": "records", "valor total del pago": "total", "producto origen": "source",
}
TITLES = ["tipo", "transaccion", "destinatario", "documento", "numero", "producto", "destino", "valor", "referencia", "celular"]
TABLE, FOOT = "registros agregados", "mostrando"
DECLARED = r"mostrando\s+[0-9\s-]+de\s+([0-9]+)\s+pago"
DOTTED_ID, AMOUNT_MARK, ANCHOR = r"^[0-9]{1,3}(?:\.[0-9]{3}){2,3}$", r"(?i)C\s*[O0]\s*P", r"[0-9][0-9.,]{4,}"
#: Words of a label, lines of a value, blank lines before it, and how far right of a line's last label its value reaches.
SPAN, VALUE_LINES, BLANK_LINES, REACH = 5, 3, 2, 320.0
#: Shape ratio from which a misread label counts.
LIKE = 0.82


def joined(words: Column) -> Column:
    return F.array_join(words["text"], " ")


def by_place(words: Column) -> Column:
    """The texts of an array of words from top to bottom, then left to right."""
    return joined(F.array_sort(F.transform(words, lambda w: F.struct(w["y0"].alias("y0"), w["x0"].alias("x0"), w["word_no"].alias("word_no"), w["text"].alias("text")))))


def stacked(words: DataFrame, heights: DataFrame) -> DataFrame:
    """Words of documents with several pages as if these stood below each other: heights (doc, page, height) of earlier pages are added up."""
    above = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    offset = heights.select("doc", "page", F.coalesce(F.sum("height").over(above), F.lit(0.0)).alias("_above"))
    at = F.coalesce("_above", F.lit(0.0))
    return words.join(offset, ["doc", "page"], "left").withColumns({"y0": F.col("y0") + at, "y1": F.col("y1") + at}).drop("_above")


def capture_lines(words: DataFrame, heights: DataFrame | None = None) -> DataFrame:
    """words (doc, page, word_no, text, x0, x1, y0, y1) -> doc, line_no, y0, y1, ws (its words from left to right) and said (normalised text). Screen noise goes.

    Words keep their order by page and number, whatever their numbers are.
    """
    real = words.where(F.col("text").isNotNull() & (F.trim("text") != "") & ~X.screen_noise(F.col("text")))
    placed = real if heights is None else stacked(real, heights)
    return gathered_lines(placed).select("doc", "line_no", "ws", "y0", "y1", X.normalise(joined(F.col("ws"))).alias("said"))


def label_hits(lines: DataFrame) -> DataFrame:
    """doc, line_no, pos, field, left, right: labels of each line with the stretch that their values stand in.

    At each word the longest run of up to five words that is a label counts, exactly or, from eight characters on, by likeness; words of an earlier
    label of the line start none. A value reaches to the next label of the line.
    """
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a ratio of LIKE leaves room for this share of letters that no label has
        letters, share = re.compile(f"[^{''.join(sorted(set(''.join(LABELS))))}]+"), LIKE / (2 - LIKE) - 1e-9
        longest = max(map(len, LABELS)) * (2 - LIKE) / LIKE + 1e-9
        like = lru_cache(50_000)(lambda key: LABELS.get(nearest(key, list(LABELS), LIKE)))
        schema = pa.schema([("doc", pa.string()), ("line_no", pa.int32()), ("pos", pa.int32()), ("field", pa.string()), ("left", pa.float64()), ("right", pa.float64())])

        def field_of(key: str) -> str | None:
            near = 8 <= len(key) <= longest and len(letters.sub("", key)) >= share * len(key)
            return LABELS.get(key) or (like(key) if near else None)

        for batch in batches:
            out = []
            cuts = (batch["said"].offsets.to_numpy() - batch["said"].offsets[0].as_py()).tolist()
            said, x0, x1 = (batch[c].flatten().to_pylist() for c in ("said", "x0", "x1"))
            for doc, line_no, at, stop in zip(batch["doc"].to_pylist(), batch["line_no"].to_pylist(), cuts, cuts[1:]):
                taken = []
                while at < stop:
                    for n in range(min(SPAN, stop - at), 0, -1):
                        key = " ".join(said[at:at + n])
                        field = field_of((re.sub(" +", " ", key) if "  " in key else key).strip(" .:"))
                        if field:
                            taken.append((field, x0[at], x1[at + n - 1]))
                            at += n - 1
                            break
                    at += 1
                for pos, (field, left, end) in enumerate(taken):
                    after = taken[pos + 1][1] if pos + 1 < len(taken) else None
                    right = after - 5 if after is not None else None if end is None else end + REACH
                    out.append((doc, line_no, pos, field, None if left is None else left - 12, right))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(schema), schema)], schema=schema)

    # a word's own blanks fall together first, and where words meet they are looked at again
    folded = F.transform(F.col("ws")["text"], lambda t: F.regexp_replace(X.fold(t), r"\s+", " "))
    given = lines.select("doc", "line_no", folded.alias("said"), F.col("ws")["x0"].alias("x0"), F.col("ws")["x1"].alias("x1"))
    return given.mapInArrow(found, "doc string, line_no int, pos int, field string, left double, right double")


def head_fields(lines: DataFrame) -> DataFrame:
    """doc, field, value: what stands below each label, of a repeated field the first that isn't blank.

    A value is up to three lines that follow each other and have words in the label's stretch. Up to two lines without any may stand before it; another label ends it.
    """
    hits = kept(label_hits(lines), "label-hits")  # few rows, read for the labels and for where the next ones stand
    stop = hits.select("doc", "line_no").distinct().withColumn("stop", F.lead("line_no").over(Window.partitionBy("doc").orderBy("line_no")))
    ahead = hits.join(stop, ["doc", "line_no"]).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(VALUE_LINES + BLANK_LINES))))
    ahead = ahead.withColumn("next", F.col("line_no") + F.col("k")).where(F.col("stop").isNull() | (F.col("next") < F.col("stop")))
    below = ahead.join(lines.select("doc", F.col("line_no").alias("next"), "ws"), ["doc", "next"])
    under = joined(F.filter("ws", lambda w: (w["x0"] < F.col("right")) & (w["x1"] > F.col("left"))))
    parts = below.groupBy("doc", "line_no", "pos", "field").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", under.alias("said")))), lambda x: x["said"]).alias("parts"))
    first = F.array_position(F.transform("parts", lambda p: p != ""), F.lit(True))
    some = F.slice("parts", first.cast("int"), F.lit(VALUE_LINES))
    gap = F.array_position(some, F.lit("")).cast("int")
    value = F.when((first > 0) & (first <= BLANK_LINES + 1), F.array_join(F.when(gap > 0, F.slice(some, F.lit(1), gap - 1)).otherwise(some), " "))
    found = parts.withColumn("value", F.trim(value)).where("value <> ''")
    return found.groupBy("doc", "field").agg(F.min_by("value", F.struct("line_no", "pos")).alias("value"))


def capture_heads(lines: DataFrame) -> DataFrame:
    """One row per capture: the head's fields as text, blank if not there, and declared, the number of payments that the foot names (0 if none)."""
    said = F.regexp_extract("said", DECLARED, 1).try_cast("long")
    foot = lines.groupBy("doc").agg(F.coalesce(F.min_by(said, F.when(said.isNotNull(), F.col("line_no"))), F.lit(0)).alias("declared"))
    fields = head_fields(lines).groupBy("doc").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in LABELS.values()])
    out = foot.join(fields, "doc", "left")
    return out.select("doc", *[F.coalesce(f, F.lit("")).alias(f) for f in LABELS.values()], "declared")


def table_marks(lines: DataFrame) -> DataFrame:
    """doc, start (line of the table's caption, 0 if none), head_first and head_last: the first block of title lines from there on, if there is one.

    A title line has a known word and no run of three digits. A block is one and up to two that follow; together they must say three known words, among them
    value or reference, and payee or document.
    """
    page = Window.partitionBy("doc").orderBy("line_no")
    seen_as = lambda word: word.translate(str.maketrans("l105", "iios"))
    says = lambda c, word: c.contains(seen_as(word))
    # a line's text is put together and its look-alikes fall together once; blocks are made of these texts
    given = lines.select("doc", "line_no", F.col("said").contains(TABLE).alias("caption"), joined(F.col("ws")).alias("text")).withColumn("text", F.struct("text", X.tolerant(F.col("text")).alias("like")))
    title = ~F.col("text.text").rlike("[0-9]{3,}") & F.col("text.like").rlike("|".join(map(seen_as, TITLES)))
    marked = given.select("doc", "line_no", "caption", F.col("text.like").alias("text"), title.alias("title"))
    marked = marked.select("doc", "line_no", F.when(F.col("title"), F.col("text")).alias("text"), "title", F.min(F.when(F.col("caption"), F.col("line_no"))).over(Window.partitionBy("doc")).alias("caption"))
    marked = marked.withColumn("start", F.coalesce("caption", F.lit(0)))
    ahead = {f"t{k}": F.coalesce(F.lead("title", k).over(page), F.lit(False)) for k in (1, 2)} | {f"s{k}": F.lead("text", k).over(page) for k in (1, 2)}
    m = marked.withColumns(ahead)
    two, three = F.col("t1"), F.col("t1") & F.col("t2")
    m = m.withColumns({"block": F.when(F.col("title"), F.concat_ws(" ", "text", F.when(two, F.col("s1")), F.when(three, F.col("s2")))), "last": F.col("line_no") + two.cast("int") + three.cast("int")})
    known = sum((says(F.col("block"), t).cast("int") for t in TITLES), F.lit(0))
    either = lambda *ts: says(F.col("block"), ts[0]) | says(F.col("block"), ts[1])
    good = F.col("title") & (F.col("line_no") >= F.col("start")) & (known >= 3) & either("valor", "referencia") & either("destinatario", "documento")
    return m.groupBy("doc").agg(F.first("start").alias("start"), F.min(F.when(good, F.col("line_no"))).alias("head_first"), F.min_by("last", F.when(good, F.col("line_no"))).alias("head_last"))


def words_of(lines: DataFrame, *more: str) -> DataFrame:
    """doc, line_no, middle (of the line's height), more columns of the line, and the words' columns."""
    return lines.select("doc", "line_no", ((F.col("y0") + F.col("y1")) / 2).alias("middle"), *more, F.explode("ws").alias("w")).select("doc", "line_no", "middle", *more, "w.*")


def title_columns(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """doc, column (from 1), field, low, high: title words that touch within 6 points are a column, and columns meet halfway. A title that names no field is one of its own."""
    block = words_of(lines.join(marks.where("head_first IS NOT NULL"), "doc").where(F.col("line_no").between(F.col("head_first"), F.col("head_last"))))
    groups = merge_intervals(block, ["doc"], 6.0).select("doc", F.col("x0").alias("gx0"), F.col("x1").alias("gx1"))
    said = groups.join(block.select("doc", "x0", "x1", "y0", "word_no", "text"), "doc").where((F.col("x0") >= F.col("gx0")) & (F.col("x1") <= F.col("gx1")))
    said = said.groupBy("doc", "gx0", "gx1").agg(X.normalise(by_place(F.collect_list(F.struct("y0", "x0", "word_no", "text")))).alias("title"))
    along = Window.partitionBy("doc").orderBy("gx0")
    low, high = (F.lag("gx1").over(along) + F.col("gx0")) / 2, (F.col("gx1") + F.lead("gx0").over(along)) / 2
    return said.select("doc", F.row_number().over(along).alias("column"), F.coalesce(F.nullif(X.column_field(F.col("title")), F.lit("")), "title").alias("field"), F.coalesce(low, F.lit(float("-inf"))).alias("low"), F.coalesce(high, F.lit(float("inf"))).alias("high"))


def table_layout(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``table_marks`` and ``title_columns``, kept: few rows, which the reading of rows needs in several places."""
    marks = kept(table_marks(lines), "table-marks")
    return marks, kept(title_columns(lines, marks), "title-columns")


FIELDS = ["payee", "document", "account", "value", "kind", "reference"]


def titled_rows(lines: DataFrame, marks: DataFrame, columns: DataFrame) -> DataFrame:
    """doc, row, FIELDS and said (all of the row's text) of tables with titles.

    Each line with a long number in the value column opens a row, which reaches halfway to its neighbours; the first reaches up to the titles, the last 40 points
    below the table, which ends at the line that counts the payments. Tables without a value column have no rows.
    """
    ends = lines.join(marks.where("head_first IS NOT NULL"), "doc")
    ends = ends.groupBy("doc", "head_last").agg(
        F.max(F.when(F.col("line_no") == F.col("head_last"), F.col("y1"))).alias("ceiling"),
        F.coalesce(F.min(F.when((F.col("line_no") > F.col("head_last")) & F.col("said").contains(FOOT), F.col("line_no"))), F.max("line_no") + 1).alias("foot"))
    ends = ends.join(lines.select("doc", F.col("line_no").alias("l"), F.col("y1").alias("floor")), "doc").where("l = foot - 1").drop("l")
    body = words_of(lines.join(ends, "doc").where((F.col("line_no") > F.col("head_last")) & (F.col("line_no") < F.col("foot"))), "ceiling", "floor")
    centre = (F.col("x0") + F.col("x1")) / 2
    value = columns.where("field = 'value'").groupBy("doc").agg(F.min("column").alias("value_column"))
    celled = body.join(columns.join(value, "doc"), "doc").where((centre >= F.col("low")) & (centre < F.col("high"))).drop("low", "high")
    anchors = celled.where((F.col("column") == F.col("value_column")) & F.col("text").rlike(ANCHOR)).select("doc", "line_no", "middle", "ceiling", "floor").distinct()
    order = Window.partitionBy("doc").orderBy("line_no")
    low = F.coalesce((F.lag("middle").over(order) + F.col("middle")) / 2, "ceiling")
    high = F.coalesce((F.lead("middle").over(order) + F.col("middle")) / 2, F.col("floor") + 40)
    rows = anchors.select("doc", F.row_number().over(order).alias("row"), low.alias("row_low"), high.alias("row_high"))
    inside = celled.join(rows, "doc").where((F.col("middle") >= F.col("row_low")) & (F.col("middle") < F.col("row_high")))
    cells = inside.groupBy("doc", "row", "column", "field").agg(F.collect_list(F.struct("y0", "x0", "word_no", "text")).alias("ws"), F.min(F.struct("line_no", "x0")).alias("seen"))
    cell = lambda f: F.coalesce(F.max_by(by_place(F.col("ws")), F.when(F.col("field") == f, F.col("seen"))), F.lit("")).alias(f)
    return cells.groupBy("doc", "row").agg(*map(cell, FIELDS), by_place(F.flatten(F.collect_list("ws"))).alias("said"))


def untitled_rows(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows as those of ``titled_rows``, of captures without titles: each amount in pesos opens one, and words go by kind and by place.

    Right of the amount stands the reference; left of it a tax id with dots, the account between both, and the name left of the id. Words go to
    the amount that is nearest by height. Lines down to the table's caption are no rows.
    """
    open_docs = marks.where("head_first IS NULL").select("doc", "start")
    words = words_of(lines.join(open_docs, "doc").where((F.col("start") == 0) | (F.col("line_no") > F.col("start")))).withColumn("centre", (F.col("y0") + F.col("y1")) / 2)
    order = Window.partitionBy("doc").orderBy("centre", "line_no", "x0", "word_no")
    amounts = words.where(F.col("text").rlike(AMOUNT_MARK) & F.col("text").rlike("[0-9]"))
    low, high = (F.lag("centre").over(order) + F.col("centre")) / 2, (F.lead("centre").over(order) + F.col("centre")) / 2
    amounts = amounts.select("doc", F.row_number().over(order).alias("row"), F.struct("x0", "x1", "y0", "word_no", "text").alias("m"), F.coalesce(low, F.lit(float("-inf"))).alias("low"), F.coalesce(high, F.lit(float("inf"))).alias("high"))
    near = amounts.join(words.select("doc", "centre", F.struct("y0", "x0", "word_no", "x1", "text").alias("w")), "doc").where((F.col("centre") >= F.col("low")) & (F.col("centre") < F.col("high")))
    each = near.groupBy("doc", "row", "m").agg(F.sort_array(F.collect_list("w")).alias("all"))
    each = each.withColumn("others", F.filter("all", lambda w: w["word_no"] != F.col("m.word_no")))
    each = each.withColumns({"left": F.filter("others", lambda w: w["x1"] <= F.col("m.x0") + 2), "right": F.filter("others", lambda w: w["x0"] >= F.col("m.x1") - 2)})
    each = each.withColumn("id", F.get(F.filter("left", lambda w: F.replace(w["text"], F.lit(" "), F.lit("")).rlike(DOTTED_ID)), 0))
    account = F.filter("left", lambda w: (w["x0"] >= F.col("id.x1") - 2) & (w["word_no"] != F.col("id.word_no")))
    name = F.when(F.col("id").isNull(), F.col("left")).otherwise(F.filter("left", lambda w: w["x1"] <= F.col("id.x0") + 2))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return each.select(
        "doc", "row", X.payee_name(joined(name), X.NAME_COLUMN_WORDS).alias("payee"), blank(F.col("id.text")).alias("document"), blank(joined(account)).alias("account"),
        F.col("m.text").alias("value"), F.lit("").alias("kind"), joined(F.col("right")).alias("reference"),
        joined(F.array_sort(F.when(F.exists("all", lambda w: w["word_no"] == F.col("m.word_no")), F.col("all")).otherwise(F.array_append("all", F.struct("m.y0", "m.x0", "m.word_no", "m.x1", "m.text"))))).alias("said"))


def capture_rows(lines: DataFrame) -> DataFrame:
    """doc, row, FIELDS and said of all captures, by titles where there are any, else by content."""
    marks, columns = table_layout(lines)
    return titled_rows(lines, marks, columns).unionByName(untitled_rows(lines, marks))


def payments(rows: DataFrame) -> DataFrame:
    """Rows with typed fields. An amount of no accepted shape is null, and a blank payee is taken from the row's text."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    keep = [c for c in rows.columns if c not in [*FIELDS, "said"]]
    raw, payee, number = F.col("value"), F.col("payee"), F.col("_number")
    spare = X.payee_name(F.col("said"))
    # a cell's number is looked for once, for its shape and for its amount
    rows = rows.withColumns({"value": flat(raw), "payee": flat(payee)}).withColumn("_number", N.longest_number(raw))
    return rows.select(
        *keep, F.when(payee != "", payee).otherwise(spare).alias("payee"), ((payee == "") & (spare != "")).alias("payee_from_row"), X.digits(F.col("document")).alias("document"),
        X.account(F.col("account")).alias("account"), flat(F.col("account")).alias("account_text"), F.when(N.portal_shaped(number), N.portal_value(number)).alias("value"), raw.alias("value_text"),
        flat(F.col("kind")).alias("kind"), flat(F.col("reference")).alias("reference"), X.invoice_references(F.col("reference")).alias("invoices"), flat(F.col("said")).alias("said"))


def batch_rows(read: DataFrame) -> DataFrame:
    """``capture_documents.read_captures`` of captures (batch, doc, arrival, name) -> batch, n, again (an earlier row of the batch is the same payment), row, first and the payment's columns, with place, arrival, name, declared and head of its capture.

    Captures of a batch with their head come first, the others as they arrived; unreadable ones have no place. A capture without payments is one line with no row; first marks one line of each.
    A payment is repeated if an earlier one has its document, value and reference, unless these are all blank (a value of 0 is). Numbers are given to those that stay. All of it
    happens inside a batch, whose captures are shuffled once.
    """
    from .capture_documents import rows_of

    has = (F.col("head.payment_name") != "") | (F.col("head.total") != "") | (F.col("head.payment_kind") != "")
    order = Window.partitionBy("batch").orderBy(F.col("lines") == 0, F.when(has, 0).otherwise(1), "arrival", "doc")
    kept_columns = ["batch", "place", "arrival", "name", "declared", "head"]
    placed = read.select("batch", "doc", "arrival", "name", "lines", "declared", "head", "titled", "rows").withColumn("place", F.when(F.col("lines") > 0, F.row_number().over(order)))
    paid = payments(rows_of(placed, *kept_columns))
    blank = (F.col("document") == "") & (F.coalesce("value", F.lit(0.0)) == 0) & (F.col("reference") == "")
    same = Window.partitionBy("batch", "document", "value", "reference").orderBy("place", "row")
    told = paid.withColumn("again", F.col("row").isNotNull() & ~blank & (F.row_number().over(same) > 1))
    along = Window.partitionBy("batch").orderBy("place", "row").rowsBetween(Window.unboundedPreceding, 0)
    return told.withColumns({"n": F.sum((F.col("row").isNotNull() & ~F.col("again")).cast("int")).over(along), "first": F.coalesce("row", F.lit(0)) == F.coalesce("opens", F.lit(0))})


def batch_payments(rows: DataFrame) -> DataFrame:
    """``batch_rows`` -> batch, n and the payment's columns, each payment once."""
    inner = ["row", "first", "opens", "again", "titled", "place", "arrival", "name", "declared", "head"]
    return rows.where("row IS NOT NULL AND NOT again").select("batch", "n", *[c for c in rows.columns if c not in ("batch", "n", *inner)])


def batch_summary(rows: DataFrame) -> DataFrame:
    """``batch_rows`` -> one row per batch: head fields by the first capture that has each, payments read, their sum, and warnings in order. A batch without a readable capture has an error and nothing else."""
    head_of = lambda f: F.coalesce(F.min_by(f"head.{f}", F.when(F.col(f"head.{f}") != "", F.col("place"))), F.lit("")).alias(f)
    n = F.col("n").cast("string")
    # The wording of the warnings.
    warned = F.array_compact(F.array(
        F.when(F.col("payee") == "", F.concat(F.lit("no se leyo el destinatario del registro "), n, F.lit("; la fila dice: "), F.left("said", F.lit(120))))
        .when(F.col("payee_from_row"), F.concat(F.lit("el destinatario del registro "), n, F.lit(' se deduzco del texto de la fila: "'), F.col("payee"), F.lit('"'))),
        F.when(F.col("value").isNull(), F.concat(F.lit("el valor del registro "), n, F.lit(" no se pudo leer con seguridad"), F.when(F.col("value_text") != "", F.concat(F.lit(': la celda dice "'), F.left("value_text", F.lit(60)), F.lit('"'))).otherwise(""), F.lit("; escribelo a mano"))),
        F.when(F.col("document") == "", F.concat(F.lit("no se leyo el documento del registro "), n))))
    once, shown = F.col("row").isNotNull() & ~F.col("again"), F.col("first") & F.col("place").isNotNull()
    out = rows.withColumn("warned", F.when(once, warned)).groupBy("batch").agg(
        *[head_of(f) for f in LABELS.values()], F.coalesce(F.min_by("declared", F.when(F.col("declared") > 0, F.col("place"))), F.lit(0)).alias("declared"), F.count_if(shown).alias("captures"), F.count_if("first").alias("given"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("first") & F.col("place").isNull(), F.struct("arrival", "name")))), lambda x: F.concat(F.lit("no se pudo leer "), x["name"])).alias("lost"),
        F.count_if(once).alias("payments"), F.coalesce(F.sum(F.when(once, F.coalesce("value", F.lit(0.0)))), F.lit(0.0)).alias("sum"), F.count_if("again").alias("again"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.size("warned") > 0, F.struct("n", "warned")))), lambda x: x["warned"])).alias("warned"))
    total = N.portal_amount(F.col("total"))
    said = N.portal_amount(F.col("records")).cast("long")
    records = F.coalesce(F.nullif(said, F.lit(0)), F.nullif(F.col("declared"), F.lit(0)))
    money = lambda c: F.format_number(c, 2)
    general = F.array_compact(F.array(
        F.when(F.col("again") > 0, F.concat(F.col("again").cast("string"), F.lit(" fila(s) venian repetidas en dos capturas y se contaron una sola vez"))),
        F.when(records != F.col("payments"), F.concat(F.lit("la pantalla declara "), records.cast("string"), F.lit(" registros y se leyeron "), F.col("payments").cast("string"), F.when(F.col("given") == 1, "; puede faltar una captura").otherwise(""))),
        F.when(F.abs(F.col("sum") - total) > 0.5, F.concat(F.lit("los registros suman "), money("sum"), F.lit(" y el total del lote dice "), money(total)))))
    read = F.col("captures") > 0
    some = lambda c: F.when(read, c)
    return out.select(
        "batch", some(F.col("payment_kind")).alias("payment_kind"), some(F.col("payment_name")).alias("payment_name"), some(X.account(F.col("account"))).alias("account"), some(F.trim(F.regexp_replace("account", r"\s+", " "))).alias("account_text"), some(total).alias("total"), some(records).alias("records"),
        some(X.bank_date(F.col("applied_on"))).alias("applied_on"), F.col("captures"), some(F.col("payments")).alias("payments"), some(F.round("sum", 2)).alias("sum"),
        some(F.concat("lost", general, "warned")).alias("warnings"), F.when(~read, "No se pudo leer ninguna de las imagenes").alias("error"))


def batches(captures: DataFrame, words: DataFrame, heights: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """captures (batch, doc, arrival, name), words and page heights -> the summary of each batch, and its payments."""
    from .capture_documents import documents_of, read_captures

    rows = batch_rows(read_captures(captures.join(documents_of(words, heights), "doc", "left")))
    return batch_summary(rows), batch_payments(rows)
