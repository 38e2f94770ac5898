"""Which sheet of a workbook is a batch's template, and where its parts are: cells as rows, first positions by conditional aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Columns, labels above the table, and how far down its titles may be.
NUMBER, ACCOUNT, FIRST, LAST, LABEL, EXAMPLE, DEEPEST = 2, 6, 2, 25, 2, 3, 40
TITLE, TOTAL, DIFFERENCES = "nro. registro", "total", "diferencias"
INFO = {
    "tipo de pago": "payment_kind", "nombre del pago": "payment_name", "cuenta a debitar": "account", "valor total": "total", "numero total de registros": "records",
    "fecha de creacion del lote": "created_on", "fecha de aplicacion": "applied_on",
}


def layouts(cells: DataFrame) -> DataFrame:
    """cells (book, position, sheet, row, col, value) -> a row for each sheet with the table of payments: title_row, total_row, differences_row, capacity, last_row.

    The titles' row is the first of the first 40 with the number's title in its column. Below it the first total counts and the last row of differences; without
    a total the table reaches to the end of the sheet. Hidden blanks, colons at the end and marks don't matter in labels.
    """
    said = X.label(F.col("value"))
    row = F.col("row")
    at = Window.partitionBy("book", "position", "sheet")
    titled = cells.withColumns({"said": said, "title_row": F.min(F.when((F.col("col") == NUMBER) & (said == TITLE) & (row <= DEEPEST), row)).over(at), "last_row": F.max("row").over(at)}).where("title_row IS NOT NULL")
    below = (row > F.col("title_row")) & (F.col("col") == ACCOUNT)
    out = titled.groupBy("book", "position", "sheet", "title_row", "last_row").agg(
        F.min(F.when(below & (F.col("said") == TOTAL), row)).alias("first_total"), F.collect_set(F.when(below & (F.col("said") == DIFFERENCES), row)).alias("differences"))
    total = F.coalesce("first_total", F.col("last_row") + 1)
    return out.select("book", "position", "sheet", "title_row", total.alias("total_row"), F.array_max("differences").alias("differences_row"), (total - F.col("title_row") - 1).alias("capacity"), "last_row")


def templates(cells: DataFrame) -> DataFrame:
    """One row per workbook: whether it has a template, the first sheet that is one with its layout, its titles by column, rows and examples of its labels, and all its sheets of batches."""
    found = layouts(cells)
    first = found.groupBy("book").agg(F.min(F.struct("position", "sheet", "title_row", "total_row", "differences_row", "capacity")).alias("m"), F.transform(F.sort_array(F.collect_list(F.struct("position", "sheet"))), lambda s: s["sheet"]).alias("sheets"))
    model = first.select("book", "m.*", "sheets")
    own = cells.join(model.select("book", "position", "title_row"), ["book", "position"])
    filled = F.coalesce(F.col("value"), F.lit("")) != ""
    titles = own.where((F.col("row") == F.col("title_row")) & F.col("col").between(FIRST, LAST) & filled).groupBy("book").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("col", "value")))).alias("titles"))
    field = F.create_map(*[F.lit(x) for pair in INFO.items() for x in pair])[X.label(F.col("value"))]
    labels = own.where((F.col("row") < F.col("title_row")) & (F.col("col") == LABEL)).withColumn("field", field).where("field IS NOT NULL").groupBy("book", "field").agg(F.max("row").alias("row"))  # a repeated label's last row counts
    example = own.where(F.col("col") == EXAMPLE).select("book", "row", F.col("value").alias("example"))
    info = labels.join(example, ["book", "row"], "left").groupBy("book").agg(F.sort_array(F.collect_list(F.struct("field", "row", "example"))).alias("info"))
    books = cells.select("book").distinct()
    out = books.join(model.drop("position"), "book", "left").join(titles, "book", "left").join(info, "book", "left")
    return out.select("book", F.col("sheet").isNotNull().alias("valid"), "sheet", "title_row", "total_row", "differences_row", "capacity", "titles", "info", "sheets")
