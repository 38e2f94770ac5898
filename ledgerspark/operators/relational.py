"""Relational operators of the payment store: batches, payments, lines, documents, events.

The operators take DataFrames with the columns they name, so they serve the stored tables and analogs alike. Joins
are equi-joins on keys, aggregates combine before the shuffle, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

CENT = 0.01


def money(c: Column) -> Column:
    """Two decimals as a double; decimals are rounded before they are cast, so that halves go up exactly."""
    return F.round(c, 2).cast("double")


def payment_summary(payments: DataFrame, lines: DataFrame, tolerance: float = CENT) -> DataFrame:
    """Per payment: sums of K and Q over its lines, their differences from the amount, invoices, and a state.

    payments: key, amount; lines: key, k, q. A payment whose K is null or 0 is unvalidated; one that agrees within the
    tolerance balances; any other is off.
    """
    sums = lines.groupBy("key").agg(F.sum("k").alias("k"), money(F.sum("q")).alias("q"), F.count(F.lit(1)).alias("invoices"))
    out = payments.join(sums, "key", "left").select("key", money(F.col("amount")).alias("amount"), money(F.col("k")).alias("sum_k"), money(F.col("q")).alias("sum_q"), F.coalesce("invoices", F.lit(0)).alias("invoices"))
    gap = F.coalesce("amount", F.lit(0.0)) - F.coalesce("sum_k", F.lit(0.0))
    state = F.when(F.coalesce("sum_k", F.lit(0.0)) == 0, "sin validar").when(F.abs(gap) < tolerance, "cuadra").otherwise("descuadre")
    return out.withColumns({"diff_l": money(gap), "diff_r": money(F.coalesce("amount", F.lit(0.0)) - F.coalesce("sum_q", F.lit(0.0))), "state": state})


def summary_totals(summary: DataFrame) -> DataFrame:
    states = {"balanced": "cuadra", "off": "descuadre", "unvalidated": "sin validar"}
    return summary.agg(F.count(F.lit(1)).alias("payments"), *[F.count_if(F.col("state") == s).alias(k) for k, s in states.items()], money(F.sum("amount")).alias("amount"))


def batch_overview(batches: DataFrame, payments: DataFrame, validated: DataFrame) -> DataFrame:
    """Per batch: distinct payments, their sum, how many have a non-null K on some line, and whether the sum agrees.

    batches: batch, total; payments: batch, key, amount; validated: key (one row or more per payment with evidence).
    """
    own = payments.groupBy("batch").agg(F.count_distinct("key").alias("payments"), F.sum("amount").alias("amount"))
    seen = payments.join(validated, "key", "left_semi").groupBy("batch").agg(F.count(F.lit(1)).alias("validated"))
    out = batches.join(own, "batch", "left").join(seen, "batch", "left")
    amount = money(F.coalesce("amount", F.lit(0.0)))
    agrees = F.when(F.col("total").isNull(), False).otherwise(F.abs(amount - F.col("total")) < CENT)
    return out.select("batch", F.coalesce("payments", F.lit(0)).alias("payments"), amount.alias("amount"), F.coalesce("validated", F.lit(0)).alias("validated"), agrees.alias("agrees"))


def owner_rollup(batches: DataFrame) -> DataFrame:
    """owner, payments, total of each batch -> one row per owner; a blank owner is shown as such."""
    owner = F.coalesce("owner", F.lit(""))
    return batches.groupBy(owner.alias("owner")).agg(F.count(F.lit(1)).alias("batches"), F.sum(F.coalesce("payments", F.lit(0))).alias("payments"), money(F.sum(F.coalesce("total", F.lit(0.0)))).alias("total")).withColumn("label", F.when(F.col("owner") == "", "(sin dueño)").otherwise(F.col("owner")))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def replace_by_owner(stored: DataFrame, incoming: DataFrame, owner: Column) -> DataFrame:
    """What is stored after an owner sends a new set: other owners' rows stay, the owner's are the incoming ones."""
    return stored.where(~F.coalesce(F.col("owner") == owner, F.lit(False))).unionByName(incoming)


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace stored ones of the same key, nulls included; others are added."""
    rest = [c for c in stored.columns if c not in keys]
    mark = incoming.withColumn("_new", F.lit(True))
    joined = stored.alias("s").join(mark.alias("i"), keys, "full")
    return joined.select(*keys, *[F.when(F.col("i._new"), F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in rest])


def insert_absent(stored: DataFrame, incoming: DataFrame, key: str, first: list[Column]) -> DataFrame:
    """Incoming rows whose key is not stored, one per key: the first in the given order."""
    one = incoming.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*first))).where("_r = 1").drop("_r")
    return one.join(stored.select(key), key, "left_anti")


def recent(df: DataFrame, order: list[Column], n: int, where: Column | None = None) -> DataFrame:
    """The newest n rows after the filter: a top-k report."""
    return (df if where is None else df.where(where)).orderBy(*order).limit(n)


def nested_work(batches: DataFrame, payments: DataFrame, lines: DataFrame) -> DataFrame:
    """Batches with their payments, each with its lines, in stored order: two aggregations instead of a select per row."""
    inner = lines.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("position", "value"))).alias("lines"))
    outer = payments.join(inner, "key", "left").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("key", "amount", F.coalesce("lines", F.array()).alias("lines")))).alias("payments"))
    return batches.join(outer, "batch", "left")


def number_or_text(c: Column) -> Column:
    """Numeric text as a whole number, other text as it is, blank as null."""
    text = F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(text.try_cast("double").cast("bigint").cast("string"), text)


def tri_and(c: Column) -> Column:
    """AND over a group that is unknown when any member is."""
    return F.when(F.count_if(c.isNull()) > 0, F.lit(None).cast("boolean")).otherwise(F.bool_and(c))


def running_start(df: DataFrame, partition: list[str], order: list[str], size: Column, start: int = 0) -> DataFrame:
    """First row of each item when every item takes max(1, size) rows."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("row_start", F.lit(start) + F.coalesce(F.sum(F.greatest(size, F.lit(1))).over(w), F.lit(0)))


def runs(df: DataFrame, partition: list[str], order: list[str], value: Column) -> DataFrame:
    """Consecutive rows with equal values get one run number: gaps and islands."""
    w = Window.partitionBy(*partition).orderBy(*order)
    new = F.when(value.eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).drop("_new")


def sheet_totals(lines: DataFrame) -> DataFrame:
    """Totals by sheet and over all sheets; lines in dollars are left out of the K sum. lines: sheet, g, k, q, currency."""
    k = F.when(F.col("currency") == "USD", 0.0).otherwise(F.col("k"))
    return lines.rollup("sheet").agg(money(F.sum("g")).alias("sum_g"), money(F.sum(k)).alias("sum_k"), money(F.sum("q")).alias("sum_q"), F.grouping("sheet").cast("int").alias("all_sheets"))


# What a failed and an open check are called in the sheet's notes.
FAILED = {
    "nit_cliente": "el NIT del cliente no coincide", "nit_tercero": "el NIT del tercero no coincide", "cufe": "sin CUFE", "qr": "sin código QR",
    "numero": "no se pudo leer el número de factura", "numero_egreso": "el número de factura no coincide con el del egreso",
    "fuera_del_registro": "la factura no es ninguna de las de este registro",
}
OPEN = {"nit_cliente": "el NIT del cliente", "nit_tercero": "el NIT del tercero", "cufe": "el CUFE", "qr": "el código QR", "numero": "el número de factura", "numero_egreso": "el número contra el egreso"}


def worded(codes: Column, words: dict[str, str]) -> Column:
    """Codes in their wording, joined by commas; an unknown code stands for itself, no codes give null."""
    book = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.when(F.size(codes) > 0, F.array_join(F.transform(codes, lambda k: F.coalesce(F.try_element_at(book, k), k)), ", "))


def invoice_cells(lines: DataFrame) -> DataFrame:
    """lines (key, has_file, ok, missing, pending) -> cell and note of each payment with a file or a finding on some line.

    OK only if every line is; a check that failed on one line isn't listed as open too. Sets of codes are few, so a group stays small.
    """
    seen = F.bool_or(F.coalesce("has_file", F.lit(False)) | (F.size("missing") > 0) | (F.size("pending") > 0))
    codes = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    g = lines.groupBy("key").agg(seen.alias("seen"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"), codes("missing").alias("missing"), codes("pending").alias("pending")).where("seen")
    failed, still = worded(F.col("missing"), FAILED), worded(F.array_except("pending", "missing"), OPEN)
    note = F.concat_ws(" · ", F.concat(F.lit("revisar: "), failed), F.concat(F.lit("sin comprobar: "), still))
    return g.select("key", F.when(F.col("ok"), "OK").otherwise("Revisar").alias("cell"), F.nullif(note, F.lit("")).alias("note"))


def comments(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """One comment per payment: why it differs (L), the invoices' note (M), then each row's notes by column letter, equal lines once.

    rows (key, position, invoice, notes, states), heads (key, reason, note); notes are structs of letter and text, states of letter and state. A pending
    state without a note is a line too. Where a payment has several rows, each line begins with the row's invoice. The rows of one payment
    meet in one array.
    """
    blank = lambda t: F.trim(F.coalesce(t, F.lit(""))) == ""
    line = lambda many, r, letter, text: F.concat(F.when(many & ~blank(r["invoice"]), F.concat(r["invoice"], F.lit(" · "))).otherwise(""), letter, F.lit(": "), text)

    def of_row(many: Column, r: Column) -> Column:
        written = F.filter(r["notes"], lambda x: ~blank(x["text"]))
        waiting = F.filter(r["states"], lambda s: (s["state"] == "Pendiente") & ~F.exists(written, lambda x: x["letter"] == s["letter"]))
        return F.concat(F.transform(written, lambda x: line(many, r, x["letter"], F.trim(x["text"]))), F.transform(waiting, lambda s: line(many, r, s["letter"], F.lit("pendiente"))))

    own = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("position", "invoice", "notes", "states"))).alias("rows")).join(heads, "key", "full")
    top = F.array_compact(F.array(F.when(~blank(F.col("reason")), F.concat(F.lit("L: "), F.col("reason"))), F.when(~blank(F.col("note")), F.concat(F.lit("M: "), F.col("note")))))
    below = F.coalesce(F.flatten(F.transform("rows", lambda r: of_row(F.size("rows") > 1, r))), F.array().cast("array<string>"))
    return own.select("key", F.array_join(F.array_distinct(F.concat(top, below)), "\n").alias("comment")).where("comment <> ''")


def rewrite_children(stored: DataFrame, incoming: DataFrame, key: str, items: str) -> DataFrame:
    """stored (key, position, value), incoming (key, items): the children of each incoming parent are replaced by its items, numbered from 0."""
    new = incoming.select(key, F.posexplode(items).alias("position", "value"))
    return stored.join(incoming.select(key), key, "left_anti").unionByName(new)


def without_text(items: Column, part: str = "entrada", field: str = "texto") -> Column:
    """The array with one field left out of a nested struct of its elements; elements without that struct stay."""
    return F.transform(items, lambda x: x.withField(part, F.when(x[part].isNotNull(), x[part].dropFields(field))))


def delete_work(batches: DataFrame, children: DataFrame, owner: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Batches (batch, owner) and children (batch) that are left when an owner's work, or with no owner all work, is deleted."""
    gone = F.lit(True) if owner is None else F.coalesce(F.col("owner") == owner.strip().lower(), F.lit(False))
    left = batches.where(~gone)
    return left, children.join(left.select("batch"), "batch", "left_semi")


def voucher_documents(docs: DataFrame, tax_id: str = "") -> DataFrame:
    """docs (name, category, tax_id): those filed as vouchers or named like the accounting system's, of one payee if an id is given."""
    hit = (F.col("category") == "egreso") | F.lower(F.coalesce("name", F.lit(""))).rlike(r"^g[0-9]{6,}")
    return docs.where(hit) if not tax_id else docs.where(hit & X.same_tax_id(F.col("tax_id"), F.lit(tax_id)))


def by_hash(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs (.., hash) and wanted (hash), one or many -> the documents of that content."""
    return docs.join(wanted.select("hash"), "hash", "left_semi")
