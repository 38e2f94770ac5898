"""Approved amounts in mails: lines, amounts with their neighbours, weighted words, classes, and the verdict per payment.

Lines are rows; context, author and list header come from windows over a document's lines, so a document is the largest
unit that meets in one task. Only the amounts themselves need match positions and use an Arrow-batched function.
"""

from __future__ import annotations

import re
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .documents import invoice_ids, mail_orders

# Weights of approval words and of noise words.
APPROVAL = {
    "aprobada": 12, "aprobado": 12, "aprobadas": 12, "aprobados": 12, "autorizada": 11, "autorizado": 11, "aprobacion": 10, "aprueba": 10, "apruebo": 10,
    "autorizacion": 9, "autorizo": 9, "procedamos": 9, "visto bueno": 9, "vo.bo": 9, "aprobar": 8, "autoriza": 8, "total a pagar": 7, "valor a pagar": 7,
    "proceder": 6, "por valor de": 6, "de acuerdo": 5, "valor total": 5, "ok": 4, "confirmo": 4, "cancelar": 3, "pago": 2,
}
NOISE = {"telefono": -8, "phone": -8, "nit": -8, "und": -8, "unidades": -8, "rollos": -8, "cra.": -6, "calle": -6, "km": -6, "cantidad": -6, "cant.": -6, "descargar": -6, "codigo": -5, "cuenta": -4, "1435": -4, "2205": -4}
# Patterns of mail headers, signatures and of what a line does.
HEADER = r"(?iu)^\s*(?:para|de|desde|cc|cco|bcc|to|from|sent|enviado|asunto|subject|fecha|date|\d+\s+archivos?\s+adjuntos?|outlook)\s*:?"
SIGNATURE = r"(?iu)(?:phone|tel[eé]fonos?|www\.|facebook|http|@\w+\.\w+|cra\.|calle\s|\bkm\s|manzana|zona\s+franca|horario\s+de|\w\.(?:pdf|jpe?g|png|mp4|xlsx?|docx?|msg)\b(?![.:]))"
ACT = r"(?<!\w)(?:aprobad[oa]s?|autorizad[oa]s?|apruebo|autorizo|aprobamos|procedamos|procedan|proceder\s+con\s+el\s+pago|visto\s+bueno|vo\.?\s?bo|de\s+acuerdo|conforme|autorizada\s+por)(?!\w)"
REQUEST = r"(?<!\w)(?:(?:su|tu)\s+(?:aprobacion|autorizacion|vo\.?\s?bo|visto\s+bueno)|por\s+favor\s+(?:su|tu|nos)|solicito|agradezco|requiero|me\s+confirmas|quedo\s+atent[oa]|pendiente\s+de\s+(?:su|tu))(?!\w)"
INFORMATIVE = r"(?<!\w)(?:nota\s+credito|nota\s+debito|saldo|debito:|credito:|registro\s+contable|iva|retencion|rete|subtotal|base\s+imponible)(?!\w)"
AUTHOR = r"(?iu)^(?:Desde|From|De)\s*:?\s*(.+?)\s*(?:<([^>]+)>)?\s*$"
SENT = r"(?i)^(?:Enviado(?:\s+el)?|Fecha|Sent)\s*:?\s*(.+)$"
DATED = r"(?iU)^(?:fecha|enviad[oa](?:\s+el)?|sent|date)\b.*[0-9]{1,2}[/\-. ]\w+[/\-. ][0-9]{2,4}"
ADDRESSED = r"(?i)^(?:para|to|cc|cco|bcc|asunto|subject)\s*:?\s+\S"
IN_WORDS = re.compile(r"\b(\d{1,3})\s*(mil|millones?)\s*(?:de\s*)?pesos?\b", re.I)
AMOUNT = re.compile(r"(?:(?P<before>\$|COP|USD)\s*)?(?P<n>\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{1,2})?|\d{4,}(?:[.,]\d{1,2})?)(?:\s*(?P<after>COP|USD|pesos))?", re.I)
BAD_NEIGHBOURS = set("-/:@%°#*_")
BOOK_SUFFIX = re.compile(r"(?:CR|DB|COP|USD)(?![A-Za-z])", re.I)


def read_amount(raw: str) -> float | None:
    """The last separator is decimal before one or two digits; the rest group thousands."""
    m = re.search(r"[.,](\d{1,2})$", raw)
    whole = re.sub(r"[.,]", "", raw[: m.start()] if m else raw)
    return float(f"{whole}.{m[1]}" if m else whole) if whole.isdigit() else None


def amounts_of(line: str) -> list[tuple[str, float, bool, int]]:
    """(text, value, has a currency, place) of each number of a line that can be an amount of money; those in words come last.

    Both "mil" and "millones" count a thousand, as the rule in use has it.
    """
    found = []
    for m in AMOUNT.finditer(line):
        a, b = m.span("n")
        left, right = line[a - 1:a] or " ", line[b:b + 1] or " "
        value, currency = read_amount(m["n"]), bool(m["before"] or m["after"])
        if value is None or {left, right} & BAD_NEIGHBOURS or left.isalnum():
            continue
        if right.isalnum():
            if not BOOK_SUFFIX.match(line, b):
                continue
            currency = True
        grouped = re.search(r"[.,]\d{3}", m["n"]) is not None
        too_plain = not grouped and (not currency or value < 10_000)
        a_year = not currency and 1900 <= value <= 2100
        if not too_plain and not a_year and value >= 1_000:
            found.append((m[0].strip(), value, currency, a))
    return found + [(m[0].strip(), float(m[1]) * 1000, True, len(line) + m.start()) for m in IN_WORDS.finditer(line)]


def line_amounts(line: Column) -> Column:
    """``amounts_of`` a line as an array; none for a null."""
    types = {"original": pa.string(), "value": pa.float64(), "currency": pa.bool_(), "place": pa.int32()}

    def run(column: pa.Array) -> pa.Array:
        found = [amounts_of(t) if t else () for t in column.to_pylist()]
        parts = list(zip(*chain.from_iterable(found))) or [()] * len(types)
        each = pa.StructArray.from_arrays([pa.array(p, t) for p, t in zip(parts, types.values())], list(types))
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), each)

    return F.arrow_udf(run, "array<struct<original string, value double, currency boolean, place int>>")(line)


def class_of(line: Column) -> Column:
    """acto, solicitud, informativo or mencion; a request outweighs an act on the same line."""
    t = X.fold(line)
    return F.when(t.rlike(REQUEST), "solicitud").when(t.rlike(ACT), "acto").when(t.rlike(INFORMATIVE), "informativo").otherwise("mencion")


def score_of(line: Column, context: Column, value: Column, currency: Column) -> Column:
    near = [F.when(X.has_word(line, k), w).when(X.has_word(context, k), max(1, w // 2)).otherwise(0) for k, w in APPROVAL.items()]
    noise = [F.when(X.has_word(line, k), w).otherwise(0) for k, w in NOISE.items()]
    return sum(near + noise, F.lit(0)) + F.when(currency, 5).otherwise(0) + F.when(value >= 100_000, 2).otherwise(0)


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\r\x0b\x0c\u00a0"))


def mail_header(line: Column) -> Column:
    """A line of a mail's own header: a sender, a date after its label, or an addressee or subject after a space. A table's title that begins so is none."""
    return line.rlike(AUTHOR) | line.rlike(DATED) | line.rlike(ADDRESSED)


def invoices_beside(text: Column, amount: Column) -> Column:
    """Invoices that a text names, without those that are part of the amount; sorted, five at most."""
    return F.slice(F.array_sort(F.array_distinct(F.filter(invoice_ids(text), lambda f: ~F.contains(amount, f)))), 1, 5)


def candidates(lines: DataFrame) -> DataFrame:
    """lines (doc, page, line_no, line) -> ranked candidate amounts of each document.

    Author and date are those of the mail's block above, which opens with a sender and may have its date in the next three lines. The party is the nearest company name
    in the seven lines above, the header the nearest line with a colon at its end in the nineteen above; neither reaches over a mail's header, and the party not over a
    list's header. Invoices are those of the line, else of the lines around it. Of equal (value, line) the best score stays, the
    first of equals; rank goes by score, then value, then place.
    """
    w = Window.partitionBy("doc", "page").orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    said, line = F.col("said"), F.col("line")
    name = F.col("name")
    begins = (name != "") & (F.length(name) <= 90)  # a block of a mail
    # each pattern is tried once on a line, and a document's lines come together once: all windows below stay inside documents
    rows = lines.withColumn("said", stripped(line)).withColumns({
        "usable": ~line.rlike(HEADER) & ~line.rlike(SIGNATURE), "name": stripped(F.regexp_extract(said, AUTHOR, 1)), "sent": F.nullif(stripped(F.regexp_extract(said, SENT, 1)), F.lit("")), "mail": mail_header(said),
        "company": X.party_name(said) & ~said.rlike(HEADER) & ~said.rlike(SIGNATURE),
    })
    # amounts are read before lines meet: a step in Python would undo the partitioning by document
    rows = rows.withColumn("amounts", line_amounts(F.when(F.col("usable") & line.rlike(r"\p{Nd}"), line))).repartition("doc")
    rows = rows.withColumns({
        "begins": begins, "n": F.row_number().over(w), "block": F.sum(begins.cast("int")).over(upto), "dated": F.coalesce(*[F.lead("sent", k).over(w) for k in (1, 2, 3)], F.lit("")),
        "context": F.array_join(F.collect_list(F.when(F.col("usable") & (said != ""), said)).over(w.rowsBetween(-2, 2)), " "),
    })
    colon, at = said.endswith(":"), lambda what: F.when(what, F.struct("n", "block", said.alias("line")))
    above = lambda c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({
        "opened": F.last(F.when(F.col("begins"), F.struct("name", "dated")), ignorenulls=True).over(upto),
        # a header of mail, and for a party a line that opens a list, hides what stands above it
        "fence": above(F.when(F.col("mail"), F.col("n"))), "barrier": above(F.when((F.col("mail") | colon) & (said != ""), F.col("n"))),
        "head_at": above(at(colon & ~F.col("mail") & (F.length("said") <= 120))), "party_at": above(at(F.col("company") & ~colon & ~F.col("mail"))),
    })
    seen = lambda at, wall, reach: F.when((F.col(f"{at}.block") == F.col("block")) & (F.col("n") - F.col(f"{at}.n") <= reach) & (F.col(f"{at}.n") > F.coalesce(wall, F.lit(0))), F.col(f"{at}.line"))
    rows = rows.withColumns({"header": seen("head_at", F.col("fence"), 19), "party": seen("party_at", F.col("barrier"), 7), "author": F.col("opened.name"), "date": F.col("opened.dated")})
    rows = rows.where("size(amounts) > 0").withColumn("m", F.explode("amounts")).select(*lines.columns, "context", "author", "date", "header", "party", "m.*")
    # folded texts and a line's own invoices are columns, so that each is made once and not for each of its uses
    found = rows.withColumns({"_said": X.fold(F.col("line")), "_near": X.fold(F.col("context"))})
    found = found.withColumns({"score": score_of(F.col("_said"), F.col("_near"), F.col("value"), F.col("currency")), "_own": invoices_beside(F.col("line"), F.col("original"))})
    found = found.withColumn("invoices", F.when(F.size("_own") > 0, F.col("_own")).otherwise(invoices_beside(F.col("context"), F.col("original")))).withColumn("line", stripped(F.col("line"))).drop("_said", "_near", "_own")
    best = Window.partitionBy("doc", "value", "line").orderBy(F.desc("score"), "page", "line_no", "place")
    one = found.withColumn("_b", F.row_number().over(best)).where("_b = 1").drop("_b")
    rank = Window.partitionBy("doc").orderBy(F.desc("score"), F.desc("value"), "page", "line_no", "place")
    own, above = F.col("_own"), F.col("_above")
    kind = F.when((own == "mencion") & above.isin("acto", "solicitud"), above).otherwise(own)
    classed = one.withColumn("rank", F.row_number().over(rank)).withColumns({"_own": class_of(F.col("line")), "_above": class_of(F.col("header"))})
    return classed.withColumn("kind", kind).drop("_own", "_above")


LISTED = 40


def listed(cands: DataFrame) -> DataFrame:
    """The candidates that a document offers: scores of 0 or more, the best 40. The others are quantities and codes."""
    return cands.where((F.col("score") >= 0) & (F.col("rank") <= LISTED))


def summaries(lines: DataFrame, cands: DataFrame) -> DataFrame:
    """lines and their candidates -> one row per document: subject, invoices, orders, suggested, shown, dropped.

    The subject is the first of the first twelve lines that is not blank and not the mail program's name, else blank. Of the invoices the first 20 count, shorter ones first, so that numbers are in their order. The
    best candidate is suggested if its score is above 0; shown and dropped count those of scores from 0 (40 at most) and below it.
    """
    said = F.trim(F.coalesce("line", F.lit("")))
    w = Window.partitionBy("doc").orderBy("page", "line_no")
    top = lines.select("doc", said.alias("said"), F.row_number().over(w).alias("n")).where("n <= 12")
    subject = top.groupBy("doc").agg(F.min_by("said", F.when((F.col("said") != "") & (F.lower("said") != "outlook"), F.col("n"))).alias("subject"))
    whole = lines.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "line_no", "line"))), lambda l: F.coalesce(l["line"], F.lit(""))), "\n").alias("text"))
    named = whole.select("doc", F.slice(F.transform(F.array_sort(F.transform(F.array_distinct(invoice_ids(F.col("text"))), lambda f: F.struct(F.length(f), f.alias("f")))), lambda x: x["f"]), 1, 20).alias("invoices"), mail_orders(F.col("text")).alias("orders"))
    best = cands.groupBy("doc").agg(F.max(F.when((F.col("rank") == 1) & (F.col("score") > 0), F.col("value"))).alias("suggested"), F.count_if(F.col("score") >= 0).alias("good"), F.count_if(F.col("score") < 0).alias("bad"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return named.join(subject, "doc").join(best, "doc", "left").select("doc", F.coalesce("subject", F.lit("")).alias("subject"), "invoices", "orders", "suggested", F.least(count("good"), F.lit(LISTED).cast("long")).alias("shown"), count("bad").alias("dropped"))


def with_invoices(cands: DataFrame) -> DataFrame:
    """Candidates with the first of their invoices, or that of the best ranked candidate of the document with the same value that has any; else blank."""
    own = F.coalesce(F.get("invoices", 0), F.lit(""))
    same = Window.partitionBy("doc", "value").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.when(own != "", own), ignorenulls=True).over(same)
    return cands.withColumn("invoice", F.when(own != "", own).otherwise(F.coalesce(first, F.lit(""))))


def chosen(cands: DataFrame) -> DataFrame:
    """Approved amounts of each document: acts, or requests where there are none; the largest per line; each value once."""
    doc = Window.partitionBy("doc")
    acts = F.max((F.col("kind") == "acto").cast("int")).over(doc)
    pick = cands.withColumn("acts", acts).where((F.col("kind") == "acto") | ((F.col("acts") == 0) & (F.col("kind") == "solicitud")))
    pick = pick.withColumn("top", F.max("value").over(Window.partitionBy("doc", "line"))).where("value = top")
    return pick.withColumn("_v", F.row_number().over(Window.partitionBy("doc", "value").orderBy("rank"))).where("_v = 1").drop("_v", "top", "acts")


# The wording of reasons and notes.
REASONS = {"informativo": "valor informativo (nota crédito, saldo o registro contable)", "mencion": "se menciona sin aprobación explícita", "solicitud": "es una solicitud de aprobación, no la aprobación"}
NOTES = {"baja": "Solo se encontraron solicitudes de aprobación. Falta el correo donde el jefe aprueba el valor.", "media": "Algunos renglones provienen de una solicitud de aprobación y no de la aprobación misma. Verifica el correo del aprobador.", "alta": ""}
NOTHING, NO_MAILS = "No se encontró ningún valor aprobado en los correos.", "No hay correos con texto para determinar el valor aprobado."
KINDS_READ = ["", "correo", "otro"]
DISCARDED = 20


def approval_mails(docs: DataFrame) -> DataFrame:
    """Documents (category, needs_ocr, ...) that can approve an amount: mails and others, with a text."""
    return docs.where(F.coalesce("category", F.lit("")).isin(*KINDS_READ) & ~F.coalesce("needs_ocr", F.lit(False)))


def discarded(cands: DataFrame, picked: DataFrame) -> DataFrame:
    """Candidates whose value their document doesn't approve, and why: an act on a line with a larger one is named by its document alone."""
    return _reasoned(cands.join(picked.select("doc", "value").distinct(), ["doc", "value"], "left_anti"))


def unchosen(cands: DataFrame) -> DataFrame:
    """``discarded`` of the candidates that ``chosen`` passes over, read off windows over their document: candidates are read once. doc and value are not null."""
    acts = F.max((F.col("kind") == "acto").cast("int")).over(Window.partitionBy("doc"))
    can = (F.col("kind") == "acto") | ((F.col("acts") == 0) & (F.col("kind") == "solicitud"))
    rows = cands.withColumn("acts", acts).withColumn("top", F.max(F.when(can, F.col("value"))).over(Window.partitionBy("doc", "line")))
    rows = rows.withColumn("taken", F.max(F.when(can & (F.col("value") == F.col("top")), True)).over(Window.partitionBy("doc", "value")))
    return _reasoned(rows.where("taken IS NULL").drop("acts", "top", "taken"))


def _reasoned(left: DataFrame) -> DataFrame:
    doc = F.col("doc").cast("string")
    reason = F.coalesce(*[F.when(F.col("kind") == k, F.concat(doc, F.lit(f": {v}"))) for k, v in REASONS.items()], doc)
    keep = [c for c in ("payment",) if c in left.columns]
    return left.select(*keep, "doc", "rank", "value", "kind", reason.alias("reason"))


def approved(picked: DataFrame, payee: Column | None = None) -> DataFrame:
    """picked (payment, doc, rank, value, line, kind, author, party; orders, if known) -> each approved amount once.

    The same value with the same quotation (80 characters) counts once over all mails of a payment; its documents and orders are those of all of them, in order. With a payee,
    amounts of others don't stay where any is the payee's; lost tells that parties are named and none of them is the payee.
    """
    rows = picked if "orders" in picked.columns else picked.withColumn("orders", F.array().cast("array<string>"))
    rows = rows.withColumns({"_payee": F.coalesce(payee, F.lit("")) if payee is not None else F.lit(""), "quote": F.left("line", F.lit(300))})
    first = F.min_by(F.struct(*[c for c in rows.columns if c not in ("payment", "value", "orders")]), F.struct("doc", "rank"))
    seen = F.sort_array(F.collect_list(F.struct("doc", "rank", "orders")))
    once = rows.groupBy("payment", "value", F.substring(X.fold(F.col("quote")), 1, 80).alias("_said")).agg(first.alias("f"), seen.alias("_seen"))
    once = once.select("payment", "value", "f.*", F.array_distinct(F.transform("_seen", lambda x: x["doc"])).alias("documents"), F.array_distinct(F.flatten(F.transform("_seen", lambda x: x["orders"]))).alias("orders"))
    w = Window.partitionBy("payment")
    named = (F.col("_payee") != "") & (F.coalesce("party", F.lit("")) != "")
    mine = named & X.same_party(F.col("party"), F.col("_payee"))
    once = once.withColumns({"_mine": mine, "_some": F.max(named).over(w)}).withColumn("_any", F.max("_mine").over(w))
    return once.withColumns({"stays": ~F.col("_any") | F.col("_mine"), "lost": F.col("_some") & ~F.col("_any")}).drop("_mine", "_some", "_any")


def _judged(rows: DataFrame) -> DataFrame:
    """A row per payment of ``approved``."""
    stays, order = F.col("stays"), [F.col("doc"), F.col("rank")]
    kept = lambda *cs: F.sort_array(F.collect_list(F.when(stays, F.struct(*order, *cs))))
    n, acts = F.count_if(stays), F.count_if(stays & (F.col("kind") == "acto"))
    lost = F.bool_or("lost")
    level = F.when(lost, "baja").when((acts == n) & (F.count_if(stays & (F.coalesce("author", F.lit("")) == "")) == 0), "alta").when(acts > 0, "media").otherwise("baja")
    base = F.when((acts == n) & (F.count_if(stays & (F.coalesce("author", F.lit("")) == "")) == 0), NOTES["alta"]).when(acts > 0, NOTES["media"]).otherwise(NOTES["baja"])
    parts = F.array_join(F.transform(kept(F.col("value")), lambda x: F.format_number(x["value"], 2)), " + ")
    names = F.array_join(F.array_sort(F.collect_set(F.when(F.coalesce("party", F.lit("")) != "", F.col("party")))), ", ")
    shared = F.when(n > 1, F.concat(F.lit("Pago repartido: "), parts, F.lit(".")))
    strangers = F.when(lost, F.concat(F.lit("El correo aprueba facturas de "), names, F.lit(" y ninguno coincide con el titular ("), F.max("_payee"), F.lit("): revisa cual corresponde.")))
    reason = F.concat(F.col("doc").cast("string"), F.lit(": aprobado de otro proveedor ("), F.coalesce(F.nullif(F.col("party"), F.lit("")), F.lit("sin nombre")), F.lit("), no de "), F.col("_payee"))
    others = F.reverse(F.sort_array(F.collect_list(F.when(~stays, F.struct(*order, "value", reason.alias("reason"))))))
    return rows.groupBy("payment").agg(
        F.round(F.sum(F.when(stays, F.col("value"))), 2).alias("total"), n.alias("lines"), (n > 1).alias("split"), level.alias("confidence"),
        F.array_distinct(F.flatten(F.transform(kept(F.col("documents")), lambda x: x["documents"]))).alias("documents"), F.array_distinct(F.flatten(F.transform(kept(F.col("orders")), lambda x: x["orders"]))).alias("orders"),
        F.concat_ws(" ", F.nullif(base, F.lit("")), shared, strangers).alias("note"), F.transform(others, lambda x: F.struct(x["value"].alias("value"), x["reason"].alias("reason"))).alias("others"))


def verdict(picked: DataFrame, payee: Column | None = None) -> DataFrame:
    """One row per payment with approved amounts: total, lines, split, confidence (see ``approved``)."""
    return _judged(approved(picked, payee)).select("payment", "total", "lines", "split", "confidence")


def decisions(payments: DataFrame, picked: DataFrame, payee: Column | None = None, *, mails: DataFrame | None = None, left: DataFrame | None = None) -> DataFrame:
    """payments (payment) and picked as of ``approved`` -> one row per payment: the verdict, its documents and orders, a note, and what was discarded.

    mails (payment): those that could be read; a payment without any says so. left: ``discarded`` amounts (payment, doc, rank, value, reason); approved amounts of
    other parties come before them, the last first, and 20 are kept. A payment without approved amounts has a total of 0 and low confidence. payment is unique and not null.
    """
    none = F.array().cast("array<struct<value: double, reason: string>>")
    j = payments.select("payment").join(_judged(approved(picked, payee)), "payment", "left")
    if left is not None:
        rest = left.groupBy("payment").agg(F.transform(F.sort_array(F.collect_list(F.struct("doc", "rank", "value", "reason"))), lambda x: F.struct(x["value"].alias("value"), x["reason"].alias("reason"))).alias("rest"))
        j = j.join(rest, "payment", "left")
    else:
        j = j.withColumn("rest", none)
    if mails is not None:
        j = j.join(mails.select("payment").distinct().withColumn("read", F.lit(True)), "payment", "left")
    else:
        j = j.withColumn("read", F.lit(True))
    empty = F.array().cast("array<string>")
    note = F.when(F.col("read").isNull(), NO_MAILS).when(F.col("confidence").isNull(), NOTHING).otherwise(F.col("note"))
    return j.select(
        "payment", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("lines", F.lit(0).cast("long")).alias("lines"), F.coalesce("split", F.lit(False)).alias("split"), F.coalesce("confidence", F.lit("baja")).alias("confidence"),
        F.coalesce("documents", empty).alias("documents"), F.coalesce("orders", empty).alias("orders"), note.alias("note"), F.slice(F.concat(F.coalesce("others", none), F.coalesce("rest", none)), 1, DISCARDED).alias("discarded"))
