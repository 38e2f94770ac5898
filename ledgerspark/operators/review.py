"""The whole review of an e-invoice: its number, hash, code and parties against what the payment knows.

Parties and hash are column expressions over the row; only the number's evidence is grouped by document. The two meet in one
join on the document, which carries no texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .checks import invoice
from .documents import labelled_ids
from .evidence import against_voucher, invoice_numbers

# The link of the tax office's check, and the fields of its code.
CHECK_LINK = r"(?i)(?:catalogo-vpfe|documentkey=)\S*?[0-9a-f]{96}"
NUMBER_FIELD, ISSUER_FIELD, BUYER_FIELD, HASH_FIELD = "numfac", "nitfac", "docadq", "cufe"


def printed(text: Column, tax_id: Column) -> Column:
    """Whether a text shows the id, however its digits are spaced; a blank id is never shown."""
    return F.coalesce((X.digits(tax_id) != "") & F.regexp_like(text, X.tax_id_pattern(tax_id)), F.lit(False))


def parties(ids: Column, code: Column, own: Column, third: Column, own_shown: Column, third_shown: Column) -> tuple[Column, Column, Column]:
    """ids: the text's labelled ids. Issuer, buyer, and whether the buyer was named as such (by the code or by its box) and not just seen somewhere.

    Issuer: of the code; else the expected one if the text shows it; else the first id that is not the own one, those with an
    issuer's words first. Buyer: of the code; else of the buyers' boxes the own id, or the first; else the own id if it is shown.
    """
    of_code = lambda f: F.nullif(X.digits(code[f]), F.lit(""))
    strange = F.filter(ids, lambda i: ~X.same_tax_id(i["tax_id"], own))
    first = lambda xs: F.get(xs, 0)["tax_id"]
    issuer = F.coalesce(of_code(ISSUER_FIELD), F.when(third_shown, X.digits(third)), first(F.filter(strange, lambda i: i["role"] == "emisor")), first(strange))
    boxes = F.filter(ids, lambda i: i["role"] == "adquirente")
    named = F.coalesce(of_code(BUYER_FIELD), first(F.filter(boxes, lambda i: X.same_tax_id(i["tax_id"], own))), first(boxes))
    return F.coalesce(issuer, F.lit("")), F.coalesce(named, F.when(own_shown, X.digits(own)), F.lit("")), named.isNotNull()


def review(docs: DataFrame) -> DataFrame:
    """docs (doc, text, links, code, code_seen, name, expected, own_id, third_id, cited) -> one row per document.

    code is the QR code's text, code_seen whether a code was found by its shape, cited the number in the voucher. Hash: of the
    text, of a link to the tax office, of the code. A link stands for a code. The client's check is open without an own id, or
    where no buyer is named and the own id isn't shown; the third party's is open without its id. A cited number that is nearly
    the number read fails as numero_egreso. m is OK when all is known and right; n number; o the third party's id as the table has
    it, else the issuer; p the third party's check. Nulls count as blank; failed and pending are sorted by name. doc is unique.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    link = F.get(F.filter("links", lambda u: F.regexp_like(u, F.lit(CHECK_LINK))), 0)
    rows = docs.select("doc", blank("text").alias("text"), blank("code").alias("raw"), X.qr_fields(blank("code")).alias("code"), F.coalesce("code_seen", F.lit(False)).alias("code_seen"), link.alias("link"), blank("own_id").alias("own"), blank("third_id").alias("third"), blank("cited").alias("cited"), "name", "expected")
    text, own, third = F.col("text"), F.col("own"), F.col("third")
    rows = rows.withColumns({"ids": labelled_ids(text), "own_shown": printed(text, own), "third_shown": printed(text, third)})
    issuer, buyer, named = parties(F.col("ids"), F.col("code"), own, third, F.col("own_shown"), F.col("third_shown"))
    coded = F.when(F.col("code")[HASH_FIELD].rlike("^[0-9a-fA-F]{96}$"), F.lower(F.col("code")[HASH_FIELD]))
    facts = rows.select(
        "doc", "own", "third", "cited", issuer.alias("issuer"), buyer.alias("buyer"), named.alias("named"), "own_shown", "third_shown",
        F.coalesce(X.invoice_hash(text), X.invoice_hash(F.col("link")), coded, F.lit("")).alias("hash"), ((F.col("raw") != "") | F.col("code_seen") | F.col("link").isNotNull()).alias("has_code"))
    numbers = invoice_numbers(rows.select("doc", "text", F.coalesce(F.col("code")[NUMBER_FIELD], F.lit("")).alias("qr"), "expected", "name"))
    j = facts.join(numbers.select("doc", "number"), "doc")
    client = F.when(own != "", F.when(F.col("named"), X.same_tax_id(F.col("buyer"), own)).when(F.col("own_shown"), True))
    supplier = F.when(third != "", X.same_tax_id(F.col("issuer"), third) | F.col("third_shown"))
    agrees = F.coalesce(against_voucher(F.col("number"), F.col("cited")), F.lit(True))
    state, bad, open_ = invoice({"cufe": F.col("hash") != "", "nit_cliente": client, "nit_tercero": supplier, "numero": F.col("number") != "", "numero_egreso": agrees, "qr": F.col("has_code")})
    shown = F.when(F.coalesce(supplier, F.lit(False)), X.digits(third)).otherwise(F.col("issuer"))
    note = F.when(~agrees, F.concat(F.lit("el egreso dice "), F.col("cited"), F.lit(" y la factura dice "), F.col("number"))).otherwise("")
    return j.select("doc", "hash", "issuer", "buyer", state.alias("m"), F.col("number").alias("n"), shown.alias("o"), supplier.alias("p"), F.array_sort(bad).alias("failed"), F.array_sort(open_).alias("pending"), note.alias("note"))
