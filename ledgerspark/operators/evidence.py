"""The number of an invoice by evidence: each rule gives points to candidates, and the candidate with most points is the number.

All evidence of a document is one array of structs, made by column expressions in one scan; it is exploded and summed by
candidate. Ranges are an array of the same row, so that no rule joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import spots
from .documents import RANGE

# The labels of an invoice's number, a bare "No.", what makes a "No." another number, and words of file names.
LABELLED = r"(?i)(?:factura\s+(?:electr[oó]nica\s+)?(?:de\s+venta\s+)?n[o°u]?\s*\.?\s*:?\s*|Nro\.?\s*Doc\.?\s*:?\s*|No\.?\s*Factura\s*:?\s*|FE\s*No\.?\s*|(?:Nro|N[uú]mero)\.?\s+de\s+documento\s*:\s*)([A-Z]{0,6}[-\s]?(?:No\.?\s*)?\d{1,12})"
BARE = r"(?i)\bN[o°º]\.?\s*:?\s*([A-Z]{1,6})?[-\s]?(\d{1,12})\b"
OTHER = r"(?i)(?:cuota|cuenta|cta|orden|pedido|o\.?\s?c|remisi[oó]n|autorizaci[oó]n|resoluci[oó]n|tel[eé]fono|cel|nit|cc|c\.c|documento\s+de\s+identidad|gu[ií]a|contrato|poliza|p[oó]liza)[^\n]{0,25}$"
NAME_WORDS = r"(?i)\b(?:factura|fra|fact|no|nro|n[o°º]|de|electr[oó]nica|venta|copia)\b\.?"
NAME_NUMBER = r"\b([A-Z]{1,6})?[\s_-]?(\d{2,12})\b"
# Points of the rules and the least that names a number.
POINTS = {"label": 4, "bare": 1, "near": 2, "range": 5, "expected": 6, "name": 2, "inside": 3, "outside": -3, "foreign": -1}
LEAST = 2
REASONS = {"label": "etiqueta de factura", "bare": "detrás de un No.", "range": "prefijo en el rango autorizado", "expected": "coincide con el egreso", "name": "nombre del archivo", "inside": "dentro del rango autorizado"}


def _vote(prefix: Column, digits: Column, points: Column, rule: str, place: Column) -> Column:
    return F.struct(F.upper(prefix).alias("prefix"), digits.alias("digits"), points.alias("points"), F.lit(list(REASONS).index(rule)).alias("rule"), place.alias("place"))


def _number(c: Column) -> Column:
    return F.coalesce(F.nullif(F.ltrim(c, F.lit("0")), F.lit("")), c)


def name_hints(name: Column) -> Column:
    """(prefix, digits) of the numbers in a file's name, its suffix and the words for an invoice left out."""
    stem = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"\.[A-Za-z0-9]+$", ""), NAME_WORDS, " ")
    return F.transform(F.regexp_extract_all(stem, F.lit(NAME_NUMBER), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, NAME_NUMBER, 1).alias("prefix"), F.regexp_extract(m, NAME_NUMBER, 2).alias("digits")))


def ranges_of(text: Column) -> Column:
    """The numbering ranges of a text as an array of prefix, low, high; a range without a prefix has a blank one."""
    made = F.transform(F.regexp_extract_all(text, F.lit(RANGE), F.lit(0)), lambda m: F.struct(F.upper(F.regexp_extract(m, RANGE, 1)).alias("prefix"), F.regexp_extract(m, RANGE, 2).try_cast("long").alias("low"), F.regexp_extract(m, RANGE, 3).try_cast("long").alias("high")))
    return F.filter(made, lambda r: (r["low"] >= 0) & (r["low"] < r["high"]))


def votes(text: Column, ranges: Column, expected: Column, name: Column) -> Column:
    """Evidence of all rules: labels, bare numbers, authorised prefixes, the voucher's number, the file's name."""
    p = {k: F.lit(v) for k, v in POINTS.items()}

    def label(s: Column) -> Column:
        raw = F.regexp_replace(F.regexp_replace(F.regexp_extract(s["hit"], LABELLED, 1), r"(?i)\bNo\.?", ""), r"\s+", "")
        return _vote(F.regexp_extract(raw, r"^([A-Za-z]*)-?([0-9]+)$", 1), F.regexp_extract(raw, r"^([A-Za-z]*)-?([0-9]+)$", 2), p["label"], "label", s["place"])

    def bare(s: Column) -> Column:
        around = F.concat(F.substring_index(F.substring(text, F.lit(1), s["place"]), "\n", -3), F.substring_index(F.substring(text, s["place"] + 1, F.length(text)), "\n", 2))
        near = F.lower(around).rlike("factura|invoice")
        return _vote(F.regexp_extract(s["hit"], BARE, 1), F.regexp_extract(s["hit"], BARE, 2), p["bare"] + F.when(near, p["near"]).otherwise(0), "bare", s["place"])

    def before(s: Column, n: int) -> Column:
        return F.substring(text, F.greatest(s["place"] - n + 1, F.lit(1)), F.least(s["place"], F.lit(n)))

    def authorised(r: Column) -> Column:
        found = spots(text, F.concat(F.lit(r"(?<![A-Z])"), r["prefix"], F.lit(r"\s*-?\s*[0-9]{1,10}\b")))
        each = F.transform(found, lambda s: _vote(r["prefix"], F.regexp_extract(s["hit"], "[0-9]+$", 0), p["range"], "range", s["place"]))
        return F.filter(each, lambda v: (v["digits"].cast("long") > r["low"]) & (v["digits"].cast("long") < r["high"]))

    wanted = F.ltrim(X.digits(expected), F.lit("0"))
    printed = lambda d: F.concat(F.lit("(?<![0-9])0*"), d, F.lit("(?![0-9])"))
    asked = F.when((wanted != "") & F.contains(text, wanted), F.transform(spots(text, printed(wanted)), lambda s: _vote(F.regexp_extract(before(s, 8), r"([A-Z]{1,6})\s*-?\s*$", 1), wanted, p["expected"], "expected", s["place"])))
    hints = F.filter(name_hints(name), lambda h: F.contains(text, _number(h["digits"])) & F.regexp_like(text, printed(_number(h["digits"]))))
    every = [
        F.transform(spots(text, F.lit(LABELLED)), label),
        F.transform(F.filter(spots(text, F.lit(BARE)), lambda s: ~before(s, 40).rlike(OTHER)), bare),
        F.flatten(F.transform(F.filter(ranges, lambda r: r["prefix"] != ""), authorised)),
        asked, F.transform(hints, lambda h: _vote(h["prefix"], h["digits"], p["name"], "name", F.length(text))),
    ]
    a_year = lambda v: (v["prefix"] == "") & (F.length(v["digits"]) == 4) & v["digits"].cast("int").between(1900, 2100)
    return F.filter(F.flatten(F.array_compact(F.array(*every))), lambda v: F.length(v["digits"]).between(1, 12) & ~a_year(v))


def invoice_numbers(docs: DataFrame) -> DataFrame:
    """docs (doc, text, qr, expected, name) -> doc, number, source, points.

    A number in the QR code stands by itself. Else points are summed by prefix and number without leading zeros; a number inside an
    authorised range of its prefix gains once, outside it or under another prefix it loses for each range. Most points
    win, then the earliest place, then the rule that is tried first; under two points there is no number. Null texts have none. doc is unique.
    """
    text = F.coalesce("text", F.lit(""))
    qr = F.regexp_replace(F.coalesce("qr", F.lit("")), "[^A-Za-z0-9-]", "")
    rows = docs.select("doc", text.alias("text"), qr.alias("qr"), "expected", "name").withColumn("ranges", ranges_of(F.col("text")))
    each = rows.select("doc", "qr", "ranges", F.posexplode_outer(F.when(F.col("qr") == "", votes(F.col("text"), F.col("ranges"), F.col("expected"), F.col("name")))).alias("found", "v"))
    each = each.select("doc", "qr", "ranges", "found", "v.*", F.concat("v.prefix", _number(F.col("v.digits"))).alias("candidate"))
    first = F.struct("rule", "place")
    sums = each.groupBy("doc", "candidate").agg(F.any_value("qr").alias("qr"), F.any_value("ranges").alias("ranges"), F.sum("points").alias("points"), F.min("place").alias("place"), F.min("found").alias("found"), F.array_sort(F.collect_set("rule")).alias("rules"), F.min_by("prefix", first).alias("prefix"), F.min_by("digits", first).alias("digits"))
    n, own = F.col("digits").cast("long"), F.col("prefix")
    within = lambda r: (r["prefix"] == own) & n.between(r["low"], r["high"])
    gains = F.exists("ranges", within) & ~F.array_contains("rules", list(REASONS).index("range"))
    loses = F.aggregate("ranges", F.lit(0), lambda a, r: a + F.when(within(r), 0).when(r["prefix"] == own, POINTS["outside"]).when((r["prefix"] != "") & (own != ""), POINTS["foreign"]).otherwise(0))
    rules = F.when(gains, F.array_append("rules", F.lit(list(REASONS).index("inside")))).otherwise(F.col("rules"))
    total = F.col("points") + loses + F.when(gains, POINTS["inside"]).otherwise(0)
    named = F.array(*map(F.lit, REASONS.values()))
    scored = sums.select("doc", "qr", total.alias("points"), "place", "found", F.concat("prefix", "digits").alias("number"), F.concat(F.lit("texto ("), F.array_join(F.transform(rules, lambda k: F.get(named, k)), ", "), F.lit(")")).alias("source"))
    best = scored.groupBy("doc").agg(F.any_value("qr").alias("qr"), F.max_by(F.struct("number", "source", "points"), F.struct("points", -F.col("place"), -F.col("found"))).alias("b"))
    enough = F.col("b.points") >= LEAST
    pick = lambda c, code: F.when(F.col("qr") != "", code).when(enough, F.col(f"b.{c}")).otherwise("")
    return best.select("doc", pick("number", F.col("qr")).alias("number"), pick("source", F.lit("QR")).alias("source"), F.when((F.col("qr") == "") & enough, F.col("b.points")).alias("points"))


def against_voucher(number: Column, expected: Column, most: int = 2) -> Column:
    """False where the number read is not the voucher's and differs in at most two digits of the same length; true where both are equal; else null."""
    a, b = X.whole_number(number), X.whole_number(expected)
    return F.when((a == "") | (b == ""), F.lit(None).cast("boolean")).when(a == b, True).when(X.differing(a, b) <= most, False)
