"""Number readers, all built-in column expressions. Documents write numbers in several ways and each reader keeps its own rule.

Every reader gives null where the text is no number of its kind; nothing raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATED = r"^[0-9.,]+$"


def _double(c: Column) -> Column:
    return c.try_cast("double")


def _drop(c: Column, what: str) -> Column:
    return F.regexp_replace(c, what, "")


def mixed(text: Column) -> Column:
    """N1-N3: the last separator is decimal when it leaves one or two digits; all others group thousands."""
    t = F.trim(text)
    tail = F.regexp_extract(t, r"[.,]([0-9]*)$", 1)
    head = F.substring(t, F.lit(1), F.length(t) - F.length(tail) - 1)
    decimal = t.rlike(r"[.,][0-9]{1,2}$")
    return F.when(t.rlike(SEPARATED), _double(F.when(decimal, F.concat(_drop(head, "[.,]"), F.lit("."), tail)).otherwise(_drop(t, "[.,]"))))


def simple(text: Column) -> Column:
    """N4: with both separators the last is decimal; a lone comma is decimal before one or two digits; dots stay."""
    t = F.regexp_replace(F.trim(text), r"[.,]+$", "")
    both = t.contains(",") & t.contains(".")
    comma_last = t.rlike(r",[^.]*$")
    few = t.rlike(r",[0-9.]{1,2}$")
    plain = (
        F.when(both & comma_last, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(both, F.replace(t, F.lit(","), F.lit("")))
        .when(t.contains(","), F.replace(t, F.lit(","), F.when(few, ".").otherwise("")))
        .otherwise(t)
    )
    return F.when(t.rlike(SEPARATED), _double(plain))


def receipt_quantity(text: Column) -> Column:
    """N5: beside a dot commas group thousands; a lone comma is decimal before exactly two digits."""
    t = F.regexp_replace(F.trim(text), r"[.,]+$", "")
    two = t.rlike(r",[0-9.]{2}$")
    plain = F.when(t.contains(","), F.replace(t, F.lit(","), F.when(t.contains("."), "").when(two, ".").otherwise(""))).otherwise(t)
    return F.when(t.rlike(SEPARATED), _double(plain))


def longest_number(text: Column) -> Column:
    """The run with most digits, the first of equals, once a lost decimal comma is back; null where there is none."""
    fixed = F.regexp_replace(F.coalesce(text, F.lit("")), r"([0-9]{1,3}(?:\.[0-9]{3})+)\s+([0-9]{2})(?![0-9])", "$1,$2")
    found = F.regexp_extract_all(F.replace(fixed, F.lit(" "), F.lit("")), F.lit(r"[0-9][0-9.,]*"), F.lit(0))
    digits = lambda x: F.length(_drop(x, "[.,]"))
    return F.nullif(F.aggregate(found, F.lit(""), lambda best, x: F.when(digits(x) > digits(best), x).otherwise(best)), F.lit(""))


def portal_amount(text: Column) -> Column:
    """N6: dots group thousands and the comma is decimal, but a last group of two digits after a dot is decimals."""
    return portal_value(longest_number(text))


def portal_value(raw: Column) -> Column:
    """``portal_amount`` of a ``longest_number``."""
    comma = F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    cents = raw.rlike(r"\.[0-9]{2}$")
    dotted = F.when(cents, F.concat(_drop(F.regexp_replace(raw, r"\.[0-9]{2}$", ""), r"\."), F.lit("."), F.right(raw, F.lit(2)))).otherwise(_drop(raw, r"\."))
    return _double(F.when(raw.contains(","), comma).otherwise(dotted))


def portal_shape(text: Column) -> Column:
    """Whether the amount is written in one of the four accepted shapes; true where there is nothing to read."""
    return portal_shaped(longest_number(text))


def portal_shaped(raw: Column) -> Column:
    """``portal_shape`` of a ``longest_number``."""
    shapes = r"^(?:[0-9]{1,3}(?:\.[0-9]{3})*(?:,[0-9]{1,2})?|[0-9]{1,3}(?:\.[0-9]{3})*\.[0-9]{2}|[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{1,2})?|[0-9]+)$"
    return F.coalesce(raw.rlike(shapes), F.lit(True))


def form_quantity(text: Column) -> Column:
    """N7: the first number; with both separators or a comma alone the comma is decimal."""
    raw = F.nullif(F.regexp_extract(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit("")), r"[0-9][0-9.,]*", 0), F.lit(""))
    return _double(F.when(raw.contains(",") & raw.contains("."), F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(raw, F.lit(","), F.lit("."))))
