"""Three-valued checks of documents against what is expected: true, false, or null for what cannot be checked."""

from __future__ import annotations

from collections.abc import Iterator
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

SEP = " · "


def failed(checks: dict[str, Column]) -> Column:
    """Names of the checks that are false."""
    return F.array_compact(F.array(*[F.when(~v, F.lit(k)) for k, v in checks.items()]))


def unknown(checks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(v.isNull(), F.lit(k)) for k, v in checks.items()]))


def state(checks: dict[str, Column], pending: Column | None = None) -> Column:
    """Revisar if any check fails, else Pendiente if anything is open, else OK."""
    open_ = F.size(unknown(checks)) > 0 if pending is None else pending
    return F.when(F.size(failed(checks)) > 0, "Revisar").when(open_, "Pendiente").otherwise("OK")


def _filled(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) != ""


def voucher(total: Column, table_value: Column) -> tuple[Column, Column]:
    """Column U: the voucher's total against the bank table's value."""
    same = F.abs(total - table_value) < 0.01
    note = F.when(total.isNull(), "sin total").when(table_value.isNull(), "sin valor en la tabla").when(~same, "no cuadra").otherwise("")
    return F.when(F.coalesce(same, F.lit(False)), "OK").otherwise("Revisar"), note


def purchase_entry(order: Column, expected_order: Column, invoice: Column, expected_invoice: Column) -> tuple[Column, Column, Column]:
    """Column V: order and invoice are compared only where both sides have one; nothing compared leaves it blank."""
    both = lambda a, b: F.when(_filled(a) & _filled(b), X.trimmed_digits(a) == X.trimmed_digits(b))
    checks = {"orden_compra": both(order, expected_order), "factura": both(invoice, expected_invoice)}
    bad = failed(checks)
    return F.when(F.size(bad) > 0, "Revisar").when(F.coalesce(*checks.values()).isNotNull(), "OK").otherwise(""), bad, F.when(_filled(expected_order) & ~_filled(order), "sin orden").otherwise("")


def order_limit(tax_id: Column, expected_id: Column, number: Column, entry_numbers: Column, quantity: Column, limit: Column) -> tuple[Column, Column]:
    """Column T: payee's id, order among the purchase entries' orders, quantity within the order's."""
    listed = F.filter(F.coalesce(entry_numbers, F.array().cast("array<string>")), lambda x: _filled(x))
    checks = {
        "nit_tercero": _filled(tax_id) & (~_filled(expected_id) | X.same_tax_id(tax_id, expected_id)),
        "orden_en_registro": F.when(F.size(listed) > 0, F.exists(listed, lambda x: X.same_number(number, x))),
        "cantidad_tope": quantity <= limit + 1e-6,
    }
    bad = failed(checks)
    return F.when(F.size(bad) > 0, "Revisar").otherwise("OK"), bad


def receipt(ids: Column, expected_id: Column, own_id: Column, signed: Column, invoice: Column, expected_invoice: Column, order: Column, expected_order: Column, received: Column, billed: Column, converted: Column) -> tuple[Column, Column]:
    """Column W: the receipt names the payee among its ids (the company's own aside), is signed, and repeats invoice, order and
    quantity; an expected field that cannot be read fails; a quantity that cannot be compared leaves it pending."""
    others = F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda x: ~X.same_tax_id(x, own_id))
    expected = lambda got, want: F.when(_filled(want), _filled(got) & (X.trimmed_digits(got) == X.trimmed_digits(want)))
    checks = {
        "nit_tercero": F.exists(others, lambda x: X.same_tax_id(x, expected_id)),
        "firma": F.coalesce(signed, F.lit(False)),
        "factura": expected(invoice, expected_invoice),
        "orden_compra": expected(order, expected_order),
        "cantidad": (F.abs(received - billed) < 0.01) | converted,
    }
    return state(checks, received.isNull() | billed.isNull()), failed(checks)


def warehouse_form(invoice: Column, expected_invoice: Column, received: Column, has_entry: Column, entry_quantity: Column, helper: Column, supervisor: Column) -> tuple[Column, Column, Column]:
    """Column X: invoice digits, quantity against the entry, both signatures; what could not be done leaves it pending."""
    checks = {
        "factura": F.when(_filled(expected_invoice), (X.digits(invoice) != "") & (F.ltrim(X.digits(invoice), F.lit("0")) == F.ltrim(X.digits(expected_invoice), F.lit("0")))),
        "cantidad": F.when(has_entry, F.coalesce(F.abs(received - entry_quantity) < 1e-6, F.lit(False))),
        "firmas": F.when(helper.isNotNull() | supervisor.isNotNull(), F.coalesce(helper, F.lit(False)) & F.coalesce(supervisor, F.lit(False))),
    }
    return state(checks), failed(checks), unknown(checks)


def event_log(present: Column, number: Column, expected_number: Column, tax_id: Column, expected_id: Column) -> tuple[Column, Column]:
    """Column S: all three events, a readable number and id, equal to the expected ones where there are any."""
    checks = {
        "eventos": F.size(F.array_except(F.array(*map(F.lit, ["aceptacion", "acuse", "recibo"])), present)) == 0,
        "numero": _filled(number) & (~_filled(expected_number) | (X.trimmed_digits(number) == X.trimmed_digits(expected_number))),
        "nit": _filled(tax_id) & (~_filled(expected_id) | X.same_tax_id(tax_id, expected_id)),
    }
    bad = failed(checks)
    return F.when(F.size(bad) > 0, "Revisar").otherwise("OK"), bad


def invoice(checks: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Column M: OK only when every check is known and true, else blank; with what fails and what is open."""
    bad, open_ = failed(checks), unknown(checks)
    return F.when((F.size(bad) == 0) & (F.size(open_) == 0), "OK").otherwise(""), bad, open_


MAX_ITEMS = 14


def smallest_conversion(quantities: list[float], factors: list[int | None], received: list[float], gap: float) -> list[int] | None:
    """Positions of the fewest items whose pack conversion, seen among the received quantities, sums to the gap."""
    there = {round(x, 2) for x in received}
    options: list[list[tuple[int, float]]] = []
    for i, (q, f) in enumerate(zip(quantities, factors)):
        ways = [(i, y - q) for y, fits in ((q * f, True), (q / f, q % f == 0)) if fits and round(y, 2) in there] if f and f > 1 and q > 0 else []
        if ways:
            options.append(ways)
    if not options or len(options) > MAX_ITEMS:
        return None
    half = len(options) // 2
    left, right = _sums(options[:half]), _sums(options[half:])
    # of right halves with one sum only the smallest counts, the first of equals; sums are then looked up in order
    by_sum: dict[float, tuple[int, int]] = {}
    for k, (total, used) in enumerate(right):
        by_sum[total] = min(by_sum.get(total, (len(used) + 1, 0)), (len(used), k))
    sums = sorted(by_sum)
    found = []
    for k, (total, used) in enumerate(left):
        for at in range(bisect_left(sums, gap - total - 0.01), bisect_right(sums, gap - total + 0.01)):
            size, j = by_sum[sums[at]]
            if used or size:
                if abs(total + sums[at] - gap) < 0.01:
                    found.append((len(used) + size, k, j))
    if not found:
        return None
    _, k, j = min(found)
    return left[k][1] + right[j][1]


def _sums(options: list[list[tuple[int, float]]]) -> list[tuple[float, list[int]]]:
    """Sum and items of every way to take one conversion, or none, of each item; seven items have 2,187."""
    out: list[tuple[float, list[int]]] = [(0.0, [])]
    for ways in options:
        out = [(total + delta, used + [i] * (i is not None)) for total, used in out for i, delta in [(None, 0.0), *ways]]
    return out


def order_timing(invoice_date: Column, order_date: Column, deliveries: Column) -> tuple[Column, Column]:
    """Days from the order to the invoice, and whether the invoice's day and month is one of the planned deliveries ("dd/mm:n, ..."); null where a part isn't known."""
    on, ordered = invoice_date.try_cast("date"), order_date.try_cast("date")
    days = F.transform(F.split(deliveries, ", "), lambda x: F.substring_index(x, ":", 1))
    planned = F.when(_filled(deliveries) & on.isNotNull(), F.array_contains(days, F.date_format(on, "dd/MM")))
    return F.datediff(on, ordered), planned


def pack_conversions(documents: DataFrame) -> DataFrame:
    """doc, quantities, factors, received, gap -> doc, items (positions, or null). One row is one bounded search."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [smallest_conversion(list(q), [None if f is None or f != f else int(f) for f in fs], list(r), g) for q, fs, r, g in zip(b["quantities"], b["factors"], b["received"], b["gap"])]
            yield pd.DataFrame({"doc": b["doc"], "items": found})

    return documents.select("doc", "quantities", "factors", "received", "gap").mapInPandas(run, "doc string, items array<int>")
