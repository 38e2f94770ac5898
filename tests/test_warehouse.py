"""Worked cases of visual lines and of the warehouse's form."""

import os
import random

import pytest

from ledgerspark import catalog
from ledgerspark.operators import layout, warehouse

WORD = "doc string, page int, word_no int, text string, x0 double, x1 double, y0 double, y1 double"
PLACE = "doc string, page int, x0 double, x1 double, bottom double"


def test_lines_against_plain_first_fit():
    rng = random.Random(5)
    for _ in range(200):
        page = sorted((y, y + rng.choice([4.0, 10.0, 40.0])) for y in (rng.uniform(0, 120) for _ in range(40)))
        lines, at = [], []
        for y0, y1 in page:
            k = next((i for i, l in enumerate(lines) if abs((y0 + y1) / 2 - (l[0] + l[1]) / 2) <= l[2]), None)
            if k is None:
                k, _ = len(lines), lines.append([y0, y1, max(6.0, (y1 - y0) / 2)])
            lines[k][:2] = min(lines[k][0], y0), max(lines[k][1], y1)
            at.append(k)
        rank = {k: i for i, k in enumerate(sorted(range(len(lines)), key=lambda i: (lines[i][0], i)))}
        assert layout._line_numbers(page, 6.0) == [rank[k] for k in at]
    assert layout._line_numbers([(None, None), (5.0, 9.0), (None, 3.0)], 6.0) == [1, 0, 2]


def words_of(doc, lines):
    return [(doc, 1, 100 * i + j, text, float(x0), float(x1), 20.0 * i, 20.0 * i + 10) for i, line in enumerate(lines) for j, (text, x0, x1) in enumerate(line)]


def test_form(spark):
    head = [("RELACIÓN DE MERCANCÍA RECIBIDA", 10, 200)]
    titles = [("CODIGO", 10, 50), ("DESCRIPCION", 100, 170), ("CANTIDAD", 320, 370)]
    foot = [("AUXILIAR", 10, 50), ("DE", 55, 65), ("ALMACEN", 70, 110), ("SUPERVISOR", 300, 350), ("DE", 355, 365), ("ALMACEN", 370, 410)]
    full = words_of("full", [head, [("FACTURA:", 10, 50), ("FC", 55, 65), ("91", 70, 80), ("ORDEN", 200, 230), ("DE", 235, 245), ("COMPRA", 250, 290)], [("FACTURA", 10, 50), ("otra", 60, 80)], titles, [("A1", 10, 30), ("TUBO", 100, 140), ("1.920,50", 320, 370)], [("solo", 10, 30)], [("LISO", 100, 140), ("sin", 330, 340)], foot, [("99", 320, 340)]])
    bare = words_of("bare", [head]) + [("bare", 1, 999, None, 0.0, 1.0, 0.0, 1.0)]
    other = words_of("other", [[("FACTURA", 10, 50), ("FC", 55, 65)], titles])
    images = spark.createDataFrame([("full", 1, 20.0, 40.0, 135.0), ("full", 1, 310.0, 330.0, 20.0)], PLACE)  # above the helper; far above the supervisor
    words = spark.createDataFrame(full + bare + other, WORD)
    got = {r["doc"]: r for r in warehouse.forms(words, images, spark.createDataFrame([], "doc string, page int")).collect()}
    assert set(got) == {"full", "bare"}
    f = got["full"]
    assert (f["invoice"], f["order_no"], f["items"], f["quantity"], f["helper"], f["supervisor"]) == ("FC91", "", 2, 1920.5, True, False)
    b = got["bare"]
    assert (b["invoice"], b["items"], b["quantity"], b["helper"]) == ("", 0, None, None)
    edges = spark.createDataFrame([("full", 1, x) for x in (0.0, 90.0, 325.0, 325.0, 500.0)], "doc string, page int, x double")
    columns = {r["name"]: (r["low"], r["high"]) for r in warehouse.title_columns(layout.visual_lines(words.where("doc = 'full'")), edges).collect()}
    assert columns == {"code": (float("-inf"), 90.0), "description": (90.0, 325.0), "quantity": (325.0, float("inf"))}
    assert warehouse.forms(spark.createDataFrame([], WORD), images, spark.createDataFrame([], "doc string, page int")).count() == 0


def test_words_of_a_form_are_not_moved(spark):
    """The orders and their lines come together as numbers; what is made of them stays where it is."""
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    plan = catalog.queries()["relacion_recibida"](spark, data)._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert 0 < len(moved) <= 2 and not any("doc" in x or "words" in x for x in moved), moved


def test_pages_without_titles_follow_the_last_that_has_them(spark):
    """Rows of two pages count up to the first signature, which is that of the last page; lines above a page's own titles are none."""
    first = words_of("a", [[("RELACION DE MERCANCIA RECIBIDA", 10, 200)], [("CANTIDAD", 320, 370), ("X", 100, 140), ("9", 320, 340)], [("CODIGO", 10, 50), ("DESCRIPCION", 100, 170), ("CANTIDAD", 320, 370)], [("SIIGO", 10, 40)], [("A1", 10, 30), ("TUBO", 100, 140), ("2", 320, 370)]])
    second = [(d, 2, *rest) for d, _, *rest in words_of("a", [[("CODO", 100, 140), ("3,5", 320, 370)], [("AUXILIAR DE ALMACÉN", 10, 100)], [("LISO", 100, 140), ("8", 330, 340)]])]
    none = spark.createDataFrame([], "doc string, page int")
    got = warehouse.forms(spark.createDataFrame(second + first, WORD), spark.createDataFrame([("a", 2, 20.0, 40.0, 18.0)], PLACE), none).collect()
    assert [(r["items"], r["quantity"], r["helper"], r["supervisor"]) for r in got] == [(2, 5.5, True, None)]
