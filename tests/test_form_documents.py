"""Forms read as documents: places as the functions over rows find them, with a small loop instead of functions over arrays."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerspark import catalog
from ledgerspark.operators import form_documents as R
from ledgerspark.operators import layout as L
from ledgerspark.operators import warehouse as W

WORD = "doc string, page int, word_no int, text string, x0 double, x1 double, y0 double, y1 double"
SAID = ["FACTURA", "FACTURA:", "ORDEN", "DE", "COMPRA", "ORDEN DE  COMPRA", ":", "PROVEEDOR", "ALFA", "9", "12,5", "TUBO", "Nacional", "NÚMERO DE", "INGRESO", "AUXILIAR DE ALMACÉN", "SUPERVISOR", "ALMACEN", "SIIGO", "UM", "CODIGO", "CANTIDAD", "RECIBIDA", " ", None, "OTRA"]


def _words(spark, n=200):
    r = random.Random(7)
    rows = []
    for d in range(n):
        words = [(1, t, x, x + 90.0, 0.0) for t, x in (("RELACIÓN DE MERCANCÍA", 0.0), ("RECIBIDA", 100.0))] if d % 8 else []
        for page in (1, 2):
            if r.random() < 0.7:
                words += [(page, t, x + r.choice([0.0, 3.0]), x + 50.0, 60.0) for t, x in (("CODIGO", 10.0), ("DESCRIPCION", 100.0), ("CANTIDAD", 200.0), (r.choice(["UM", "OTRA", "RECIBIDA"]), 300.0))]
            words += [(page, r.choice(SAID), x, x + r.choice([20.0, 45.0, 80.0]), float(r.randrange(20, 200, 10))) for x in (float(r.randrange(0, 380, 20)) for _ in range(r.choice([0, 5, 30])))]
        if d % 5 == 0:
            words = [(p, t, x, x1, r.choice([y, y, None])) for p, t, x, x1, y in words]
        rows += [(f"d{d}", p, k, t, x, x1, y, None if y is None else y + r.choice([8.0, 9.0])) for k, (p, t, x, x1, y) in enumerate(words)]
    return spark.createDataFrame(rows, WORD)


def test_forms_are_read_as_rows_are(spark):
    words = _words(spark).cache()
    edges = spark.createDataFrame([(f"d{d}", 1, x) for d in range(0, 200, 3) for x in (0.0, 95.0, 95.0, 190.0, None, 290.0)[:4 + d % 3]], "doc string, page int, x double")
    images = spark.createDataFrame([(f"d{d}", p, float(d % 200), float(d % 200 + 60), float(d)) for d in range(200) for p in (1, 2)], "doc string, page int, x0 double, x1 double, bottom double")
    scanned = spark.createDataFrame([(f"d{d}", 1) for d in range(0, 200, 7)], "doc string, page int")
    lined = L.visual_lines(words.where("text IS NOT NULL")).cache()
    array = lambda df, name, *cs: df.groupBy("doc").agg(F.collect_list(F.struct(*cs)).alias(name))
    docs = array(words, "words", *words.columns[1:]).join(array(edges, "edges", "page", "x"), "doc", "left").join(array(images, "images", "page", "x0", "x1", "bottom"), "doc", "left")
    docs = docs.join(scanned.groupBy("doc").agg(F.collect_list("page").alias("scanned")), "doc", "left").withColumns({"scanned": F.coalesce("scanned", F.array().cast("array<int>")), "edges": F.coalesce("edges", F.array().cast("array<struct<page: int, x: double>>"))})
    read = {r.doc: r for r in R.read_forms(docs).collect()}
    assert 150 < len(read) < 200
    head = {(r.doc, r.field): r.value for r in W.head_fields(lined).collect() if r.doc in read and r.value}
    assert len(head) > 60 and {(d, f): v for d, r in read.items() for f, v in r["head"].asDict().items() if v} == head
    items: dict = {}
    for r in W.item_rows(lined, W.title_columns(lined, edges)).orderBy("doc", "page", "line_no").collect():
        items.setdefault(r.doc, []).append((r.description, r.quantity_text))
    assert len(items) > 40 and {d: [tuple(i) for i in r["items"]] for d, r in read.items() if r["items"]} == {d: v for d, v in items.items() if d in read}
    labels = W.label_spans(lined, W.SIGNED).withColumnRenamed("field", "label")
    seen: dict = {}
    for r in L.signatures(labels, images, scanned).collect():
        page, before = seen.get((r.doc, r.label), (0, False))
        if r.page >= page:
            seen[r.doc, r.label] = (r.page, None if r.signed is None else r.signed or (r.page == page and bool(before)))
    assert len(seen) > 30 and {(d, f): r["signed"][f] for d, r in read.items() for f in W.SIGNED.values()} == {(d, f): seen.get((d, f), (0, None))[1] for d in read for f in W.SIGNED.values()}


def test_words_of_one_height_are_placed_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    placed = []
    plain = L._line_numbers
    monkeypatch.setattr(L, "_line_numbers", lambda page, tolerance: placed.append(len(page)) or plain(page, tolerance))
    r = random.Random(3)
    for _ in range(200):
        page = sorted(((y, y + r.choice([4.0, 10.0, -3.0])) for y in (float(r.randrange(0, 40, 4)) for _ in range(30))), key=lambda w: w[0])
        table = pa.table({"y0": [a for a, _ in page], "y1": [b for _, b in page]})
        assert L._numbered(table, np.array([0, 7]), 6.0).tolist() == plain(page[:7], 6.0) + plain(page[7:], 6.0)
    assert sum(placed) < 200 * 30


def test_functions_over_arrays_are_few(spark):
    """Labels, columns and items were functions over arrays, which run without generated code; quantities alone are now."""
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    plan = catalog.queries()["relacion_recibida"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan[:plan.index("MapInArrow")].count("lambdafunction(") <= 8
