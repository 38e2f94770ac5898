"""Pages, boxes, columns and sheets written from the tables; the SQL knows what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import checks as K
from ..operators import codes as Q
from ..operators import layout as L
from ..operators import pages as G
from ..operators import templates as T
from ..sources.tables import spread, table

c = F.col


def o_():
    return c("o_orderkey")


def _box(text, x0, x1, y, h=10, when=None, **more):
    at = F.lit(float(y)) if isinstance(y, (int, float)) else y.cast("double")
    b = F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"), at.alias("y0"), (at + h).alias("y1"), *[F.lit(v).alias(k) for k, v in more.items()])
    return b if when is None else F.when(when, b)


def _boxes(df, key, boxes, page=1):
    return df.select(key.cast("string").alias("doc"), F.lit(page).alias("page"), F.posexplode(F.array_compact(F.array(*boxes))).alias("word_no", "w")).select("doc", "page", "word_no", "w.*")


def _orders(spark, d):
    return table(spark, d, "orders")


def _pages(spark, d):
    """Pages of six lines with an image between two of them; what stands in the image goes below the line above it, and to the end where none is."""
    p = table(spark, d, "pages").select("page_id")
    k = c("page_id")
    line = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct(i.alias("line_no"), F.concat(F.lit("linea "), i.cast("string"), F.lit(" de "), k.cast("string")).alias("line"), (100.0 + 40 * i).alias("top")))
    lines = p.select(k.cast("string").alias("doc"), F.lit(1).alias("page"), F.explode(line).alias("l")).select("doc", "page", "l.*")
    y = F.when(k % 5 == 0, 40).otherwise(105 + 40 * (k % 6))
    images = p.select(k.cast("string").alias("doc"), F.lit(1).alias("page"), F.explode(F.array(
        F.struct(F.lit(50.0).alias("x0"), F.lit(300.0).alias("x1"), y.cast("double").alias("y0"), (y + 32).cast("double").alias("y1")), F.struct(F.lit(400.0).alias("x0"), F.lit(430.0).alias("x1"), F.lit(0.0).alias("y0"), F.lit(600.0).alias("y1")))).alias("i")).select("doc", "page", "i.*")
    boxes = [_box("Aprobada", 60, 100, y + 2), _box(F.concat(F.lit("por$"), (k + 100_000).cast("string")), 110, 200, y + 2), _box("FRA", 60, 80, y + 18), _box(k.cast("string"), 90, 120, y + 18), _box("icono", 405, 425, 120), _box("fuera", 310, 340, y + 2), _box(" ", 60, 70, y + 2)]
    return p, lines, _boxes(p, k, boxes), images


def texto_paginas(spark, d):
    """Lines of all pages with those of their images."""
    _, lines, boxes, images = _pages(spark, d)
    return G.spliced(lines, G.image_lines(boxes, images)).select("doc", "line_no", "line")


def texto_con_ocr(spark, d):
    """Texts of pages: every third has no text layer and is read as a scan, and of these every second shows nothing."""
    p, lines, boxes, images = _pages(spark, d)
    k = F.col("doc").cast("long")
    layer = lines.where(k % 3 > 0).unionByName(lines.where((k % 3 == 0) & (F.col("line_no") == 0)).withColumn("line", F.lit("  ")))
    seen = boxes.where((k % 6 > 0) & (F.col("text") != "icono") & (F.col("text") != "fuera"))
    pages = p.select(c("page_id").cast("string").alias("doc"), F.lit(1).alias("page"))
    return G.page_texts(pages, layer, G.image_lines(seen, images), seen).select("doc", "text", "scanned")


def lectura_cajas(spark, d):
    """Rows of a scanned receipt: boxes that are sure enough, in the order of their rows."""
    boxes = [
        _box("Entra 5.00PZ", 200, 260, 103, confidence="0.9"), _box(F.concat(F.lit("1405"), o_().cast("string")), 10, 80, 100, confidence="0.8"), _box("dudoso", 90, 120, 100, when=o_() % 2 == 0, confidence="0.2"),
        _box("FRA FC1", 10, 60, 130, 14, confidence="x"), _box("0.C. 77", 100, 150, 138, confidence="0.4"), _box("final", 10, 50, 170, when=o_() % 3 == 0, confidence="0.95")]
    read = G.readable(_boxes(_orders(spark, d), o_(), boxes), G.RECEIPT_CONFIDENCE)
    return G.box_lines(read.withColumnRenamed("word_no", "box_no")).select("doc", "line_no", "line")


def cantidad_factura(spark, d):
    """Quantities under a column's title over one to three pages; totals end the items, and a page that is printed twice counts once."""
    li = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("l_quantity")).alias("q"))
    orders = table(spark, d, "orders").select("o_orderkey")
    o = orders.join(li, "o_orderkey")
    odd = o_() % 2 == 1
    words = [
        _box("Código", 10, 50, 90), _box("Cantidad", 200, 250, 90), _box("VALOR", 300, 330, 90), _box("TOTAL", 335, 360, 90),
        _box("10000001", 10, 60, 120), _box("CINTA", 70, 110, 120), _box("x4", 115, 130, 120), _box(F.concat(c("q").cast("string"), F.lit(".00")), 210, 240, 120), _box("12,500.00", 300, 350, 120),
        _box("TUBO", 70, 100, 140), _box("7", 222, 228, 140), _box("9", 180, 186, 140), _box("IVA", 120, 140, 140), _box("19", 300, 310, 140),
        _box("Subtotal", 10, 60, 180, when=odd), _box(c("n").cast("string"), 215, 235, 180, when=odd), _box("555", 215, 235, 200, when=odd)]
    other = [_box("CANT.", 200, 240, 50), _box("3", 215, 222, 80), _box("cantidades", 10, 60, 300)]
    said = lambda page, ws: F.transform(ws, lambda w, n: F.struct(F.lit(page).alias("page"), n.alias("word_no"), *[w[f].alias(f) for f in ("text", "x0", "x1", "y0", "y1")]))
    # a document's pages are written once, of the words of its first
    made = o.select(o_(), F.array_compact(F.array(*words)).alias("ws")).select(o_(), F.array(said(1, c("ws")), F.when(o_() % 3 == 0, said(2, c("ws"))), F.when(o_() % 5 == 0, said(3, F.array(*other)))).alias("pages"))
    pages = made.select(o_().cast("string").alias("doc"), F.explode(F.flatten(F.array_compact("pages"))).alias("w")).select("doc", "w.*")
    heights = spread(orders).select(o_().cast("string").alias("doc"), F.explode(F.array_compact(F.array(F.lit(1), F.when(o_() % 3 == 0, 2), F.when(o_() % 5 == 0, 3)))).alias("page"), F.lit(700.0).alias("height"))
    return L.column_quantity(pages, heights)


def renglones_cantidad(spark, d):
    """Items of a page with their descriptions, and the packs that these name."""
    o = spread(table(spark, d, "orders").select("o_orderkey")).withColumn("n", o_() % 7 + 2)
    words = [_box("CANT", 200, 240, 50), _box("10000001", 10, 60, 80), _box("PH JUMBO", 70, 110, 80), _box(F.concat(c("n").cast("string"), F.lit(" ROLLOS X 250")), 115, 160, 80), _box("15.00", 210, 230, 80), _box("$1.200,50", 300, 340, 80), _box("TORNILLO", 70, 110, 110), _box("0", 215, 222, 110)]
    heights = o.select(o_().cast("string").alias("doc"), F.lit(1).alias("page"), F.lit(700.0).alias("height"))
    return L.quantity_rows(_boxes(o, o_(), words), heights).select("doc", "row", "quantity", "description", X.pack_factor(c("description")).alias("factor"))


def empaque(spark, d):
    """Which items of an order, sold by the pack and received by the piece, explain the gap between both quantities."""
    w = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = table(spark, d, "lineitem").select(c("l_orderkey").alias("doc"), w.alias("w"), F.floor("l_quantity").cast("double").alias("q"), (c("l_partkey") % 3 + 2).cast("int").alias("f"))
    docs = li.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "q", "f"))), lambda x: F.struct(x["q"].alias("q"), x["f"].alias("f"))).alias("ls")).where("size(ls) <= 10")
    # the first item came by the piece; for even orders the gap is larger than that by one
    q, f = F.transform("ls", lambda x: x["q"]), F.transform("ls", lambda x: x["f"])
    first = F.get("ls", 0)
    gap = first["q"] * first["f"] - first["q"] + F.when(c("doc") % 2 == 0, 0.5).otherwise(0.0)
    made = docs.select("doc", q.alias("quantities"), f.alias("factors"), F.array(first["q"] * first["f"]).alias("received"), gap.alias("gap"), F.size("ls").alias("n"))
    found = K.pack_conversions(made.withColumn("doc", c("doc").cast("string")))
    return found.select("doc", F.coalesce(F.size("items"), F.lit(0)).alias("n_items"), F.coalesce(F.get("items", 0) >= 0, F.lit(False)).alias("explained"))


def codigo_por_forma(spark, d):
    """Invoices of the suppliers: a logo, then for two in three a code of random modules, on the first page or too late to be looked at."""
    k = c("s_suppkey")
    side = 60
    at = F.sequence(F.lit(0), F.lit(side * side - 1))
    module = lambda i: F.pmod(F.xxhash64(k, i), F.lit(2)) * 255
    drawn = lambda level: F.unhex(F.array_join(F.transform(at, lambda i: F.lpad(F.hex(level(i).cast("long")), 2, "0")), ""))
    image = lambda page, no, width, pixels: F.struct(F.lit(page).alias("page") if isinstance(page, int) else page.alias("page"), F.lit(no).alias("image_no"), F.lit(float(width)).alias("width"), F.lit(80.0).alias("height"), pixels.alias("pixels"))
    logo = drawn(lambda i: F.when(i % side < 25, 0).otherwise(255))
    images = F.array_compact(F.array(image(1, 1, 80, logo), F.when(k % 3 > 0, image(F.when(k % 7 == 0, 5).otherwise(1), 2, 80, drawn(module))), F.when(k % 3 == 0, image(1, 3, 200, drawn(module)))))
    made = table(spark, d, "supplier").select(k.alias("doc"), F.explode(images).alias("i")).select("doc", "i.*", F.lit(side).alias("columns"), F.lit(side).alias("rows"))
    return Q.codes_by_shape(made)


def _cells(spark, d):
    """A workbook for each nation: notes, then a batch's sheet whose titles stand lower the greater its key; some books have no table, some no total."""
    n = c("n_nationkey").cast("int")
    cell = lambda pos, sheet, row, col, value: F.struct(F.lit(pos).alias("position"), F.lit(sheet).alias("sheet"), (F.lit(row) if isinstance(row, int) else row).alias("row"), F.lit(col).alias("col"), (F.lit(value) if isinstance(value, str) else value).alias("value"))
    t = n % 9 + 5
    cells = F.array_compact(F.array(
        cell(0, "Notas", 1, 2, "Nro. registro de nada"), cell(1, "Lote", 1, 2, "Tipo de pago:"), cell(1, "Lote", 1, 3, "Proveedores"), cell(1, "Lote", 2, 2, "FECHA DE APLICACIÓN :"), cell(1, "Lote", 2, 3, F.concat(F.lit("2026-09-"), F.lpad((n + 1).cast("string"), 2, "0"))),
        cell(1, "Lote", 3, 2, "Otra cosa"), cell(1, "Lote", F.when(n % 5 == 4, 50).otherwise(t), 2, "Nro. Registro"), cell(1, "Lote", t, 4, "Titular"), cell(1, "Lote", t, 26, "fuera"), cell(1, "Lote", t + 3, 6, "Cuenta 1"),
        F.when(n % 3 > 0, cell(1, "Lote", t + 6, 6, "TOTAL")), F.when(n % 3 > 0, cell(1, "Lote", t + 9, 6, "Total")), cell(1, "Lote", t + 10, 6, "Diferencias"), F.when(n % 2 == 0, cell(2, "Lote 2", 7, 2, "nro. registro:"))))
    return table(spark, d, "nation").select(c("n_name").alias("book"), F.explode(cells).alias("x")).select("book", "x.*")


def plantilla(spark, d):
    out = T.templates(_cells(spark, d))
    titles = F.array_join(F.transform(F.map_entries("titles"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.replace(e["value"], F.lit(" "), F.lit(" ")))), ",")
    info = F.array_join(F.transform("info", lambda i: F.concat(i["field"], F.lit("@"), i["row"].cast("string"), F.lit("="), i["example"])), ",")
    return out.withColumns({"titles": F.coalesce(titles, F.lit("")), "info": F.coalesce(info, F.lit("")), "sheets": F.coalesce(F.array_join("sheets", ","), F.lit(""))})


def _table_words(spark, d):
    """Two rows of two columns under their titles, a little askew."""
    words = [
        _box("Valor", 10, 40, 10), _box("Titular", 100, 150, 11), _box(o_().cast("string"), 10, 60, 40), _box("ACEROS", 100, 140, 42), _box(c("o_custkey").cast("string"), 145, 180, 41),
        _box(F.concat(o_().cast("string"), F.lit(",00")), 10, 60, 70), _box("VIDRIOS", 100, 160, 71)]
    return _boxes(_orders(spark, d), o_(), words)


def lineas_visuales(spark, d):
    return L.line_texts(L.visual_lines(_table_words(spark, d))).select("doc", "line_no", "text")


def tabla_portal(spark, d):
    keys = _orders(spark, d).select(o_().cast("string").alias("doc"), F.lit(1).alias("page"))
    rows = keys.select("doc", "page", F.explode(F.array(F.lit(45.0), F.lit(75.0))).alias("y"))
    columns = keys.select("doc", "page", F.explode(F.array(F.struct(F.lit("valor").alias("name"), F.lit(35.0).alias("x")), F.struct(F.lit("titular").alias("name"), F.lit(130.0).alias("x")))).alias("k")).select("doc", "page", "k.*")
    return L.table_cells(_table_words(spark, d).where("y0 > 30"), rows, columns).select("doc", "row", "name", "text")


def _labels(spark, d):
    labels = [_box("auxiliar", 10, 60, 200), _box("supervisor", 200, 260, 200)]
    return _boxes(_orders(spark, d), o_(), labels).withColumnRenamed("text", "label")


def firmas(spark, d):
    """Images stand over the first label of two orders in three and beside the second; every seventh page is a scan."""
    o = _orders(spark, d)
    images = [_box("", 20, 80, 170, when=o_() % 3 > 0), _box("", 300, 340, 180)]
    i = _boxes(o, o_(), images).withColumnRenamed("y1", "bottom")
    return L.signatures(_labels(spark, d), i, o.where("o_orderkey % 7 = 0").select(o_().cast("string").alias("doc"), F.lit(1).alias("page"))).select("doc", "label", "signed")


def valor_etiqueta(spark, d):
    """Values beside one label and below the other."""
    words = [_box("Pedro", 70, 100, 201, when=o_() % 2 == 0), _box(F.concat(F.lit("Marta "), o_().cast("string")), 205, 240, 230), _box("lejos", 10, 40, 300)]
    return L.value_beside(_boxes(_orders(spark, d), o_(), words), _labels(spark, d)).select("doc", "label", "value")


_S = "CAST(o_orderkey AS VARCHAR)"
SQL = {
    "texto_paginas": """WITH p AS (SELECT CAST(page_id AS VARCHAR) AS doc, page_id AS k, CASE WHEN page_id % 5 = 0 THEN 6 ELSE page_id % 6 END AS a FROM pages), i AS (SELECT unnest(range(0, 6)) AS i),
 x AS (SELECT doc, i * 10 AS s, 'linea ' || i || ' de ' || doc AS line FROM p, i UNION ALL SELECT doc, a * 10 + 1, 'Aprobada por $' || CAST(k + 100000 AS VARCHAR) FROM p UNION ALL SELECT doc, a * 10 + 2, 'FRA ' || doc FROM p) SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY s) AS INTEGER) AS line_no, line FROM x""",
    "texto_con_ocr": """WITH p AS (SELECT CAST(page_id AS VARCHAR) AS doc, page_id AS k, CASE WHEN page_id % 5 = 0 THEN 6 ELSE page_id % 6 END AS a FROM pages), i AS (SELECT unnest(range(0, 6)) AS i),
 r AS (SELECT doc, k, a * 10 + 1 AS s, 'Aprobada por $' || CAST(k + 100000 AS VARCHAR) AS line FROM p UNION ALL SELECT doc, k, a * 10 + 2, 'FRA ' || doc FROM p),
 x AS (SELECT doc, i * 10 AS s, 'linea ' || i || ' de ' || doc AS line FROM p, i WHERE k % 3 > 0 UNION ALL SELECT doc, s, line FROM r WHERE k % 6 > 0), t AS (SELECT doc, string_agg(line, chr(10) ORDER BY s) AS text FROM x GROUP BY doc)
 SELECT p.doc, coalesce(text, '') AS text, k % 3 = 0 AND k % 6 > 0 AS scanned FROM p LEFT JOIN t ON t.doc = p.doc""",
    "lectura_cajas": f"""WITH o AS (SELECT {_S} AS doc, o_orderkey AS k FROM orders) SELECT doc, 1 AS line_no, '1405' || doc || ' Entra 5.00PZ' AS line FROM o UNION ALL SELECT doc, 2, 'FRA FC1 0.C. 77' FROM o UNION ALL SELECT doc, 3, 'final' FROM o WHERE k % 3 = 0""",
    "cantidad_factura": f"""WITH q AS (SELECT l_orderkey AS o_orderkey, sum(floor(l_quantity)) AS q FROM lineitem GROUP BY 1) SELECT {_S} AS doc, 'Cantidad' AS header, q + 7 + CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 0 END AS quantity, CAST(CASE WHEN q > 0 THEN 1 ELSE 0 END + 1 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS rows FROM orders JOIN q USING (o_orderkey)""",
    "renglones_cantidad": f"""SELECT {_S} AS doc, 1 AS row, 15.0::DOUBLE AS quantity, 'PH JUMBO ' || CAST(o_orderkey % 7 + 2 AS VARCHAR) || ' ROLLOS X 250' AS description, CAST(o_orderkey % 7 + 2 AS INTEGER) AS factor FROM orders""",
    "empaque": """WITH li AS (SELECT l_orderkey, floor(l_quantity) AS q, l_partkey % 3 + 2 AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
 a AS (SELECT l_orderkey, q * f AS got, q * f - q AS delta FROM li WHERE k = 1 AND n <= 10), ways AS (SELECT a.l_orderkey, got, a.delta AS gap, li.k, q * f - q AS d FROM a JOIN li USING (l_orderkey) WHERE q > 0 AND q * f = got UNION ALL SELECT a.l_orderkey, got, a.delta, li.k, q / f - q FROM a JOIN li USING (l_orderkey) WHERE q > 0 AND q % f = 0 AND q / f = got),
 one AS (SELECT l_orderkey, bool_or(abs(d - gap) < 0.01) AS hit FROM ways GROUP BY 1) SELECT CAST(a.l_orderkey AS VARCHAR) AS doc, CASE WHEN a.l_orderkey % 2 = 1 AND coalesce(hit, false) THEN 1 ELSE 0 END AS n_items, a.l_orderkey % 2 = 1 AND coalesce(hit, false) AS explained FROM a LEFT JOIN one USING (l_orderkey)""",
    "plantilla": """WITH n AS (SELECT n_name AS book, CAST(n_nationkey AS INTEGER) AS n, CAST(n_nationkey % 9 + 5 AS INTEGER) AS t FROM nation), s AS (SELECT *, n % 5 <> 4 AS one, n % 2 = 0 AS two FROM n)
SELECT book, one OR two AS valid, CASE WHEN one THEN 'Lote' WHEN two THEN 'Lote 2' END AS sheet, CASE WHEN one THEN t WHEN two THEN 7 END AS title_row, CASE WHEN one THEN CASE WHEN n % 3 > 0 THEN t + 6 ELSE t + 11 END WHEN two THEN 8 END AS total_row, CASE WHEN one THEN t + 10 END AS differences_row,
 CASE WHEN one THEN CASE WHEN n % 3 > 0 THEN 5 ELSE 10 END WHEN two THEN 0 END AS capacity, CASE WHEN one THEN '2=Nro. Registro,4=Titular' WHEN two THEN '2=nro. registro:' ELSE '' END AS titles,
 CASE WHEN one THEN 'applied_on@2=2026-09-' || lpad(CAST(n + 1 AS VARCHAR), 2, '0') || ',payment_kind@1=Proveedores' ELSE '' END AS info, concat_ws(',', CASE WHEN one THEN 'Lote' END, CASE WHEN two THEN 'Lote 2' END) AS sheets FROM s""",
    "codigo_por_forma": """SELECT s_suppkey AS doc, 1 AS page, 2 AS image_no FROM supplier WHERE s_suppkey % 3 > 0 AND s_suppkey % 7 <> 0""",
    "lineas_visuales": f"""SELECT {_S} AS doc, 0 AS line_no, 'Valor Titular' AS text FROM orders UNION ALL SELECT {_S}, 1, {_S} || ' ACEROS ' || CAST(o_custkey AS VARCHAR) FROM orders UNION ALL SELECT {_S}, 2, {_S} || ',00 VIDRIOS' FROM orders""",
    "tabla_portal": f"""SELECT {_S} AS doc, 1 AS row, 'valor' AS name, {_S} AS text FROM orders UNION ALL SELECT {_S}, 1, 'titular', CAST(o_custkey AS VARCHAR) || ' ACEROS' FROM orders UNION ALL SELECT {_S}, 2, 'valor', {_S} || ',00' FROM orders UNION ALL SELECT {_S}, 2, 'titular', 'VIDRIOS' FROM orders""",
    "firmas": f"""SELECT {_S} AS doc, 'auxiliar' AS label, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 3 > 0 END AS signed FROM orders UNION ALL SELECT {_S}, 'supervisor', CASE WHEN o_orderkey % 7 <> 0 THEN false END FROM orders""",
    "valor_etiqueta": f"""SELECT {_S} AS doc, 'auxiliar' AS label, 'Pedro' AS value FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT {_S}, 'supervisor', 'Marta ' || {_S} FROM orders""",
}

QUERIES = {k: globals()[k] for k in SQL}
