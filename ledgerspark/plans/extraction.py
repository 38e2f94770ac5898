"""Supplier documents written from the orders and their lines, and what is read back from them; the SQL knows what was written."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import checks as K
from ..operators import documents as D
from ..operators import matching as M
from ..operators import pages as G
from ..sources.tables import table

c = F.col


def o_():
    return c("o_orderkey")


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _padded(x, n):
    return F.lpad(x.cast("string"), n, "0")


def _way(n, *xs):
    return F.get(F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs]), (o_() % n).cast("int"))


def _money(x):
    return F.format_number(x, 2)


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", o_().alias("doc"))


def _lines(spark, d, *texts):
    """Orders with a text for each line (l_quantity, l_partkey, k: its number), joined: one column for each of texts."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_partkey", F.row_number().over(w).alias("k"))
    joined = [F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", t.alias("t")))), lambda x: x["t"]), "").alias(name) for name, t in texts]
    return _orders(spark, d).join(li.groupBy(c("l_orderkey").alias("o_orderkey")).agg(*joined), "o_orderkey")


def _vouchers(spark, d):
    """Vouchers of two invoices, of one, and of none; every fifth has the paid sum in its table alone."""
    row = lambda label, value: _text("\n| ", label, " | ", value, " |")
    one, two = row(_text("2205050100 - CANCELA FACTURA No. ", _padded(o_(), 11), "-001"), _money(c("o_totalprice"))), row(_text("2205050100 - ABONO A LA FACTURA FE", o_().cast("string")), _money(o_() + 100))
    text = _text(
        "EMPRESA EJEMPLO S.A.S. NIT : 900123456 -0\nTRANSFERENCIAS BANCARIAS G-002-00", _padded(o_(), 9), "\n| Girado a : PROVEEDOR ", _way(3, "UNO", "DOS", "TRES"), " SAS       FECHA : ", _way(2, "2026/09/01", "01/09/2026"), " |\n| NIT : 901,", _padded(o_() % 1000, 3),
        ",", _padded(c("o_custkey") % 1000, 3), "-5 |\n| Banco : BANCO UNO CTA CTE No. 000-00  C.Costo : 0001 |\n| LA SUMA DE : MIL PESOS | |", _way(3, F.concat(one, two), one, ""), row("2408 - RETENCION EN LA FUENTE", F.lit("1.00")), row("CORTO", F.lit("5.00")), F.when(o_() % 5 == 0, "").otherwise(row("Girado :", _money(c("o_totalprice") + 7))))
    return _orders(spark, d).select("doc", text.alias("text"))


def comprobantes(spark, d):
    return D.vouchers(_vouchers(spark, d)).withColumn("invoices", F.array_join("invoices", ","))


def renglones_comprobante(spark, d):
    return D.voucher_lines(_vouchers(spark, d)).select("doc", "invoice", "value", "concept")


def conceptos_comprobante(spark, d):
    return D.voucher_concepts(_vouchers(spark, d))


def registro_compras(spark, d):
    cited = _way(3, _text("Fact. No.: 003-", _padded(o_(), 9), "\nRETFTE FACT ", o_().cast("string")), _text("FRA FV", o_().cast("string"), "\nRETFTE FACT 1"), _text("Fact. No.: ", (o_() + 900_000).cast("string")))
    total = F.when(o_() % 2 == 0, _text("T o t a l | 1.00\nT o t a l | ", _money(c("o_totalprice")))).otherwise(_text("Valor : ", _money(c("o_totalprice") + 1)))
    text = _text("OTRAS COMPRAS P-003-", _padded(o_(), 9), "\nA Favor de : SERVICIOS ", _way(2, "UNO", "DOS"), " SAS | Fecha : 2026/06/01\nCédula / NIT : 860.", _padded(c("o_custkey") % 1000, 3), ".222-3\n", cited, "\nO.C. 2026", _padded(o_(), 6), " Orden : 6", _padded(o_(), 6), "\n", total)
    return D.purchase_entries(_orders(spark, d).select("doc", text.alias("text")))


def _purchase_orders(spark, d):
    """Orders with the lines of the order; the page of every fourth is printed twice."""
    line = ("rows", _text("|", _padded(c("l_partkey"), 10), " | ITEM |PZ | ", c("l_quantity").cast("long").cast("string"), ".00| 10.00| 10.00|\n"))
    number = _text("000", (o_() + 20_260_000).cast("string"))
    page = _text("ORDEN DE COMPRA MATERIAL NACIONAL ", number, "\n| Señores : PROVEEDOR S.A. 860", _padded(c("o_custkey") % 1_000_000, 6), "-3 | Fecha: 2026/07/14 |\n| Fec.Ent. : 22/09/2026 |\n", c("rows"))
    foot = _text(F.when(o_() % 3 == 0, "|ENTREGAS: 21/07: 20 CIL / 04/08: 15 CIL / 21/07: 9 CIL\n").otherwise(""), "| Neto a Pagar | ", _money(c("o_totalprice")), "|")
    return _lines(spark, d, line).select("doc", _text(page, F.when(o_() % 4 == 0, page).otherwise(""), foot).alias("text"))


def ordenes_compra(spark, d):
    return D.purchase_orders(_purchase_orders(spark, d))


def plazo_orden(spark, d):
    """Days from an order to its invoice, and whether the invoice came on a planned day."""
    on = F.when(c("doc") % 2 == 0, "2026-07-21").when(c("doc") % 5 == 0, "").otherwise("2026-08-03")
    days, planned = K.order_timing(on, c("date"), c("deliveries"))
    return D.purchase_orders(_purchase_orders(spark, d)).select("doc", days.alias("days"), planned.alias("planned"))


def _receipts(spark, d):
    """Receipts as lines of their pages, and the letters of the stamps that came out one by one."""
    line = ("rows", _text("Entra ", c("l_quantity").cast("long").cast("string"), F.when(c("k") % 2 == 0, ".00ROL\n").otherwise(".0OPZ\n")))
    seal = _way(4, "REVISADO POR COSTOS\nANA RUIZ PAZ 05-08-2026", "R E V I S A D O P O R C O S T O S\nA N A R U I Z 0 5 - 0 8 - 2 0 2 6", "Aceptada", "VISTO BUENO\nEVA MARIA LOPEZ")
    text = _text("ENTRADA DE ALMACEN No. E-001-", _padded(o_(), 9), "\nNIT : 900123456-0\nSEÑORES : ALFA SAS NIT : 860", _padded(c("o_custkey") % 1_000_000, 6), "-3\nFECHA : 2026/08/05\n", c("rows"), "0.C. 2026", _padded(o_(), 6), " FRA FC", o_().cast("string"), "\n", seal)
    lines = _lines(spark, d, line).select("doc", F.lit(1).alias("page"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    printed = F.array(*[F.struct(F.lit(y).cast("double").alias("top"), F.lit(s).alias("s")) for y, s in ((700, "REVISADO POR COSTOS"), (715, "ANA RUIZ 05-08-2026"), (730, "otra cosa"))])
    chars = _orders(spark, d).where("o_orderkey % 4 = 1").select("doc", F.lit(1).alias("page"), F.explode(printed).alias("p")).select("doc", "page", "p.top", F.posexplode(F.split("p.s", "")).alias("x0", "ch"))
    return lines, chars


def entradas(spark, d):
    out = D.receipts(G.with_raw_lines(*_receipts(spark, d)))
    return out.withColumns({"tax_ids": F.array_join("tax_ids", ","), "units": F.array_join("units", ",")})


def rangos_y_numero(spark, d):
    """Numbers with an authorised prefix, inside the range and not at its ends."""
    prefix = _way(2, "FV", "SETT")
    text = _text("numeración autorizada desde ", prefix, " 10 hasta ", prefix, " ", (o_() * 2 % 1500 + 11).cast("string"), "\nFactura No. ", prefix, " ", o_().cast("string"), " y ", prefix, "-10")
    docs = _orders(spark, d).select("doc", text.alias("text"))
    ranges = D.authorised_ranges(docs)
    found = docs.select("doc", F.explode(F.regexp_extract_all("text", F.lit(r"\b([A-Z]{1,6})\s*-?\s*(\d{1,10})\b"), F.lit(0))).alias("raw"))
    points = found.select("doc", F.regexp_extract("raw", "^[A-Z]+", 0).alias("prefix"), F.regexp_extract("raw", r"\d+$", 0).cast("long").alias("n"))
    return M.range_join(points, ranges, inclusive=False, own=("doc",)).select("doc", "prefix", "n").distinct()


def nits_factura(spark, d):
    id_ = _text("860.", _padded(c("o_custkey") % 1000, 3), ".", _padded(o_() % 1000, 3), "-1")
    text = _way(3, _text("CLIENTE EJEMPLO NIT: 900.123.456-0\nProveedor ACME N.I.T. ", id_), _text("NIT ", id_, "\nNIT 900123456"), _text("Emisor ACME NIT ", id_, "\nNIT 811222333"))
    docs = _orders(spark, d).select("doc", text.alias("text"))
    return D.issuer_and_buyer(D.tax_ids(docs), docs.select("doc", F.lit("900123456").alias("own_id")))


def eventos_radian(spark, d):
    said = [F.when(F.bitwise_not(o_()).bitwiseAND(1 << k) == 0, s) for k, s in enumerate(("Acuse de recibo", "Recibo del bien o Prestación del servicio", "ACEPTACIÓN EXPRESA"))]
    return D.event_logs(_orders(spark, d).select("doc", F.concat_ws(" ... ", F.lit("Eventos"), *said).alias("text"))).select("doc", F.array_join("present", ",").alias("present"))


def identificadores(spark, d):
    """Ids, invoices, accounts and file names as they are written, and as they are kept and compared."""
    k = c("c_custkey")
    s = table(spark, d, "customer").select(
        k, _text("900,", _padded(k % 1000, 3), ".111-8").alias("nit"), F.when(k % 2 == 0, _text(" 00000000", k.cast("string"), "-001")).otherwise(_text(" fe", k.cast("string"), "-2")).alias("factura"),
        _text("Cta 787 - ", _padded(k, 6), " -14 Cuenta corriente").alias("cuenta"), _text("../a b/", F.when(k % 3 == 0, "ñ ").otherwise(""), "factura ", k.cast("string"), F.when(k % 2 == 0, ".PDF").otherwise("")).alias("archivo"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, _text("900", _padded(k % 1000, 3), "111")).when(k % 4 == 2, _text("900", _padded(k % 1000, 3), "1118")).otherwise(_text("900", _padded(k % 1000, 3), "1129")).alias("otro"), _text("fc-00", k.cast("string")).alias("numero"))
    other = F.when(k % 2 == 0, _text("FC00", k.cast("string"))).otherwise(_text("FC", k.cast("string")))
    return s.select(
        "c_custkey", X.clean_tax_id(c("nit")).alias("nit"), X.clean_invoice(c("factura")).alias("factura"), X.account(c("cuenta")).alias("cuenta"), X.safe_name(c("archivo")).alias("archivo"), X.same_tax_id(c("nit"), c("otro")).alias("mismo_nit"),
        X.whole_number(c("numero")).alias("entero"), X.trimmed_digits(F.when(k == 0, "000").otherwise(c("numero"))).alias("digitos"), X.same_number(c("numero"), other).alias("mismo_numero"))


def fechas(spark, d):
    """Dates of the bank and of orders in several shapes, from the orders' own dates."""
    on = c("o_orderdate").cast("date")
    months = F.array(*map(F.lit, ["Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Set", "Oct", "Nov", "Dic"]))
    named = _text(F.dayofmonth(on).cast("string"), " ", F.get(months, F.month(on) - 1), _way(2, " ", ""), F.year(on).cast("string"))
    slashed = F.date_format(on, "dd/MM/yyyy")
    raw = _way(4, named, slashed, F.date_format(on, "d-M-yyyy"), F.date_format(on, "yyyy/MM/dd"))
    return table(spark, d, "orders").select("o_orderkey", X.bank_date(raw).alias("banco"), X.order_date(raw).alias("orden"))


def cuentas_bancarias(spark, d):
    """Account numbers among other text; numbers of under seven places are none."""
    k = c("s_suppkey")
    raw = F.when(k % 3 == 0, _text("Ahorros 477 -", _padded(k, 6), " -72 Banco")).when(k % 3 == 1, _text("No. ", _padded(k, 9), "- Corriente")).otherwise(_text("12 ", (k % 10).cast("string"), "4 x"))
    return table(spark, d, "supplier").select("s_suppkey", X.account(raw).alias("cuenta"))


_V = """WITH v AS (SELECT o_orderkey AS doc, o_totalprice AS p, o_custkey AS k, o_orderkey % 3 AS way FROM orders)"""
_Q = """WITH li AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem), q AS (SELECT l_orderkey, sum(floor(l_quantity)) AS n, bool_or(k % 2 = 0 AND floor(l_quantity) > 0) AS rol, bool_or(k % 2 = 1 AND floor(l_quantity) > 0) AS pz FROM li GROUP BY 1), v AS (SELECT o_orderkey AS doc, o_custkey AS k, o_totalprice AS p, q.* FROM orders JOIN q ON l_orderkey = o_orderkey)"""
SQL = {
    "comprobantes": _V + """ SELECT doc, 'TRANSFERENCIAS BANCARIAS' AS kind, 'G-002-00' || lpad(CAST(doc AS VARCHAR), 9, '0') AS number, 'PROVEEDOR ' || ['UNO', 'DOS', 'TRES'][way + 1] || ' SAS' AS payee, '900123456' AS payer_id, '901' || lpad(CAST(doc % 1000 AS VARCHAR), 3, '0') || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') AS payee_id,
 CASE WHEN doc % 5 <> 0 THEN round(p + 7, 2) WHEN way = 0 THEN greatest(round(p, 2), doc + 100) WHEN way = 1 THEN round(p, 2) ELSE 5.0 END AS value, 'BANCO UNO CTA CTE No. 000-00' AS bank, '2026-09-01' AS date, 'MIL PESOS' AS in_words, CASE way WHEN 0 THEN CAST(doc AS VARCHAR) || ',FE' || CAST(doc AS VARCHAR) WHEN 1 THEN CAST(doc AS VARCHAR) ELSE '' END AS invoices FROM v""",
    "renglones_comprobante": _V + """ SELECT doc, CAST(doc AS VARCHAR) AS invoice, round(p, 2) AS value, '2205050100 - CANCELA FACTURA No. ' || lpad(CAST(doc AS VARCHAR), 11, '0') || '-001' AS concept FROM v WHERE way < 2 UNION ALL SELECT doc, 'FE' || CAST(doc AS VARCHAR), CAST(doc + 100 AS DOUBLE), '2205050100 - ABONO A LA FACTURA FE' || CAST(doc AS VARCHAR) FROM v WHERE way = 0
 UNION ALL SELECT doc, '', CASE WHEN doc % 5 <> 0 THEN round(p + 7, 2) ELSE 5.0 END, '' FROM v WHERE way = 2""",
    "conceptos_comprobante": _V + """, x AS (SELECT doc, 1 AS s, '2205050100 - CANCELA FACTURA No. ' || lpad(CAST(doc AS VARCHAR), 11, '0') || '-001' AS concept, round(p, 2) AS value, CAST(doc AS VARCHAR) AS invoice FROM v WHERE way < 2 UNION ALL SELECT doc, 2, '2205050100 - ABONO A LA FACTURA FE' || CAST(doc AS VARCHAR), CAST(doc + 100 AS DOUBLE), 'FE' || CAST(doc AS VARCHAR) FROM v WHERE way = 0
 UNION ALL SELECT doc, 3, '2408 - RETENCION EN LA FUENTE', 1.0, '' FROM v) SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY s) AS INTEGER) AS n, concept, value, invoice FROM x""",
    "registro_compras": _V + """ SELECT doc, 'OTRAS COMPRAS' AS kind, 'P-003-' || lpad(CAST(doc AS VARCHAR), 9, '0') AS number, 'SERVICIOS ' || ['UNO', 'DOS'][doc % 2 + 1] || ' SAS' AS party, '860' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || '222' AS tax_id, CASE WHEN doc % 2 = 0 THEN round(p, 2) ELSE round(p + 1, 2) END AS total,
 CASE way WHEN 0 THEN CAST(doc AS VARCHAR) WHEN 1 THEN 'FV' || CAST(doc AS VARCHAR) ELSE CAST(doc + 900000 AS VARCHAR) END AS invoice, CASE way WHEN 0 THEN CASE WHEN doc = 0 THEN '0' ELSE CAST(doc AS VARCHAR) END WHEN 1 THEN NULL ELSE CAST(doc + 900000 AS VARCHAR) END AS cited, '2026' || lpad(CAST(doc AS VARCHAR), 6, '0') AS order_no, '6' || lpad(CAST(doc AS VARCHAR), 6, '0') AS inner_order FROM v""",
    "ordenes_compra": _Q + """ SELECT doc, CAST(doc + 20260000 AS VARCHAR) AS number, 'PROVEEDOR S.A.' AS party, '860' || lpad(CAST(k % 1000000 AS VARCHAR), 6, '0') AS tax_id, '2026-07-14' AS date, '2026-09-22' AS due, CAST(n AS DOUBLE) AS quantity, round(p, 2) AS net, CASE WHEN doc % 3 = 0 THEN '21/07:20, 04/08:15' ELSE '' END AS deliveries FROM v""",
    "plazo_orden": _Q + """ SELECT doc, CASE WHEN doc % 2 = 0 THEN 7 WHEN doc % 5 = 0 THEN NULL ELSE 20 END AS days, CASE WHEN doc % 3 = 0 THEN CASE WHEN doc % 2 = 0 THEN true WHEN doc % 5 = 0 THEN NULL ELSE false END END AS planned FROM v""",
    "entradas": _Q + """ SELECT doc, 'E-001-' || lpad(CAST(doc AS VARCHAR), 9, '0') AS number, 'ALFA SAS' AS party, '860' || lpad(CAST(k % 1000000 AS VARCHAR), 6, '0') AS tax_id, '2026-08-05' AS date, '900123456,860' || lpad(CAST(k % 1000000 AS VARCHAR), 6, '0') AS tax_ids, CASE WHEN n > 0 THEN CAST(n AS DOUBLE) END AS quantity,
 concat_ws(',', CASE WHEN pz THEN 'PZ' END, CASE WHEN rol THEN 'ROL' END) AS units, '2026' || lpad(CAST(doc AS VARCHAR), 6, '0') AS order_no, 'FC' || CAST(doc AS VARCHAR) AS invoice, doc % 4 <> 2 AS signed, ['REVISADO POR COSTOS', 'R E V I S A D O P O R C O S T O S', '', 'VISTO BUENO'][doc % 4 + 1] AS seal,
 ['ANA RUIZ PAZ', 'ANA RUIZ', '', 'EVA MARIA LOPEZ'][doc % 4 + 1] AS reviewer, ['05-08-2026', '05-08-2026', '', ''][doc % 4 + 1] AS signed_on FROM v""",
    "rangos_y_numero": """SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 2 = 0 THEN 'FV' ELSE 'SETT' END AS prefix, o_orderkey AS n FROM orders WHERE o_orderkey > 10 AND o_orderkey < o_orderkey * 2 % 1500 + 11""",
    "nits_factura": _V + """, w AS (SELECT doc, way, '860' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || lpad(CAST(doc % 1000 AS VARCHAR), 3, '0') || '1' AS id FROM v) SELECT doc, CASE WHEN way > 0 THEN id END AS issuer, CASE way WHEN 0 THEN '9001234560' WHEN 1 THEN '900123456' END AS buyer FROM w""",
    "eventos_radian": """SELECT o_orderkey AS doc, concat_ws(',', CASE WHEN o_orderkey & 1 = 1 THEN 'acuse' END, CASE WHEN o_orderkey & 2 = 2 THEN 'recibo' END, CASE WHEN o_orderkey & 4 = 4 THEN 'aceptacion' END) AS present FROM orders""",
    "identificadores": """SELECT c_custkey, '900' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '111' AS nit, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'FE' || CAST(c_custkey AS VARCHAR) END AS factura, '787-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '-14' AS cuenta,
 'factura_' || CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey % 2 = 0 THEN '.PDF' ELSE '.pdf' END AS archivo,
 c_custkey % 4 IN (1, 2) AS mismo_nit, CAST(c_custkey AS VARCHAR) AS entero, CASE WHEN c_custkey = 0 THEN '000' ELSE CAST(c_custkey AS VARCHAR) END AS digitos, c_custkey % 2 = 0 AS mismo_numero FROM customer""",
    "fechas": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS banco, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS orden FROM orders""",
    "cuentas_bancarias": """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '477-' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '-72' WHEN 1 THEN lpad(CAST(s_suppkey AS VARCHAR), 9, '0') ELSE '' END AS cuenta FROM supplier""",
}

QUERIES = {k: globals()[k] for k in SQL}
