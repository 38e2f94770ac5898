"""Invoices written from the orders, one layout in six, whose numbers are read back by evidence; the SQL knows what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import portal as P
from ..operators import review as V
from ..sources.tables import spread, table

c = F.col


def _invoices(spark, d):
    n = (c("o_orderkey") + 100_000).cast("string")
    pick = lambda *xs: F.get(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs]), (c("o_orderkey") % 6).cast("int"))
    say = lambda form: F.concat(*[p for i, s in enumerate(form.split("{n}")) for p in ([n] if i else []) + [F.lit(s)]])
    text = pick(say("Factura electronica de venta No. FV {n}\nOrden No. 4455"), say("ALFA\nResolucion desde FE 1 hasta FE 99999999\nNo. FE {n}\nCuenta No. 5551234567"), say("ALFA\nDocumento FC-{n}\nTotal"), say("ALFA\nRef {n}"), "ALFA\nNo. 77", "ALFA\nTotal 2026")
    return spread(table(spark, d, "orders").select("o_orderkey")).select(c("o_orderkey").alias("doc"), text.alias("text"), pick("", "", "", "", F.concat(F.lit("ÿÿ"), n), "").alias("qr"), pick("", "", F.concat(F.lit("00"), n), "", "", "31").alias("expected"), pick("copia.pdf", "", "", F.concat(F.lit("FRA FE"), n, F.lit(" ALFA.pdf")), "", "Fra 88.pdf").alias("name"))


def numero_factura(spark, d):
    return E.invoice_numbers(_invoices(spark, d))


def numero_contra_egreso(spark, d):
    """Numbers read back against what a voucher cites: the same one, one with a digit off, or another."""
    cited = F.when(c("doc") % 4 == 0, c("doc") + 100_000).when(c("doc") % 4 == 1, c("doc") + 130_000).when(c("doc") % 4 == 2, F.lit(7))
    return numero_factura(spark, d).select("doc", E.against_voucher(c("number"), cited.cast("string")).alias("agrees"))


def _reviewed(spark, d):
    """The invoices with parties, hash and code in five, four and three ways; hashes are letters, so that they hold no number."""
    o = c("o_orderkey")
    key = table(spark, d, "orders").select(o.alias("doc"), F.concat(F.lit("860"), F.lpad(c("o_custkey").cast("string"), 6, "0")).alias("third"))
    made = _invoices(spark, d).join(key, "doc")
    code_hash = F.repeat(F.translate(F.md5(c("doc").cast("string")), "0123456789", "abcdefabcd"), 3)
    way = lambda n, *xs: F.get(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs]), (c("doc") % n).cast("int"))
    issuer = F.concat(F.lit("\nEmisor ALFA NIT "), c("third"), F.lit("-1"))
    own = "\nCliente EJEMPLO NIT: 900.123.456-0"
    boxes = way(5, F.concat(issuer, F.lit(own)), F.concat(issuer, F.lit("\nCliente OTRO NIT: 811.222.333")), "\nEmisor BETA NIT 830555666-2", "", F.concat(issuer, F.lit(own)))
    shown = F.when(c("doc") % 4 == 0, F.concat(F.lit("\nCUFE: "), code_hash)).otherwise("")
    field = lambda name, x: F.when(x, F.concat(F.lit(name + ": "), F.when(F.lit(name) == "NumFac", c("qr")).when(F.lit(name) == "NitFac", c("third")).when(F.lit(name) == "DocAdq", F.lit("900123456")).otherwise(code_hash)))
    code = F.concat_ws("\n", field("NumFac", c("qr") != ""), field("NitFac", c("doc") % 5 == 3), field("DocAdq", c("doc") % 5 == 3), field("CUFE", c("doc") % 4 == 2))
    links = F.when(c("doc") % 4 == 1, F.array(F.lit("https://tienda.example"), F.concat(F.lit("https://consulta.example/documentKey="), code_hash)))
    cited = F.when(c("doc") % 3 == 0, c("doc") + 100_000).when(c("doc") % 3 == 1, c("doc") + 130_000)
    return made.select("doc", F.concat("text", boxes, shown).alias("text"), links.alias("links"), code.alias("code"), (c("doc") % 7 == 0).alias("code_seen"), "name", "expected", F.lit("900123456").alias("own_id"), F.when(c("doc") % 5 != 4, c("third")).alias("third_id"), cited.cast("string").alias("cited"))


def analisis_factura(spark, d):
    return V.review(_reviewed(spark, d)).select("doc", "hash", "issuer", "buyer", "m", "n", "o", "p", F.array_join("failed", ",").alias("failed"), F.array_join("pending", ",").alias("pending"), "note")


def _portal_lines(spark, d):
    """A portal page of each order: titles over their values, or with a colon at their left; a cut title stands at the right of the number's."""
    n, side = (c("o_orderkey") + 100_000).cast("string"), c("o_orderkey") % 2 == 1
    third = F.concat(F.lit("860"), F.lpad(c("o_custkey").cast("string"), 6, "0"))
    spot = lambda text, x, y, when=F.lit(True): F.when(when, F.struct(text.alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(x + 80)).alias("x1"), F.lit(float(y)).alias("y0"), F.lit(float(y + 10)).alias("y1")))
    title = lambda t, y: spot(F.concat(F.lit(t), F.when(side, ":").otherwise("")), 10, y)
    value = lambda v, y, when=F.lit(True): [spot(v, 10, y + 15, when & ~side), spot(v, 110, y, when & side)]
    lines = [
        title("Número de documento", 10), *value(F.concat(F.lit("FV"), n), 10), spot(F.lit("Versic"), 110, 10, ~side), title("NUMERODEIDENTIFICACION", 210), *value(third, 210, c("o_orderkey") % 5 != 0),
        title("Razón social", 410), *value(F.lit("ALFA SAS"), 410), title("Estatus legal", 610), *value(F.lit("Registrado"), 610), spot(F.lit("Acuse de recibo"), 400, 810), spot(F.lit("Recibo del bien"), 400, 830, c("o_orderkey") % 3 != 0),
        spot(F.lit("Aceptación expresa"), 400, 850, c("o_orderkey") % 4 != 0),
    ]
    return spread(table(spark, d, "orders").select("o_orderkey", "o_custkey")).select(c("o_orderkey").alias("doc"), F.lit(1).alias("page"), F.posexplode(F.array_compact(F.array(*lines))).alias("line_no", "l")).select("doc", "page", "line_no", "l.*")


def soporte_radian(spark, d):
    """The portal's fields of each order, checked against a number (other for every eleventh) and the customer's id (with a check digit for every sixth)."""
    want = table(spark, d, "orders").select(c("o_orderkey").alias("doc"), F.when(c("o_orderkey") % 11 == 0, "77").when(c("o_orderkey") % 7 == 0, "").otherwise(F.concat(F.lit("00"), (c("o_orderkey") + 100_000).cast("string"))).alias("want_number"),
        F.concat(F.lit("860"), F.lpad(c("o_custkey").cast("string"), 6, "0"), F.when(c("o_orderkey") % 6 == 0, "-4").otherwise("")).alias("want_id"))
    return P.portal_checks(P.portal_fields(_portal_lines(spark, d)), want)


_NUMBER = "CASE o_orderkey % 6 WHEN 0 THEN 'FV' || n WHEN 1 THEN 'FE' || n WHEN 2 THEN 'FC' || n WHEN 3 THEN 'FE' || n WHEN 4 THEN n ELSE '' END"
_ORDERS = "(SELECT o_orderkey, CAST(o_orderkey + 100000 AS VARCHAR) AS n FROM orders)"
SQL = {
    "numero_factura": f"""SELECT o_orderkey AS doc, {_NUMBER} AS number, CASE o_orderkey % 6 WHEN 0 THEN 'texto (etiqueta de factura, detrás de un No.)' WHEN 1 THEN 'texto (detrás de un No., prefijo en el rango autorizado)' WHEN 2 THEN 'texto (coincide con el egreso)' WHEN 3 THEN 'texto (nombre del archivo)' WHEN 4 THEN 'QR' ELSE '' END AS source,
 CAST(CASE o_orderkey % 6 WHEN 0 THEN 7 WHEN 1 THEN 6 WHEN 2 THEN 6 WHEN 3 THEN 2 END AS BIGINT) AS points FROM {_ORDERS}""",
    "numero_contra_egreso": f"""WITH x AS (SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 6 < 5 THEN o_orderkey + 100000 END AS a, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey + 100000 WHEN 1 THEN o_orderkey + 130000 WHEN 2 THEN 7 END AS b FROM orders)
SELECT doc, CASE WHEN a = b THEN true WHEN length(CAST(a AS VARCHAR)) = length(CAST(b AS VARCHAR)) AND hamming(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) <= 2 THEN false END AS agrees FROM x""",
    "analisis_factura": f"""WITH x AS (SELECT o_orderkey AS doc, '860' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS third, {_NUMBER} AS n, o_orderkey % 6 < 5 AS has_n, o_orderkey % 5 AS way, CASE WHEN o_orderkey % 4 < 3 THEN repeat(translate(md5(CAST(o_orderkey AS VARCHAR)), '0123456789', 'abcdefabcd'), 3) ELSE '' END AS hash,
 o_orderkey % 6 = 4 OR o_orderkey % 5 = 3 OR o_orderkey % 4 IN (1, 2) OR o_orderkey % 7 = 0 AS has_code FROM (SELECT o_orderkey, o_custkey, CAST(o_orderkey + 100000 AS VARCHAR) AS n FROM orders)),
 y AS (SELECT *, CASE way WHEN 2 THEN '8305556662' WHEN 4 THEN third || '1' ELSE third END AS issuer, CASE way WHEN 0 THEN '9001234560' WHEN 1 THEN '811222333' WHEN 2 THEN '' WHEN 3 THEN '900123456' ELSE '9001234560' END AS buyer, CASE way WHEN 2 THEN false WHEN 4 THEN NULL ELSE true END AS p,
 has_n AND doc % 3 = 1 AND length(CAST(doc + 130000 AS VARCHAR)) = length(CAST(doc + 100000 AS VARCHAR)) AND hamming(CAST(doc + 130000 AS VARCHAR), right('0000000' || CAST(doc + 100000 AS VARCHAR), length(CAST(doc + 130000 AS VARCHAR)))) <= 2 AS off FROM x),
 z AS (SELECT *, array_to_string(list_filter([CASE WHEN hash = '' THEN 'cufe' END, CASE WHEN way = 1 THEN 'nit_cliente' END, CASE WHEN way = 2 THEN 'nit_tercero' END, CASE WHEN NOT has_n THEN 'numero' END, CASE WHEN off THEN 'numero_egreso' END, CASE WHEN NOT has_code THEN 'qr' END], lambda v: v IS NOT NULL), ',') AS failed, CASE way WHEN 2 THEN 'nit_cliente' WHEN 4 THEN 'nit_tercero' ELSE '' END AS pending FROM y)
 SELECT doc, hash, issuer, buyer, CASE WHEN failed = '' AND pending = '' THEN 'OK' ELSE '' END AS m, n, CASE WHEN p THEN third ELSE issuer END AS o, p, failed, pending, CASE WHEN off THEN 'el egreso dice ' || CAST(doc + 130000 AS VARCHAR) || ' y la factura dice ' || n ELSE '' END AS note FROM z""",
    "soporte_radian": """WITH x AS (SELECT o_orderkey AS doc, 'FV' || CAST(o_orderkey + 100000 AS VARCHAR) AS number, CASE WHEN o_orderkey % 5 <> 0 THEN '860' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') ELSE '' END AS tax_id, CASE WHEN o_orderkey % 11 = 0 THEN '77' WHEN o_orderkey % 7 = 0 THEN '' ELSE '00' || CAST(o_orderkey + 100000 AS VARCHAR) END AS want,
 '860' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') || CASE WHEN o_orderkey % 6 = 0 THEN '-4' ELSE '' END AS want_id, list_filter([CASE WHEN o_orderkey % 4 = 0 THEN 'aceptacion' END, CASE WHEN o_orderkey % 3 = 0 THEN 'recibo' END], lambda v: v IS NOT NULL) AS lost FROM orders),
 y AS (SELECT *, list_filter([CASE WHEN len(lost) > 0 THEN 'eventos' END, CASE WHEN doc % 11 = 0 THEN 'numero' END, CASE WHEN tax_id = '' THEN 'nit' END], lambda v: v IS NOT NULL) AS bad FROM x)
 SELECT doc, number, tax_id, 'ALFA SAS' AS name, CASE WHEN len(bad) > 0 THEN 'Revisar' ELSE 'OK' END AS state, array_to_string(bad, ',') AS failed, array_to_string(list_filter([CASE WHEN len(lost) > 0 THEN 'faltan ' || array_to_string(lost, ', ') END,
 CASE WHEN doc % 11 = 0 THEN 'RADIAN dice ' || number || ' y la factura es 77' END, CASE WHEN tax_id = '' THEN 'RADIAN dice NIT sin NIT y el tercero es ' || want_id END], lambda v: v IS NOT NULL), ' · ') AS note FROM y""",
}

QUERIES = {k: globals()[k] for k in SQL}
