"""Queries of the document checks, near-key joins, candidates, layout and verdicts, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import candidates as C
from ..operators import checks as K
from ..operators import layout as L
from ..operators import matching as M
from ..operators import relational as R
from ..operators.access import lockouts
from ..sources.tables import table

# Facts of documents made from orders and their lines: nulls and misreadings come from the keys.
_FACTS = """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS total,
 CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END END AS seen,
 CASE WHEN o_orderkey % 13 <> 0 THEN CAST(900000000 + o_custkey AS {text}) END AS nit,
 CAST(900000000 + o_custkey AS {text}) || CASE WHEN o_orderkey % 3 = 0 THEN '-7' WHEN o_orderkey % 17 = 0 THEN '42' ELSE '' END AS want_nit,
 CASE WHEN o_orderkey % 4 <> 0 THEN 'FV-00' || CAST(o_orderkey AS {text}) ELSE '' END AS fra,
 CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderkey + CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END AS {text}) ELSE '' END AS want_fra,
 CASE WHEN o_orderkey % 6 <> 0 THEN 'OC' || CAST(o_custkey AS {text}) ELSE '' END AS oc, CASE WHEN o_orderkey % 8 <> 0 THEN 'oc ' || CAST(o_custkey AS {text}) ELSE '' END AS want_oc,
 CASE WHEN o_orderkey % 10 <> 0 THEN q END AS billed, CASE WHEN o_orderkey % 12 <> 0 THEN q + CASE WHEN o_orderkey % 23 = 0 THEN 2 ELSE 0 END END AS received,
 o_orderkey % 14 <> 0 AS signed, CASE WHEN o_orderkey % 15 <> 0 THEN o_orderkey % 16 <> 0 END AS helper, CASE WHEN o_orderkey % 15 <> 0 THEN o_orderkey % 21 <> 0 END AS boss
 FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) s ON l_orderkey = o_orderkey"""


def _facts(spark, d):
    return spark.sql(_FACTS.format(text="STRING").replace("FROM orders", "FROM {orders}").replace("FROM lineitem", "FROM {lineitem}"), orders=table(spark, d, "orders"), lineitem=table(spark, d, "lineitem"))


c = F.col


def chequeo_egreso(spark, d):
    state, note = K.voucher(c("total"), c("seen"))
    return _facts(spark, d).select("key", state.alias("state"), note.alias("note"))


def chequeo_compras(spark, d):
    state, bad, note = K.purchase_entry(c("oc"), c("want_oc"), c("fra"), c("want_fra"))
    return _facts(spark, d).select("key", state.alias("state"), F.array_join(bad, ",").alias("failed"), note.alias("note"))


def tope_orden(spark, d):
    state, bad = K.order_limit(c("nit"), c("want_nit"), c("oc"), F.array(c("want_oc")), c("billed"), c("received"))
    return _facts(spark, d).select("key", state.alias("state"), F.array_join(bad, ",").alias("failed"))


def chequeo_entrada(spark, d):
    """Some differences are explained by packs, and pass."""
    ids = F.array_compact(F.array(c("nit"), F.lit("800123123")))
    state, bad = K.receipt(ids, c("want_nit"), F.lit("800123123-1"), c("signed"), c("fra"), c("want_fra"), c("oc"), c("want_oc"), c("received"), c("billed"), c("key") % 46 == 0)
    return _facts(spark, d).select("key", state.alias("state"), F.array_join(bad, ",").alias("failed"))


def chequeo_recibido(spark, d):
    state, bad, open_ = K.warehouse_form(c("fra"), c("want_fra"), c("received"), c("billed").isNotNull(), c("billed"), c("helper"), c("boss"))
    return _facts(spark, d).select("key", state.alias("state"), F.array_join(bad, ",").alias("failed"), F.array_join(open_, ",").alias("pending"))


def chequeo_radian(spark, d):
    """Users whose events hold the three kinds that are asked for."""
    kind = F.create_map(*[F.lit(x) for p in (("click", "acuse"), ("view", "recibo"), ("purchase", "aceptacion")) for x in p])
    e = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(kind[c("event_type")]).alias("present"), F.max("event_id").cast("string").alias("number"))
    state, bad = K.event_log(F.array_compact("present"), c("number"), F.when(c("user_id") % 3 == 0, F.concat(F.lit("00"), c("number"))), c("user_id").cast("string"), F.when(c("user_id") % 5 == 0, F.concat(c("user_id").cast("string"), F.lit("-1"))))
    return e.select("user_id", state.alias("state"), F.array_join(bad, ",").alias("failed"))


def factura_m(spark, d):
    checks = {"nit_cliente": F.when(c("nit").isNotNull(), c("signed")), "nit_tercero": X.same_tax_id(c("nit"), c("want_nit")), "numero": F.when(c("fra") != "", F.lit(True)), "qr": c("helper")}
    state, bad, open_ = K.invoice(checks)
    return _facts(spark, d).select("key", state.alias("state"), F.array_join(bad, ",").alias("failed"), F.array_join(open_, ",").alias("pending"))


def estado_combinado(spark, d):
    """Per order: unknown if any line is, else AND; OK only if all lines are true."""
    ok = F.when(c("l_discount") > 0.01, c("l_tax") < 0.07)
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(R.tri_and(ok).alias("p"), F.bool_and(F.coalesce(ok, F.lit(False))).alias("all_ok"))
    return g.select("l_orderkey", "p", F.when(c("all_ok"), "OK").otherwise("").alias("m"))


def nit_igual_join(spark, d):
    s = table(spark, d, "supplier").select(c("s_suppkey").alias("a_key"), F.concat(F.lit("9"), F.lpad(c("s_suppkey").cast("string"), 6, "0"), F.lit("-"), (c("s_suppkey") % 10).cast("string")).alias("a_id"))
    u = table(spark, d, "customer").select(c("c_custkey").alias("b_key"), F.concat(F.lit("9"), F.lpad(c("c_custkey").cast("string"), 6, "0")).alias("b_id"))
    return M.tax_id_join(s, u)


def emparejar_facturas(spark, d):
    """Orders' numbers, one digit in four read wrong, against the customer's own list."""
    n = c("o_orderkey") + 1_000_000
    o = table(spark, d, "orders")
    wrong = F.when(c("o_orderkey") % 4 == 0, n + 30).when(c("o_orderkey") % 9 == 0, n * 10).otherwise(n)
    read = o.select(c("o_orderkey").alias("doc"), c("o_custkey").alias("batch"), F.concat(F.lit("FV-"), wrong.cast("string")).alias("number"))
    listed = o.select(c("o_custkey").alias("batch"), c("o_orderkey").alias("position"), F.concat(F.lit("FC"), n.cast("string")).alias("invoice"))
    return M.near_numbers(read, listed)


def rango_dian(spark, d):
    points = table(spark, d, "orders").select("o_orderkey", c("o_orderstatus").alias("prefix"), c("o_orderkey").alias("n"))
    ranges = table(spark, d, "nation").select("n_nationkey", F.element_at(F.array(F.lit("O"), F.lit("F"), F.lit("P")), (c("n_nationkey") % 3 + 1).cast("int")).alias("prefix"), (c("n_nationkey") * 90).cast("long").alias("low"), (c("n_nationkey") * 90 + 130).cast("long").alias("high"))
    return M.range_join(points, ranges, inclusive=False).select("o_orderkey", "n_nationkey")


def evidencia_numero(spark, d):
    """Parts of an order vote for a supplier by quantity; the earliest line breaks ties."""
    e = table(spark, d, "lineitem").select(c("l_orderkey").alias("doc"), (c("l_suppkey") % 4).cast("string").alias("candidate"), F.when(c("l_quantity") > 25, 3).otherwise(1).alias("points"), c("l_linenumber").alias("position"))
    return M.best_evidence(e)


def mayor_por_linea(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", R.money(c("l_extendedprice")).alias("price"))
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.max("price").alias("price"))


def mejor_candidato(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return table(spark, d, "lineitem").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("l_orderkey", "rank", "l_quantity", R.money(c("l_extendedprice")).alias("price"))


def bloqueo_intentos(spark, d):
    """Five failures in a row of one user lock the account for five minutes, in which nothing counts; longest is the longest run of failures."""
    e = table(spark, d, "events").select("user_id", c("event_id").alias("place"), c("ts").alias("at"), (c("event_type") == "purchase").alias("ok"))
    w = Window.partitionBy("user_id").orderBy("at", "place")
    island = e.withColumn("island", F.sum(c("ok").cast("int")).over(w)).where("NOT ok").groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"))
    locks = lockouts(e).groupBy("user_id").agg(F.count(F.lit(1)).alias("locks"))
    return island.groupBy("user_id").agg(F.max("n").alias("longest")).join(locks, "user_id", "left").select("user_id", F.coalesce("locks", F.lit(0).cast("long")).alias("locks"), "longest")


def candidatos_documentos(spark, d):
    lines = table(spark, d, "documents").select(c("doc_id").alias("doc"), F.lit(1).alias("page"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return C.candidates(lines).select("doc", "rank", "value", "kind", "score", "currency")


def intervalos_unidos(spark, d):
    """Line items of a part as quantity intervals that touch: the same merge as of columns on a page."""
    x = table(spark, d, "lineitem").select("l_suppkey", c("l_quantity").alias("x0"), (c("l_quantity") + 0.25).alias("x1"))
    return L.merge_intervals(x, ["l_suppkey"], 0.5)


_C = "regexp_replace({}, '[^0-9]', '', 'g')"
_EQ = lambda a, b: f"(coalesce({_C.format(a)}, '') <> '' AND coalesce({_C.format(b)}, '') <> '' AND ({_C.format(a)} = {_C.format(b)} OR (length({_C.format(a)}) = length({_C.format(b)}) + 1 AND starts_with({_C.format(a)}, {_C.format(b)})) OR (length({_C.format(b)}) = length({_C.format(a)}) + 1 AND starts_with({_C.format(b)}, {_C.format(a)}))))"
_D = lambda a: f"CASE WHEN ltrim({_C.format(a)}, '0') = '' THEN {_C.format(a)} ELSE ltrim({_C.format(a)}, '0') END"
_F = f"WITH f AS ({_FACTS.format(text='VARCHAR')})"
_STATE = "CASE WHEN len(bad) > 0 THEN 'Revisar' WHEN {} THEN 'Pendiente' ELSE 'OK' END AS state, array_to_string(bad, ',') AS failed"
_LIST = lambda pairs: "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in pairs) + "], lambda x: x IS NOT NULL)"

SQL = {
    "chequeo_egreso": _F + " SELECT key, CASE WHEN abs(total - seen) < 0.01 THEN 'OK' ELSE 'Revisar' END AS state, CASE WHEN total IS NULL THEN 'sin total' WHEN seen IS NULL THEN 'sin valor en la tabla' WHEN abs(total - seen) >= 0.01 THEN 'no cuadra' ELSE '' END AS note FROM f",
    "chequeo_compras": _F + f", g AS (SELECT *, {_LIST([('orden_compra', f'''oc <> '' AND want_oc <> '' AND {_D('oc')} <> {_D('want_oc')}'''), ('factura', f'''fra <> '' AND want_fra <> '' AND {_D('fra')} <> {_D('want_fra')}''')])} AS bad FROM f) SELECT key, CASE WHEN len(bad) > 0 THEN 'Revisar' WHEN (oc <> '' AND want_oc <> '') OR (fra <> '' AND want_fra <> '') THEN 'OK' ELSE '' END AS state, array_to_string(bad, ',') AS failed, CASE WHEN want_oc <> '' AND oc = '' THEN 'sin orden' ELSE '' END AS note FROM g",
    "tope_orden": _F + f", g AS (SELECT *, {_LIST([('nit_tercero', f'''NOT (nit IS NOT NULL AND {_EQ('nit', 'want_nit')})'''), ('orden_en_registro', '''want_oc <> '' AND (oc = '' OR upper(oc) <> replace(upper(want_oc), ' ', ''))'''), ('cantidad_tope', 'billed > received + 1e-6')])} AS bad FROM f) SELECT key, CASE WHEN len(bad) > 0 THEN 'Revisar' ELSE 'OK' END AS state, array_to_string(bad, ',') AS failed FROM g",
    "chequeo_entrada": _F + f", g AS (SELECT *, {_LIST([('nit_tercero', f'''NOT (nit IS NOT NULL AND {_EQ('nit', 'want_nit')})'''), ('firma', 'NOT signed'), ('factura', f'''want_fra <> '' AND (fra = '' OR {_D('fra')} <> {_D('want_fra')})'''), ('orden_compra', f'''want_oc <> '' AND (oc = '' OR {_D('oc')} <> {_D('want_oc')})'''), ('cantidad', 'abs(received - billed) >= 0.01 AND key % 46 <> 0')])} AS bad FROM f) SELECT key, {_STATE.format('received IS NULL OR billed IS NULL')} FROM g",
    "chequeo_recibido": _F + f", g AS (SELECT *, {_LIST([('factura', f'''want_fra <> '' AND (fra = '' OR ltrim({_C.format('fra')}, '0') <> ltrim({_C.format('want_fra')}, '0'))'''), ('cantidad', 'billed IS NOT NULL AND coalesce(abs(received - billed) >= 1e-6, true)'), ('firmas', 'NOT (helper AND boss)')])} AS bad, {_LIST([('factura', '''want_fra = '' '''), ('cantidad', 'billed IS NULL'), ('firmas', 'helper IS NULL AND boss IS NULL')])} AS open FROM f) SELECT key, {_STATE.format('len(open) > 0')}, array_to_string(open, ',') AS pending FROM g",
    "chequeo_radian": "WITH e AS (SELECT user_id, count(DISTINCT event_type) FILTER (event_type IN ('click', 'view', 'purchase')) AS k FROM events GROUP BY 1) SELECT user_id, CASE WHEN k = 3 THEN 'OK' ELSE 'Revisar' END AS state, CASE WHEN k = 3 THEN '' ELSE 'eventos' END AS failed FROM e",
    "factura_m": _F + f", g AS (SELECT *, {_LIST([('nit_cliente', 'nit IS NOT NULL AND NOT signed'), ('nit_tercero', f'''NOT {_EQ('nit', 'want_nit')}'''), ('qr', 'NOT helper')])} AS bad, {_LIST([('nit_cliente', 'nit IS NULL'), ('numero', '''fra = '' '''), ('qr', 'helper IS NULL')])} AS open FROM f) SELECT key, CASE WHEN len(bad) = 0 AND len(open) = 0 THEN 'OK' ELSE '' END AS state, array_to_string(bad, ',') AS failed, array_to_string(open, ',') AS pending FROM g",
    "estado_combinado": "WITH x AS (SELECT l_orderkey, CASE WHEN l_discount > 0.01 THEN l_tax < 0.07 END AS ok FROM lineitem) SELECT l_orderkey, CASE WHEN count(*) > count(ok) THEN NULL ELSE bool_and(ok) END AS p, CASE WHEN bool_and(coalesce(ok, false)) THEN 'OK' ELSE '' END AS m FROM x GROUP BY 1",
    "nit_igual_join": "WITH a AS (SELECT s_suppkey AS a_key, '9' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || CAST(s_suppkey % 10 AS VARCHAR) AS x FROM supplier), b AS (SELECT c_custkey AS b_key, '9' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS y FROM customer) SELECT a_key, b_key FROM a JOIN b ON x = y OR (length(x) = length(y) + 1 AND x[:-2] = y) OR (length(y) = length(x) + 1 AND y[:-2] = x)",
    "emparejar_facturas": "WITH r AS (SELECT o_orderkey AS doc, o_custkey AS batch, CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey + 1000030 WHEN o_orderkey % 9 = 0 THEN (o_orderkey + 1000000) * 10 ELSE o_orderkey + 1000000 END AS VARCHAR) AS n FROM orders), l AS (SELECT o_custkey AS batch, o_orderkey AS position, CAST(o_orderkey + 1000000 AS VARCHAR) AS m FROM orders), c AS (SELECT doc, position, m, hamming(n, m) AS gap, row_number() OVER (PARTITION BY doc ORDER BY hamming(n, m) > 0, position) AS k FROM r JOIN l ON r.batch = l.batch AND length(n) = length(m) WHERE hamming(n, m) <= 2) SELECT r.doc, 'FV-' || n AS number, 'FC' || m AS invoice, coalesce(gap = 0, false) AS exact, CAST(coalesce(gap, -1) AS INTEGER) AS gap FROM r LEFT JOIN c ON c.doc = r.doc AND k = 1",
    "rango_dian": "SELECT o_orderkey, n_nationkey FROM orders JOIN nation ON o_orderstatus = ['O', 'F', 'P'][n_nationkey % 3 + 1] AND o_orderkey > n_nationkey * 90 AND o_orderkey < n_nationkey * 90 + 130",
    "evidencia_numero": "WITH s AS (SELECT l_orderkey AS doc, CAST(l_suppkey % 4 AS VARCHAR) AS candidate, CAST(sum(CASE WHEN l_quantity > 25 THEN 3 ELSE 1 END) AS BIGINT) AS points, min(l_linenumber) AS position FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY points DESC, position, candidate DESC) AS k FROM s) SELECT doc, CASE WHEN points >= 2 THEN candidate ELSE '' END AS candidate, points FROM r WHERE k = 1",
    "mayor_por_linea": "SELECT l_orderkey, l_linenumber, max(round(l_extendedprice, 2)) AS price FROM lineitem GROUP BY 1, 2",
    "mejor_candidato": "SELECT l_orderkey, CAST(rank AS INTEGER) AS rank, l_quantity, round(l_extendedprice, 2) AS price FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS rank FROM lineitem) WHERE rank <= 3",
    "bloqueo_intentos": """WITH RECURSIVE e AS (SELECT user_id, ts, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, 0 AS n, TIMESTAMP '1970-01-01' AS until, CAST(0 AS BIGINT) AS locks FROM events
 UNION ALL SELECT e.user_id, e.k, CASE WHEN e.ts < until THEN n WHEN ok OR n = 4 THEN 0 ELSE n + 1 END, CASE WHEN e.ts >= until AND NOT ok AND n = 4 THEN e.ts + INTERVAL 5 MINUTE ELSE until END, locks + CASE WHEN e.ts >= until AND NOT ok AND n = 4 THEN 1 ELSE 0 END
 FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1), i AS (SELECT user_id, ok, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY k) AS island FROM e), r AS (SELECT user_id, island, count(*) AS n FROM i WHERE NOT ok GROUP BY 1, 2)
 SELECT r.user_id, m.locks, max(r.n) AS longest FROM r JOIN (SELECT user_id, max(locks) AS locks FROM s GROUP BY 1) m ON m.user_id = r.user_id GROUP BY 1, 2""",
    "intervalos_unidos": "WITH a AS (SELECT l_suppkey, l_quantity AS x0, l_quantity + 0.25 AS x1, max(l_quantity + 0.25) OVER (PARTITION BY l_suppkey ORDER BY l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM lineitem), b AS (SELECT *, sum(CASE WHEN e IS NULL OR x0 > e + 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY x0, x1 RANGE UNBOUNDED PRECEDING) AS grp FROM a) SELECT l_suppkey, CAST(grp AS BIGINT) AS grp, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM b GROUP BY 1, 2",
}

QUERIES = {k: globals()[k] for k in [*SQL, "candidatos_documentos"]}
