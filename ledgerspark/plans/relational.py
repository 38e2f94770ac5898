"""Relational queries over the star-schema analogs (customer - orders - lineitem for batch - payment - line) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources.tables import table

TOLERANCE = 10_000.0


def _payments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("batch"), F.col("o_totalprice").alias("amount"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_extendedprice").alias("k"), (F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("q"))


def resumen_registros(spark, d):
    return R.payment_summary(_payments(spark, d), _lines(spark, d), TOLERANCE)


def resumen_totales(spark, d):
    return R.summary_totals(resumen_registros(spark, d))


def panorama_lotes(spark, d):
    batches = table(spark, d, "customer").select(F.col("c_custkey").alias("batch"), F.when(F.col("c_custkey") % 3 != 0, R.money(F.col("c_acctbal"))).alias("total"))
    evidence = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"))
    return R.batch_overview(batches, _payments(spark, d), evidence)


def panorama_validados(spark, d):
    evidence = table(spark, d, "lineitem").where("l_discount > 0.05").select(F.col("l_orderkey").alias("key"))
    return _payments(spark, d).join(evidence, "key", "left_semi").groupBy("batch").agg(F.count(F.lit(1)).alias("validated"))


def panorama_por_dueno(spark, d):
    per = _payments(spark, d).groupBy("batch").agg(F.count(F.lit(1)).alias("payments"), F.sum("amount").alias("total"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    own = table(spark, d, "customer").join(nation, "c_nationkey").select(F.col("c_custkey").alias("batch"), F.when(F.col("c_nationkey") > 0, F.col("n_name")).alias("owner"))
    return R.owner_rollup(own.join(per, "batch", "left"))


def huerfanos(spark, d):
    parents = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    lost = R.orphans(table(spark, d, "lineitem"), parents, "l_orderkey")
    return lost.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), R.money(F.sum("l_quantity")).alias("quantity"))


def _batches(spark, d, lo, hi, extra):
    o = table(spark, d, "orders").where((F.col("o_orderkey") % 10 >= lo) & (F.col("o_orderkey") % 10 < hi))
    return o.select(F.col("o_custkey").cast("string").alias("owner"), F.col("o_orderkey").alias("sheet"), R.money(F.col("o_totalprice") + extra).alias("total"), F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")).alias("note"))


def reemplazo_por_dueno(spark, d):
    stored, new = _batches(spark, d, 0, 7, 0.0), _batches(spark, d, 5, 10, 1.0)
    return R.replace_by_owner(stored, new.where("owner = '7'"), F.lit("7"))


def upsert_lote(spark, d):
    return R.upsert(_batches(spark, d, 0, 7, 0.0), _batches(spark, d, 5, 10, 1.0), ["owner", "sheet"])


def documentos_unicos(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size"))
    one = docs.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.min("size").alias("size"), F.count(F.lit(1)).alias("copies"))
    return one.withColumn("stored_name", F.concat(F.substring("hash", 1, 16), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf")))


def documentos_nuevos(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    return R.insert_absent(docs.where("source = 'src0'"), docs.where("source <> 'src0'"), "hash", [F.col("doc_id")]).select("doc_id", "hash")


def documentos_recientes(spark, d):
    return R.recent(table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), [F.desc("n_chars"), F.desc("doc_id")], 300, F.col("lang") == "en")


def eventos_recientes(spark, d):
    return R.recent(table(spark, d, "events").select("event_id", "user_id", "event_type", "value"), [F.desc("event_id")], 200)


def eventos_por_dia(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("events"), R.money(F.sum("value")).alias("value"))


def arbol_trabajo(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity").alias("position"), R.money(F.col("l_extendedprice")).alias("value"))
    tree = R.nested_work(table(spark, d, "customer").select(F.col("c_custkey").alias("batch"), "c_name"), _payments(spark, d), lines)
    flat = tree.select("batch", "c_name", F.posexplode_outer("payments").alias("n", "p")).select("batch", "c_name", "n", F.col("p.key").alias("key"), R.money(F.col("p.amount")).alias("amount"), F.size("p.lines").alias("lines"), F.when(F.size("p.lines") > 0, F.get("p.lines", F.lit(0))["value"]).alias("first_value"))
    return flat.select("batch", "c_name", F.col("n").cast("int").alias("n"), "key", "amount", F.coalesce("lines", F.lit(0)).alias("lines"), "first_value")


def json_resto(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), R.number_or_text(F.get_json_object("props", "$.k")).alias("k_text"), R.number_or_text(F.concat(F.get_json_object("props", "$.k"), F.lit(".7"))).alias("cut"), R.number_or_text(F.lit("  ")).alias("blank"), R.number_or_text(F.col("event_type")).alias("type_text"))


def anotar_documentos(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    read = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return docs.join(read, "doc_id", "left").select("doc_id", "source", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


def migracion_dueno(spark, d):
    """Rows get a constant owner; the copy is right when counts agree and no child lost its parent."""
    own = table(spark, d, "orders").withColumn("owner", F.lit("admin"))
    lines = table(spark, d, "lineitem").select("l_orderkey")
    lost = lines.join(own.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    return own.agg(F.count(F.lit(1)).alias("copied"), F.count_if(F.col("owner") == "admin").alias("owned")).crossJoin(F.broadcast(lost))


def lote_desde_egresos(spark, d):
    """Vouchers to one batch per nation: sum, dates, and the first non-empty bank in order of number."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("number"), F.col("s_nationkey").alias("batch"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("value"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("bank"))
    return s.groupBy("batch").agg(F.count(F.lit(1)).alias("vouchers"), R.money(F.sum(F.coalesce("value", F.lit(0.0)))).alias("total"), F.min("number").alias("first_number"), F.max("number").alias("last_number"), F.min_by("bank", F.when(F.col("bank").isNotNull(), F.col("number"))).alias("bank"))


def primer_usuario(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.min_by("c_name", "c_custkey").alias("first_user"), F.count(F.lit(1)).alias("users"))


def visibilidad(spark, d):
    """A reviewer sees their own rows; the other roles see all of them, read-only."""
    people = spark.createDataFrame([("ana", "revisor", 3), ("luz", "gerente", 0), ("rey", "admin", 0)], "person string, role string, nation int")
    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("owner"))
    may = F.col("role").isin("gerente", "admin") | (F.col("owner") == F.col("nation"))
    return rows.join(F.broadcast(people), may).select("person", "s_suppkey", (F.col("role") == "revisor").alias("writes"))


def reporte_huerfanos_archivo(spark, d):
    """Files named by time stamp, as the old scheme did: how many, how large, and the first 20 names. Names are made of page ids and urls."""
    stamp = F.when(F.col("page_id") % 3 == 0, F.concat(F.lpad(F.col("page_id").cast("string"), 13, "1"), F.lit("_"))).otherwise("")
    names = table(spark, d, "pages").select(F.concat(stamp, F.regexp_extract("url", r"([^/]+)$", 1)).alias("name"), F.octet_length("html").cast("long").alias("size"))
    hit = names.where(F.col("name").rlike(r"^[0-9]{13}_"))
    first = hit.orderBy("name").limit(20).agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("first_names"))
    return hit.agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("size") / 1048576, 1).alias("mb")).crossJoin(first)


def diferencias_l_r(spark, d):
    usd = F.col("o_orderpriority") == "1-URGENT"
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("g"), usd.alias("usd"))
    sums = _lines(spark, d).groupBy("key").agg(F.sum("k").alias("k"), R.money(F.sum("q")).alias("q"))
    j = o.join(sums, "key", "left")
    return j.select("key", F.when(~F.col("usd"), R.money(F.col("g") - F.coalesce("k", F.lit(0.0)))).alias("diff_l"), F.when(F.col("usd"), "USD").alias("note_l"), R.money(F.col("g") - F.coalesce("q", F.lit(0.0))).alias("diff_r"))


def _sheet_lines(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("sheet"), F.when(F.col("o_orderstatus") == "P", "USD").otherwise("COP").alias("currency"), F.col("o_totalprice").alias("g"))
    sums = _lines(spark, d).groupBy("key").agg(F.sum("k").alias("k"), R.money(F.sum("q")).alias("q"))
    return o.join(sums, "key", "left")


def fila_total(spark, d):
    return R.sheet_totals(_sheet_lines(spark, d))


def diferencias_lote(spark, d):
    head = table(spark, d, "customer").select(F.col("c_custkey").alias("batch"), F.col("c_acctbal").alias("declared"))
    return head.join(_payments(spark, d).groupBy("batch").agg(F.sum("amount").alias("g")), "batch", "left").select("batch", R.money(F.coalesce("g", F.lit(0.0)) - F.col("declared")).alias("difference"))


def filas_asignadas(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey").join(n.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left")
    return R.running_start(o, ["o_custkey"], ["o_orderkey"], F.coalesce("n", F.lit(0)), 5).select("o_custkey", "o_orderkey", "row_start")


def grupos_combinados(spark, d):
    """Consecutive payments of a customer with the same status merge into one block."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return R.runs(o, ["o_custkey"], ["o_orderkey"], F.col("o_orderstatus")).groupBy("o_custkey", "run", "o_orderstatus").agg(F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("first_key"))


def resumen_exportacion(spark, d):
    k = F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("invoices"), (F.count(k) > 0).alias("validated"), R.money(F.coalesce(F.sum(k), F.lit(0.0))).alias("sum_k"))


def avisos_lote(spark, d):
    """Warnings of all kinds in one table: a union of filtered batches."""
    o = _payments(spark, d).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("g"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("batch"), (F.col("c_custkey") % 25).alias("declared"), F.col("c_acctbal").alias("total"), F.when(F.col("c_nationkey") > 2, F.col("c_name")).alias("payee")).join(o, "batch", "left")
    count = b.where(F.coalesce("n", F.lit(0)) != F.col("declared")).select("batch", F.lit("cantidad").alias("warning"))
    total = b.where(F.abs(F.coalesce("g", F.lit(0.0)) - F.col("total")) > 0.5).select("batch", F.lit("suma").alias("warning"))
    payee = b.where("payee IS NULL").select("batch", F.lit("titular").alias("warning"))
    return count.unionByName(total).unionByName(payee)


def conteo_declarado(spark, d):
    o = _payments(spark, d).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("batch"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey")).alias("declared")).join(o, "batch", "left").select("batch", F.coalesce("declared", "n", F.lit(0)).alias("records"))


def columna_j(spark, d):
    """The payment's text repeated on each of its lines."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat_ws(" / ", "o_orderpriority", "o_orderstatus").alias("mail"))
    return table(spark, d, "lineitem").join(o, "l_orderkey").groupBy("l_orderkey", "mail").agg(F.count(F.lit(1)).alias("rows"))


def cuentas(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.lower("c_name").alias("usuario"), (F.col("c_acctbal") > 0).alias("activo"), (F.col("c_mktsegment") == "BUILDING").alias("admin"))


def ultimo_por_nombre(spark, d):
    """The newest file of each name."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("name"))
    return p.groupBy("name").agg(F.max("page_id").alias("page_id"), F.count(F.lit(1)).alias("versions"))


_SUMMARY = """SELECT o_orderkey AS key, round(o_totalprice, 2) AS amount, round(k, 2) AS sum_k, round(q, 2) AS sum_q, coalesce(n, 0) AS invoices,
  round(round(o_totalprice, 2) - coalesce(round(k, 2), 0), 2) AS diff_l, round(round(o_totalprice, 2) - coalesce(round(q, 2), 0), 2) AS diff_r,
  CASE WHEN coalesce(round(k, 2), 0) = 0 THEN 'sin validar' WHEN abs(round(o_totalprice, 2) - round(k, 2)) < 10000 THEN 'cuadra' ELSE 'descuadre' END AS state
FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS k, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))), 2) AS DOUBLE) AS q, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
_SUMS = "(SELECT l_orderkey, sum(l_extendedprice) AS k, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))), 2) AS DOUBLE) AS q FROM lineitem GROUP BY 1)"
_SLICE = "SELECT CAST(o_custkey AS VARCHAR) AS owner, o_orderkey AS sheet, round(o_totalprice + {x}, 2) AS total, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderpriority END AS note FROM orders WHERE o_orderkey % 10 >= {lo} AND o_orderkey % 10 < {hi}"
_OLD, _NEW = _SLICE.format(x="0.0", lo=0, hi=7), _SLICE.format(x="1.0", lo=5, hi=10)

SQL = {
    "resumen_registros": _SUMMARY,
    "resumen_totales": f"SELECT count(*) AS payments, count(*) FILTER (state = 'cuadra') AS balanced, count(*) FILTER (state = 'descuadre') AS off, count(*) FILTER (state = 'sin validar') AS unvalidated, round(sum(amount), 2) AS amount FROM ({_SUMMARY})",
    "panorama_lotes": """WITH b AS (SELECT c_custkey AS batch, CASE WHEN c_custkey % 3 <> 0 THEN round(c_acctbal, 2) END AS total FROM customer),
 p AS (SELECT o_custkey AS batch, count(DISTINCT o_orderkey) AS n, sum(o_totalprice) AS g, count(*) FILTER (EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')) AS v FROM orders GROUP BY 1)
SELECT b.batch, coalesce(n, 0) AS payments, round(coalesce(g, 0), 2) AS amount, coalesce(v, 0) AS validated, CASE WHEN total IS NULL THEN false ELSE abs(round(coalesce(g, 0), 2) - total) < 0.01 END AS agrees FROM b LEFT JOIN p USING (batch)""",
    "panorama_validados": "SELECT o_custkey AS batch, count(*) AS validated FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.05) GROUP BY 1",
    "panorama_por_dueno": """WITH p AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS g FROM orders GROUP BY 1),
 o AS (SELECT coalesce(CASE WHEN c_nationkey > 0 THEN n_name END, '') AS owner, n, g FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN p ON o_custkey = c_custkey)
SELECT owner, count(*) AS batches, CAST(sum(coalesce(n, 0)) AS BIGINT) AS payments, round(sum(coalesce(g, 0)), 2) AS total, CASE WHEN owner = '' THEN '(sin dueño)' ELSE owner END AS label FROM o GROUP BY owner""",
    "huerfanos": "SELECT l_orderkey, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'O') GROUP BY 1",
    "reemplazo_por_dueno": f"SELECT * FROM ({_OLD}) WHERE owner <> '7' UNION ALL SELECT * FROM ({_NEW}) WHERE owner = '7'",
    "upsert_lote": f"SELECT coalesce(i.owner, s.owner) AS owner, coalesce(i.sheet, s.sheet) AS sheet, CASE WHEN i.sheet IS NOT NULL THEN i.total ELSE s.total END AS total, CASE WHEN i.sheet IS NOT NULL THEN i.note ELSE s.note END AS note FROM ({_OLD}) s FULL JOIN ({_NEW}) i ON s.owner = i.owner AND s.sheet = i.sheet",
    "documentos_unicos": "SELECT sha256(text) AS hash, min(doc_id) AS doc_id, min(CAST(strlen(text) AS BIGINT)) AS size, count(*) AS copies, sha256(text)[:16] || '_' || CAST(min(doc_id) AS VARCHAR) || '.pdf' AS stored_name FROM documents GROUP BY sha256(text)",
    "documentos_nuevos": "SELECT min(doc_id) AS doc_id, sha256(text) AS hash FROM documents WHERE source <> 'src0' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0') GROUP BY 2",
    "documentos_recientes": "SELECT doc_id, source, lang, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id DESC LIMIT 300",
    "eventos_recientes": "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 200",
    "eventos_por_dia": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
    "arbol_trabajo": """WITH l AS (SELECT l_orderkey, count(*) AS n, arg_min(round(l_extendedprice, 2), {'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey, 'd': l_shipdate, 'e': l_quantity, 'f': l_extendedprice}) AS v FROM lineitem GROUP BY 1)
SELECT c_custkey AS batch, c_name, CASE WHEN o_orderkey IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS INTEGER) END AS n, o_orderkey AS key, round(o_totalprice, 2) AS amount, CAST(coalesce(l.n, 0) AS INTEGER) AS lines, v AS first_value
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN l ON l_orderkey = o_orderkey""",
    "json_resto": "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR) AS k_text, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR) AS cut, CAST(NULL AS VARCHAR) AS blank, event_type AS type_text FROM events",
    "anotar_documentos": "SELECT doc_id, source, coalesce(q, -1) AS quality, coalesce(t, -1) AS toxic FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY 1) USING (doc_id)",
    "migracion_dueno": "SELECT count(*) AS copied, count(*) AS owned, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphans FROM orders",
    "lote_desde_egresos": "SELECT s_nationkey AS batch, count(*) AS vouchers, round(sum(CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 0 END), 2) AS total, min(s_suppkey) AS first_number, max(s_suppkey) AS last_number, arg_min(s_name, s_suppkey) FILTER (s_suppkey % 2 = 0) AS bank FROM supplier GROUP BY 1",
    "primer_usuario": "SELECT c_mktsegment, arg_min(c_name, c_custkey) AS first_user, count(*) AS users FROM customer GROUP BY 1",
    "visibilidad": "SELECT person, s_suppkey, role = 'revisor' AS writes FROM supplier, (VALUES ('ana', 'revisor', 3), ('luz', 'gerente', 0), ('rey', 'admin', 0)) v(person, role, nation) WHERE role IN ('gerente', 'admin') OR s_nationkey = nation",
    "reporte_huerfanos_archivo": "WITH f AS (SELECT CASE WHEN page_id % 3 = 0 THEN lpad(CAST(page_id AS VARCHAR), 13, '1') || '_' ELSE '' END || regexp_extract(url, '([^/]+)$', 1) AS name, strlen(html) AS size FROM pages) SELECT count(*) AS files, round(sum(size) / 1048576, 1) AS mb, array_to_string(list_slice(list_sort(list(name)), 1, 20), ',') AS first_names FROM f WHERE regexp_matches(name, '^[0-9]{13}_')",
    "diferencias_l_r": f"SELECT o_orderkey AS key, CASE WHEN o_orderpriority <> '1-URGENT' THEN round(o_totalprice - coalesce(k, 0), 2) END AS diff_l, CASE WHEN o_orderpriority = '1-URGENT' THEN 'USD' END AS note_l, round(o_totalprice - coalesce(q, 0), 2) AS diff_r FROM orders LEFT JOIN {_SUMS} ON l_orderkey = o_orderkey",
    "fila_total": f"SELECT o_orderpriority AS sheet, round(sum(o_totalprice), 2) AS sum_g, round(sum(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE k END), 2) AS sum_k, round(sum(q), 2) AS sum_q, CAST(grouping(o_orderpriority) AS INTEGER) AS all_sheets FROM orders LEFT JOIN {_SUMS} ON l_orderkey = o_orderkey GROUP BY ROLLUP (o_orderpriority)",
    "diferencias_lote": "SELECT c_custkey AS batch, round(coalesce(g, 0) - c_acctbal, 2) AS difference FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS g FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "filas_asignadas": "SELECT o_custkey, o_orderkey, CAST(5 + coalesce(sum(greatest(coalesce(n, 0), 1)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_start FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
    "grupos_combinados": "WITH a AS (SELECT *, CASE WHEN o_orderstatus IS NOT DISTINCT FROM lag(o_orderstatus) OVER w THEN 0 ELSE 1 END AS x FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), b AS (SELECT *, CAST(sum(x) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS run FROM a) SELECT o_custkey, run, o_orderstatus, count(*) AS rows, min(o_orderkey) AS first_key FROM b GROUP BY 1, 2, 3",
    "resumen_exportacion": "SELECT l_orderkey, count(*) AS invoices, count(*) FILTER (l_returnflag <> 'N') > 0 AS validated, round(coalesce(sum(l_extendedprice) FILTER (l_returnflag <> 'N'), 0), 2) AS sum_k FROM lineitem GROUP BY 1",
    "avisos_lote": "WITH b AS (SELECT c_custkey AS batch, c_custkey % 25 AS declared, c_acctbal AS total, c_nationkey, n, g FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS g FROM orders GROUP BY 1) ON o_custkey = c_custkey) SELECT batch, 'cantidad' AS warning FROM b WHERE coalesce(n, 0) <> declared UNION ALL SELECT batch, 'suma' FROM b WHERE abs(coalesce(g, 0) - total) > 0.5 UNION ALL SELECT batch, 'titular' FROM b WHERE c_nationkey <= 2",
    "conteo_declarado": "SELECT c_custkey AS batch, coalesce(CASE WHEN c_custkey % 4 = 0 THEN c_custkey END, n, 0) AS records FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "columna_j": "SELECT l_orderkey, o_orderpriority || ' / ' || o_orderstatus AS mail, count(*) AS rows FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2",
    "cuentas": "SELECT lower(c_name) AS usuario, c_acctbal > 0 AS activo, c_mktsegment = 'BUILDING' AS admin FROM customer",
    "ultimo_por_nombre": "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS name, max(page_id) AS page_id, count(*) AS versions FROM pages GROUP BY 1",
}

QUERIES = {k: globals()[k] for k in SQL}
