"""Queries of the store's writes and lookups, and of the sheet's cells and comments, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources.tables import table

c = F.col


def documento_por_hash(spark, d):
    """All documents with the content of the first ones, by hash."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    return R.by_hash(docs, docs.where("doc_id = 0 OR doc_id = 1")).select("doc_id", "source", "hash")


def hijos_reescritos(spark, d):
    """Open orders send their prices anew, largest first; the lines of the others stay as they are stored."""
    price = R.money(c("l_extendedprice"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(price)).alias("items"))
    stored = lines.select("l_orderkey", F.posexplode("items").alias("position", "value"))
    open_ = table(spark, d, "orders").where("o_orderstatus = 'O'").select(c("o_orderkey").alias("l_orderkey"))
    incoming = lines.join(open_, "l_orderkey", "left_semi").withColumn("items", F.reverse("items"))
    return R.rewrite_children(stored, incoming, "l_orderkey", "items")


def texto_aliviado(spark, d):
    """Saved elements without the text of their receipt."""
    name = lambda x: F.coalesce(c(x), F.lit(""))
    receipt = F.struct(c("doc_id").alias("numero"), c("text").alias("texto"))
    items = F.array(F.struct(name("source").alias("nombre"), receipt.alias("entrada")), F.struct(name("lang").alias("nombre"), F.lit(None).cast("struct<numero:bigint,texto:string>").alias("entrada")))
    return table(spark, d, "documents").select("doc_id", F.to_json(R.without_text(items)).alias("saved"))


def trabajo_borrado(spark, d):
    """What each owner still has when one owner's work is deleted: batches, payments and their sum."""
    batches = table(spark, d, "customer").select(c("c_custkey").alias("batch"), F.lower("c_mktsegment").alias("owner"))
    payments = table(spark, d, "orders").select(c("o_custkey").alias("batch"), c("o_totalprice").alias("amount"))
    left, kept = R.delete_work(batches, payments, " BUILDING ")
    own = kept.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("g"))
    return left.join(own, "batch", "left").groupBy("owner").agg(F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum("n"), F.lit(0)).alias("payments"), R.money(F.coalesce(F.sum("g"), F.lit(0.0))).alias("amount"))


def conteos_cuentas(spark, d):
    """Whether there are accounts at all, how many, and how many administrators are active."""
    u = table(spark, d, "customer")
    return u.agg((F.count(F.lit(1)) == 0).alias("empty"), F.count(F.lit(1)).alias("accounts"), F.count_if((c("c_mktsegment") == "BUILDING") & (c("c_acctbal") > 0)).alias("active_admins"))


def documentos_egreso(spark, d):
    name = F.when(c("lang") == "en", F.concat(F.lit("G"), F.lpad(c("doc_id").cast("string"), 9, "0"), F.lit(".pdf"))).otherwise(F.concat(c("source"), F.lit(".pdf")))
    tax_id = F.concat((900_000_000 + c("n_chars") % 50).cast("string"), F.when(c("lang") == "en", "-3").otherwise(""))
    docs = table(spark, d, "documents").select("doc_id", name.alias("name"), F.when(c("source") == "src1", "egreso").otherwise("correo").alias("category"), tax_id.alias("tax_id"))
    return R.voucher_documents(docs, "900000007").select("doc_id", "name", "tax_id")


def celdas_factura(spark, d):
    """The sheet's invoice cell of each order with its note."""
    codes = lambda **k: F.array_compact(F.array(*[F.when(v, F.lit(n)) for n, v in k.items()]))
    ok = (c("l_discount") <= 0.07) & (c("l_tax") <= 0.06) & (c("l_returnflag") != "A")
    lines = table(spark, d, "lineitem").select(c("l_orderkey").alias("key"), (c("l_quantity") < 15).alias("has_file"), ok.alias("ok"), codes(numero=c("l_discount") > 0.07, qr=c("l_tax") > 0.06).alias("missing"), codes(qr=c("l_quantity") > 40, cufe=c("l_returnflag") == "A", radian=c("l_quantity") == 30).alias("pending"))
    return R.invoice_cells(lines)


def comentarios(spark, d):
    """The comment column of each order: notes and pending states of its lines."""
    note = lambda letter, when, text: F.struct(F.lit(letter).alias("letter"), F.when(when, text).alias("text"))
    state = lambda letter, flag: F.struct(F.lit(letter).alias("letter"), F.when(c("l_returnflag") == flag, "Pendiente").otherwise("OK").alias("state"))
    notes = F.array(note("K", c("l_discount") > 0.08, "descuento alto"), note("O", c("l_tax") > 0.07, " impuesto alto "), note("S", c("l_quantity") > 45, "cantidad alta"))
    rows = table(spark, d, "lineitem").select(c("l_orderkey").alias("key"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("position"), F.concat(F.lit("FV"), c("l_suppkey").cast("string")).alias("invoice"), notes.alias("notes"), F.array(state("S", "A"), state("T", "R")).alias("states"))
    heads = table(spark, d, "orders").select(c("o_orderkey").alias("key"), F.when(c("o_orderpriority") == "1-URGENT", "urgente").alias("reason"), F.when(c("o_orderstatus") == "P", "parcial").alias("note"))
    return R.comments(rows, heads)


_case = lambda words: "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items()) + " ELSE x END"
_some = lambda *codes: "list_filter([" + ", ".join(f"CASE WHEN {w} THEN '{n}' END" for n, w in codes) + "], lambda x: x IS NOT NULL)"
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
_NOTES = [("l_discount > 0.08", 10, "K: descuento alto"), ("l_tax > 0.07", 11, "O: impuesto alto"), ("l_quantity > 45", 12, "S: cantidad alta"), ("l_returnflag = 'A' AND l_quantity <= 45", 20, "S: pendiente"), ("l_returnflag = 'R'", 21, "T: pendiente")]

SQL = {
    "documento_por_hash": "SELECT doc_id, source, sha256(text) AS hash FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id = 0 OR doc_id = 1)",
    "hijos_reescritos": "SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN o_orderstatus = 'O' THEN -v ELSE v END) - 1 AS INTEGER) AS position, v AS value FROM (SELECT l_orderkey, round(l_extendedprice, 2) AS v FROM lineitem) LEFT JOIN orders ON o_orderkey = l_orderkey",
    "texto_aliviado": """SELECT doc_id, '[{"nombre":"' || coalesce(source, '') || '","entrada":{"numero":' || doc_id || '}},{"nombre":"' || coalesce(lang, '') || '"}]' AS saved FROM documents""",
    "trabajo_borrado": "SELECT lower(c_mktsegment) AS owner, count(*) AS batches, CAST(coalesce(sum(n), 0) AS BIGINT) AS payments, round(coalesce(sum(g), 0), 2) AS amount FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS g FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY 1",
    "conteos_cuentas": "SELECT count(*) = 0 AS empty, count(*) AS accounts, count(*) FILTER (c_mktsegment = 'BUILDING' AND c_acctbal > 0) AS active_admins FROM customer",
    "documentos_egreso": "WITH f AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'G' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.pdf' ELSE source || '.pdf' END AS name, source = 'src1' AS e, CAST(900000000 + n_chars % 50 AS VARCHAR) || CASE WHEN lang = 'en' THEN '-3' ELSE '' END AS tax_id FROM documents) SELECT doc_id, name, tax_id FROM f WHERE (e OR regexp_matches(lower(name), '^g[0-9]{6,}')) AND tax_id IN ('900000007', '900000007-3')",
    "celdas_factura": f"""WITH l AS (SELECT l_orderkey AS key, l_quantity < 15 AS f, l_discount <= 0.07 AND l_tax <= 0.06 AND l_returnflag <> 'A' AS ok, {_some(('numero', 'l_discount > 0.07'), ('qr', 'l_tax > 0.06'))} AS m, {_some(('qr', 'l_quantity > 40'), ('cufe', "l_returnflag = 'A'"), ('radian', 'l_quantity = 30'))} AS p FROM lineitem),
 g AS (SELECT key, bool_or(f OR len(m) > 0 OR len(p) > 0) AS seen, bool_and(ok) AS ok, list_sort(list_distinct(flatten(list(m)))) AS m, list_sort(list_distinct(flatten(list(p)))) AS p FROM l GROUP BY 1),
 h AS (SELECT key, ok, m, list_filter(p, lambda x: NOT list_contains(m, x)) AS p FROM g WHERE seen)
SELECT key, CASE WHEN ok THEN 'OK' ELSE 'Revisar' END AS cell, nullif(concat_ws(' · ', CASE WHEN len(m) > 0 THEN 'revisar: ' || array_to_string(list_transform(m, lambda x: {_case(R.FAILED)}), ', ') END, CASE WHEN len(p) > 0 THEN 'sin comprobar: ' || array_to_string(list_transform(p, lambda x: {_case(R.OPEN)}), ', ') END), '') AS note FROM h""",
    "comentarios": f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS pos, CASE WHEN count(*) OVER (PARTITION BY l_orderkey) > 1 THEN 'FV' || l_suppkey || ' · ' ELSE '' END AS pre FROM lineitem),
 n AS (SELECT o_orderkey AS key, 0 AS o, 'L: urgente' AS line FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, 1, 'M: parcial' FROM orders WHERE o_orderstatus = 'P' {' '.join(f"UNION ALL SELECT l_orderkey, pos * 100 + {i}, pre || '{t}' FROM l WHERE {w}" for w, i, t in _NOTES)}),
 d AS (SELECT key, line, min(o) AS o FROM n GROUP BY 1, 2) SELECT key, string_agg(line, chr(10) ORDER BY o) AS comment FROM d GROUP BY 1""",
}

QUERIES = {k: globals()[k] for k in SQL}
