"""Queries over texts: folding, numbers, identifiers, lines, windows; each runs over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import matching as M
from ..sources.tables import table

NAMES = [("INFOSISCO S A S", "INFOSISCO SAS"), ("CAMARA DE COMERCIO DE BARRANQUILLA", "COOPERATIVA DE TRANSPORTADORES"), ("ACEROS DEL NORTE LTDA", "ACEROS NORTE"), ("", "X"), ("GRUPO SAS", "GRUPO SAS")]
AMOUNTS = ["1.920", "1,920.00", "1.920,00", "3,271,845", "2.871.845,00", "1,452,300.00", "4.118.250", "15", "15.00", "1.920.000", "COP $ 4.118.250,00", "1.347.288.00", "2.651.400 00", "1.452.00.00", "1,234,567.00", ".", ",", "", "abc", "12,5", "1,2,34", "7.5,", " 40.0 ", "100-200 3.000,50", "0,00"]


def _values(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _sql_values(rows, names):
    q = lambda v: "'" + v.replace("'", "''") + "'"
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    return "(VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + f") v({names})"


def _tokens(spark, d):
    found = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[0-9][0-9.,]*"), F.lit(0))).alias("raw"))
    return found.union(_values(spark, [(a,) for a in AMOUNTS], "raw string")).distinct()


def lectores_numero(spark, d):
    r = F.col("raw")
    return _tokens(spark, d).select("raw", N.mixed(r).alias("n1"), N.simple(r).alias("n4"), N.receipt_quantity(r).alias("n5"), N.portal_amount(r).alias("n6"), N.portal_shape(r).alias("n6_shape"), N.form_quantity(r).alias("n7"))


def plegar_tildes(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(X.fold(t)).alias("folded"), F.md5(X.compact(t)).alias("compact"), F.md5(X.normalise(t)).alias("normal"), F.md5(X.tolerant(t)).alias("tolerant"), F.length(X.digits(t)).alias("n_digits"))


def mismo_nombre(spark, d):
    """All pairs of a supplier and a customer of one nation, and the pairs of names above: whether they share their telling words."""
    s = table(spark, d, "supplier").select(F.col("s_name").alias("a"), F.col("s_nationkey").alias("n"))
    c = table(spark, d, "customer").select(F.col("c_name").alias("b"), F.col("c_nationkey").alias("n"))
    known = _values(spark, NAMES, "a string, b string")
    return M.party_verdicts(s, c, "n").unionByName(known.select("a", "b", X.same_party(F.col("a"), F.col("b")).alias("same")))


def _lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def lineas_documento(spark, d):
    return _lines(spark, d).select("doc_id", "line_no", F.md5("line").alias("hash"), F.length("line").alias("n_chars"))


def contexto_ventana(spark, d):
    """Each line with two lines around it, blank and signature-like lines left out."""
    ok = (F.trim("line") != "") & ~F.lower("line").rlike(r"phone|www\.|http|@[a-z0-9_]+\.[a-z0-9_]+")
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(-2, 2)
    context = F.array_join(F.collect_list(F.when(ok, F.trim("line"))).over(w), " ")
    return _lines(spark, d).select("doc_id", "line_no", F.md5(context).alias("context"))


def autor_de_linea(spark, d):
    """Who spoke last before or at each turn: the as-of header of a line."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    author = F.when(F.col("role") == "user", F.concat(F.lit("u"), F.col("turn").cast("string")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.last(author, ignorenulls=True).over(w).alias("author"))


def paginas_repetidas(spark, d):
    """Lines of a document that equal an earlier one, as repeated pages are found by signature."""
    w = Window.partitionBy("doc_id", "hash").orderBy("line_no")
    return lineas_documento(spark, d).withColumn("r", F.row_number().over(w)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("r") > 1).alias("repeated"))


WEIGHTS = {"the": 12, "that": 7, "de": 5, "is": 4, "und": 3, "la": -6, "los": -8, "of": -4}


def puntaje_claves(spark, d):
    """Weighted whole-word keys in the line, or at half weight in its context.

    A key is one word, so it is in the context if it is in one of the context's lines: lines are scanned once, into a bit for each
    key, and the bits are joined over the window.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(-2, 2)
    line = F.lower("line")
    hit = lambda k: F.contains(line, F.lit(k)) & line.rlike(rf"(^|[^0-9A-Za-z_]){k}([^0-9A-Za-z_]|$)")
    bits = sum((F.when(hit(k), 1 << i).otherwise(0) for i, k in enumerate(WEIGHTS)), F.lit(0))
    rows = _lines(spark, d).select("doc_id", "line_no", bits.alias("own")).withColumn("near", F.bit_or("own").over(w))
    has = lambda col, i: F.col(col).bitwiseAND(1 << i) != 0
    score = sum((F.when(has("own", i), v).when(has("near", i), max(1, v // 2) if v > 0 else 0).otherwise(0) for i, v in enumerate(WEIGHTS.values())), F.lit(0))
    return rows.groupBy("doc_id").agg(F.sum(score).alias("score"), F.max(score).alias("best"))


def ip_y_telefonos(spark, d):
    """Number-like runs of texts by shape: what an amount reader must refuse."""
    runs = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9][0-9.,:/-]*[0-9]"), F.lit(0))).alias("raw"))
    return runs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("raw").rlike(r"^[0-9]{1,3}([.,][0-9]{3})+([.,][0-9]{1,2})?$")).alias("grouped"), F.count_if(F.col("raw").rlike(r"^[0-9]+(\.[0-9]+){3}$")).alias("addresses"), F.count_if(F.col("raw").rlike(r"^[0-9]+(-[0-9]+)+$")).alias("dashed"))


_N4 = "regexp_replace(trim(raw), '[.,]+$', '')"
SQL = {
    "lectores_numero": rf"""WITH t AS (SELECT DISTINCT raw FROM (SELECT unnest(regexp_extract_all(text, '[0-9][0-9.,]*')) AS raw FROM documents UNION ALL SELECT raw FROM {_sql_values(AMOUNTS, 'raw')})),
 a AS (SELECT raw, trim(raw) AS t, {_N4} AS s, regexp_extract_all(replace(regexp_replace(raw, '([0-9]{{1,3}}(?:\.[0-9]{{3}})+)\s+([0-9]{{2}})($|[^0-9])', '\1,\2\3', 'g'), ' ', ''), '[0-9][0-9.,]*') AS c, regexp_extract(replace(raw, ' ', ''), '[0-9][0-9.,]*') AS f FROM t),
 b AS (SELECT *, list_sort(list_transform(c, lambda x, i: {{'d': -len(regexp_replace(x, '[.,]', '', 'g')), 'i': i, 'x': x}}))[1].x AS g FROM a)
SELECT raw,
 CASE WHEN regexp_matches(t, '^[0-9.,]+$') THEN TRY_CAST(CASE WHEN regexp_matches(t, '[.,][0-9]{{1,2}}$') THEN regexp_replace(regexp_extract(t, '^(.*)[.,][0-9]*$', 1), '[.,]', '', 'g') || '.' || regexp_extract(t, '([0-9]*)$', 1) ELSE regexp_replace(t, '[.,]', '', 'g') END AS DOUBLE) END AS n1,
 CASE WHEN regexp_matches(s, '^[0-9.,]+$') THEN TRY_CAST(CASE WHEN contains(s, ',') AND contains(s, '.') THEN CASE WHEN strpos(reverse(s), ',') < strpos(reverse(s), '.') THEN replace(replace(s, '.', ''), ',', '.') ELSE replace(s, ',', '') END WHEN contains(s, ',') THEN replace(s, ',', CASE WHEN length(string_split(s, ',')[-1]) IN (1, 2) THEN '.' ELSE '' END) ELSE s END AS DOUBLE) END AS n4,
 CASE WHEN regexp_matches(s, '^[0-9.,]+$') THEN TRY_CAST(CASE WHEN contains(s, ',') AND contains(s, '.') THEN replace(s, ',', '') WHEN contains(s, ',') THEN replace(s, ',', CASE WHEN length(string_split(s, ',')[-1]) = 2 THEN '.' ELSE '' END) ELSE s END AS DOUBLE) END AS n5,
 TRY_CAST(CASE WHEN contains(g, ',') THEN replace(replace(g, '.', ''), ',', '.') WHEN len(string_split(g, '.')) > 1 AND length(string_split(g, '.')[-1]) = 2 THEN replace(left(g, length(g) - 3), '.', '') || '.' || right(g, 2) ELSE replace(g, '.', '') END AS DOUBLE) AS n6,
 coalesce(regexp_matches(g, '^[0-9]{{1,3}}(\.[0-9]{{3}})*(,[0-9]{{1,2}})?$') OR regexp_matches(g, '^[0-9]{{1,3}}(\.[0-9]{{3}})*\.[0-9]{{2}}$') OR regexp_matches(g, '^[0-9]{{1,3}}(,[0-9]{{3}})*(\.[0-9]{{1,2}})?$') OR regexp_matches(g, '^[0-9]+$'), true) AS n6_shape,
 TRY_CAST(CASE WHEN contains(f, ',') AND contains(f, '.') THEN replace(replace(f, '.', ''), ',', '.') ELSE replace(f, ',', '.') END AS DOUBLE) AS n7
FROM b""",
    "plegar_tildes": r"SELECT doc_id, md5(f) AS folded, md5(regexp_replace(f, '[^a-z0-9]', '', 'g')) AS compact, md5(trim(regexp_replace(f, '\s+', ' ', 'g'), ' .:')) AS normal, md5(translate(f, 'l105', 'iios')) AS tolerant, CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS INTEGER) AS n_digits FROM (SELECT doc_id, text, strip_accents(lower(text)) AS f FROM documents)",
    "mismo_nombre": f"""WITH p AS (SELECT s_name AS a, c_name AS b FROM supplier JOIN customer ON s_nationkey = c_nationkey UNION ALL SELECT a, b FROM {_sql_values(NAMES, 'a, b')}),
 w AS (SELECT a, b, list_distinct(list_filter(string_split(regexp_replace(upper(strip_accents(a)), '[^A-Z0-9 ]', ' ', 'g'), ' '), lambda x: length(x) >= 3 AND NOT list_contains({X.GENERIC}, x))) AS x, list_distinct(list_filter(string_split(regexp_replace(upper(strip_accents(b)), '[^A-Z0-9 ]', ' ', 'g'), ' '), lambda x: length(x) >= 3 AND NOT list_contains({X.GENERIC}, x))) AS y FROM p)
SELECT a, b, len(x) > 0 AND len(y) > 0 AND len(list_intersect(x, y)) >= greatest(1, (least(len(x), len(y)) + 1) // 2) AS same FROM w""",
    "lineas_documento": "SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, md5(l[i]) AS hash, CAST(length(l[i]) AS INTEGER) AS n_chars FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(generate_series(1, len(l))) u(i)",
    "contexto_ventana": r"WITH l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(generate_series(1, len(l))) u(i)), o AS (SELECT doc_id, line_no, CASE WHEN trim(line) <> '' AND NOT regexp_matches(lower(line), 'phone|www\.|http|@[a-z0-9_]+\.[a-z0-9_]+') THEN trim(line) END AS line FROM l) SELECT doc_id, line_no, md5(coalesce(array_to_string(list_filter(list(line) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), lambda x: x IS NOT NULL), ' '), '')) AS context FROM o",
    "autor_de_linea": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN 'u' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS author FROM conversations",
    "paginas_repetidas": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS pages, count(*) - count(DISTINCT line) AS repeated FROM l GROUP BY 1",
    "puntaje_claves": "WITH l AS (SELECT doc_id, i, lower(l[i]) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(generate_series(1, len(l))) u(i)), c AS (SELECT doc_id, l, array_to_string(list(l) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), ' ') AS c FROM l), s AS (SELECT doc_id, " + " + ".join(f"CASE WHEN regexp_matches(l, '(^|[^0-9A-Za-z_]){k}([^0-9A-Za-z_]|$)') THEN {v} WHEN regexp_matches(c, '(^|[^0-9A-Za-z_]){k}([^0-9A-Za-z_]|$)') THEN {max(1, v // 2) if v > 0 else 0} ELSE 0 END" for k, v in WEIGHTS.items()) + " AS s FROM c) SELECT doc_id, CAST(sum(s) AS BIGINT) AS score, max(s) AS best FROM s GROUP BY 1",
    "ip_y_telefonos": r"WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9][0-9.,:/-]*[0-9]')) AS raw FROM documents) SELECT doc_id, count(*) AS runs, count(*) FILTER (regexp_matches(raw, '^[0-9]{1,3}([.,][0-9]{3})+([.,][0-9]{1,2})?$')) AS grouped, count(*) FILTER (regexp_matches(raw, '^[0-9]+(\.[0-9]+){3}$')) AS addresses, count(*) FILTER (regexp_matches(raw, '^[0-9]+(-[0-9]+)+$')) AS dashed FROM r GROUP BY 1",
}

QUERIES = {k: globals()[k] for k in SQL}
