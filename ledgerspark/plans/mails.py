"""Approval mails written from the orders, two or three a payment; the SQL knows what they approve.

The first mail of a payment is one of eight kinds: an act under its request with orders in the subject; a request beside a mention; an act without an
author; a balance; a list of two parties; amounts in words; an act under a table's head; an act beside an invoice and a quantity. The second is a copy
of the first, two more acts, or nothing. Some payments have a third that can't approve: of another category, or without a text.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators.documents import mail_orders
from ..sources.shared import kept
from ..sources.tables import spread, table

c = F.col
ONE, TWO = "HILOS DEL PACIFICO LTDA", "TUBOS Y CODOS SAS"
PAYEES = {4: "HILOS PACIFICO SAS", 12: "OTRA COSA LTDA"}


def _mails(spark, d):
    """payment, payee, doc, category, needs_ocr and text of all documents."""
    k = c("o_orderkey")
    n = (k + 100_000).cast("string")
    value = F.concat(F.lit("$ "), F.substring(n, 1, 3), F.lit("."), F.substring(n, 4, 3), F.lit(".000"))
    way = lambda m, *xs: F.get(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs]), (k % m).cast("int"))
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    fra = lambda base: (k + base).cast("string")
    one = way(
        8,
        text("Desde: Ana Ruiz <ana@x.co>\nEnviado: 4 Sep 2026 10:15\nAsunto: RE: APROBACION OC ", F.concat(F.lit("2026"), F.lpad(k.cast("string"), 8, "0")), "\nsu aprobación a la FRA ", fra(700_000), " por ", value, "\nAprobada por ", value),
        text("Desde: Ana Ruiz\nsolicito su visto bueno por ", value, "\npresupuesto $ 55.000.000"),
        text("Aprobada por ", value),
        text("saldo de ", value),
        text("Desde: Ana Ruiz\nFecha Mar 01/09/2026\nAprobadas:\n", ONE, "\nToner negro\nFRA ", fra(700_000), " valor ", value, "\n", TWO, "\nFRA ", fra(800_000), " valor $ 1.500.000"),
        text("Desde: Luis Paz\nAprobado por 150 mil pesos\nAprobado por 3 millones de pesos"),
        text("Desde: Ana Ruiz\nCANTIDAD VALOR TOTAL\nAprobada por ", value, "\nTelefono 6.051.234"),
        text("Desde: Ana Ruiz\nAdjunto FRA ", fra(600_000), "\nAprobada por ", value, "\ncantidad 5.000 und"),
    )
    two = way(3, one, "Desde: Luis Paz\nAprobado por $ 20.000.000\nAprobado por $ 30.000.000", "gracias")
    mail = lambda part, category, ocr, x: F.struct(F.lit(part).alias("part"), F.lit(category).alias("category"), F.lit(ocr).alias("needs_ocr"), (F.lit(x) if isinstance(x, str) else x).alias("text"))
    third = F.when(k % 10 == 0, mail("c", "factura", False, "Aprobada por $ 77.000.000")).when(k % 10 == 5, mail("c", "correo", True, "Aprobada por $ 78.000.000"))
    # every seventh payment of one kind has no mail that can be read
    hidden = (k % 8 == 3) & (k % 7 == 0)
    mails = F.array_compact(F.array(F.when(~hidden, mail("a", "correo", False, one)), F.when(~hidden, mail("b", "otro", False, two)), third))
    payee = F.coalesce(*[F.when(k % 16 == m, p) for m, p in PAYEES.items()], F.lit(""))
    return spread(table(spark, d, "orders").select(k)).select(k.alias("payment"), payee.alias("payee"), F.explode(mails).alias("m")).select("payment", "payee", F.concat(c("payment").cast("string"), c("m.part")).alias("doc"), "m.category", "m.needs_ocr", "m.text")


def _lines(mails):
    more = [c for c in ("orders",) if c in mails.columns]
    return mails.select("payment", "payee", "doc", *more, F.lit(1).alias("page"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _candidates(spark, d):
    """Mails, and the candidates that count, with payment, payee, invoice and orders."""
    mails = C.approval_mails(_mails(spark, d))
    return mails, C.with_invoices(C.listed(C.candidates(_lines(mails.withColumn("orders", mail_orders(c("text")))))))


def resumen_correos(spark, d):
    """The mails below the mail program's name and a blank line."""
    mails = _lines(C.approval_mails(_mails(spark, d)))
    above = mails.where("line_no = 0").select("payment", "payee", "doc", "page", F.posexplode(F.array(F.lit("Outlook"), F.lit(" "))).alias("line_no", "line")).withColumn("line_no", c("line_no") - 2)
    lines = mails.unionByName(above)
    return C.summaries(lines, C.candidates(lines)).select("doc", "subject", F.array_join("invoices", ",").alias("invoices"), F.array_join("orders", ",").alias("orders"), "suggested", "shown", "dropped")


def candidatos_correo(spark, d):
    """All candidates of the first mails with what stands around them."""
    return C.candidates(_lines(_mails(spark, d)).where("doc LIKE '%a'")).select("doc", "rank", "value", "kind", "line", "currency", F.coalesce("author", F.lit("")).alias("author"), F.coalesce("date", F.lit("")).alias("date"), F.coalesce("header", F.lit("")).alias("header"), F.coalesce("party", F.lit("")).alias("party"), F.array_join("invoices", ",").alias("invoices"))


def clasificar_linea(spark, d):
    """What the lines of the first mails do."""
    return _lines(_mails(spark, d)).where("doc LIKE '%a'").select("doc", "line_no", C.class_of(c("line")).alias("kind"))


def ordenes_correo(spark, d):
    """Orders that a mail names: those of its subject, else those of its body."""
    k = c("o_orderkey")
    order = F.concat(F.lit("2026"), F.lpad(k.cast("string"), 6, "0"))
    body = F.concat(F.lit("Buenas\nORDENES DE COMPRA No. "), order, F.lit("1\nO.C. "), order, F.lit("2 y o.c "), order, F.lit("1\nfactura "), order)
    text = F.when(k % 3 == 0, F.concat(F.lit("Asunto: RE: aprobación OC "), order, F.lit(" || ASEO\n"), body)).when(k % 3 == 1, body).otherwise(F.concat(F.lit("Asunto: saldo\nDoc "), order))
    return table(spark, d, "orders").select(k.alias("doc"), F.array_join(mail_orders(text), ",").alias("orders"))


def puntaje_renglones(spark, d):
    """Scores of a customer's amounts: each line says one word of approval and one of noise, and the lines around it count by half."""
    k = c("o_orderkey")
    n = (k + 100_000).cast("string")
    word = lambda words: F.get(F.array(*map(F.lit, words)), (k % len(words)).cast("int"))
    line = F.concat(F.lit("Linea "), word(list(C.APPROVAL)), F.lit(" y "), word(list(C.NOISE)), F.lit(" por $ "), F.when(k % 3 == 0, F.concat(F.substring(n, 2, 2), F.lit(".000"))).otherwise(F.concat(F.substring(n, 1, 3), F.lit("."), F.substring(n, 4, 3))))
    rows = table(spark, d, "orders").select(c("o_custkey").alias("doc"), F.lit(1).alias("page"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("line_no"), line.alias("line"))
    return C.candidates(rows).select("doc", "line_no", "value", "score")


def veredicto(spark, d):
    """The verdict of each payment with approved amounts, whoever its payee is."""
    return C.verdict(C.chosen(_candidates(spark, d)[1]).select("payment", "doc", "rank", "value", "line", "kind", "author", "party"))


def decision_pagos(spark, d):
    payments = table(spark, d, "orders").select(c("o_orderkey").alias("payment"))
    mails, found = _candidates(spark, d)
    found = kept(found, "mail-candidates")  # choosing and what is left over read these rows several times
    picked = C.chosen(found)
    out = C.decisions(payments, picked, c("payee"), mails=mails, left=C.discarded(found, picked))
    said = F.array_join(F.transform("discarded", lambda x: F.concat(F.format_number(x["value"], 0), F.lit(" "), x["reason"])), " | ")
    return out.withColumns({"documents": F.array_join("documents", ","), "orders": F.array_join("orders", ","), "discarded": said})


def aprobados_con_factura(spark, d):
    return C.chosen(_candidates(spark, d)[1]).select("doc", "value", "kind", "invoice")


def descartados_con_motivo(spark, d):
    return C.unchosen(_candidates(spark, d)[1]).select("doc", "value", "kind", "reason")


_MAILS = """o AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS s, o_orderkey % 8 AS way, CASE WHEN o_orderkey % 8 = 3 AND o_orderkey % 7 = 0 THEN 9 ELSE o_orderkey % 3 END AS two, o_orderkey % 8 = 3 AND o_orderkey % 7 = 0 AS hidden, CAST(substr(CAST(o_orderkey + 100000 AS VARCHAR), 1, 6) AS DOUBLE) * 1000 AS v,
  '$ ' || substr(CAST(o_orderkey + 100000 AS VARCHAR), 1, 3) || '.' || substr(CAST(o_orderkey + 100000 AS VARCHAR), 4, 3) || '.000' AS t FROM orders),
 m AS (SELECT k, s || 'a' AS doc, way, v, t FROM o WHERE NOT hidden UNION ALL SELECT k, s || 'b', way, v, t FROM o WHERE two = 0)"""
_R = _MAILS + f""",
 r AS (SELECT k, doc, way, 1 AS seq, v, CASE WHEN way = 1 THEN 'solicitud' ELSE 'acto' END AS kind, CASE WHEN way = 2 THEN '' ELSE 'Ana Ruiz' END AS author, CASE WHEN way = 4 THEN '{ONE}' ELSE '' END AS party, CASE way WHEN 0 THEN CAST(k + 700000 AS VARCHAR) WHEN 4 THEN CAST(k + 700000 AS VARCHAR) WHEN 7 THEN CAST(k + 600000 AS VARCHAR) ELSE '' END AS invoice FROM m WHERE way NOT IN (3, 5)
  UNION ALL SELECT k, doc, way, 2, 1500000.0, 'acto', 'Ana Ruiz', '{TWO}', CAST(k + 800000 AS VARCHAR) FROM m WHERE way = 4
  UNION ALL SELECT k, doc, way, x.seq, x.v, 'acto', 'Luis Paz', '', '' FROM m, (VALUES (1, 150000.0::DOUBLE), (2, 3000.0::DOUBLE)) x(seq, v) WHERE way = 5
  UNION ALL SELECT k, s || 'b', way, x.seq, x.v, 'acto', 'Luis Paz', '', '' FROM o, (VALUES (1, 30000000.0::DOUBLE), (2, 20000000.0::DOUBLE)) x(seq, v) WHERE two = 1)"""
#: Each approved amount once, with whether it stays for the payee.
_U = _R + f""",
 u AS (SELECT r.*, k % 16 = 4 AS theirs, k % 16 = 12 AS lost, CASE WHEN k % 16 = 4 THEN party = '{ONE}' ELSE true END AS stays FROM r QUALIFY row_number() OVER (PARTITION BY k, v, kind ORDER BY doc) = 1),
 g AS (SELECT k, sum(v) FILTER (stays) AS total, count(*) FILTER (stays) AS n, count(*) FILTER (stays AND kind = 'acto') AS acts, count(*) FILTER (stays AND author = '') AS bare, bool_or(lost AND party <> '') AS strange, string_agg(format('{{:,.2f}}', v), ' + ' ORDER BY doc, seq) FILTER (stays) AS parts,
  string_agg(format('{{:,.0f}}', v) || ' ' || doc || ': aprobado de otro proveedor (' || CASE WHEN party = '' THEN 'sin nombre' ELSE party END || '), no de {PAYEES[4]}', ' | ' ORDER BY doc DESC, seq DESC) FILTER (NOT stays) AS others FROM u GROUP BY k)"""
_ACTS, _ASKS = C.NOTES["media"], C.NOTES["baja"]
_LEFT = f"""SELECT k, doc, v AS value, 'informativo' AS kind, doc || ': {C.REASONS['informativo']}' AS reason FROM m WHERE way = 3 UNION ALL SELECT k, doc, 55000000.0, 'mencion', doc || ': {C.REASONS['mencion']}' FROM m WHERE way = 1"""
_ORDER = "'2026' || lpad(CAST(k AS VARCHAR), 8, '0')"
SQL = {
    "decision_pagos": f"""WITH {_U}, l AS ({_LEFT}), left_over AS (SELECT k, string_agg(format('{{:,.0f}}', value) || ' ' || reason, ' | ' ORDER BY doc, value) AS rest FROM l GROUP BY k),
 e AS (SELECT o.*, coalesce(total, 0) AS total, coalesce(n, 0) AS n, strange, parts, others, rest, CASE WHEN n IS NULL THEN 'none' WHEN acts = n AND bare = 0 THEN 'alta' WHEN acts > 0 THEN 'media' ELSE 'baja' END AS plain FROM o LEFT JOIN g USING (k) LEFT JOIN left_over USING (k))
 SELECT k AS payment, CAST(total AS DOUBLE) AS total, CAST(n AS BIGINT) AS lines, n > 1 AS split, CASE WHEN plain = 'none' OR strange THEN 'baja' ELSE plain END AS confidence,
 CASE WHEN n = 0 THEN '' ELSE array_to_string(list_filter([CASE WHEN way <> 3 THEN s || 'a' END, CASE WHEN two = 0 OR (two = 1 AND k % 16 <> 4) THEN s || 'b' END], lambda x: x IS NOT NULL), ',') END AS documents, CASE WHEN way = 0 THEN {_ORDER} ELSE '' END AS orders,
 CASE WHEN hidden THEN '{C.NO_MAILS}' WHEN n = 0 THEN '{C.NOTHING}' ELSE concat_ws(' ', CASE plain WHEN 'media' THEN '{_ACTS}' WHEN 'baja' THEN '{_ASKS}' END, CASE WHEN n > 1 THEN 'Pago repartido: ' || parts || '.' END,
  CASE WHEN strange THEN 'El correo aprueba facturas de {ONE}, {TWO} y ninguno coincide con el titular ({PAYEES[12]}): revisa cual corresponde.' END) END AS note, concat_ws(' | ', others, rest) AS discarded FROM e""",
    "veredicto": f"""WITH {_R}, u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY k, v, kind ORDER BY doc) = 1), g AS (SELECT k, sum(v) AS total, count(*) AS n, count(*) FILTER (kind = 'acto') AS acts, count(*) FILTER (author = '') AS bare FROM u GROUP BY k)
 SELECT k AS payment, CAST(total AS DOUBLE) AS total, n AS lines, n > 1 AS split, CASE WHEN acts = n AND bare = 0 THEN 'alta' WHEN acts > 0 THEN 'media' ELSE 'baja' END AS confidence FROM g""",
    "aprobados_con_factura": f"""WITH {_R} SELECT doc, v AS value, kind, invoice FROM r""",
    "descartados_con_motivo": f"""WITH {_MAILS}, l AS ({_LEFT}) SELECT doc, value, kind, reason FROM l""",
    "resumen_correos": f"""WITH {_MAILS}, x AS (SELECT * FROM m UNION ALL SELECT k, s || 'b', CASE two WHEN 1 THEN 20 ELSE 21 END, v, t FROM o WHERE two IN (1, 2))
 SELECT doc, CASE way WHEN 0 THEN 'Desde: Ana Ruiz <ana@x.co>' WHEN 2 THEN 'Aprobada por ' || t WHEN 3 THEN 'saldo de ' || t WHEN 5 THEN 'Desde: Luis Paz' WHEN 20 THEN 'Desde: Luis Paz' WHEN 21 THEN 'gracias' ELSE 'Desde: Ana Ruiz' END AS subject,
 CASE way WHEN 0 THEN CAST(k + 700000 AS VARCHAR) WHEN 4 THEN CAST(k + 700000 AS VARCHAR) || ',' || CAST(k + 800000 AS VARCHAR) WHEN 7 THEN CAST(k + 600000 AS VARCHAR) ELSE '' END AS invoices, CASE WHEN way = 0 THEN {_ORDER} ELSE '' END AS orders,
 CASE way WHEN 20 THEN 30000000.0 WHEN 21 THEN NULL WHEN 5 THEN 150000.0 ELSE v END AS suggested, CAST(CASE WHEN way IN (0, 1, 4, 5, 20) THEN 2 WHEN way = 21 THEN 0 ELSE 1 END AS BIGINT) AS shown, CAST(CASE WHEN way = 7 THEN 1 ELSE 0 END AS BIGINT) AS dropped FROM x""",
    "candidatos_correo": f"""WITH {_MAILS}, a AS (SELECT * FROM m WHERE doc LIKE '%a'), x AS (
  SELECT doc, 1 AS rank, v AS value, 'acto' AS kind, 'Aprobada por ' || t AS line, true AS currency, 'Ana Ruiz' AS author, CASE way WHEN 0 THEN '4 Sep 2026 10:15' ELSE '' END AS date, '' AS header, '' AS party, CASE way WHEN 0 THEN CAST(k + 700000 AS VARCHAR) WHEN 7 THEN CAST(k + 600000 AS VARCHAR) ELSE '' END AS invoices FROM a WHERE way IN (0, 6, 7)
  UNION ALL SELECT doc, 2, v, 'solicitud', 'su aprobación a la FRA ' || CAST(k + 700000 AS VARCHAR) || ' por ' || t, true, 'Ana Ruiz', '4 Sep 2026 10:15', '', '', CAST(k + 700000 AS VARCHAR) FROM a WHERE way = 0
  UNION ALL SELECT doc, 2, 5000.0, 'mencion', 'cantidad 5.000 und', false, 'Ana Ruiz', '', '', '', CAST(k + 600000 AS VARCHAR) FROM a WHERE way = 7
  UNION ALL SELECT doc, 1, v, 'solicitud', 'solicito su visto bueno por ' || t, true, 'Ana Ruiz', '', '', '', '' FROM a WHERE way = 1 UNION ALL SELECT doc, 2, 55000000.0, 'mencion', 'presupuesto $ 55.000.000', true, 'Ana Ruiz', '', '', '', '' FROM a WHERE way = 1
  UNION ALL SELECT doc, 1, v, 'acto', 'Aprobada por ' || t, true, '', '', '', '', '' FROM a WHERE way = 2 UNION ALL SELECT doc, 1, v, 'informativo', 'saldo de ' || t, true, '', '', '', '', '' FROM a WHERE way = 3
  UNION ALL SELECT doc, 1, v, 'acto', 'FRA ' || CAST(k + 700000 AS VARCHAR) || ' valor ' || t, true, 'Ana Ruiz', 'Mar 01/09/2026', 'Aprobadas:', '{ONE}', CAST(k + 700000 AS VARCHAR) FROM a WHERE way = 4
  UNION ALL SELECT doc, 2, 1500000.0, 'acto', 'FRA ' || CAST(k + 800000 AS VARCHAR) || ' valor $ 1.500.000', true, 'Ana Ruiz', 'Mar 01/09/2026', 'Aprobadas:', '{TWO}', CAST(k + 800000 AS VARCHAR) FROM a WHERE way = 4
  UNION ALL SELECT doc, 1, 150000.0, 'acto', 'Aprobado por 150 mil pesos', true, 'Luis Paz', '', '', '', '' FROM a WHERE way = 5 UNION ALL SELECT doc, 2, 3000.0, 'acto', 'Aprobado por 3 millones de pesos', true, 'Luis Paz', '', '', '', '' FROM a WHERE way = 5)
 SELECT * FROM x""",
    "puntaje_renglones": f"""WITH o AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line_no, CAST(o_orderkey + 100000 AS VARCHAR) AS n, o_orderkey AS k, {list(C.APPROVAL)}[o_orderkey % {len(C.APPROVAL)} + 1] AS a, {list(C.NOISE)}[o_orderkey % {len(C.NOISE)} + 1] AS b FROM orders),
 l AS (SELECT *, 'linea ' || a || ' y ' || b || ' por $ ' || CASE WHEN k % 3 = 0 THEN substr(n, 2, 2) || '.000' ELSE substr(n, 1, 3) || '.' || substr(n, 4, 3) END AS line, CASE WHEN k % 3 = 0 THEN CAST(substr(n, 2, 2) AS DOUBLE) * 1000 ELSE CAST(substr(n, 1, 6) AS DOUBLE) END AS value, b NOT IN ('telefono', 'phone', 'cra.', 'calle', 'km') AS usable FROM o),
 x AS (SELECT *, ' ' || coalesce(string_agg(line, ' ') FILTER (usable) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), '') || ' ' AS context FROM l),
 w(word, good, points) AS (VALUES {', '.join(f"('{k}', true, {v})" for k, v in C.APPROVAL.items())}, {', '.join(f"('{k}', false, {v})" for k, v in C.NOISE.items())}),
 s AS (SELECT doc, line_no, any_value(value) AS value, sum(CASE WHEN contains(' ' || line || ' ', ' ' || word || ' ') THEN points WHEN good AND contains(context, ' ' || word || ' ') THEN greatest(1, points // 2) ELSE 0 END) + 5 + CASE WHEN any_value(value) >= 100000 THEN 2 ELSE 0 END AS score FROM x, w WHERE usable GROUP BY doc, line_no)
 SELECT doc, CAST(line_no AS INTEGER) AS line_no, value, CAST(score AS INTEGER) AS score FROM s WHERE value >= 1000""",
    "clasificar_linea": f"""WITH {_MAILS}, a AS (SELECT doc, [['mencion', 'mencion', 'mencion', 'solicitud', 'acto'], ['mencion', 'solicitud', 'mencion'], ['acto'], ['informativo'], ['mencion', 'mencion', 'acto', 'mencion', 'mencion', 'mencion', 'mencion', 'mencion'], ['mencion', 'acto', 'acto'], ['mencion', 'mencion', 'acto', 'mencion'], ['mencion', 'mencion', 'acto', 'mencion']][way + 1] AS kinds FROM m WHERE doc LIKE '%a')
 SELECT doc, CAST(generate_subscripts(kinds, 1) - 1 AS INTEGER) AS line_no, unnest(kinds) AS kind FROM a""",
    "ordenes_correo": """SELECT o_orderkey AS doc, CASE o_orderkey % 3 WHEN 0 THEN n WHEN 1 THEN n || '1,' || n || '2' ELSE '' END AS orders FROM (SELECT o_orderkey, '2026' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS n FROM orders)""",
}

QUERIES = {k: globals()[k] for k in SQL}
