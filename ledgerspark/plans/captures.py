"""Captures of a bank's portal written from the orders: a customer's orders are a batch, four payments to a capture; the SQL knows what was written.

Each capture after the first repeats the last payment of the one before. Those of odd customers repeat the column titles, those of
even ones have none. Some batches have misread titles and labels, two pages to a capture, captures in reverse, an
unreadable one, a wrong total or a wrong number of payments; some payments lack a document or a readable amount, or have their name in the wrong column.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import capture_documents as R
from ..operators import captures as C
from ..sources.tables import spread, table

c = F.col
NAMES = ["Aceros del Rio", "Lopez y Ortega", "Hilos de la Sierra", "Ferretería Ñandú", "Vidrios O'Brien & Co"]
PLAIN_NAMES = ["Aceros Rio", "Lopez y Ortega", "Hilos Sierra", "Ferretería Ñandú", "Vidrios O'Brien Co"]
BREAK = 180.0
_WORDS = "array<struct<page: int, word_no: int, text: string, x0: double, x1: double, y0: double, y1: double>>"


def _box(text, x0, x1, y, when=None):
    """A word of a capture by its number. Captures that are cut have what stands below the break on a second page."""
    at = F.lit(float(y)) if isinstance(y, (int, float)) else y.cast("double")
    below = (c("b") % 7 == 3) & (c("cap") == 0) & (at >= BREAK)
    top = at - F.when(below, BREAK).otherwise(0.0)

    def word(word_no):
        made = F.struct(F.when(below, 2).otherwise(1).alias("page"), word_no.cast("int").alias("word_no"), (F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"), top.alias("y0"), (top + 10).alias("y1"))
        return made if when is None else F.when(when, made)

    return word


def _apart(text, x0, y, when):
    """A text as two boxes, the last word on its own."""
    first, last = text.rsplit(" ", 1)
    x1 = x0 + 6 * len(first)
    return [_box(first, x0, x1, y, when), _box(last, x1 + 4, x1 + 4 + 6 * len(last), y, when)]


def _money(x):
    return F.concat(F.lit("COP $ "), F.translate(F.format_number(x, 2), ",.", ".,"))


def _doc(cap):
    return F.concat(c("b").cast("string"), F.lit("-"), cap.cast("string"))


def _captures(spark, d):
    """batch, doc, arrival, name, words and heights of each capture. Orders come together by customer, as numbers; a capture's words are made where they are read."""
    own = Window.partitionBy("b")
    o = spread(table(spark, d, "orders").select(c("o_custkey").alias("b"), "o_orderkey", "o_totalprice"))
    o = o.withColumns({"r": F.row_number().over(own.orderBy("o_orderkey")), "n": F.count(F.lit(1)).over(own), "total": F.sum("o_totalprice").over(own)})
    place = lambda cap, pos: F.struct(cap.cast("int").alias("cap"), pos.cast("int").alias("pos"))
    places = F.array_compact(F.array(place((c("r") - 1) / 4, (c("r") - 1) % 4 + 1), F.when((c("r") % 4 == 0) & (c("r") < c("n")), place(c("r") / 4, F.lit(0)))))
    shown = o.withColumn("place", F.explode(places)).select("*", "place.*")
    o, b = c("o_orderkey"), c("b")
    odd_titles, odd_labels, single = b % 4 == 1, b % 5 == 2, b % 2 == 0
    titles = lambda y: [
        _box("#", 10, 18, y), _box("Tipo", 40, 60, y), _box("de", 64, 74, y), _box(F.when(odd_titles, "Dest1natario").otherwise("Destinatario"), 150, 230, y), _box("Número", 330, 360, y), _box("de", 364, 374, y),
        _box("Producto", 470, 510, y), _box(F.when(odd_titles, "Va1or").otherwise("Valor"), 640, 680, y), _box(F.when(odd_titles, "Referencla").otherwise("Referencia"), 800, 870, y),
        _box(F.when(odd_titles, "transacci0n").otherwise("Transacción"), 40, 110, y + 12), _box("documento", 330, 395, y + 12), _box("destino:", 514, 550, y + 12)]
    label = lambda good, bad, x, y: [_box(F.when(odd_labels, bad).otherwise(good), x, x + 6 * len(good), y, single), *_apart(good, x, y, ~single)]
    named = F.concat(F.lit("Pago "), b.cast("string"))
    date = F.concat((1 + b % 28).cast("string"), F.lit(" "), F.element_at(F.array(*map(F.lit, ["Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic"])), (b % 12 + 1).cast("int")), F.lit(" 2026"))
    head = [
        *label("Nombre del pago", "Nomb1e del pago", 20, 20), *label("Tipo de pago", "T1po de pago", 400, 20), _box("Cambiar", 250, 290, 35), _box("Editar", 900, 930, 35), _box(named, 20, 80, 50), _box("Pago a proveedores", 400, 500, 50),
        *label("Producto a debitar", "Producto a debltar", 20, 80), *label("Valor total del pago", "Valor tota1 de1 pago", 400, 80),
        _box(F.concat(F.lit("300 - "), F.lpad(b.cast("string"), 6, "0"), F.lit(" -14")), 20, 110, 95), _box("Cuenta corriente", 20, 110, 108), _box(_money(c("total") + F.when(b % 6 == 0, 1.0).otherwise(0.0)), 400, 500, 95),
        *label("Fecha de aplicación", "Fecha de apiicacion", 20, 140), *label("Cantidad de registros", "Cantidad de reglstros", 400, 140), _box(date, 20, 90, 155), _box(c("n").cast("string"), 400, 412, 155, c("n") >= 10),
        _box("Editar", 900, 930, 170), _box("Registros agregados", 20, 120, 185), *titles(200),
        _box(F.concat(F.lit("Mostrando 1-4 de "), (c("n") + F.when(b % 10 == 9, 1).otherwise(0)).cast("string"), F.lit(" pagos")), 20, 160, 500.0)]
    y = F.when(c("cap") == 0, 220).otherwise(60) + 40 * c("pos")
    name, amount = F.element_at(F.array(*map(F.lit, NAMES)), (o % 5 + 1).cast("int")), F.when(o % 13 == 0, "COP $ 1.78.00.00").otherwise(_money(c("o_totalprice")))
    moved, known = o % 19 == 0, o % 17 != 0
    dotted = F.concat(F.lit("900."), F.lpad(((o / 1000).cast("long") % 1000).cast("string"), 3, "0"), F.lit("."), F.lpad((o % 1000).cast("string"), 3, "0"))
    row = [
        _box("Abono a cuenta", 40, 120, y), _box(name, 150, 300, y, ~moved), _box(name, 40, 110, y + 13, moved), _box(dotted, 330, 400, y, known), _box(F.concat(F.lit("47 - "), F.lpad(o.cast("string"), 8, "0"), F.lit(" - 1")), 470, 560, y, known),
        _box("Cuenta de ahorro", 470, 540, y + 13, known), _box(amount, 620, 700, y), _box(F.concat(F.lit("F "), (o + 100000).cast("string"), F.lit(" "), (o + 200000).cast("string")), 800, 880, y)]
    listed = lambda words, base=F.lit(0): F.array_compact(F.array(*[w(base + k) for k, w in enumerate(words)]))
    paid = shown.groupBy("b", "cap").agg(F.sort_array(F.collect_list(F.struct("pos", listed(row, 1000 + 100 * c("pos")).alias("ws")))).alias("paid"), F.max("n").alias("n"), F.max("total").alias("total"))
    above = F.when(c("cap") == 0, listed(head)).when(b % 2 == 1, listed(titles(10)))
    whole = F.concat(F.coalesce(above, F.array().cast(_WORDS)), F.flatten(c("paid")["ws"]))
    cut = (b % 7 == 3) & (c("cap") == 0)  # these captures have two pages
    height = lambda page: F.struct(F.lit(page).alias("page"), F.lit(BREAK).alias("height"))
    none = F.array().cast("array<struct<page: int, height: double>>")
    real = paid.select(
        b.cast("string").alias("batch"), _doc(c("cap")).alias("doc"), F.when((b / 2).cast("int") % 3 == 0, 1000 - c("cap")).otherwise(c("cap")).alias("arrival"), F.concat(F.lit("captura "), (c("cap") + 1).cast("string")).alias("name"),
        whole.alias("words"), F.when(cut, F.array(height(1), height(2))).otherwise(none).alias("heights"))
    blank = table(spark, d, "customer").where("c_custkey % 11 = 0").select(c("c_custkey").alias("b"), F.lit(1).alias("cap"))
    return real.unionByName(blank.select(b.cast("string").alias("batch"), _doc(F.lit("x")).alias("doc"), F.lit(2000).alias("arrival"), F.lit("captura x").alias("name"), listed([_box("¿Necesitas ayuda?", 700, 780, 300)]).alias("words"), none.alias("heights")))


def _read(spark, d, **parts):
    return R.read_captures(_captures(spark, d), **parts)


def encabezado_lote(spark, d):
    """The head's fields as they are read, some under misread labels."""
    return _read(spark, d, rows=False).where("lines > 0 AND doc LIKE '%-0'").select("doc", *[c(f"head.{f}").alias(f) for f in ("payment_name", "payment_kind", "account", "total", "applied_on", "records")], "declared")


def columnas_portal(spark, d):
    """Columns of each capture with titles, from left to right."""
    return _read(spark, d, heads=False, rows=False).select("doc", F.posexplode("columns").alias("k", "c")).select("doc", (c("k") + 1).alias("column"), "c.field")


def filas_con_titulos(spark, d):
    return R.rows_of(_read(spark, d, heads=False, kinds=(True,)).where("titled"), "doc").where("row IS NOT NULL").select("doc", "row", "payee", "document", "account", "value", "kind", "reference")


def filas_sin_titulos(spark, d):
    return R.rows_of(_read(spark, d, heads=False, kinds=(False,)).where("NOT titled"), "doc").where("row IS NOT NULL").select("doc", "row", "payee", "document", "account", "value", "reference")


def lote_banco(spark, d):
    """Each batch with its head, number and sum of payments, and warnings."""
    return C.batch_summary(C.batch_rows(_read(spark, d))).withColumn("warnings", F.array_join("warnings", "\n"))


def lote_registros(spark, d):
    """Each payment of a batch once, with its number."""
    paid = C.batch_payments(C.batch_rows(_read(spark, d)))
    return paid.select("batch", "n", "payee", "payee_from_row", "document", "account", "account_text", "value", "reference", F.array_join("invoices", ",").alias("invoices"))


def titular_de_texto(spark, d):
    """Payees taken from a form's text around them, with either list of noise."""
    k = c("c_custkey")
    name = F.element_at(F.array(*map(F.lit, NAMES)), (k % 5 + 1).cast("int"))
    text = F.concat(F.when(k % 3 == 0, "e Abono a cuenta 900.123 ").otherwise("y "), name, F.when(k % 2 == 0, " Y S 12.500,00").otherwise(" COP$ y"), F.when(k % 7 == 0, " Banco").otherwise(""))
    return table(spark, d, "customer").select(k, X.payee_name(text).alias("payee"), X.payee_name(text, X.NAME_COLUMN_WORDS).alias("in_column"))


def campo_de_titulo(spark, d):
    """The field of each column title, one letter of some misread, and whether a text is a button of the screen."""
    k = c("p_partkey")
    said = F.array(*map(F.lit, ["#", "n", "tipo de documento", "numero de documento", "tipo de transaccion", "destinatario", "producto destino", "numero celular", "referencia", "valor", "estado", "otra columna"]))
    title = F.element_at(said, (k % 12 + 1).cast("int"))
    misread = F.when(k % 5 == 0, F.translate(title, "olis", "0115")).otherwise(title)
    shown = F.element_at(F.array(*map(F.lit, ["Cambiar", "¿Necesitas ayuda?", "AYUDA ?", "Cambiar cuenta", "necesitas", "ayudas"])), (k % 6 + 1).cast("int"))
    return table(spark, d, "part").select(k, X.column_field(misread).alias("field"), X.screen_noise(shown).alias("noise"))


def _list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_SHOWN = f"""WITH o AS (SELECT o_custkey AS b, o_orderkey AS o, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS total FROM orders),
shown AS (SELECT *, (r - 1) // 4 AS cap, (r - 1) % 4 + 1 AS pos FROM o UNION ALL SELECT *, r // 4, 0 FROM o WHERE r % 4 = 0 AND r < n),
rows AS (SELECT *, CAST(b AS VARCHAR) || '-' || CAST(cap AS VARCHAR) AS doc, row_number() OVER (PARTITION BY b, cap ORDER BY pos) AS row, {_list(NAMES)}[o % 5 + 1] AS name, {_list(PLAIN_NAMES)}[o % 5 + 1] AS plain, o % 19 = 0 AS moved, o % 17 <> 0 AS known, cap = 0 OR b % 2 = 1 AS titled,
 '900.' || lpad(CAST(o // 1000 % 1000 AS VARCHAR), 3, '0') || '.' || lpad(CAST(o % 1000 AS VARCHAR), 3, '0') AS dotted, '47 - ' || lpad(CAST(o AS VARCHAR), 8, '0') || ' - 1 Cuenta de ahorro' AS acc, CASE WHEN o % 13 = 0 THEN 'COP $ 1.78.00.00' ELSE 'COP $ ' || translate(format('{{:,.2f}}', price), ',.', '.,') END AS amount,
 'F ' || CAST(o + 100000 AS VARCHAR) || ' ' || CAST(o + 200000 AS VARCHAR) AS ref FROM shown)"""
_KEPT = _SHOWN + """,
placed AS (SELECT *, CASE WHEN cap = 0 THEN 0 WHEN b // 2 % 3 = 0 THEN 1000 - cap ELSE cap END AS place FROM rows),
once AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY b, r ORDER BY place, pos) = 1),
paid AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY place, pos) AS k, moved AND titled AS spare, CASE WHEN o % 13 <> 0 THEN round(price, 2) END AS value FROM once)"""
_TOTAL = "round(total, 2) + CASE WHEN b % 6 = 0 THEN 1 ELSE 0 END"

SQL = {
    "encabezado_lote": f"""WITH h AS (SELECT o_custkey AS b, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT CAST(b AS VARCHAR) || '-0' AS doc, 'Pago ' || CAST(b AS VARCHAR) AS payment_name, 'Pago a proveedores' AS payment_kind, '300 - ' || lpad(CAST(b AS VARCHAR), 6, '0') || ' -14 Cuenta corriente' AS account,
 'COP $ ' || translate(format('{{:,.2f}}', total + CASE WHEN b % 6 = 0 THEN 1 ELSE 0 END), ',.', '.,') AS total, CAST(1 + b % 28 AS VARCHAR) || ' ' || ['Ene', 'Feb', 'Mar', 'Abr', 'May', 'Jun', 'Jul', 'Ago', 'Sep', 'Oct', 'Nov', 'Dic'][b % 12 + 1] || ' 2026' AS applied_on,
 CASE WHEN n >= 10 THEN CAST(n AS VARCHAR) ELSE '' END AS records, n + CASE WHEN b % 10 = 9 THEN 1 ELSE 0 END AS declared FROM h""",
    "columnas_portal": _SHOWN + """ SELECT DISTINCT doc, CAST(i AS INTEGER) AS column, ['nro', 'kind', 'payee', 'document', 'account', 'value', 'reference'][i] AS field FROM rows, range(1, 8) t(i) WHERE titled""",
    "filas_con_titulos": _SHOWN + """ SELECT doc, CAST(row AS INTEGER) AS row, CASE WHEN moved THEN '' ELSE name END AS payee, CASE WHEN known THEN dotted ELSE '' END AS document, CASE WHEN known THEN acc ELSE '' END AS account, amount AS value, 'Abono a cuenta' || CASE WHEN moved THEN ' ' || name ELSE '' END AS kind, ref AS reference FROM rows WHERE titled""",
    "filas_sin_titulos": _SHOWN + """ SELECT doc, CAST(row AS INTEGER) AS row, replace(name, '& ', '') AS payee, CASE WHEN known THEN dotted ELSE '' END AS document, CASE WHEN known THEN acc ELSE '' END AS account, amount AS value, ref AS reference FROM rows WHERE NOT titled""",
    "lote_registros": _KEPT + """ SELECT CAST(b AS VARCHAR) AS batch, k AS n, CASE WHEN spare THEN plain WHEN titled THEN name ELSE replace(name, '& ', '') END AS payee, spare AS payee_from_row, CASE WHEN known THEN replace(dotted, '.', '') ELSE '' END AS document,
 CASE WHEN known THEN '47-' || lpad(CAST(o AS VARCHAR), 8, '0') || '-1' ELSE '' END AS account, CASE WHEN known THEN acc ELSE '' END AS account_text, value, ref AS reference, CAST(100000 + o AS VARCHAR) || ',' || CAST(200000 + o AS VARCHAR) AS invoices FROM paid""",
    "lote_banco": _KEPT + f""",
told AS (SELECT b, string_agg(w, chr(10) ORDER BY k, part) AS w FROM (
  SELECT b, k, 1 AS part, 'el destinatario del registro ' || k || ' se deduzco del texto de la fila: "' || plain || '"' AS w FROM paid WHERE spare
  UNION ALL SELECT b, k, 2, 'el valor del registro ' || k || ' no se pudo leer con seguridad: la celda dice "COP $ 1.78.00.00"; escribelo a mano' FROM paid WHERE value IS NULL
  UNION ALL SELECT b, k, 3, 'no se leyo el documento del registro ' || k FROM paid WHERE NOT known) GROUP BY b),
t AS (SELECT b, max(n) AS n, {_TOTAL.replace('total', 'max(total)')} AS total, count(*) AS payments, round(coalesce(sum(value), 0), 2) AS s, (max(n) - 1) // 4 + 1 AS caps, CASE WHEN max(n) >= 10 THEN max(n) ELSE max(n) + CASE WHEN b % 10 = 9 THEN 1 ELSE 0 END END AS records FROM paid GROUP BY b),
w AS (SELECT t.*, [CASE WHEN b % 11 = 0 THEN 'no se pudo leer captura x' END, CASE WHEN caps > 1 THEN CAST(caps - 1 AS VARCHAR) || ' fila(s) venian repetidas en dos capturas y se contaron una sola vez' END,
  CASE WHEN records <> payments THEN 'la pantalla declara ' || records || ' registros y se leyeron ' || payments || CASE WHEN caps = 1 AND b % 11 <> 0 THEN '; puede faltar una captura' ELSE '' END END,
  CASE WHEN abs(s - t.total) > 0.5 THEN 'los registros suman ' || format('{{:,.2f}}', s) || ' y el total del lote dice ' || format('{{:,.2f}}', t.total) END, told.w] AS ws FROM t LEFT JOIN told USING (b))
SELECT CAST(b AS VARCHAR) AS batch, 'Pago a proveedores' AS payment_kind, 'Pago ' || CAST(b AS VARCHAR) AS payment_name, '300-' || lpad(CAST(b AS VARCHAR), 6, '0') || '-14' AS account, '300 - ' || lpad(CAST(b AS VARCHAR), 6, '0') || ' -14 Cuenta corriente' AS account_text,
 round(total, 2) AS total, records, '2026-' || lpad(CAST(b % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + b % 28 AS VARCHAR), 2, '0') AS applied_on, caps AS captures, payments, s AS sum, array_to_string(list_filter(ws, lambda x: x IS NOT NULL), chr(10)) AS warnings, CAST(NULL AS VARCHAR) AS error FROM w
UNION ALL SELECT CAST(c_custkey AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, NULL, NULL, NULL, 'No se pudo leer ninguna de las imagenes' FROM customer WHERE c_custkey % 11 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)""",
    "titular_de_texto": f"""SELECT c_custkey, plain || CASE WHEN c_custkey % 2 = 1 THEN '' ELSE '' END AS payee, named || CASE WHEN c_custkey % 2 = 1 THEN ' COP' || CASE WHEN c_custkey % 7 = 0 THEN ' y Banco' ELSE '' END WHEN c_custkey % 7 = 0 THEN ' Y Banco' ELSE '' END AS in_column
 FROM (SELECT *, {_list(PLAIN_NAMES)}[c_custkey % 5 + 1] AS plain, replace({_list(NAMES)}[c_custkey % 5 + 1], '& ', '') AS named FROM customer)""",
    "campo_de_titulo": """SELECT p_partkey, ['nro', 'nro', 'document_kind', 'document', 'kind', 'payee', 'account', 'phone', 'reference', 'value', '', ''][p_partkey % 12 + 1] AS field, [true, true, true, false, true, false][p_partkey % 6 + 1] AS noise FROM part""",
}

QUERIES = {k: globals()[k] for k in SQL}
