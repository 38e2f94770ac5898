"""Fields of the e-invoice portal's pages, read from lines with places, and the check of its events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .checks import event_log
from .documents import events_shown
from .layout import value_beside

# The portal's labels without spaces; none of them is ever a value.
LABELS = [
    "razonsocial", "numerodeidentificacion", "versiondeldocumento", "tipodedocumento", "numerodedocumento", "fechadeemision", "totaldelafactura", "cufe", "casooradicado", "nombre",
    "fechaderecepcion", "estatusactual", "estatusdepago", "estatuslegal", "historialdecambios", "fechadelregistro", "creadopor", "estatus", "comentarios", "estadodocumento", "origenevento",
    "acciones", "validaciondian", "detalledeldocumento", "resumendeldocumento", "datosdeldocumento", "representacion", "adjuntos", "infodatos", "gestion", "enproduccion", "asignarestatus",
    "actualizarhistorial", "vereventos", "consultarenladian", "consultesu", "comprobante", "mostrandodesde", "documentoelectronico",
]
# What the label of a field contains.
FIELDS = {"number": ["numerodedocumento"], "tax_id": ["deidentificacion"], "name": ["razonsocial", "nombre"], "kind": ["tipodedocumento"], "filed": ["radicado"], "status": ["estatus"], "legal": ["estatuslegal"]}
NO_EVENTS = "no posee eventos registrados"


def is_label(text: Column) -> Column:
    """A blank line, one that holds a label of the portal, or a piece of a label of five characters or more."""
    c = X.compact(text)
    return (c == "") | c.rlike("|".join(LABELS)) | ((F.length(c) >= 5) & F.contains(F.lit("|".join(LABELS)), c))


def portal_fields(lines: DataFrame) -> DataFrame:
    """lines (doc, page, line_no, text, x0, x1, y0, y1) -> one row per document: its fields, its statuses, and whether it says that there are no events.

    Each label's value is the line beside it that is no label itself. In reading order (page, line_no) the number is the first value with a digit that
    is no date, has no comma and at most 20 characters; the id and the filing number the first with 7 and 4 digits; the name the first without
    digits; the legal status is that of its first label, be it blank. A field that isn't there is blank. Null texts count as blank lines.
    """
    rows = lines.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("squeezed", X.compact(F.col("text")))
    holds = lambda parts: F.col("squeezed").rlike("|".join(parts))
    names = F.array_compact(F.array(*[F.when(holds(parts), F.lit(f)) for f, parts in FIELDS.items()]))
    labels = rows.withColumn("fields", names).where(F.size("fields") > 0).withColumnRenamed("text", "label")
    beside = value_beside(rows.where(~is_label(F.col("text"))).withColumnRenamed("line_no", "word_no"), labels, by=("line_no", "fields"))
    spot, v = F.struct("page", "line_no"), F.trim("value")
    count = F.length(X.digits(F.col("value")))
    good = {
        "number": (count > 0) & ~v.rlike(r"^\d{2}-\d{2}-\d{4}$") & ~F.contains(v, F.lit(",")) & (F.length(v) <= 20), "tax_id": count >= 7, "name": (count == 0) & (v != ""), "kind": v != "", "filed": count >= 4,
    }
    first = [F.min_by(v, F.when(F.array_contains("fields", f) & test, spot)).alias(f) for f, test in good.items()]
    said = F.sort_array(F.collect_list(F.when(F.array_contains("fields", "status") & (v != "") & ~F.startswith(X.compact(v), F.lit("estatus")), F.struct("page", "line_no", v.alias("value")))))
    found = beside.groupBy("doc").agg(*first, F.transform(said, lambda s: s["value"]).alias("statuses"), F.sort_array(F.collect_list(F.when(F.array_contains("fields", "legal"), F.struct("page", "line_no", v.alias("value"))))).alias("legals"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("page", "line_no", "text"))), lambda l: l["text"])
    whole = rows.groupBy("doc").agg(F.array_join(ordered, " ").alias("text"), F.min(F.when(F.contains("squeezed", F.lit("estatuslegal")), spot)).alias("legal_at"))
    says = whole.select("doc", "legal_at", events_shown(F.col("text")).alias("present"), F.contains(X.fold(F.col("text")), F.lit(NO_EVENTS)).alias("no_events"))
    j = says.join(found, "doc", "left")
    legal = F.get(F.filter("legals", lambda l: (l["page"] == F.col("legal_at.page")) & (l["line_no"] == F.col("legal_at.line_no"))), 0)["value"]
    blank = lambda c: F.coalesce(c, F.lit(""))
    return j.select("doc", *[blank(F.col(f)).alias(f) for f in good], F.coalesce("statuses", F.array().cast("array<string>")).alias("statuses"), blank(legal).alias("legal"), "present", "no_events")


def portal_checks(fields: DataFrame, expected: DataFrame) -> DataFrame:
    """portal_fields rows and expected (doc, want_number, want_id) -> doc, number, tax_id, name, state, failed and the note of the state."""
    j = fields.join(expected, "doc", "left")
    state, bad = event_log(F.col("present"), F.col("number"), F.col("want_number"), F.col("tax_id"), F.col("want_id"))
    or_none = lambda c, none: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(none))
    notes = {
        "eventos": F.concat(F.lit("faltan "), F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, ["aceptacion", "acuse", "recibo"])), "present")), ", ")),
        "numero": F.concat(F.lit("RADIAN dice "), or_none("number", "sin número"), F.lit(" y la factura es "), or_none("want_number", "—")),
        "nit": F.concat(F.lit("RADIAN dice NIT "), or_none("tax_id", "sin NIT"), F.lit(" y el tercero es "), or_none("want_id", "—")),
    }
    note = F.array_join(F.array_compact(F.array(*[F.when(F.array_contains(bad, k), n) for k, n in notes.items()])), " · ")
    return j.select("doc", "number", "tax_id", "name", state.alias("state"), F.array_join(bad, ",").alias("failed"), note.alias("note"))
