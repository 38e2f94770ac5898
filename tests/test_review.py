"""Worked cases of locked accounts, of invoice reviews with missing facts, and of portal fields."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerspark.operators import access, candidates, portal, review

DOC = "doc long, text string, links array<string>, code string, code_seen boolean, name string, expected string, own_id string, third_id string, cited string"


def test_lockouts(spark):
    at = lambda s: dt.datetime(2026, 9, 4, 10) + dt.timedelta(seconds=s)
    rows = [(2**53 + 1, at(s), s, False) for s in (0, 1, 2, 3, 4, 5, 100, 303, 304, 305, 306, 307, 308)]  # locked at 4 until 304, so 5 to 303 don't count
    rows += [(None, at(s), s, False) for s in range(4)] + [(None, at(5), 5, True), (None, at(6), 6, None), (None, None, 7, False)]
    rows += [(3, at(0), s, s == 2) for s in range(8)]  # equal times: place orders them, and the success in between starts anew
    locks = access.lockouts(spark.createDataFrame(rows, "user_id long, at timestamp, place long, ok boolean")).selectExpr("user_id", "unix_timestamp(locked_at) - unix_timestamp(timestamp'2026-09-04 10:00:00') AS s", "unix_timestamp(until) - unix_timestamp(locked_at) AS span")
    assert sorted(map(tuple, locks.collect())) == [(3, 0, 300), (2**53 + 1, 4, 300), (2**53 + 1, 308, 300)]
    assert access.lockouts(spark.createDataFrame([], "user_id string, at timestamp, place long, ok boolean")).count() == 0


def reviewed(spark, *rows):
    return {r["doc"]: r.asDict() for r in review.review(spark.createDataFrame(list(rows), DOC)).collect()}


def test_review_of_what_is_missing(spark):
    key = "ab" * 48
    text = f"Factura No. FV 2295\nEmisor UNO NIT 860111222-3\nCliente DOS NIT 811222333\nse menciona 900.123.456\nCUDE={key}"
    got = reviewed(
        spark,
        (1, None, None, None, None, None, None, None, None, None),
        (2, text, [], None, True, "", "", "900123456", "860111222", "2296"),  # named buyer is another, though the own id is printed; the voucher is a digit off
        (3, "nada 9 0 0.123.456", None, f"NitFac: 860111222\nCUFE: {key.upper()}\nNumFac: FV7", None, None, None, "900123456", "860111222", "7"),
        (4, "solo texto", [f"https://x.example/catalogo-vpfe/q?k={key}"], None, None, None, None, "900123456", None, None),
    )
    assert (got[1]["m"], got[1]["n"], got[1]["issuer"], got[1]["failed"], got[1]["pending"]) == ("", "", "", ["cufe", "numero", "qr"], ["nit_cliente", "nit_tercero"])
    assert got[2]["failed"] == ["nit_cliente", "numero_egreso"] and got[2]["hash"] == key and got[2]["note"] == "el egreso dice 2296 y la factura dice FV2295"
    assert (got[3]["m"], got[3]["n"], got[3]["o"], got[3]["hash"]) == ("OK", "FV7", "860111222", key)
    assert got[4]["failed"] == ["numero"] and got[4]["pending"] == ["nit_cliente", "nit_tercero"] and got[4]["hash"] == key
    assert reviewed(spark) == {}


def test_portal_fields(spark):
    def line(doc, no, text, x0, y0):
        return doc, 1, no, text, float(x0), float(x0 + 80), float(y0), float(y0 + 10)

    rows = [
        line("a", 1, "Número de documento", 10, 10), line("a", 2, "12-09-2026", 10, 25), line("a", 3, "Número de documento:", 10, 100), line("a", 4, "FV 77", 110, 100), line("a", 5, "Nombre", 10, 200), line("a", 6, "UNO SAS", 10, 215),
        line("a", 7, "Estatus", 10, 300), line("a", 8, "Aprobado", 10, 315), line("a", 9, "Este documento no posee eventos registrados", 10, 900), line("a", 10, None, 10, 950), line("b", 1, "Version", 10, 10),
    ]
    got = {r["doc"]: r for r in portal.portal_fields(spark.createDataFrame(rows, "doc string, page int, line_no int, text string, x0 double, x1 double, y0 double, y1 double")).collect()}
    assert (got["a"]["number"], got["a"]["tax_id"], got["a"]["name"], got["a"]["statuses"], got["a"]["no_events"]) == ("FV 77", "", "UNO SAS", ["Aprobado"], True)
    assert (got["b"]["number"], got["b"]["statuses"], got["b"]["present"]) == ("", [], [])
    assert [r[0] for r in spark.createDataFrame([("Versi",), ("Vers",), ("RAZÓN SOCIAL:",), ("",), ("ALFA",)], "t string").select(portal.is_label(F.col("t"))).collect()] == [True, False, True, True, False]


def test_decisions(spark):
    picked = [
        (1, "b", 1, 10.0, "Aprobado 10", "acto", "Ana", "NORTE SAS"), (1, "a", 1, 10.0, "aprobado 10", "acto", "Ana", "NORTE SAS"),  # the same quotation in two mails counts once
        (2, "c", 1, 5.0, "x", "acto", "Ana", "ALFA DEL SUR LTDA"), (3, "d", 1, 7.0, "y", "solicitud", None, None),
    ]
    picked = spark.createDataFrame(picked, "payment long, doc string, rank int, value double, line string, kind string, author string, party string")
    payments = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "payment long")
    got = {r["payment"]: r for r in candidates.decisions(payments, picked, F.lit("NORTE SAS")).collect()}
    assert (got[1]["total"], got[1]["confidence"], got[1]["documents"], got[1]["note"]) == (10.0, "alta", ["a", "b"], "")
    assert (got[2]["total"], got[2]["confidence"], got[2]["note"]) == (5.0, "baja", "El correo aprueba facturas de ALFA DEL SUR LTDA y ninguno coincide con el titular (NORTE SAS): revisa cual corresponde.")
    assert (got[3]["confidence"], got[3]["note"]) == ("baja", candidates.NOTES["baja"])
    assert (got[4]["total"], got[4]["lines"], got[4]["split"], got[4]["documents"], got[4]["note"]) == (0.0, 0, False, [], candidates.NOTHING)
    scores = spark.createDataFrame([(i, 41 - i, float(i)) for i in range(1, 43)], "rank int, score int, value double")
    assert sorted(r["rank"] for r in candidates.listed(scores).collect()) == list(range(1, 41))
