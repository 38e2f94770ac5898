"""Worked examples of the invoice number by evidence, of its hints, and of comments."""

from pyspark.sql import functions as F

from ledgerspark.operators import evidence as E


def read(spark, text, qr=None, expected=None, name=None):
    row = E.invoice_numbers(spark.createDataFrame([(1, text, qr, expected, name)], "doc long, text string, qr string, expected string, name string")).first()
    return row["number"], row["points"]


def test_rules(spark):
    assert read(spark, None) == ("", None) and read(spark, "") == ("", None)
    assert read(spark, "Factura Electronica De Venta No\n. FWS No. 5296") == ("FWS5296", 4)  # the bare "No. 5296" has no prefix: another candidate, with 3
    assert read(spark, "Remision No. 4040\nnada") == ("", None)  # another kind of number
    assert read(spark, "Invoice\nNo. 2026") == ("", None)  # a year
    assert read(spark, "x No. 12", qr="ÿÿ47-19") == ("47-19", None)
    assert read(spark, "pago A\nfactura 0071 del mes", expected="71")[0] == "71"


def test_ranges(spark):
    inside = "factura\nNo. ab-0050\nautorizada desde AB 10 al 90"
    assert read(spark, inside) == ("AB0050", 4 + 3 + 3)  # label over the line's end, bare number by the word, inside; a lower-case prefix isn't found by its range
    outside = "Factura No. AB 95\ndesde AB 10 al 90\nNo. 44"
    assert read(spark, outside)[0] == "AB95" and read(spark, outside)[1] == 7 - 3
    foreign = "Factura No. ZZ 50\ndesde AB 10 al 90 y desde CD 1 al 9"
    assert read(spark, foreign) == ("ZZ50", 7 - 2)


def test_name_hints(spark):
    names = ["Fra No MS 3906.pdf", "FRA FE14733 NORTE.pdf", "copia.pdf", None]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", E.name_hints(F.col("n")).alias("h")).orderBy("i").collect()
    assert [[tuple(x) for x in r["h"]] for r in rows] == [[("MS", "3906")], [("FE", "14733")], [], []]
