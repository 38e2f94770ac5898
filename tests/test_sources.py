"""Readers, writers and streams on small inputs."""

import datetime as dt
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import access
from ledgerspark.sources import documents as D
from ledgerspark.sources import sheets, store
from ledgerspark.streaming import audit


def test_pages_and_errors(spark, tmp_path):
    (tmp_path / "a.txt").write_text("uno\f\ftres")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    rows = D.read_pages(spark, str(tmp_path), D.plain_text_reader, ocr=lambda p, c: ["x", "dos", "y"], pattern="*.txt").collect()
    good = sorted((r.page, r.text) for r in rows if r.error is None)
    assert good == [(1, "uno"), (2, "dos"), (3, "tres")] and [r.path[-5:] for r in rows if r.error] == ["b.txt"]


def test_saved_work(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"lotes": [{"hoja": "L1", "dueno": "ana", "registros": [{"nro": "1", "renglones": [{"factura": "F1"}, {"factura": "F2"}]}]}]}))
    t = D.read_work(spark, str(tmp_path / "w.json"))
    assert {k: v.count() for k, v in t.items()} == {"lotes": 1, "registros": 1, "renglones": 2} and [r.factura for r in t["renglones"].orderBy("orden").collect()] == ["F1", "F2"]


def test_cells_and_sheet_names(spark, tmp_path):
    names = {r.position: r.sheet for r in D.sheet_names(spark.createDataFrame([(1, "Pago: julio/2026"), (2, "Pago: julio/2026"), (3, "x" * 40)], "position int, name string")).collect()}
    assert names[1] == "Pago  julio 2026" and names[2] == "Pago  julio 2026 2" and len(names[3]) <= 31
    cells = spark.createDataFrame([("a", 1, 2, "v", None), ("b", 1, 1, None, "=1")], "sheet string, row int, col int, value string, formula string")
    D.write_cells(cells, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_lockouts_of_unordered_batches(spark, tmp_path):
    """Attempts in shuffled files, each a batch, give the locks of the whole table; the last files move the watermark on."""
    r = random.Random(3)
    at = lambda s: dt.datetime(2026, 1, 1, 10, 0, 0) + dt.timedelta(seconds=s)
    rows = [(u, at(s), s, r.random() < 0.12) for u in (1, 2, 3) for s in range(0, 500, 4)]
    schema = "user_id long, at timestamp, place long, ok boolean"
    whole = spark.createDataFrame(rows, schema)
    want = sorted((x.user_id, x.locked_at, x.until) for x in access.lockouts(whole).collect())
    late = r.sample(rows, len(rows))
    folder = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame(late[k::3], schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
    for k in range(2):  # nobody's attempts, much later
        spark.createDataFrame([(9, at(50_000 + k * 5000), 0, True)], schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
    old = spark.conf.get(audit.STATE_STORE[0])
    spark.conf.set(*audit.STATE_STORE)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        drain(audit.lockouts(stream, late="1 hour"), "locks")
    finally:
        spark.conf.set(audit.STATE_STORE[0], old)
    assert want and sorted((x.user_id, x.locked_at, x.until) for x in spark.table("locks").collect()) == want


def test_sheets_are_written_whole(spark, tmp_path):
    cells = spark.createDataFrame([("Uno/a", 1, 1, "x", None), ("Uno/a", 3, 2, "1,5", "=A1"), ("Dos", 2, 1, 'di"ce', None)], "sheet string, row int, col int, value string, formula string")
    out = str(tmp_path / "book")
    sheets.write_sheets(cells, out)
    assert {f: open(f"{out}/{f}").read() for f in os.listdir(out)} == {"Uno%2Fa.csv": "x\n\n,=A1\n", "Dos.csv": '\n"di""ce"\n'}
    bad = cells.where("sheet = 'Dos'").withColumn("row", F.when(F.col("row") == 2, F.raise_error(F.lit("torn")).cast("int")))
    with pytest.raises(Exception, match="torn"):
        sheets.write_sheets(cells.where("sheet <> 'Dos'").withColumn("sheet", F.lit("Tres")).unionByName(bad), out)
    assert sorted(os.listdir(out)) == ["Dos.csv", "Uno%2Fa.csv"]  # neither the failed sheet nor the good one, and nothing staged
    sheets.write_sheets(cells.where("sheet = 'Dos'").withColumn("sheet", F.lit("Tres")), out, mode="append")
    assert sorted(os.listdir(out)) == ["Dos.csv", "Tres.csv", "Uno%2Fa.csv"]


def test_other_owners_files_stay(spark, tmp_path):
    schema = "owner string, batch int, value string"
    path = str(tmp_path / "store")
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    store.write_owners(rows(("ana", 1, "a"), ("ana", 2, "b"), ("eva luz", 1, "c")), path, "owner")
    files = lambda who: {p.name: p.read_bytes() for p in (tmp_path / "store" / f"owner={who}").iterdir()}
    others = files("eva luz")
    store.write_owners(rows(("ana", 3, "z")), path, "owner")
    read = lambda: sorted((r.owner, r.batch, r.value) for r in spark.read.schema(schema).parquet(path).collect())
    assert read() == [("ana", 3, "z"), ("eva luz", 1, "c")] and files("eva luz") == others
    store.upsert_owners(spark, rows(("ana", 3, "y"), ("ana", 4, None), ("leo", 1, "n")), path, "owner", ["batch"])
    assert read() == [("ana", 3, "y"), ("ana", 4, None), ("eva luz", 1, "c"), ("leo", 1, "n")] and files("eva luz") == others
    assert store.delete_owner(spark, path, "owner", "leo") and not store.delete_owner(spark, path, "owner", "leo")
    assert read() == [("ana", 3, "y"), ("ana", 4, None), ("eva luz", 1, "c")] and files("eva luz") == others


def test_children_of_one_owner_are_replaced(spark, tmp_path):
    path = str(tmp_path / "children")
    schema = "owner string, batch int, position int, value string"
    store.write_owners(spark.createDataFrame([("ana", 1, 0, "a"), ("ana", 1, 1, "b"), ("ana", 2, 0, "c"), ("eva", 1, 0, "d")], schema), path, "owner")
    store.replace_children(spark, spark.createDataFrame([("ana", 1, ["x"]), ("leo", 5, ["y", "z"])], "owner string, batch int, items array<string>"), path, "owner", "batch", "items")
    got = sorted((r.owner, r.batch, r.position, r.value) for r in spark.read.schema(schema).parquet(path).collect())
    assert got == [("ana", 1, 0, "x"), ("ana", 2, 0, "c"), ("eva", 1, 0, "d"), ("leo", 5, 0, "y"), ("leo", 5, 1, "z")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_event_stream(spark):
    events = audit.event_stream(spark, "/root/testdata/sf0.001", pattern="events.parquet")
    drain(audit.windowed_counts(events), "days", "complete")
    assert spark.table("days").groupBy().sum("events").first()[0] == 1000
