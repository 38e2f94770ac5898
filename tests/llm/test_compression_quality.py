"""The compression classifier: sizes against a plain loop, held-out accuracy, and odd inputs."""

import os
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from ledgerspark.llm import compression_quality as cq
from ledgerspark.llm import queries

DATA = "/root/testdata/sf0.01"


def table(spark, n=160, seed=5):
    r = random.Random(seed)
    good = ["river", "stone", "walks", "under", "the", "of", "a", "light", "evening", "slowly", "and"]
    rows, labels = [], []
    for i in range(n):
        y = int(i % 4 > 0)
        ws = [r.choice(good) + ("" if y else r.choice(["%%%", "$$$", "&&&"])) for _ in range(r.randint(20, 300))]
        rows.append((i, " ".join(ws), "x", "s", 0, "clash"))
        labels.append((i, y, 0))
    rows += [(1000, None, "x", "s", 0, "c"), (1001, "", "x", "s", 0, "c"), (None, "the river", None, None, 0, "c"), (1002, "%%% " * 60_000, "x", "s", 0, "c"), rows[0], (1003, "a퟿\U0001f600 of", "x", "s", 0, "c")]
    labels += [(0, 1, 0), (5, None, None), (None, 1, 1), (999, 0, 0), (6, 7, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, y int, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_sizes_are_those_of_a_plain_loop(spark):
    docs, labels = table(spark)
    model = cq.learn(docs, labels)
    assert isinstance(model, cq.Model)
    by = [zstandard.ZstdCompressor(level=cq.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    text = "the river of stone " * 900 + "ü"
    raw = text.encode()
    want = [sum(len(c.compress(raw[k:k + cq.BLOCK])) for k in range(0, len(raw), cq.BLOCK)) for c in by] + [len(raw)]
    assert cq.Sizer(model.good, model.bad).sizes([text, None, ""]).tolist() == [want, [0, 0, 0], [0, 0, 0]]


def test_scores_of_odd_rows(spark):
    docs, labels = table(spark)
    model = cq.learn(docs, labels, trainable=F.col("doc_id") % 5 != 0)
    got = cq.score(docs.repartition(4), model).collect()
    assert len(got) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(by[0]) == 1 and by[1000] == by[1001] and max(by[1002]) < 0.3
    held = [(i, i % 4 > 0) for i in range(160) if i % 5 == 0]
    assert np.mean([(min(by[i]) >= 0.3) == y for i, y in held]) > 0.95


def test_without_enough_to_learn_from(spark):
    docs, labels = table(spark, n=8)
    none = labels.where("false")
    assert cq.learn(docs, none) == 0.5
    assert cq.learn(docs, labels.where("quality = 1")) == 1.0
    assert {r["score"] for r in cq.score(docs, 0.5).collect()} == {0.5}
    assert cq.score(docs.where("false"), cq.learn(docs, labels)).count() == 0


def test_the_bounds_hold(spark):
    docs, labels = table(spark)
    assert cq.labelled(docs, labels, None, 10).groupBy("y").count().agg(F.max("count")).first()[0] <= 10


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    out = queries.op11_compression_quality(spark, DATA)
    assert out.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    told = out.where("held_out").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg("predicted").alias("p")).collect()
    share = {r["quality"]: r["p"] for r in told}
    assert share[1] > 0.97 and share[0] < 0.2
