"""The pipeline's stages on the smallest tables, each judged on its own input, and on an empty table."""

import collections
import os
import re

import pytest

import corpus_pipeline
from ledgerspark.llm.common import documents, written

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def kept(spark):
    out = [documents(spark, DATA)]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], DATA), "stage", keep=True))
    return out


def test_stages(kept):
    docs, good, lines, single, mixed, ids = [[r.asDict() for r in df.collect()] for df in kept]
    assert all(set(x[0]) == set(docs[0]) for x in (good, lines, single, mixed))
    texts = {r["doc_id"]: r["text"] for r in docs}
    assert len(docs) > len(good) and all(r["text"] == texts[r["doc_id"]] for r in good)
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) >= 20 for r in good)
    seen = collections.Counter(x for r in lines for x in r["text"].split("\n"))
    assert max(seen.values()) == 1 and {x for r in good for x in r["text"].split("\n")} >= set(seen)
    assert {r["doc_id"] for r in single} <= {r["doc_id"] for r in lines} and len({r["doc_id"] for r in single}) == len(single)
    times = collections.Counter(r["doc_id"] for r in mixed)
    assert max(times.values()) <= 3 and set(times) <= {r["doc_id"] for r in single}
    assert len(ids) == len(mixed) and all(r["round_trip"] and r["parity"] and len(r["ids"]) == r["n_tokens"] for r in ids)


def test_empty(spark):
    docs = documents(spark, DATA).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)  # a stage may read one that was not written
        assert docs.count() == 0


def test_odd_rows_through_all_stages(spark):
    """Nulls, blanks, a long text, ties, repeated rows, null ids and clashing names, together."""
    import random

    r = random.Random(4)
    good = [x["text"] for x in corpus_pipeline.keep_quality(spark, documents(spark, DATA), DATA).orderBy("doc_id").collect()]

    def shuffled(text):
        lines = [line.split(" ") for line in text.split("\n")]
        words = [w for line in lines for w in line]
        r.shuffle(words)
        return "\n".join(" ".join(words.pop() for _ in line) for line in lines)

    prose = shuffled(next(t for t in good if 200 < len(t.split()) < 500))
    long = "\n".join(shuffled(t) for t in good * 8)
    rows = [(900_001, None, "en", "s"), (900_002, "", None, None), (900_003, " \t\n", "en", "s"), (None, prose, "en", None), (None, None, None, None), (900_004, long, "en", "s"), (900_005, prose, "en", "s"), (900_005, prose, "en", "s"), (900_006, prose + " x", "fr", "t")]
    extra = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "CAST(length(text) AS LONG) AS n_chars")
    docs = documents(spark, DATA).unionByName(extra).selectExpr("*", "'a' AS _row", "'b' AS quality_kept", "'c' AS size", "1 AS _near")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], DATA), "stage", keep=True))
    ids = [[x["doc_id"] for x in df.select("doc_id").collect()] for df in out]
    assert not {900_001, 900_002, 900_003} & set(ids[1]) and all(set(b) <= set(a) for a, b in zip(ids, ids[1:]))
    assert all(set(docs.columns) == set(df.columns) for df in out[1:5])
    copies = [x for x in ids[3] if x is None or x >= 900_005]
    assert len([x for x in ids[1] if x is None or x >= 900_005]) == 4 and len(copies) == 1  # one row of the copies stays
    if 900_004 in ids[1]:
        kept = {x["doc_id"]: x["text"] for x in out[2].where("doc_id = 900004").collect()}
        assert len(kept[900_004].split("\n")) > 100
    assert out[5].where("NOT round_trip OR NOT parity").count() == 0


def test_tables_of_a_stage_go(spark):
    import os as files

    from ledgerspark.llm.common import _scratch, begin, release, shared_dir

    begin(spark)
    a, b = written(documents(spark, DATA).limit(3), "gone"), written(documents(spark, DATA).limit(2), "read")
    kept = written(documents(spark, DATA).limit(1), "kept", keep=True)
    release(spark, b)
    names = {f.split("-")[0] for f in files.listdir(shared_dir(spark))}
    assert {"read", "kept"} <= names and "gone" not in names and b.count() == 2 and kept.count() == 1 and not _scratch.paths and a.columns
