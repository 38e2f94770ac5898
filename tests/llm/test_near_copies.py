"""The exact near-copy join against brute force over all pairs of texts."""

import random

import corpus_pipeline
from ledgerspark.llm import near_copies


def variants(seed=2):
    r = random.Random(seed)
    texts = []
    for size in (3, 5, 9, 30, 60, 120, 400):
        base = [f"w{r.randint(0, 5000)}" for _ in range(size)]
        for _ in range(9):
            x = list(base)
            for _ in range(r.randint(0, max(1, size // 60))):
                x[r.randrange(len(x))] = f"v{r.randint(0, 9)}"
            texts.append(" ".join(x))
    passage = " ".join(f"p{i}" for i in range(40))
    return texts + [passage + " " + " ".join(f"u{r.randint(0, 9999)}" for _ in range(20)) for _ in range(12)]


def test_one_row_stays_of_each_component(spark):
    texts = variants() + [None, "", " \n"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "lone text without any id here"), (None, "lone text without any id here"), (5, texts[5])]
    sets = [near_copies.shingle_set(t, 5).tolist() for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both, either = len(set(a) & set(sets[j])), len(set(a) | set(sets[j]))
            if 5 * both >= 4 * either:
                pairs += rows[i][1] != rows[j][1]
                root[max(top(i), top(j))] = min(top(i), top(j))
    assert pairs > 20
    best = {}
    for i, (d, _) in enumerate(rows):
        best[top(i)] = min(best.get(top(i), (True, 0)), (d is None, d or 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted(best.values())
