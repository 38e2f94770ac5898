"""Search over the bisected index against scores of all documents, and the parts of the index."""

import collections
import math
import random
import re

import numpy as np

from ledgerspark.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def terms(t):
    return TERM.findall((t or "").translate(LOWER))


def brute(docs, items, top=50):
    tfs = [(i, collections.Counter(terms(t))) for i, t in docs]
    tfs = [(i, c) for i, c in tfs if c]
    n, total = len(tfs), sum(c.total() for _, c in tfs)
    df = collections.Counter(t for _, c in tfs for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, ts in asked.items():
        scored = []
        for doc, c in tfs:
            m = 50 + 50 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=repr)


def tables(seed=1, n=500):
    r = random.Random(seed)
    groups = [[f"{c}{i}" for i in range(40)] for c in ("a", "ñ", "x_y", "Q")]
    common = ["the", "of", "and", "ÉTÉ", "42"]
    docs = []
    for i in range(n):
        g = r.choice(groups)
        docs.append((i * 7 % 1009, " ".join(r.choice(common if r.random() < 0.5 else g) for _ in range(r.randint(1, 80)))))
    docs += [(5000, None), (5001, ""), (5002, "_ -- \n"), (None, docs[0][1]), (None, "the the"), docs[3], (5003, "the " * 30_000 + "rareword"), (5004, "x\x00y\x7fz")] + [(6000 + i, docs[9][1]) for i in range(60)]
    items = [(i, docs[i * 11][1][:120]) for i in range(20)] + [(20, None), (21, "nowhere"), (22, "the"), (None, "a1 of"), (0, "ñ3 rareword"), (23, "y"), (24, "rareword")]
    return docs, items


def test_against_scores_of_all(spark, monkeypatch):
    docs, items = tables()
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, shard int, term string").repartition(4)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, item int").repartition(3)
    want = brute(docs, items)
    index = ls.build_index(d, sample=200, shard=20)
    assert index.shards > 20 and index.documents == len([1 for _, t in docs if terms(t)])
    assert sorted((tuple(r) for r in ls.search(index, q).collect()), key=repr) == want
    monkeypatch.setattr(ls, "BROADCAST", 0)
    monkeypatch.setattr(ls, "ITEMS", 5)
    assert sorted((tuple(r) for r in ls.search(index, q, top=7).collect()), key=repr) == brute(docs, items, 7)


def test_rounds_stop_by_bound(spark, monkeypatch):
    """Documents of a topic share shards, so that a search for its words leaves most shards out."""
    r = random.Random(5)
    docs = [(i, " ".join(r.choice([f"t{i % 8}w{k}" for k in range(12)]) for _ in range(30))) for i in range(800)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(k, f"t{k}w0 t{k}w1 t{k}w2 t{k}w3") for k in range(8)], "item_id long, text string")
    index = ls.build_index(d, sample=800, levels=4, shard=50)
    real, seen = ls.visited, []
    monkeypatch.setattr(ls, "visited", lambda rows, held, visits, *a: seen.append(visits.count()) or real(rows, held, visits, *a))
    got = sorted((tuple(x) for x in ls.search(index, q, top=20).collect()), key=repr)
    assert got == brute(docs, [(k, f"t{k}w0 t{k}w1 t{k}w2 t{k}w3") for k in range(8)], 20)
    assert sum(seen) < 8 * index.shards / 2


def test_empty_tables(spark):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    assert ls.build_index(d.where("false")) is None
    assert ls.search(None, q).collect() == []
    assert ls.search(ls.build_index(d, sample=10), q.where("false")).collect() == []
    assert ls.search(ls.build_index(d, sample=10), q).columns == ["item_id", "rank", "doc_id", "score"]


def test_bisection_gathers_topics():
    r = random.Random(3)
    docs = [sorted({f"t{i % 4}w{r.randint(0, 30)}".encode() for _ in range(12)} | {b"the", b"of"}) for i in range(256)]
    tree = ls.bisected(docs, 2)
    leaves = collections.defaultdict(set)
    for i, d in enumerate(docs):
        leaves[i % 4].add(tree.leaf(d))
    assert all(len(x) == 1 for x in leaves.values()) and len({min(x) for x in leaves.values()}) == 4


def test_swaps_lower_the_cost():
    r = np.random.default_rng(1)
    owner = np.repeat(np.arange(64), 20)
    terms_ = np.where(owner % 2, r.integers(0, 30, len(owner)), r.integers(30, 60, len(owner)))
    cost = lambda left, right, a, b: ls.bits(left, a).sum() + ls.bits(right, b).sum()
    _, l0, r0 = ls.halves(terms_, owner, 64, swaps=0)
    side, l1, r1 = ls.halves(terms_, owner, 64)
    assert side.sum() == 32 and cost(l1, r1, 32, 32) < 0.8 * cost(l0, r0, 32, 32)


def test_terms():
    assert ls.terms_of("Ab1_c-É\x7fÉ\x00z q") == [x.encode() for x in terms("Ab1_c-É\x7fÉ\x00z q")]
