"""Phrases by suffix sorting against a plain count of all n-grams."""

import collections
import random
import re

import pyarrow as pa
import numpy as np

from ledgerspark.llm import phrases

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows, max_n=4, least=30, keep=80, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for i in range(len(ws)):
                for k in range(1, max_n + 1):
                    if i + k <= len(ws):
                        f[lang][tuple(ws[i:i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= keep * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            s, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((s, a, " ".join(p), c[p[:k]], c[p[k:]]))
        rows.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, ph, a, l, r, n[lang], s) for i, (s, a, ph, l, r) in enumerate(rows[:top])]
    return sorted(out)


def texts(seed=1, n=300):
    r = random.Random(seed)
    vocab = ["the", "The", "of", "ñja", "x\x01y", "a", "a\x01", "É", "$$", "river", "stone", "(b)", "new", "york", "new york city"]
    weights = [30, 5, 20, 3, 2, 9, 2, 2, 1, 5, 5, 1, 6, 6, 9]
    line = lambda k: "".join(w + r.choice([" ", " ", " ", "\t ", ". ", "\n", ", ", "  "]) for w in r.choices(vocab, weights, k=k))
    rows = [(r.choice(["en", "en", "e n%", None, "und", "a\nb"]), line(r.randint(1, 60))) for _ in range(n)]
    return rows + [("en", None), ("en", ""), ("fr", " \t\n. "), ("en", "same line here " * 4000), ("en", "hot pair " + " z"), *[("de", "und so weiter.")] * 50]


def got(spark, rows, **options):
    df = spark.createDataFrame([(i, x, t, 1) for i, (x, t) in enumerate(rows)], "doc_id long, lang string, text string, n long").repartition(5)
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


def test_against_a_plain_count(spark):
    rows = texts()
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, least=3, top=25) == brute(rows, least=3, top=25)
    assert got(spark, rows, max_n=3, least=5) == brute(rows, max_n=3, least=5)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_hot_prefixes_are_split_and_added_up(spark, monkeypatch):
    rows = texts(seed=2)
    real, seen = phrases.counted, []
    monkeypatch.setattr(phrases, "counted", lambda dealt, hot, *a: seen.append(hot) or real(dealt, hot, *a))
    assert got(spark, rows, least=4) == brute(rows, least=4)
    assert {h.count(b" ") for h in seen[0]} == {1, 2, 3}  # hot words, pairs and triples


def test_one_stack_over_batches():
    r = random.Random(4)
    suffixes = sorted((b"en\n" + b"".join(bytes([97 + r.choice((0, 0, 1, 2))]) + b" " for _ in range(r.randint(1, 4))) for _ in range(400)), reverse=True)
    want = collections.Counter()
    for s in suffixes:
        ws = s.split(b" ")[:-1]
        for k in range(1, len(ws) + 1):
            want[b" ".join(ws[:k]) + b" "] += 1
    for step in (1, 3, 50, 400):
        stack, out = phrases.Stack(4, 1, set()), []
        for lo in range(0, 400, step):
            part = suffixes[lo:lo + step]
            out += stack.push(pa.array(part, pa.binary()), np.ones(len(part), np.int64))
        out += stack.close(0)
        assert sorted((p, n) for p, _, n in out) == sorted(want.items())
