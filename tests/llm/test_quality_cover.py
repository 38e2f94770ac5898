"""The learner of quality rules against a plain covering that tries every condition on every row, and two statistics."""

import math
import random
import re

from pyspark.sql import functions as F

from ledgerspark.llm import quality_rules as q


def brute(table, cuts, precision, max_rules, max_conditions):
    """Rows one by one: (bins, held, bad); conditions (signal, above, bin) are tried in the order of signals, bins, and above before below."""
    rows = [(x, h, bad) for x, h, b, g in table for bad, n in ((True, b), (False, g)) for _ in range(n)]
    fits = lambda rule, x: all((x[s] >= k) == above for s, above, k in rule)
    count = lambda rs, rule: (sum(bad for x, _, bad in rs if fits(rule, x)), sum(not bad for x, _, bad in rs if fits(rule, x)))
    out = []
    while len(out) < max_rules:
        grow, held = [r for r in rows if not r[1]], [r for r in rows if r[1]]
        rule = ()
        while len(rule) < max_conditions:
            b0, g0 = count(grow, rule)
            best, pick = 0.0, None
            for s, at in cuts.items():
                for k in range(1, len(at) + 1):
                    for above in (True, False):
                        b, g = count(grow, (*rule, (s, above, k)))
                        if b0 and g0 and b and (gain := b * (math.log2(b / (b + g)) - math.log2(b0 / (b0 + g0)))) > best + 1e-9:
                            best, pick = gain, (s, above, k)
            if pick is None:
                break
            rule += (pick,)
        if not rule:
            break

        def worth(r):
            b, g = count(held, r)
            return (b - g) / (b + g) if b + g else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        b, g = count(rows, rule)
        if b < 3 or b < precision * (b + g):
            break
        out.append(rule)
        rows = [r for r in rows if not fits(rule, r[0])]
    return out


def test_cover_is_that_of_all_conditions():
    found = 0
    for seed in range(60):
        r = random.Random(seed)
        cuts = {s: sorted(r.sample(range(100), r.randint(1, 4))) for s in ("a", "b", "c")}
        table = {}
        for _ in range(r.randint(5, 120)):
            x = tuple(r.randint(0, len(cuts[s])) for s in cuts)
            bad = r.random() < (0.95 if x[0] >= 2 and x[1] < 2 or x[2] == 1 else 0.1)
            key = (x, r.random() < 0.33)
            b, g = table.get(key, (0, 0))
            table[key] = (b + bad, g + (not bad))
        rows = [(dict(zip(cuts, x)), h, b, g) for (x, h), (b, g) in sorted(table.items())]
        precision = r.choice([0.6, 0.8, 0.97])
        got = q.cover(rows, cuts, precision, 4, 3)
        assert [tuple((c.signal, c.above, c.bin) for c in rule) for rule in got] == brute(rows, cuts, precision, 4, 3), seed
        assert all(c.threshold == cuts[c.signal][c.bin - 1] for rule in got for c in rule)
        found += len(got)
    assert found > 40


def test_capitals_and_marks(spark):
    texts = ["ÀB cd E!? ñÑ\nx", "", None, "¡no!", "Ⅷ ǅ A"]
    got = {r["doc_id"]: (r["n_upper"], r["n_marks"]) for r in q.statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select(F.col("doc_id"), "n_upper", "n_marks").collect()}
    import unicodedata

    assert got == {i: (sum(unicodedata.category(c) == "Lu" for c in t or ""), len(re.findall("[!?]", t or ""))) for i, t in enumerate(texts)}
