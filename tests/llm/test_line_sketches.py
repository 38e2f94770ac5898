"""What line dedup knows of two lines before it reads them: no linked pair is passed over, most others are."""

import random

from pyspark.sql import functions as F

from ledgerspark.llm import line_dedup as D


def _pairs(r):
    word = lambda: "".join(r.choice("abcdefgñ日") for _ in range(r.randint(1, 6)))
    for _ in range(1500):
        ws = [word() for _ in range(r.choice([2, 3, 5, 9, 29, 31, 33, 50]))]
        line = " ".join(ws)
        chars = list(line)
        for _ in range(r.randint(1, 3)):
            k = r.randrange(len(chars))
            chars[k:k + 1] = r.choice([[], ["z"], [chars[k], "z"]])
            chars = chars or ["z"]
        other = list(ws)
        for _ in range(r.randint(1, 4)):
            k = r.randrange(len(other))
            other[k:k + 1] = r.choice([[], [word()], [other[k], word()]])
            other = other or ["z"]
        yield from ((line, x) for x in ("".join(chars), " ".join(other)) if x.strip())


def test_sketches_pass_over_no_link(spark):
    pairs = list(_pairs(random.Random(3)))
    both = [list(zip(*(c.to_pylist() for c in D.sketches(list(side))))) for side in zip(*pairs)]
    kinds = "struct<" + ", ".join(f"{c}: long" for c in D.SKETCH) + ">"
    may = [r[0] for r in spark.createDataFrame(list(zip(*both)), f"x {kinds}, y {kinds}").selectExpr(f"{D.may_link()} AS may").collect()]
    linked = [D.near(a, b) for a, b in pairs]
    assert not any(n and not m for n, m in zip(linked, may))
    assert sum(linked) > 300 and sum(may) < sum(linked) * 1.25


def test_lines_just_beyond_the_limit_are_told_apart(spark):
    """Lines with a few replaced words more than the limit, of which a group of near copies is full, seldom meet as texts."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    lines = []
    for _ in range(120):
        ws = list(base)
        for k in r.sample(range(60), 2):
            ws[k] = f"x{r.randint(0, 10**6)}"
        lines.append(" ".join(ws))
    rows = list(zip(range(120), *(c.to_pylist() for c in D.sketches(lines))))
    t = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} long" for c in D.SKETCH))
    may = {tuple(x) for x in t.alias("x").join(t.alias("y"), F.expr(f"x.id < y.id AND {D.may_link()}")).select("x.id", "y.id").collect()}
    linked = {(i, j) for i in range(120) for j in range(i + 1, 120) if D.near(lines[i], lines[j])}
    assert linked <= may and len(may - linked) < 0.1 * 120 * 119 / 2
