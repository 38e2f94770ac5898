"""Lines linked by word edits, hot groups of near-copies, and rows that share or lack ids."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import graph, line_dedup


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def linked(a, b):
    x, y = a.split(), b.split()
    n = max(len(x), len(y))
    if n < 32:
        return edits(a, b) <= min(2, max(len(a), len(b)) // 10)
    return edits(x, y) <= min(3, n // 16)


def varied(seed=5):
    r = random.Random(seed)
    base = [[f"w{r.randint(0, 99)}" for _ in range(n)] for n in (7, 12, 30, 31, 32, 34, 47, 48, 90, 200)]
    lines = [" ".join(x) for x in base]
    for x in base:
        for k in (1, 1, 2, 3, 3, 4):
            y = list(x)
            for _ in range(k):
                i = r.randrange(len(y) + 1)
                y[i:i + r.randint(0, 1)] = r.choice([[], [f"o{r.randint(0, 99)}"]])
            lines.append(" ".join(y))
    return lines + [lines[5].upper(), lines[6].replace(" ", "   ")]


def test_word_edits(spark):
    lines = list(dict.fromkeys(varied()))
    root = list(range(len(lines)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    degree = [0] * len(lines)
    for i, a in enumerate(lines):
        for j in range(i):
            assert line_dedup.near(a, lines[j]) == linked(a, lines[j])
            if linked(a, lines[j]):
                degree[i], degree[j] = degree[i] + 1, degree[j] + 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    want = [top(i) for i in range(len(lines))]
    assert sum(w != i for i, w in enumerate(want)) > 20
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in line_dedup.dedup_lines(docs).collect()}
    assert [got[i].class_doc_id for i in range(len(lines))] == want
    assert [got[i].dropped for i in range(len(lines))] == [w != i for i, w in enumerate(want)]
    assert all((got[i].n_links > 0) == (d > 0) and got[i].n_links <= d for i, d in enumerate(degree))


def test_long_lines_and_repeated_content():
    keys = lambda lines: line_dedup.line_keys(lines)
    long = "word " * 300_000 + "end"
    key, h, side = keys([long, "a" * 50_000, "b" * 7, "ab" * 30])
    assert len(key) == len(h) == len(side) and len(set(h.tolist())) == 3  # neither 7 characters nor two more tolerate an edit
    assert line_dedup.near(long, long + " more") and not line_dedup.near(long, "end " + long + " more and more")


def test_hot_group_grows_in_proportion(spark, monkeypatch):
    """2,000 near-copies of one line: candidates stay a multiple of the group, and all are one class."""
    r = random.Random(7)
    base = [f"b{i}" for i in range(70)]
    lines = [" ".join(base)]
    while len(lines) < 2000:
        x = list(base)
        for _ in range(r.choice([1, 1, 2, 3, 4])):
            x[r.randrange(len(x))] = f"x{r.randint(0, 10**6)}"
        lines.append(" ".join(x))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    asked = []
    inner = graph.linked_under_keys

    def counted(shared, verified, *rest):
        def check(pairs):
            asked.append(pairs.count())
            return verified(pairs)
        return inner(shared, check, *rest)

    monkeypatch.setattr(line_dedup, "linked_under_keys", counted)
    got = line_dedup.dedup_lines(docs).groupBy("class_doc_id").count().collect()
    assert sum(x["count"] for x in got) == 2000 and max(x["count"] for x in got) > 1500
    assert sum(asked) < 120 * 2000, asked  # all pairs would be 2 million
    # lines that stay alone are within the limit of no other
    words = [x.split() for x in lines]
    for x in got:
        if x["count"] == 1:
            i = x["class_doc_id"]
            assert all(sum(a != b for a, b in zip(words[i], w)) > 3 for j, w in enumerate(words) if j != i)


def test_rows_that_share_or_lack_an_id_keep_their_own_lines(spark):
    a, b, c = "a common line that occurs in several rows", "a wholly different first line found nowhere else", "another one that is alone, with 12 words in it"
    rows = [(1, f"{a}\none"), (7, f"{a}\nseven"), (7, f"{b}\nsecond seven"), (None, f"{a}\n\nnull one"), (None, f"{c}\nnull two"), (9, f" \n{a}"), (9, None), (9, "\n")]
    docs = spark.createDataFrame([(*x, "s", 5) for x in rows], "doc_id long, text string, _row string, _drop int")
    out = line_dedup.without_dropped_lines(docs)
    assert out.columns == docs.columns
    got = sorted((x.doc_id is None, x.doc_id or 0, x.text is None, x.text or "") for x in out.collect())
    want = [(1, rows[0][1]), (7, "seven"), (7, rows[2][1]), (None, "\nnull one"), (None, rows[4][1]), (9, None), (9, "\n")]
    assert got == sorted((d is None, d or 0, t is None, t or "") for d, t in want)


def mates_of(keyed, gathered):
    def make(batch):
        yield batch.column("key").to_numpy(), batch.column("id").to_numpy(), batch.column("side").to_numpy()

    return graph.gathered_keys(keyed, make, gathered)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_gathered_keys_finds_every_key_with_two_ids(spark, n):
    rows = [(k, i, 3) for k in range(20) for i in range(k % (n + 1))] * 2
    keyed = spark.createDataFrame(rows, "key long, id long, side int").select("key", "id", F.col("side").cast("byte").alias("side"))
    got = sorted({(r.key, r.id) for r in mates_of(keyed, 7).collect()})
    assert got == sorted({(k, i) for k, i, _ in rows if k % (n + 1) > 1})


def test_mates_connect_all_ids_of_a_key(spark):
    import collections
    import random

    r = random.Random(8)
    rows = [(k, r.randint(0, 400), r.choice([1, 2, 3])) for k, n in ((1, 900), (2, 1), (3, 2), (4, 40), (-5, 300), (6, 5)) for _ in range(n)] + [(7, 9, 1)] * 3
    keyed = spark.createDataFrame(rows, "key long, id long, side byte").repartition(5)
    want = {k: {i for q, i, _ in rows if q == k} for k in {k for k, *_ in rows}}
    want = {k: ids for k, ids in want.items() if len(ids) > 1}
    for gathered in (2_000_000, 3):
        got = mates_of(keyed, gathered).collect()
        assert {k: {x.id for x in got if x.key == k} for k in {x.key for x in got}} == want
        assert all(x.mate in want[x.key] and x.mate != x.id for x in got if x.mate is not None)
        side = collections.defaultdict(int)
        for x in got:
            side[x.key, x.id] |= x.side
        if gathered > 3:
            bits = collections.defaultdict(int)
            for q, j, s in rows:
                bits[q, j] |= s
            assert all(side[k, i] == bits[k, i] for k, ids in want.items() for i in ids)
        for k, ids in want.items():
            root = {i: i for i in ids}

            def find(i):
                while root[i] != i:
                    i = root[i]
                return i

            for x in got:
                if x.key == k and x.mate is not None:
                    root[find(x.id)] = find(x.mate)
            assert len({find(i) for i in ids}) == 1
    assert mates_of(keyed.where("false"), 10).count() == 0


def test_lines_of_more_words_than_characters(monkeypatch):
    import random

    r = random.Random(2)
    x = [f"w{r.randint(0, 50)}" for _ in range(200)]
    cases = [(x, x[:50] + ["new"] + x[51:]), (x, x[:50] + x[52:] + ["a"]), (x, ["p", "q", "r", "s"] + x[4:]), (x, x + ["z"] * 4), (x, x[::-1])]
    want = [line_dedup.near(" ".join(a), " ".join(b)) for a, b in cases]
    monkeypatch.setattr(line_dedup, "NAMED", 3)
    assert [line_dedup.near(" ".join(a), " ".join(b)) for a, b in cases] == want and want[0] and not want[2]


def test_all_links_of_a_group_are_counted(spark):
    """Lines that are near one another count all of each other, not those alone that connect them."""
    r = random.Random(11)
    lines = list(dict.fromkeys(varied() + [f"row {k:02d} of a table of many rows that are alike" for k in range(40)]))
    for k in range(30):
        words = [f"b{i}" for i in range(40)]
        words[r.randrange(40)] = f"x{k}"
        lines.append(" ".join(words))
    degree = [sum(linked(a, b) for b in lines if b != a) for a in lines]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.n_links for x in line_dedup.dedup_lines(docs).collect()}
    assert [got[i] for i in range(len(lines))] == degree
    assert line_dedup.edit_links(docs).count() < line_dedup.edit_links(docs, every=True).count() == sum(degree) // 2
