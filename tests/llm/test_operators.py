"""Each corpus operator against brute force on small tables with nulls, blanks, long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerspark.llm import graph, language_id, line_dedup, lm_scoring, media, mixing, quality_rules, sentencepiece_codec, sharding, simhash, token_counts
from ledgerspark.llm.common import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, b string"


def corpus(seed=3, n=60):
    r = random.Random(seed)
    vocab = ["thon", "ered", "la", "de", "aux", "ñja", "Über", "ing", "$$$", "ist", "heou", "THE"]
    line = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    texts = ["\n".join(line(r.randint(1, 25)) for _ in range(r.randint(1, 6))) for _ in range(n)]
    texts += [None, "", " \t\n ", "x", texts[0], texts[0], texts[1] + "!", line(9) * 1 + "\n" + line(9), ("ab " * 400).strip(), line(3000)]
    rows = [(i * 3 + 1, t, r.choice(["en", "fr", None]), r.choice(["s1", "s1", "s1", "s2", "ß", None]), 1, "clash", "clash") for i, t in enumerate(texts)]
    return rows + [rows[0]]  # a repeated row


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_quality_statistics(docs, none):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, [], "q_").collect()}
    for i, t, *_ in ROWS:
        w, t = words(t), t or ""
        seen, dup = set(), 0
        for x in t.split("\n"):
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        c = collections.Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        again = {k + j for k in range(len(w) - 7) if c[tuple(w[k:k + 8])] > 1 for j in range(8)}
        r = got[i]
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(again)), i
        assert r.q_base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and r.q_kept == (not r.q_base_failed) and r["size"] == "clash"
    assert quality_rules.judge(none, []).count() == 0


def test_quality_rules_learn_what_labels_show(spark):
    r = random.Random(5)
    rows = [(i, " ".join(("#" if i % 4 == 0 else "w") + str(r.randint(100, 999)) for _ in range(r.randint(20, 60)))) for i in range(200)]
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(0, 200)] + [(None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rules = quality_rules.learn(docs, labels)
    assert rules and all(1 <= len(x) <= 3 for x in rules)
    got = {x.doc_id: x.kept for x in quality_rules.judge(docs, rules).collect()}
    assert all(kept == (i % 4 != 0) for i, kept in got.items())
    assert quality_rules.learn(docs, labels.where("quality = 1")) == [] and quality_rules.learn(docs.limit(0), labels) == []


def fill(sizes, weights, most=3):
    """Targets by raising the level step by step until nobody is above the cap."""
    total, open_, out = sum(sizes.values()), set(sizes), {}
    while True:
        left = total - sum(out.values())
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > most * sizes[s]} if w else set()
        if not over:
            return out | {s: left * weights[s] / w for s in open_}
        out |= {s: most * sizes[s] for s in over}
        open_ -= over


def test_mixing(docs, none):
    got = mixing.mix(docs, rows_per_bucket=7).collect()
    sizes = collections.Counter()
    for _, t, _, s, *_ in ROWS:
        sizes[s] += len(words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    goal = fill(sizes, {s: k % 3 + 1 for k, s in enumerate(order)})
    assert len(got) == len(ROWS) and collections.Counter(r["size"] for r in got) == collections.Counter(len(words(r[1])) for r in ROWS)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, goal[r.source]) and r.taken == r["size"] * r.passes and 0 <= r.passes <= 3
        taken[r.source] += r.taken
    longest = max(len(words(r[1])) for r in ROWS)
    assert all(abs(taken[s] - goal[s]) <= longest for s in sizes) and sum(taken.values()) <= sum(sizes.values()) + longest
    again = mixing.mix(docs.repartition(5), rows_per_bucket=7).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    assert mixing.mix(none).count() == 0
    clash = docs.select("*", *[F.lit(1).alias(x) for x in ("passes", "_pass", "row", "target", "h", "times", "taken")])
    rows = mixing.mixed_rows(clash, rows_per_bucket=7)
    assert rows.columns == clash.columns and rows.count() == sum(r.passes for r in got)
    assert rows.where("_pass <> 1 OR size <> 'clash' OR `row` <> 1").count() == 0


BIG = 9007199254740993  # beyond what a double holds


def test_large_ids_beside_nulls(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    df = spark.createDataFrame([(BIG, text, "en", "s"), (None, text + " x", "en", "s")], "doc_id long, text string, lang string, source string").coalesce(1)
    data = tokenizer_file("piece_bpe_32k.model")
    media_rows = media.media_digests(media.store_texts(df))
    models = language_id.learn(df)
    for out in (simhash.near_duplicates(df), media_rows, media.read_pages(media.store_texts(df)), sentencepiece_codec.encode(df, data), language_id.predict(df, models),
                lm_scoring.score(df, F.lit(True)), token_counts.bpe_counts(df, "/opt/tokenizers/byte_bpe_50k.tiktoken", lm_scoring.Subwords.PATTERN),
                line_dedup.dedup_lines(df), sharding.hilbert_shards(df, shards=1), mixing.mix(df)):
        assert {r.doc_id for r in out.select("doc_id").collect()} == {BIG, None}


def test_tiff_round_trip(docs, none, spark):
    got = {r["doc_id"]: r for r in media.media_digests(media.store_texts(docs)).collect()}
    for i, t, *_ in ROWS:
        b = (t or "").encode()
        full = b + b" " * ((-len(b)) % 192 or (0 if b else 192))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
    assert media.media_digests(media.store_texts(none)).count() == 0
    r = np.random.default_rng(1)
    pages = [r.integers(0, 4, (130, 70)).astype(np.uint8), np.arange(35, dtype=np.uint8).reshape(5, 7)]
    for kw in ({}, {"tile": 64}, {"compression": media.LZW}, {"compression": media.PACKBITS, "predictor": False}, {"order": ">"}, {"compression": media.NONE, "tile": 32}):
        back = list(media.tiff_pages(media.write_tiff(pages, **kw)))
        assert len(back) == 2 and all((x.pixels[:, :, 0] == p).all() for x, p in zip(back, pages)), kw
    for n in (0, 1, 2, 300, 254, 255, 256, 5000):
        for raw in (bytes(r.integers(0, 256, n, dtype=np.uint8)), b"ab" * (n // 2), b"\0" * n):
            assert media.lzw_decode(media.lzw_encode(raw), len(raw)) == raw and media.unpack_bits(media.pack_bits(raw), len(raw)) == raw
    file = media.write_tiff(pages)
    df = spark.createDataFrame([(1, bytearray(file), "x"), (2, None, "y"), (3, bytearray(b"II*\0"), "z"), (4, bytearray(file[:-30]), "w")], "id int, media binary, page string")
    rows = media.read_pages(df).collect()
    assert [(x["id"], x["_page"], x["width"]) for x in rows if x["id"] == 1] == [(1, 0, 70), (1, 1, 7)] and {x["id"]: x["error"] for x in rows}[2] == "null"
    assert all(any(x["error"] for x in rows if x["id"] == k) for k in (3, 4))


def retagged(file, tag, count=None, value=None):
    """The file with the count or the value of a tag of its first directory changed."""
    out = bytearray(file)
    at = int.from_bytes(out[4:8], "little")
    for place in range(at + 2, at + 2 + 12 * int.from_bytes(out[at:at + 2], "little"), 12):
        if int.from_bytes(out[place:place + 2], "little") == tag:
            if count is not None:
                out[place + 4:place + 8] = count.to_bytes(4, "little")
            if value is not None:
                out[place + 8:place + 12] = value.to_bytes(4, "little")
    return out


def test_malformed_tiff_gives_errors(spark):
    import struct

    page = np.arange(35, dtype=np.uint8).reshape(5, 7)
    strips, tiles = media.write_tiff([page]), media.write_tiff([page], tile=16)
    bad = [retagged(strips, t, count=0) for t in (256, 257, 258, 259, 273, 277, 278, 279, 317)] + [retagged(tiles, t, count=0) for t in (322, 323, 324, 325)]
    bad += [retagged(strips, t, value=v) for t in (256, 257, 277) for v in (0, 8_000_000)] + [retagged(tiles, t, value=v) for t in (322, 323) for v in (0, 8_000_000)]
    bad += [retagged(strips, 273, value=1 << 31), retagged(strips, 279, value=1 << 31), retagged(strips, 256, count=1 << 30), retagged(strips, 317, value=3), retagged(strips, 259, value=7)]
    bomb = zlib.compress(b"\0" * 10_000_000)
    file = bytearray(strips)
    for tag, value in ((273, len(file)), (279, len(bomb))):
        file = retagged(file, tag, value=value)
    rows = media.read_pages(spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bad)] + [(900, bytearray(b"MM")), (901, bytearray(struct.pack("<2sHI", b"II", 42, 1 << 31)))], "id int, media binary")).collect()
    assert len(rows) == len(bad) + 2 and all(r.error and r.page is None for r in rows), [r["id"] for r in rows if not r.error]
    assert list(media.tiff_pages(bytes(file) + bomb))[0].pixels.shape == (5, 7, 1)  # unpacked only as far as the page reaches


def test_token_rollup(docs, none, spark, tmp_path):
    got = {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in token_counts.maintained(docs, str(tmp_path / "a")).collect()}
    want = collections.defaultdict(lambda: [0, 0])
    for _, t, lang, source, *_ in ROWS:
        if len(words(t)) >= 20:
            for v, n in (("words-1", len(words(t))), ("pieces-1", len(re.findall(r"[A-Za-zÀ-ɏ]+|[0-9]+|[^A-Za-z0-9À-ɏ\x20\x09-\x0D]", t)))):
                want[source, lang, v][0] += 1
                want[source, lang, v][1] += n
    assert got == {k: tuple(v) for k, v in want.items()}
    assert token_counts.maintained(none, str(tmp_path / "b")).count() == 0
    roll = token_counts.Rollup(spark, str(tmp_path / "c"))
    assert roll.totals().count() == 0
    one = docs.where("doc_id = 1").limit(1)
    roll.commit("1", token_counts.changes(one, "insert", "v", F.lit(5)))
    roll.commit("1", token_counts.changes(one, "insert", "v", F.lit(5)))
    roll.commit("2", token_counts.changes(one, "revise", "v", F.lit(7), F.lit(5)))
    small = roll.compact(str(tmp_path / "d"))
    assert [(r.docs, r.tokens) for r in roll.totals().collect()] == [(1, 7)] == [(r.docs, r.tokens) for r in small.totals().collect()]
    assert not small.commit("2", token_counts.changes(one, "insert", "v", F.lit(9))) and set(small.batches()) == {"1", "2"}
    with pytest.raises(Exception, match="unknown operation"):  # an attempt that fails leaves nothing
        roll.commit("3", token_counts.changes(one, "odd", "v", F.lit(7)))
    roll = token_counts.Rollup(spark, str(tmp_path / "c"))  # a new driver
    assert [(r.docs, r.tokens) for r in roll.totals().collect()] == [(1, 7)]
    assert not roll.commit("1", token_counts.changes(one, "insert", "v", F.lit(5)))
    assert not roll._publish("1".encode().hex(), ["1"], "late")  # another committer came first
    counted = token_counts.bpe_counts(one, "/opt/tokenizers/byte_bpe_50k.tiktoken", lm_scoring.Subwords.PATTERN).select("*", F.col("n_tokens").alias("n"))
    bpe = token_counts.Rollup(spark, str(tmp_path / "e"))
    bpe.commit("b", token_counts.changes(counted, "insert", "bpe-50k", F.col("n")))
    import tiktoken
    coder = lm_scoring.Subwords(tokenizer_file("byte_bpe_50k.tiktoken")).coder
    assert isinstance(coder, tiktoken.Encoding) and [r.tokens for r in bpe.totals().collect()] == [len(coder.encode_ordinary(ROWS[0][1]))]
    roll.commit("3", token_counts.changes(one, "delete", "v", F.lit(7)))
    assert roll.totals().count() == 0
    with pytest.raises(Exception, match="unknown operation"):
        token_counts.signed(token_counts.changes(one, "odd", "v", F.lit(1))).collect()


def dp(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    r = random.Random(1)
    for _ in range(4000):
        a = [r.choice("abc") for _ in range(r.randint(0, 14))]
        b = list(a)
        for _ in range(r.randint(0, 4)):
            i = r.randint(0, len(b))
            b[i:i + r.randint(0, 1)] = r.choice(["", "a", "b"])
        k = r.randint(0, 4)
        assert line_dedup.edit_distance("".join(a), "".join(b), k) == min(dp(a, b), k + 1)


def edited_lines(seed=8):
    r = random.Random(seed)
    base = ["".join(r.choice("abcde ñ") for _ in range(n)) for n in (5, 9, 10, 12, 19, 20, 21, 30, 40, 60)]
    out = []
    for b in base:
        for _ in range(6):
            x = list(b)
            for _ in range(r.randint(0, 3)):
                i = r.randint(0, len(x))
                x[i:i + r.randint(0, 1)] = r.choice(["", "a", "z", "zq"])
            out.append("".join(x))
    return out


def test_line_dedup(spark, docs, none):
    r = random.Random(4)
    pool = edited_lines()
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 7)))) for i in range(40)] + [(None, pool[0]), (90, None), (91, " \n"), (92, "")]
    got = {(x.doc_id, x.line_no): (x.class_doc_id, x.class_line_no, x.n_links, x.dropped) for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    flat = [(i, k, x) for i, t in rows for k, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    kinds = sorted({x for *_, x in flat})
    root, links = {x: x for x in kinds}, collections.Counter()

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if dp(a, b) <= min(2, max(len(a), len(b)) // 10):
                links.update((a, b))
                root[top(a)] = top(b)
    first = {}
    for i, k, x in flat:
        key = (i is None, i or 0, k)
        first[top(x)] = min(first.get(top(x), key), key)
    for i, k, x in flat:
        none_id, d, at = first[top(x)]
        assert (*got[i, k][:2], got[i, k][3]) == (None if none_id else d, at, (none_id, d, at) != (i is None, i or 0, k)), (i, k, x)
        assert (got[i, k][2] > 0) == (links[x] > 0) and got[i, k][2] <= links[x]
    assert len(got) == len(flat) and line_dedup.dedup_lines(none).count() == 0
    out = line_dedup.without_dropped_lines(docs)
    assert out.columns == docs.columns
    texts = {x.doc_id: x.text for x in out.collect()}
    assert 181 in texts and texts[181] is None and texts[1] == ROWS[0][1] and 1 + 3 * 64 not in texts  # null stays, a copy goes


def brute_fingerprint(t, k):
    w = (t or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), seed=42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(codes, radius):
    root = {c: c for c in codes}

    def top(c):
        while root[c] != c:
            c = root[c]
        return c

    for a in codes:
        for b in codes:
            if (a ^ b).bit_count() <= radius:
                root[top(a)] = top(b)
    return {c: top(c) for c in codes}


@pytest.mark.parametrize("shingle", [3, 5])
def test_simhash(docs, none, shingle):
    got = simhash.near_duplicates(docs, shingle=shingle).collect()
    code = {i: brute_fingerprint(t, shingle) for i, t, *_ in ROWS}
    top = brute_components(set(code.values()), 2)
    least = {}
    for i, c in code.items():
        least[top[c]] = min(least.get(top[c], i), i)
    assert len(got) == len(ROWS) and all(r.fingerprint == f"{code[r.doc_id]:016x}" and r.component_id == least[top[code[r.doc_id]]] for r in got)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("radius, max_shard, blocks", [(2, 256, None), (2, 5, None), (1, 5, None), (2, 256, 5)])
def test_links_with_hot_shards(spark, radius, max_shard, blocks):
    r = random.Random(6)
    centre = r.getrandbits(64)
    codes = {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(120)} | {r.getrandbits(64) for _ in range(40)}
    edges = simhash.links(spark.createDataFrame([(simhash._signed(c),) for c in codes], "fp long"), radius=radius, max_shard=max_shard, blocks=blocks)
    roots = {x.node: x.root for x in graph.components(edges).collect()}
    want = brute_components(codes, radius)
    for a in codes:
        for b in codes:
            x, y = simhash._signed(a), simhash._signed(b)
            assert (roots.get(x, x) == roots.get(y, y)) == (want[a] == want[b])


def test_bk_tree():
    r = random.Random(2)
    codes = [r.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree()
    for c in codes:
        tree.add(c)
    for q in codes[:50]:
        assert sorted(tree.codes[i] for i in tree.within(q, 2)) == sorted({c for c in codes if (c ^ q).bit_count() <= 2})


def test_components_of_a_chain(spark):
    n = 40
    edges = [(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100}


def test_hilbert_shards(docs, none):
    got = sharding.hilbert_shards(docs, shards=5, bits=3).collect()
    n = len(ROWS)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        t = dict((x[0], x[1]) for x in ROWS)[r.doc_id] or ""
        assert r["size"] == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode())
    assert len(got) == n and all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert {r.source for r in got} == {x[3] for x in ROWS}
    curve = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert curve == sorted(curve) and sharding.hilbert_shards(none).count() == 0


def test_hilbert_shards_prune_on_each_column(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    touched = lambda rows, column: np.mean([len({s for s, *x in rows if x[column] == v}) for v in {r[1 + column] for r in rows}])
    rows = [(r.shard, r.lang, r.source, int(math.log2(r["size"]))) for r in sharding.hilbert_shards(docs).collect()]
    by_size = sorted(rows, key=lambda r: r[3])
    by_size = [(i * 24 // len(rows), *r[1:]) for i, r in enumerate(by_size)]
    hilbert, sorted_by_size = [touched(rows, k) for k in range(3)], [touched(by_size, k) for k in range(3)]
    # shards that a filter touches: sorting by size alone prunes on size only
    assert hilbert[0] < 0.75 * sorted_by_size[0] and hilbert[1] < 0.75 * sorted_by_size[1] and hilbert[2] < 20, (hilbert, sorted_by_size)


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_steps_to_neighbours(dims, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    index = sharding.hilbert_index(points, bits)
    assert sorted(index) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_sentencepiece_parity(docs, none):
    import sentencepiece

    data = tokenizer_file("piece_bpe_32k.model")
    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    for r in sentencepiece_codec.encode(docs, data).collect():
        want = theirs.encode(r.text or "")
        assert r.ids == want and r.n_tokens == len(want) and r.parity and r.round_trip and r["size"] == "clash"
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, data), data)
    assert back.where("NOT coalesce(text, '') <=> _text").count() == 0 and back.count() == len(ROWS)
    assert sentencepiece_codec.encode(none, data).count() == 0
    codec = sentencepiece_codec.Codec(data)
    for t in ("", " ", "  a  b ", "ü€𝒳 <s> </s>", "\n\n", "a" * 5000):
        ids, whole, agree = codec.encode([t])[0]
        assert ids.tolist() == theirs.encode(t) and whole and agree and codec.decode(ids) == t


def test_sentencepiece_unigram_model():
    def field(n, kind, body):
        return bytes([n << 3 | kind]) + (bytes([len(body)]) if kind == 2 else b"") + body

    piece = lambda t, s, k=1: field(1, 2, field(1, 2, t.encode()) + field(2, 5, np.float32(s).tobytes()) + field(3, 0, bytes([k])))
    data = piece("<unk>", 0, 2) + piece("▁a", -1) + piece("b", -2) + piece("▁ab", -2.5) + piece("a", -3) + piece("▁", -4) + field(2, 2, field(3, 0, b"\1")) + field(3, 2, field(4, 0, b"\0"))
    m = sentencepiece_codec.parse_model(data)
    assert m.kind == 1 and [p for p, *_ in m.pieces][:3] == ["<unk>", "▁a", "b"]
    codec = sentencepiece_codec.Codec(data, parity=False)
    assert codec.encode(["ab a"])[0][0].tolist() == [3, 1] and codec.encode([""])[0][0].tolist() == []


def test_language_id(spark, none):
    r = random.Random(9)
    parts = {"en": ["the", "ing", "and", "tion"], "fr": ["eau", "é", "les", "ment"], "de": ["und", "sch", "ü", "ein"]}
    text = lambda k: " ".join("".join(r.choice(parts[k]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 30)))
    rows = [(i, text(k), k, "s") for i, k in enumerate(r.choice(list(parts)) for _ in range(240))]
    extra = [(1000, None, "en", "s"), (1001, "123 !!", "fr", "s"), (1002, "", None, "s"), (1003, rows[0][1].upper(), None, None), (None, text("fr"), "fr", "s")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, source string")
    models = language_id.learn(df, trainable=F.col("doc_id") % 4 != 0)
    got = {x.doc_id: x for x in language_id.predict(df, models).collect()}
    held = [(i, k) for i, _, k, _ in rows if i % 4 == 0]
    assert sum(got[i].lang_pred == k for i, k in held) >= 0.95 * len(held) and all(0 <= x.score <= 1 for x in got.values())
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3 and got[1003].lang_pred == rows[0][2]
    grams = models.char_scores(np.array([0, ord("t"), ord("h"), ord("e")]), np.array([0]))
    assert np.isfinite(grams).all() and (grams < 0).all()
    assert language_id.learn(none) is None and language_id.predict(df, None).where("lang_pred <> 'und'").count() == 0


def brute_kneser_ney(counts, letters):
    """P(letter | context) straight from the definition, by recursion over the context's length."""
    def p(letter, context):
        k = len(context)
        level = counts
        for _ in range(language_id.ORDER - 1 - k):
            level = collections.Counter(g[1:] for g in level)  # distinct left neighbours
        here = {g: n for g, n in level.items() if g[:-1] == context}
        lower = p(letter, context[1:]) if k else 1 / (len(letters) + 1)
        total = sum(here.values())
        return lower if not total else max(here.get(context + letter, 0) - 0.75, 0) / total + 0.75 * len(here) / total * lower
    return p


def test_kneser_ney_against_its_definition():
    texts = ["abra cadabra", "bra \u6f22\u5b57 abc", "\u6f22\u5b57\u6f22\u5b57 ab"]
    counts = collections.Counter()
    for t in texts:
        line = "\0\0\0" + "\0" + t.replace(" ", "\0")
        counts.update(line[i:i + 4] for i in range(len(line) - 3))
    m = language_id.build({"x": counts, "y": collections.Counter({"\0\0\0z": 2})})
    known = {g[-1] for g in counts} | {"z"}
    p = brute_kneser_ney(counts, known)
    for t in ["abra", "cab \u5b57\u6f22", "zq r"]:
        points, first = language_id.normalised([t])
        got = m.char_scores(points, first)[:, 0]
        line = "\0\0\0" + "".join(map(chr, points))
        want = [math.log(p(line[i + 3], line[i:i + 3])) for i in range(len(points))]
        assert np.allclose(got, want, rtol=1e-4), t
    assert math.isclose(sum(p(x, "\0ab") for x in known) + p("?", "\0ab"), 1)


def test_lm_gradients_and_windows():
    rng = np.random.default_rng(0)
    model = lm_scoring.Attention()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    win, target = rng.integers(0, lm_scoring.PAD + 1, (2, 2 * lm_scoring.BLOCK)).astype(np.int16), rng.integers(-1, lm_scoring.CLASSES, (2, lm_scoring.BLOCK)).astype(np.int16)
    _, g = model.gradients(win, target)
    for k, p in model.p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), p.shape)
        p[at] += 1e-4
        up, _ = model.gradients(win, target)
        p[at] -= 2e-4
        down, _ = model.gradients(win, target)
        p[at] += 1e-4
        assert math.isclose(g[k][at], (up - down) / 2e-4, rel_tol=1e-3), k
    sizes = np.array([1, lm_scoring.BLOCK, lm_scoring.BLOCK + 1])
    ids = np.arange(sizes.sum())
    w, place = lm_scoring.windows(ids.astype(np.int16), np.r_[0, np.cumsum(sizes)[:-1]], sizes)
    assert len(w) == 4 and (w[:, lm_scoring.BLOCK:].reshape(-1)[place] == ids).all() and len(set(place)) == len(ids)


def test_lm_class_scores_are_a_distribution_and_causal():
    model = lm_scoring.Attention(1)
    f = model.freeze()
    rng = np.random.default_rng(3)
    win = rng.integers(0, lm_scoring.PAD + 1, (3, 2 * lm_scoring.BLOCK)).astype(np.int16)
    each = np.stack([lm_scoring.class_scores(f, win, np.full((3, lm_scoring.BLOCK), c, np.int16)) for c in range(lm_scoring.CLASSES)])
    assert np.allclose(np.exp(each).sum(axis=0), 1, atol=1e-3)
    other = win.copy()
    other[:, lm_scoring.BLOCK + 10:] = 5
    target = rng.integers(0, lm_scoring.CLASSES, (3, lm_scoring.BLOCK)).astype(np.int16)
    assert np.allclose(lm_scoring.class_scores(f, win, target)[:, :11], lm_scoring.class_scores(f, other, target)[:, :11])


def brute_log10(t, subwords, voc, net, follows):
    """log10 P(text), each id by itself: attention over the block before and the ids so far, in float64."""
    words = [subwords.encode([w])[0] for w in lm_scoring.words_of(t)] + [[subwords.end]]
    ids = [i for w in words for i in w]
    so_far = [tuple(w[:k]) for w in words for k in range(len(w))]
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    b, total = lm_scoring.BLOCK, 0.0
    for i, x in enumerate(ids):
        begin = (i // b - 1) * b
        seen = range(max(begin, 0), i)  # ids before this one, in the window
        keys, where = [int(voc.input[ids[j]]) for j in seen], [j - begin for j in seen]
        if i < b:  # the mark of the text's start
            keys, where = [lm_scoring.PAD, *keys], [b - 1, *where]
        e = p["emb"][keys] + p["pos"][where]
        q = e[-1] @ p["wq"]
        a = e @ p["wk"] @ q * lm_scoring.WIDTH**-0.5
        a = np.exp(a - a.max())
        h = e[-1] + (a / a.sum()) @ (e @ p["wv"])
        y = (h + np.maximum(h @ p["w1"] + p["b1"], 0) @ p["w2"] + p["b2"]) @ p["out"] + p["bias"]
        total += y[voc.cls[x]] - y.max() - math.log(np.exp(y - y.max()).sum())
        same = sum(c for (b4, other), c in follows.items() if b4 == so_far[i] and voc.cls[other] == voc.cls[x])
        total += math.log((follows[so_far[i], x] + 2 * math.exp(voc.inside[x])) / (same + 2))
    return total / math.log(10)


def test_lm_scores(docs, none, spark):
    training = F.col("doc_id") % 3 != 0
    shared = spark.sparkContext.broadcast(tokenizer_file("byte_bpe_50k.tiktoken"))
    model = lm_scoring.learn(docs.where(training), shared, least_bytes=20_000)
    got = {r.doc_id: r for r in lm_scoring.score(docs, training, head=6, model=model).collect()}
    c = collections.Counter()
    for i, t, *_ in ROWS:
        if i % 3 != 0:
            c.update(lm_scoring.words_of(t))
            c[b""] += 1
    n, v = sum(c.values()), len(c)
    subwords = lm_scoring.Subwords(shared.value)
    ids = np.zeros(subwords.size)
    for w, k in c.items():
        for x in subwords.encode([w])[0] if w else [subwords.end]:
            ids[x] += k
    follows = collections.Counter()
    for w, k in c.items():
        x = subwords.encode([w])[0] if w else [subwords.end]
        for j in range(len(x)):
            follows[tuple(x[:j]), x[j]] += k
    assert (lm_scoring.vocabulary(ids).cls == model[1].cls).all() and np.allclose(lm_scoring.vocabulary(ids).inside, model[1].inside)
    for i, t, *_ in ROWS:
        w = [*lm_scoring.words_of(t), b""]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        if len(w) < 400:
            assert math.isclose(r.score, brute_log10(t, subwords, model[1], model[2], follows), rel_tol=1e-3, abs_tol=1e-3), i
    assert lm_scoring.score(none, training).count() == 0


def test_lm_training_helps_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    shared = spark.sparkContext.broadcast(tokenizer_file("byte_bpe_50k.tiktoken"))
    counts, voc, net, inside = lm_scoring.learn(docs.where(~held), shared)
    total = lambda x: lm_scoring.score(docs.where(held), ~held, model=(counts, voc, x, inside)).agg(F.sum("score")).first()[0]
    untrained = lm_scoring.Attention()
    assert total(net) > 0.8 * total(untrained)
