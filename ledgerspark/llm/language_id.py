"""Language identification with interpolated Kneser-Ney character models.

Texts become runs of lower-case letters with one space between them. For each language, n-gram counts of a bounded
sample of its documents (``per_language`` of them, whole texts, drawn by id hash) give an interpolated Kneser-Ney
model of order four. Models are stored as sorted arrays of 64-bit n-gram hashes with a column of log-probabilities per
language, so letters and languages of any number are told apart; texts are scored in numpy over whole batches, and the language with the lowest cross-entropy per
character wins. Rejection is calibrated on documents held back from the counts: a text whose best cross-entropy lies above the language's
mean on them by ``reject_sd`` deviations is marked ``rejected``.

Defined results: a text that is null or has no letter is ``und`` with score 0; ties go to the first language in
order; rows are judged one by one, so repeated rows agree; null languages and ids are not learned from; with
nothing to learn from, every text is ``und``. Extra columns are dropped, so that names cannot clash.
"""

from __future__ import annotations

import math
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped

ORDER = 4
DISCOUNT = 0.75
#: Bound on the labelled documents of a language that its model is fitted on and calibrated with.
PER_LANGUAGE = 400
#: One of so many of these is held back from the counts, for calibration.
HELD_BACK = 5
#: Bytes of text that are scored at once.
CHUNK = 1 << 20

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point: 1 if it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, letters lower-cased and other runs one space (0), each text led by a space; and the start of each text."""
    low = [t.lower() for t in texts]
    sizes = np.fromiter((len(t) + 1 for t in low), np.int64, len(low))
    points = np.frombuffer((" " + " ".join(low)).encode("utf-32-le", "surrogatepass"), "<u4") if low else np.zeros(0, "<u4")
    points = np.where(letters()[points], points, 0)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    keep[starts] = True
    moved = np.cumsum(keep) - 1
    return points[keep], moved[starts] if len(low) else starts


def gram_hashes(points: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of the n-grams that end at each character, n from 1 to ORDER; nothing of the text before is seen.

    The hash of an n-gram is made from the code points read backwards, so that cutting its last letter leaves ``contexts``.
    """
    at = np.arange(len(points))
    into = at - np.repeat(first, np.diff(np.r_[first, len(points)]))  # place in the text
    out = []
    for k in range(ORDER):
        h = np.full(len(points), k + 1, np.uint64)
        for j in range(k, -1, -1):  # from the oldest letter to the newest; 0 stands for what lies before the text
            letter = np.where(into >= j, points[np.maximum(at - j, 0)], 0).astype(np.uint64)
            h = step(h, letter)
        out.append(h)
    return out


def context_hashes(points: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Hashes of the 0 to ORDER - 1 letters before each character."""
    at = np.arange(len(points))
    into = at - np.repeat(first, np.diff(np.r_[first, len(points)]))
    out = []
    for k in range(ORDER):
        h = np.full(len(points), k + 1, np.uint64)
        for j in range(k, 0, -1):
            h = step(h, np.where(into >= j, points[np.maximum(at - j, 0)], 0).astype(np.uint64))
        out.append(h)
    return out


def step(h: np.ndarray, letter: np.ndarray) -> np.ndarray:
    h = (h ^ letter) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def text_hash(gram: str, order: int) -> int:
    """Hash of one n-gram, or of a context of the given order."""
    h = np.full(1, order, np.uint64)
    for ch in gram:
        h = step(h, np.full(1, ord(ch), np.uint64))
    return int(h[0])


@dataclass
class Models:
    languages: list[str]
    keys: list[np.ndarray]  # per order: hashes of n-grams, sorted
    logp: list[np.ndarray]  # per order: rows as keys, a column per language
    contexts: list[np.ndarray]  # per order: hashes of contexts, sorted
    rest: list[np.ndarray]  # per order: log weight that a context leaves to the shorter ones
    unseen: np.ndarray  # log-probability of a letter that no language of the sample has
    mean: np.ndarray
    sd: np.ndarray

    def char_scores(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-probability of each character (code points, 0 for a space) under each language. first: where texts start."""
        grams, contexts = gram_hashes(points, first), context_hashes(points, first)
        out = np.zeros((len(points), len(self.languages)), np.float32)
        todo = np.arange(len(points))
        for k in range(ORDER - 1, -1, -1):
            at, hit = found(self.keys[k], grams[k][todo])
            out[todo[hit]] += self.logp[k][at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            if k:
                at, known = found(self.contexts[k], contexts[k][todo])
                out[todo[known]] += self.rest[k][at[known]]
            else:
                out[todo] += self.unseen
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character (texts x languages), and the number of letters of each text."""
        points, starts = normalised(texts)
        if not texts:
            return np.zeros((0, len(self.languages))), np.zeros(0, np.int64)
        size = np.diff(np.r_[starts, len(points)])
        scores = self.char_scores(points, starts)
        total = np.add.reduceat(scores, starts, axis=0, dtype=np.float64)
        count = np.add.reduceat((points != 0).astype(np.int64), starts)
        return -total / np.maximum(size, 1)[:, None], count


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def build(counts: dict[str, Counter]) -> Models:
    """Interpolated Kneser-Ney models from counts of ORDER-grams (strings; NUL for spaces and what lies before a text) per language."""
    languages = sorted(counts)
    orders: list[list[Counter]] = []
    for lang in languages:
        levels = [counts[lang]]
        for _ in range(ORDER - 1):  # lower orders count distinct left neighbours
            lower: Counter = Counter()
            for gram in levels[-1]:
                lower[gram[1:]] += 1
            levels.append(lower)
        orders.append(levels[::-1])
    letters_known = {g for o in orders for g in o[0]}
    share = 1 / (len(letters_known) + 1)  # one more for the letters that nobody has
    grams = [sorted(set().union(*(o[k] for o in orders))) for k in range(ORDER)]
    before = [sorted({g[:-1] for g in gs}) for gs in grams]
    hashes = [np.array([text_hash(g, k + 1) for g in gs], np.uint64) for k, gs in enumerate(grams)]
    context = [np.array([text_hash(g, k + 1) for g in gs], np.uint64) for k, gs in enumerate(before)]
    logp = [np.zeros((len(g), len(languages)), np.float32) for g in grams]
    rest = [np.zeros((len(g), len(languages)), np.float32) for g in before]
    unseen = np.full(len(languages), math.log(share), np.float32)
    for c in range(len(languages)):
        below: dict[str, float] = {}
        for k in range(ORDER):
            level = orders[c][k]
            total: dict[str, float] = defaultdict(float)
            kinds: dict[str, int] = defaultdict(int)
            for gram, n in level.items():
                total[gram[:-1]] += n
                kinds[gram[:-1]] += 1
            weight = {h: DISCOUNT * kinds[h] / total[h] for h in total}
            here = {}
            for gram in grams[k]:
                h, lower = gram[:-1], below[gram[1:]] if k else share
                here[gram] = max(level.get(gram, 0) - DISCOUNT, 0) / total[h] + weight[h] * lower if h in total else lower
            logp[k][:, c] = np.log([here[g] for g in grams[k]])
            rest[k][:, c] = np.log([weight.get(h, 1.0) for h in before[k]])
            if k == 0 and "" in weight:
                unseen[c] = math.log(weight[""] * share)
            below = here
    by = [np.argsort(h) for h in hashes]
    by_context = [np.argsort(h) for h in context]
    return Models(languages, [h[o] for h, o in zip(hashes, by)], [x[o] for x, o in zip(logp, by)], [h[o] for h, o in zip(context, by_context)], [x[o] for x, o in zip(rest, by_context)],
                  unseen, np.zeros(len(languages)), np.ones(len(languages)))


def learn(docs: DataFrame, *, trainable: Column | None = None, per_language: int = PER_LANGUAGE, held_back: int = HELD_BACK) -> Models | None:
    """Models from the documents with a language and a text for which trainable holds."""
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    if trainable is not None:
        usable = usable.where(trainable)
    usable = usable.select("text", "lang", ((F.xxhash64("doc_id", F.lit("langid")) / F.lit(2.0**64)) + 0.5).alias("draw"), F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(held_back)).alias("part"))
    sizes = usable.groupBy("lang").count()
    sample = usable.join(F.broadcast(sizes), "lang").where(F.col("draw") * F.col("count") < float(per_language))  # a row for each language

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """ORDER-grams of code points, some of them before the text, with counts: one batch's part."""
        for batch in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch["lang"], batch["text"]):
                points, _ = normalised([text])
                line = "\0" * (ORDER - 1) + points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                seen[lang].update(map("".join, zip(*(line[k:] for k in range(ORDER)))))
            for lang, c in seen.items():
                yield pd.DataFrame({"lang": lang, "gram": list(c), "n": list(c.values())})

    fitted, back = sample.where("part > 0").select("lang", "text"), sample.where("part = 0").select("lang", "text")
    counts: dict[str, Counter] = defaultdict(Counter)
    for r in fitted.mapInPandas(grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect():
        counts[r["lang"]][r["gram"]] = r["n"]
    if not counts:
        return None
    models = build(counts)
    # Calibration: cross-entropy under their own language of documents that the models were not fitted on.
    own = {x: i for i, x in enumerate(models.languages)}

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["lang"].isin(own)]
            ce, n = models.entropies(batch["text"].tolist())
            yield pd.DataFrame({"lang": batch["lang"].to_numpy(), "ce": ce[np.arange(len(batch)), [own[x] for x in batch["lang"]]] if len(batch) else [], "n": n}).query("n > 0")

    judged = back.mapInPandas(fit, "lang string, ce double, n long").groupBy("lang").agg(F.avg("ce").alias("m"), F.stddev_pop("ce").alias("s")).collect()
    for r in judged:
        models.mean[own[r["lang"]]], models.sd[own[r["lang"]]] = r["m"], max(r["s"], 0.05)
    for i in set(own.values()) - {own[r["lang"]] for r in judged}:  # too few documents to hold any back: never rejected
        models.mean[i], models.sd[i] = math.inf, 1.0
    return models


def predict(docs: DataFrame, models: Models | None, *, reject_sd: float = 4.0, sharpness: int = 24) -> DataFrame:
    """doc_id, lang_pred, score, entropy and rejected. Only the text is looked at.

    score is the posterior of the language when ``sharpness`` characters (or the text's, if fewer) are taken as evidence.
    """
    if models is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample

    def run(texts: list) -> list:
        m = shared.value
        ce, n = m.entropies([t or "" for t in texts])
        at = np.arange(len(texts))
        k = ce.argmin(axis=1)
        top, has = ce[at, k], n > 0
        odds = np.exp((top[:, None] - ce) * np.minimum(n, sharpness)[:, None])
        names = [m.languages[i] if ok else "und" for i, ok in zip(k, has)]
        return [names, np.where(has, 1 / odds.sum(axis=1), 0.0), pa.array(top, mask=~has), ~has | (top > m.mean[k] + reject_sd * m.sd[k])]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return mapped(docs, "text", ["doc_id"], fields, run, limit=CHUNK)
