"""Quality classifier by compression: the dictionary that shortens a text more tells its label.

Two zstandard dictionaries are trained, one on text of documents labelled good (1), one on text labelled bad (0). A text is
cut into blocks of ``BLOCK`` bytes, all of them are compressed on their own with either dictionary, and the sizes are
summed: g with the good one, b with the bad one. The difference b - g is normalised twice, by b + g (which of the two fits) and
by the text's own bytes (how much it matters). A logistic curve over both, over the log of the mean compressed share and over that times the first (a
text that compresses to nothing, such as repetition, has differences of little weight), fitted on labelled documents that the
dictionaries haven't seen, makes them a score from 0 to 1.

Fitting is bounded and scoring covers every row and every byte: the sample is at most ``DOCS`` documents a label, the least by id
hash, one half for the dictionaries (at most ``BLOCKS`` blocks a label, again the least by hash), the other for the curve.

Defined results: null and empty texts have differences of 0 and get what the curve gives for them; rows are scored one by one, so
repeated rows agree; labels other than 0 and 1, null ids and labels without a document are not learned from; a document with
both labels counts for both; of several rows with one doc_id the least text is learned from; without documents of both labels every score is the share
of label 1 (one half, if there is none); other columns of the input are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, written

#: Bytes that are compressed together, bytes of a dictionary, and the compressor's level.
BLOCK, DICTIONARY, LEVEL = 1024, 262_144, 9
#: Bounds on the labelled documents of a label that are learned from, and on the blocks of a label that its dictionary is trained on.
DOCS, BLOCKS = 4000, 12_000
#: Scores from here on are predicted 1.
THRESHOLD = 0.3


def blocks(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[lo:lo + BLOCK] for lo in range(0, len(raw), BLOCK)]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(256, sum(map(len, samples)) // 4)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


@dataclass
class Model:
    good: bytes
    bad: bytes
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # constant, and those of the columns of features

    def scores(self, sizes: np.ndarray) -> np.ndarray:
        z = self.weights[0] + (features(sizes) - self.centre) / self.spread @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


class Sizer:
    """Both compressors, made once a worker."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.by = []
        for raw in (good, bad):
            known = zstandard.ZstdCompressionDict(raw)
            known.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, texts: list[str | None]) -> np.ndarray:
        """g, b and the text's bytes, a row for each text."""
        out = np.zeros((len(texts), 3))
        for i, text in enumerate(texts):
            parts = blocks(text)
            out[i] = [*(sum(len(c.compress(x)) for x in parts) for c in self.by), sum(map(len, parts))]
        return out


def features(sizes: np.ndarray) -> np.ndarray:
    """Both normalised differences, the log of the compressed share, and that times the first."""
    g, b, n = sizes.T
    by_sizes, share = (b - g) / np.maximum(b + g, 1), np.log((b + g + 16) / (2 * n + 32))
    return np.stack([by_sizes, (b - g) / (n + 32), share, by_sizes * share], axis=1)


_sizers: dict[bytes, Sizer] = {}


def sizer(model: Model) -> Sizer:
    key = xxhash.xxh128_digest(model.good + b"\0" + model.bad)
    if key not in _sizers:
        _sizers.clear()
        _sizers[key] = Sizer(model.good, model.bad)
    return _sizers[key]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a constant and the columns of x, by Newton's method with a small ridge."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    keep = ridge * np.r_[0.0, np.ones(x.shape[1])]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -700, 700)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(keep + 1e-9), a.T @ (y - p) - keep * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, trainable: Column | None, per_label: int) -> DataFrame:
    """doc_id, y, part and text of the bounded sample; part 0 is for the dictionaries, 1 for the curve."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if trainable is not None:
        usable = usable.where(trainable)
    usable = usable.select("doc_id", F.col("quality").cast("int").alias("y")).distinct().withColumn("draw", F.xxhash64("doc_id", F.lit("compression")))
    chosen = None
    for y in (0, 1):
        some = usable.where(F.col("y") == y).orderBy("draw", "doc_id").limit(per_label)
        chosen = some if chosen is None else chosen.unionByName(some)
    found = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * per_label rows
    return found.groupBy("doc_id", "y", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(2)).alias("part")).agg(F.min("text").alias("text"))


def learn(docs: DataFrame, labels: DataFrame, *, trainable: Column | None = None, per_label: int = DOCS, per_dictionary: int = BLOCKS) -> Model | float:
    """A model from the labelled documents for whose doc_id trainable holds; the share of label 1 where there aren't enough."""
    sample = written(labelled(docs, labels, trainable, per_label), "labelled-texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
                parts = blocks(text)
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(parts), pa.int32()), pa.array(parts, pa.binary())], names=["y", "block"])

    parts = sample.where("part = 0").select("y", "text").mapInArrow(cut, "y int, block binary")
    known = []
    for y in (1, 0):
        chosen = parts.where(F.col("y") == y).orderBy(F.xxhash64("block"), "block").limit(per_dictionary)  # BLOCK bytes each
        known.append(dictionary([bytes(r["block"]) for r in chosen.collect()]))
    model = Model(known[0], known[1], np.zeros(4), np.ones(4), np.zeros(5))
    if not all(known):
        return sample.agg(F.avg("y")).first()[0] if sample.head(1) else 0.5
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(texts: list) -> list:
        return list(sizer(shared.value).sizes(texts).T)

    judged = mapped(sample.where("part = 1"), "text", ["y"], [T.StructField(c, T.DoubleType()) for c in "gbn"], measure).collect()  # 2 * per_label rows
    y = np.array([r["y"] for r in judged], float)
    if len(set(y)) < 2:
        return sample.agg(F.avg("y")).first()[0]
    x = features(np.array([[r["g"], r["b"], r["n"]] for r in judged]))
    model.centre, model.spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    model.weights = logistic((x - model.centre) / model.spread, y)
    return model


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id, score, predicted and both differences of every row. Only the text is looked at."""
    fields = [T.StructField("score", T.DoubleType()), T.StructField("by_sizes", T.DoubleType()), T.StructField("by_bytes", T.DoubleType())]
    if isinstance(model, Model):
        shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries

        def run(texts: list) -> list:
            sizes = sizer(shared.value).sizes(texts)
            x = features(sizes)
            return [shared.value.scores(sizes), x[:, 0], x[:, 1]]

        out = mapped(docs, "text", ["doc_id"], fields, run)
    else:
        out = docs.select("doc_id", F.lit(float(model)).alias("score"), F.lit(None).cast("double").alias("by_sizes"), F.lit(None).cast("double").alias("by_bytes"))
    return out.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "by_sizes", "by_bytes")
