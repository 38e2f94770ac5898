"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed as protobuf by its wire format. Its normaliser flags, pieces with scores and byte fallback are
rebuilt as a tokenizers model: unigram models from their scores, BPE models from merges ordered by the scores of what
they make. Words are marked with the metaspace. Where no piece has a metaspace after another character, texts are cut
before each run of metaspaces; distinct chunks are encoded once in multithreaded batches, decoded, and compared
with the SentencePiece library (parity), and texts are assembled from the chunks' ids.

Defined results: null and empty texts have no ids, round trip and agree; lone spaces are chunks; texts that repeat
get equal ids; characters outside the vocabulary become byte pieces; control pieces' strings in a text are ordinary
characters. Columns of the input pass through; new ones get leading underscores where a name is taken.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_name, mapped, worker_object

MARK = "▁"
#: Bytes of chunks and ids that a worker remembers; then it starts anew.
CACHE_BYTES = 32_000_000
THREADS = 2


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[i:i + n]
            i += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield tag >> 3, data[i:i + n]
            i += n
        else:
            raise ValueError(f"wire type {kind}")


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # text, score, kind
    kind: int = 1
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


# Fixed values of the SentencePiece format: model and piece kinds.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def parse_model(data: bytes) -> Model:
    m = Model()
    for number, value in wire_fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in wire_fields(value):
                if n == 1:
                    text = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((text, score, kind))
        elif number == 2:
            for n, v in wire_fields(value):
                if n == 3:
                    m.kind = v
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for n, v in wire_fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.squeeze = bool(v)
                elif n == 5:
                    m.escape = bool(v)
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, best score first."""
    rank = {p: s for p, s, k in m.pieces if k in (NORMAL, USER, UNUSED)}
    found = [(-s, a, p[:a], p[a:]) for p, s in rank.items() for a in range(1, len(p)) if p[:a] in rank and p[a:] in rank]
    return [(x, y) for _, _, x, y in sorted(found)]


def build_tokenizer(m: Model):
    """A tokenizer for chunks whose spaces are metaspaces already."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if m.kind == BPE:
        unk = next((p for p, _, k in m.pieces if k == UNKNOWN), None)
        model = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(m.pieces)}, merges=merges(m), unk_token=unk, fuse_unk=True, byte_fallback=m.byte_fallback, cache_capacity=0)
    elif m.kind == UNIGRAM:
        unk_id = next((i for i, (_, _, k) in enumerate(m.pieces) if k == UNKNOWN), None)
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=unk_id, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"model kind {m.kind}")
    t = Tokenizer(model)
    steps = ([normalizers.Precompiled(m.charsmap)] if m.charsmap else []) + ([normalizers.Replace(Regex(MARK + "{2,}"), MARK)] if m.squeeze else [])
    if steps:
        t.normalizer = normalizers.Sequence(steps)
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return t


class Codec:
    """Encodes and decodes texts in one worker. Chunks met before are remembered, up to about ``cache`` bytes."""

    def __init__(self, data: bytes, threads: int = THREADS, parity: bool = True, cache: int = CACHE_BYTES) -> None:
        self.cache = cache
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = parse_model(data)
        self.tokenizer = build_tokenizer(self.model)
        self.separable = not self.model.charsmap and not self.model.squeeze and self.model.escape and self.model.dummy_prefix and not any(MARK in p.lstrip(MARK) for p, _, _ in self.model.pieces)
        self.other = None
        if parity:
            import sentencepiece

            self.other = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.reset()

    def reset(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.starts, self.used = np.zeros(1 << 16, np.int32), array("q", [0]), 0  # ids of chunk k: from starts[k] to starts[k + 1]
        self.wrong: dict[int, tuple[bool, bool]] = {}  # chunks that don't round trip or agree
        self.bytes = 0

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.separable:
            line = " ".join(text.split(" ")).strip(" ") if self.model.squeeze else text
            return [(" " if self.model.dummy_prefix else "") + line] if line else []
        return re.findall(r" *[^ ]+| +", " " + text)

    def learn(self, chunks: list[str]) -> None:
        """Encodes chunks not met before, in batches, and checks each."""
        for lo in range(0, len(chunks), 4096):
            some = chunks[lo:lo + 4096]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([c.replace(" ", MARK) for c in some], add_special_tokens=False)]
            back = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
            theirs = self.other.encode([c[1:] if self.model.dummy_prefix else c for c in some], num_threads=1) if self.other else ids
            if self.other and self.model.dummy_prefix:  # a space at a text's end is a chunk that the library has no text for
                theirs = [[self.other.piece_to_id(MARK)] if c == " " else o for c, o in zip(some, theirs)]
            total = sum(map(len, ids))
            if self.used + total > len(self.ids):
                self.ids = np.concatenate([self.ids[:self.used], np.zeros(self.used + 2 * total, np.int32)])
            self.ids[self.used:self.used + total] = [i for x in ids for i in x]
            for c, i, b, o in zip(some, ids, back, theirs):
                if b != c or i != o:
                    self.wrong[len(self.place)] = b == c, i == o
                self.place[c] = len(self.place)
                self.used += len(i)
                self.starts.append(self.used)
            self.bytes += sum(map(len, some)) + 8 * total + 220 * len(some)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool, bool]]:
        """ids, whether decoding gives the text again, and whether the SentencePiece library agrees.

        Chunks are cut before metaspaces, where pieces and bytes end, so that a text decodes to its chunks' texts.
        """
        out, lo = [], 0
        while lo < len(texts):
            hi, size, parts = lo, 0, []
            while hi < len(texts) and (hi == lo or size < 500_000):  # bounded batches
                parts.append(self.chunks(texts[hi]))
                size += len(texts[hi])
                hi += 1
            if self.bytes > self.cache:
                self.reset()
            self.learn(list({c: None for p in parts for c in p if c not in self.place}))
            starts = np.frombuffer(self.starts, np.int64).copy()
            for p in parts:
                at = np.fromiter(map(self.place.__getitem__, p), np.int64, len(p))
                size_of = starts[at + 1] - starts[at]
                begin = np.cumsum(size_of) - size_of
                ids = self.ids[np.arange(int(size_of.sum())) + np.repeat(starts[at] - begin, size_of)]
                odd = [self.wrong[i] for i in set(at.tolist()) & self.wrong.keys()] if self.wrong else []
                out.append((ids, all(x for x, _ in odd), all(x for _, x in odd)))
            lo = hi
        return out

    def text_of(self, line: str) -> str:
        return line[1:] if self.model.dummy_prefix and line.startswith(" ") else line

    def decode(self, ids: list[int]) -> str:
        return self.text_of(self.tokenizer.decode(list(ids), skip_special_tokens=False))


def worker_codec(data: bytes, threads: int, parity: bool, cache: int = CACHE_BYTES) -> Codec:
    return worker_object(("codec", zlib.crc32(data), len(data), threads, parity, cache), lambda: Codec(data, threads, parity, cache))


def encode(docs: DataFrame, model: bytes, *, threads: int = THREADS, parity: bool = True, cache: int = CACHE_BYTES) -> DataFrame:
    """docs with ids, n_tokens, ids_crc32 (of 32-bit little-endian ids), round_trip and parity.

    model is the model file's content: a few hundred kB, sent to each worker once.
    """
    kinds = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "ids_crc32": T.LongType(), "round_trip": T.BooleanType(), "parity": T.BooleanType()}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> list:
        got = worker_codec(shared.value, threads, parity, cache).encode([t or "" for t in texts])
        ends = np.cumsum([0, *[len(g[0]) for g in got]]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([g[0] for g in got])))
        return [ids, np.diff(ends).astype(np.int64), [zlib.crc32(g[0].astype("<i4").tobytes()) for g in got], [g[1] for g in got], [g[2] for g in got]]

    return mapped(docs, "text", docs.columns, [T.StructField(free_name(docs, k), t) for k, t in kinds.items()], run, limit=1_000_000, keeps=True)


def decode(encoded: DataFrame, model: bytes, *, ids: str = "ids", threads: int = THREADS) -> DataFrame:
    """The columns of encoded, without the ids, with the text that they stand for; null ids give a null text."""
    name = free_name(encoded.drop(ids), "text")
    schema = T.StructType([f for f in encoded.schema if f.name != ids] + [T.StructField(name, T.StringType())])
    rest = [f.name for f in encoded.schema if f.name != ids]
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            codec = worker_codec(shared.value, threads, False)
            for lo in range(0, len(whole), 256):
                part = whole.slice(lo, 256)
                rows = part.column(ids).to_pylist()
                back = codec.tokenizer.decode_batch([x or [] for x in rows], skip_special_tokens=False)
                texts = pa.array([None if x is None else codec.text_of(t) for x, t in zip(rows, back)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in rest] + [texts], names=schema.names)

    return encoded.mapInArrow(run, schema)
