"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: White space that separates words: space and the five ASCII controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a temporary one only where it is unset."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="ledgerspark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Tables that operators have written in this thread, from the last ``release`` on.
_scratch = threading.local()


def written(df: DataFrame, label: str, *, keep: bool = False) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts the lineage, survives lost executors. keep: ``release`` leaves it."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    if not keep:
        _scratch.paths = [*getattr(_scratch, "paths", []), path]
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, still: DataFrame) -> None:
    """For callers that have written all results so far: deletes the tables that operators have left since ``begin``, and lets Spark's cleaner drop the shuffle files of work that is done.

    Tables that ``still`` reads stay; other frames that read a deleted one can't be used afterwards.
    """
    read = still.inputFiles()
    for path in getattr(_scratch, "paths", []):
        if any(f"/{path.rstrip('/').rsplit('/', 1)[-1]}/" in f for f in read):
            continue
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _scratch.paths = []
    released(spark)


def begin(spark: SparkSession) -> None:
    """From now on ``release`` deletes only what is written after this call. Whole texts go to Python in batches of a few MB, unless the session has its own bound."""
    _scratch.paths = []
    if spark.conf.get(BATCH_BYTES, "67108864") in ("67108864", "64MB", "67108864b"):
        spark.conf.set(BATCH_BYTES, "8388608")


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of work that is done and written, by collecting garbage on the driver."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: The one large object that a worker keeps between tasks, by its key.
_kept: dict[object, object] = {}


def worker_object(key: object, make: Callable[[], object]) -> object:
    """An object made once a worker; it takes the place of any other that the worker keeps."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def trimmed() -> None:
    """Gives memory that a task has freed back to the machine: workers outlive their tasks, and several of them wait in an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean() -> None:
    """Drops what an earlier operator keeps in this worker."""
    _kept.clear()
    trimmed()


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def word_list(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))


def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_RE))).cast("long")


_SPACE_BYTE = np.zeros(256, bool)
_SPACE_BYTE[[9, 10, 11, 12, 13, 32]] = True


def split_words(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words (large binary, A-Z lower-cased) of all texts, the word at each place (its number), and each text's number of words."""
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join(coded).lower() + b"\n", np.uint8)
    inside = ~_SPACE_BYTE[raw]
    first = np.flatnonzero(inside & np.r_[True, ~inside[:-1]])
    after = np.flatnonzero(inside & np.r_[~inside[1:], True]) + 1
    bound = np.searchsorted(first, np.cumsum([0, *(len(c) + 1 for c in coded)]))
    letters = raw[inside]
    offsets = np.r_[0, np.cumsum(after - first)]
    made = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    return made.dictionary, made.indices.to_numpy(), np.diff(bound)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it until no column of df clashes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def tokenizer_file(name: str, folder: str = "/opt/tokenizers") -> bytes:
    """Content of a public tokenizer's file, read once on the driver."""
    with open(f"{folder}/{name}", "rb") as f:
        return f.read()


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows whose texts have about ``limit`` bytes together; a longer text is a run of its own."""
    lo = size = 0
    for i, n in enumerate(x or 0 for x in pa.compute.binary_length(batch.column(column)).to_pylist()):
        if size and size + n > limit:
            yield batch.slice(lo, i - lo)
            lo, size = i, 0
        size += n
    if lo < len(batch):
        yield batch.slice(lo)


#: Bits of a filter that goes to the tasks: 8 MB, whatever the number of ids in it.
FILTER_BITS = 1 << 26


def id_filter(ids: DataFrame, column: str = "id"):
    """A broadcast filter of fixed size over hashes of a long column: all ids given pass it, and few others."""
    bit = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)) + 1
    parts = ids.select(bit.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()  # FILTER_BITS bits at most
    bits = bytearray(FILTER_BITS // 8)
    for r in parts:
        at = (r["b"] - 1) * 4096
        bits[at:at + 4096] = r["bits"]
    return ids.sparkSession.sparkContext.broadcast(bytes(bits))


def passes(bits: bytes, ids: np.ndarray) -> np.ndarray:
    """Which of the ids (longs) pass a filter. Their hashes are those of Spark's xxhash64."""
    one = np.ascontiguousarray(ids, "<i8")
    h = np.fromiter((xxhash.xxh64_intdigest(one[i:i + 1].tobytes(), 42) for i in range(len(one))), np.uint64, len(one))
    at = (h % np.uint64(FILTER_BITS)).astype(np.int64)
    return ((np.frombuffer(bits, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def filtered(df: DataFrame, column: str, shared, hit: bool = True) -> DataFrame:
    """Rows of df whose ids pass the filter, or those that don't; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            ok = passes(shared.value, batch.column(column).to_numpy())
            yield batch.filter(pa.array(ok if hit else ~ok))
        trimmed()

    return df.mapInArrow(run, df.schema)


def mapped(df: DataFrame, column: str, keep: list[str], fields: list[T.StructField], run: Callable[[list], list], *, limit: int = 4_000_000, keeps: bool = False) -> DataFrame:
    """The columns of df to keep, untouched as Arrow arrays (so that integers beside nulls stay exact), and new ones.

    run takes the column's values of a few rows, at most about ``limit`` bytes or one row, and returns a list of values
    for each of the fields. It is made once in each task by calling ``run()`` if it has the attribute ``per_task``. keeps: run uses a ``worker_object``.
    """
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            lean()
        work = run() if getattr(run, "per_task", False) else run
        for whole in parts:
            for part in slices(whole, column, limit):
                made = work(part.column(column).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(made, kinds)], names=schema.names)
        trimmed()

    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, column])]).mapInArrow(batches, schema)
