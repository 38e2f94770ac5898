"""Token counts kept as delta-maintained rollups.

Counts of documents become signed changes: an insert adds its count, a delete takes it away, a revision adds the
difference of the new count and the old. A batch of changes is summed by source, language and tokenizer version
before it is stored; totals are the sums over committed batches. A batch counts by its manifest, which appears whole
or not at all and only once, so failed attempts, retries, repeated sends, lost executors and new drivers change nothing.

Defined results: null texts count 0 tokens; null sources and languages are groups of their own; a null count is 0;
unknown operations raise; groups whose documents and tokens are both 0 leave the totals; repeated rows in a batch are
separate changes; empty batches add nothing; columns beyond those named are ignored.
"""

from __future__ import annotations

import base64
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, word_count, written

KEYS = ["source", "lang", "version"]
PIECES_1 = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"
PIECES_2 = r"[A-Za-z\x{C0}-\x{24F}]+|[0-9]+|[^A-Za-z0-9\x{C0}-\x{24F}\x20\x09-\x0D]"


def words(text: Column) -> Column:
    return word_count(text)


def pieces(text: Column, pattern: str = PIECES_1) -> Column:
    """Runs of letters, runs of digits, and single other characters."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long")


def bpe_counts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """docs with n_tokens by a byte-level BPE given as a file of ranks that every executor can read."""
    spark = docs.sparkSession
    ranks = {base64.b64decode(r["value"].split(" ")[0]): int(r["value"].split(" ")[1]) for r in spark.read.text(ranks_path).collect()}  # a vocabulary
    shared = spark.sparkContext.broadcast(ranks)

    def coder():
        import tiktoken

        one = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={}).encode_ordinary
        return lambda texts: [[len(one(t or "")) for t in texts]]

    coder.per_task = True
    return mapped(docs, "text", ["doc_id", "source", "lang"], [T.StructField("n_tokens", T.LongType())], coder)


def changes(rows: DataFrame, op: str, version: str, tokens: Column, old_tokens: Column | None = None) -> DataFrame:
    """Change rows of one kind from a table with doc_id, source and lang."""
    old = F.lit(None).cast("long") if old_tokens is None else old_tokens
    return rows.select(F.lit(op).alias("op"), "doc_id", "source", "lang", F.lit(version).alias("version"), tokens.cast("long").alias("n_tokens"), old.cast("long").alias("old_tokens"))


def signed(batch: DataFrame) -> DataFrame:
    """Change rows -> additive totals of the batch: docs and tokens by source, language and version."""
    n, old, op = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0)), F.col("op")
    unknown = F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce(op, F.lit("null"))))
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(unknown)
    tokens = F.when(op == "insert", n).when(op == "delete", -n).when(op == "revise", n - old).otherwise(unknown)
    return batch.select(*KEYS, docs.cast("long").alias("d"), tokens.cast("long").alias("t")).groupBy(*KEYS).agg(F.sum("d").alias("docs"), F.sum("t").alias("tokens"))


class Rollup:
    """Totals in a folder that all executors share.

    Each commit writes its totals to a folder of its own, then publishes one small manifest that names it under the
    batch's id. A batch counts once its manifest is there: a commit that fails before leaves nothing that is read, and a
    known id is left as it is. A manifest is renamed into its place, which succeeds for one of several committers. The
    list of batches is read from the folder, so it outlives the driver.
    """

    SCHEMA = "source string, lang string, version string, docs long, tokens long"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> dict[str, str]:
        """Committed batch ids and the folders that hold their totals."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return {}
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        done = [x for x in names if x.endswith(".manifest")]
        if not done:
            return {}
        rows = self.spark.read.text([f"{self.root}/manifests/{x}" for x in done], wholetext=True).collect()  # a line for each batch
        return {bytes.fromhex(x).decode(): attempt for attempt, *ids in (r["value"].split("\n") for r in rows) for x in ids}

    def commit(self, batch_id: str, batch: DataFrame) -> bool:
        """Stores the batch's totals under its id; False if the id is committed already."""
        if batch_id in self.batches():
            return False
        attempt = uuid.uuid4().hex
        signed(batch).write.mode("error").parquet(f"{self.root}/data/{attempt}")
        return self._publish(batch_id.encode().hex(), [batch_id], attempt)

    def _publish(self, name: str, batch_ids: list[str], attempt: str) -> bool:
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        draft = self._path(f"{self.root}/manifests/{attempt}.draft")
        out = self._fs.create(draft, False)
        out.write(bytearray("\n".join([attempt, *[x.encode().hex() for x in batch_ids]]).encode()))
        out.close()
        place = self._path(f"{self.root}/manifests/{name}.manifest")
        done = not self._fs.exists(place) and self._fs.rename(draft, place)
        if not done:
            self._fs.delete(draft, False)
        return bool(done)

    def totals(self) -> DataFrame:
        known = self.batches()
        if not known:
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.root}/data/{x}" for x in sorted(set(known.values()))])
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def compact(self, into: str) -> "Rollup":
        """A rollup in another folder that holds this one's totals under the same batch ids, so that they stay known."""
        other = Rollup(self.spark, into)
        known = sorted(self.batches())
        if known and not other.batches():
            attempt = uuid.uuid4().hex
            self.totals().write.parquet(f"{other.root}/data/{attempt}")
            other._publish("compact", known, attempt)
        return other


def maintained(docs: DataFrame, root: str) -> DataFrame:
    """Three batches over all documents, one of them sent twice: inserts of two versions, revisions, deletes.

    Batch 1 inserts every document under ``words-1`` and ``pieces-1``; batch 2 revises ``pieces-1`` to the counts of a
    pattern that keeps accented letters together, for each document whose count that changes; batch 3 deletes documents
    under 20 words from both versions.
    """
    text = F.col("text")
    base = docs.select("doc_id", "source", "lang", words(text).alias("w"), pieces(text).alias("p"), pieces(text, PIECES_2).alias("p2"))
    base = written(base, "token-counts")
    rollup = Rollup(docs.sparkSession, root)
    rollup.commit("1", changes(base, "insert", "words-1", F.col("w")).unionByName(changes(base, "insert", "pieces-1", F.col("p"))))
    revised = changes(base.where("p2 <> p"), "revise", "pieces-1", F.col("p2"), F.col("p"))
    rollup.commit("2", revised)
    short = base.where("w < 20")
    rollup.commit("3", changes(short, "delete", "words-1", F.col("w")).unionByName(changes(short, "delete", "pieces-1", F.col("p2"))))
    rollup.commit("2", revised)
    return rollup.totals()


MAINTAINED_SQL = r"""
WITH counted AS (
  SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w,
         len(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{24F}]+|[0-9]+|[^A-Za-z0-9\x{C0}-\x{24F}\x20\x09-\x0D]')) AS p
  FROM documents),
kept AS (SELECT * FROM counted WHERE w >= 20),
long AS (SELECT source, lang, 'words-1' AS version, w AS n FROM kept UNION ALL SELECT source, lang, 'pieces-1', p FROM kept)
SELECT source, lang, version, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM long GROUP BY ALL
"""
