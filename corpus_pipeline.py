"""Corpus pipeline over the operators of ``ledgerspark.llm``; each stage reads all that its predecessor kept.

1. Quality rules: documents that fail the base rule or a learned rule go.
2. Line dedup: lines that repeat an earlier line, within the edit limit, are cut; documents left without lines go.
3. SimHash near-dedup, completed by a banded MinHash join with exact verification: documents whose five-word shingles have
   Jaccard similarity 0.8 or more are linked; of each component one row, that of the smallest id, stays.
4. Mixing: each document stays as often as the mix takes it, up to three times, or goes.
5. SentencePiece: ids of each text.

A stage's result must be written before the next stage is called, as ``run`` does: tables and shuffles that a stage has made for itself go when the
next one starts. The written results stay in the shared folder until it is cleared.
Null texts fail the first stage; an empty table passes through all stages; columns beyond those of ``documents`` are kept
by the first three stages and the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import line_dedup, mixing, near_copies, quality_rules, sentencepiece_codec
from ledgerspark.llm.common import begin, documents, release, tokenizer_file, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin(spark)
    rules = quality_rules.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    prefix = "quality_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return quality_rules.judge(docs, rules, prefix).where(F.col(f"{prefix}kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark, docs)
    out = line_dedup.without_dropped_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark, docs)
    return near_copies.without_near_copies(docs, shingle=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark, docs)
    return mixing.mixed_rows(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark, docs)
    return sentencepiece_codec.encode(docs.select("doc_id", "source", "lang", "text"), tokenizer_file("piece_bpe_32k.model")).drop("text")


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("sentencepiece", encode_texts),
]

#: Learned rules, fingerprints and subword ids have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"), keep=True)
    return docs
