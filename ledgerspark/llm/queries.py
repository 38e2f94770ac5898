"""The registered queries of the corpus operators: thin calls with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, shared_path, tokenizer_file


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules as q

    docs = documents(spark, sf_dir)
    rules = q.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return q.judge(docs.select("doc_id", "text"), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "passes")


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import maintained

    return maintained(documents(spark, sf_dir), shared_path(spark, "token-rollup"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(documents(spark, sf_dir))


def op6_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score

    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(True))
    return score(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import hilbert_shards

    out = hilbert_shards(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op3_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_digests, store_texts

    return media_digests(store_texts(documents(spark, sf_dir)))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode

    return encode(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"), cache=128_000_000).drop("text")


def op9_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import learn, predict

    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    models = learn(docs, trainable=~held_out)
    return predict(docs, models).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op11_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .compression_quality import learn, score

    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), trainable=~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "by_sizes", "by_bytes")


def op12_suffix_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(documents(spark, sf_dir)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_bisected_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import build_index, search

    return search(build_index(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from .lexical_search import SQL as SEARCH_SQL
    from .mixing import SQL
    from .phrases import SQL as PHRASES_SQL
    from .token_counts import MAINTAINED_SQL

    return {"op2_source_mixing": SQL, "op4_token_rollup": MAINTAINED_SQL, "op12_suffix_phrases": PHRASES_SQL, "op13_bisected_search": SEARCH_SQL}
