"""The registered query of each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    decontam,
    embeddings,
    html,
    language,
    lines,
    mining,
    mixing,
    sharding,
    simhash,
    substrings,
    toxicity,
    whitening,
)

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    held = language.held_out("doc_id", 3, 1)
    samples = language.sample_texts(docs.where(~held))
    named = language.predict_languages(docs.select("doc_id", "text"), samples)
    return named.select("doc_id", held.alias("held_out"), "_lang.lang_pred", "_lang.score")


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = substrings.remove_repeats(_table(spark, folder, "documents"))
    return cut.select(
        "doc_id", "n_bytes", "cut.n_removed", "cut.n_spans", F.sha2("cut.kept", 256).alias("kept_sha256")
    )


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    held = language.held_out("doc_id", 5, 0)
    model = toxicity.fit(docs, _table(spark, folder, "labels").where(~held))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        held.alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_report(_table(spark, folder, "documents"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document and benchmark item that it holds."""
    docs = _table(spark, folder, "documents")
    return decontam.contaminated(docs, _table(spark, folder, "benchmark"))


def op6_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, folder, "embeddings"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return bpe.digests(docs, VOCABULARY, PATTERN).select("doc_id", "_code.*")


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, folder, "documents"))


def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url", "html")
    return html.extract(pages).select(
        "page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars")
    )


def op11_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(_table(spark, folder, "documents"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh row bears a wrong label on purpose."""
    rows = _table(spark, folder, "embeddings")
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mining.hard_negatives(rows.withColumn("label", wrong))


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that SQL can express."""
    return {
        "op4_line_dedup": lines.LINE_REPORT_SQL,
        "op9_sharding": sharding.shards_sql(),
        "op11_source_mixing": mixing.mix_sql(),
        "op12_hard_negatives": mining.HARD_NEGATIVES_SQL,
    }
