"""From raw documents to token ids: five stages, each by one operator of ``sqlgauge.llm``.

Each stage is written as Parquet to the shared folder and read back for the next. All but the
last return the columns of ``documents``; texts that a stage changes get a new ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.llm import bpe, decontam, language, lines, near
from sqlgauge.llm.common import store
from sqlgauge.llm.queries import PATTERN, VOCABULARY

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# The model of the language stage and the token ids are Python's; SQL has no function for them
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without any recognisable language (null texts, or no letter at all).

    A missing ``lang`` is filled with the predicted one; a given one stays.
    """
    docs = docs.select(*COLUMNS)
    named = language.predict_languages(docs, language.sample_texts(docs))
    kept = named.where(F.col("_lang.lang_pred") != language.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "_lang.lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; every document stays, if need be empty."""
    kept = lines.drop_repeated_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates (five-word shingles, 0.8)."""
    return near.keep_one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.drop_contaminated(docs.select(*COLUMNS), benchmark).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the text as decoded from them."""
    coded = bpe.round_trip(docs.select(*COLUMNS), VOCABULARY, PATTERN)
    return coded.select(
        "doc_id",
        F.col("_code.decoded").cast("string").alias("text"),
        "lang",
        "source",
        "n_chars",
        "_code.ids",
        F.size("_code.ids").cast("long").alias("n_tokens"),
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
