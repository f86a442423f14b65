"""Readers of the text and JSON formats the samples, schemas and results use.

A JSON array or map is one document, which one task has to parse; the readers
therefore also take JSON Lines, where a file of any size is split over tasks.
Line formats get their index from :func:`with_line_index`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sqlgauge.functions.text import strip
from sqlgauge.functions.wordlists import MISSING_PREDICTION, PREDICTION_DELIMITER
from sqlgauge.session import materialise
from sqlgauge.sources.catalog import TABLES_JSON_FIELDS


def with_line_index(lines: DataFrame, name: str = "sql_idx") -> DataFrame:
    """Number the lines of a freshly read text frame, first file and line first.

    Two passes over the files: the first counts the lines of each file block, one row per block;
    the second adds the lines of all earlier blocks to a line's place in its own. A task reads a
    block from front to back, so that place is the distance to the block's first row id, and no
    line moves. Only the blocks, one row for each split of the input, are put in order.
    """
    block = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    marked = lines.select("*", block.alias("_block"), F.monotonically_increasing_id().alias("_row"))
    named = lines.select(
        block.alias("_block"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
    )
    blocks = materialise(
        named.groupBy("_file", "_start", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first")),
        "blocks",
    )
    before = W.orderBy("_file", "_start").rowsBetween(W.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("_n").over(before), F.lit(0))
    offsets = blocks.select("_block", (earlier - F.col("_first")).alias("_offset"))
    return (
        marked.join(F.broadcast(offsets), "_block")
        .withColumn(name, F.col("_row") + F.col("_offset"))
        .drop("_block", "_row", "_offset")
    )


def read_lines(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(sql_idx, <column>): one entry per line."""
    return with_line_index(spark.read.text(path)).select(
        "sql_idx", strip(F.col("value")).alias(column)
    )


def read_sql_lines(spark: SparkSession, path: str) -> DataFrame:
    """Draft or corrected SQL, one statement per line."""
    return read_lines(spark, path, "predicted_sql")


def _json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parse each whole file as one JSON value; column ``doc``."""
    return spark.read.text(path, wholetext=True).select(
        F.from_json("value", schema).alias("doc")
    )


_SAMPLE_DDL = (
    "struct<sql_idx:bigint,db_id:string,question:string,query:string,"
    "evidence:string,difficulty:string>"
)


def read_questions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Samples keyed by ``sql_idx``: their own, else their place in the input.

    The gold query may be stored under ``query`` or ``SQL``.
    """
    if lines:
        rows = with_line_index(spark.read.text(path), "place").select(
            "place", F.from_json("value", _SAMPLE_DDL).alias("s"), F.col("value").alias("raw")
        )
    else:
        raw = spark.read.text(path, wholetext=True).select(
            F.posexplode(F.from_json("value", "array<string>")).alias("place", "raw")
        )
        rows = raw.select("place", "raw", F.from_json("raw", _SAMPLE_DDL).alias("s"))
    return rows.select(
        F.coalesce("s.sql_idx", F.col("place").cast("long")).alias("sql_idx"),
        "s.db_id",
        "s.question",
        "s.evidence",
        "s.difficulty",
        F.coalesce("s.query", F.get_json_object("raw", "$.SQL")).alias("gold_sql"),
    )


def _placed_documents(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    """(sql_idx, doc): the entries of a JSON array, or of JSON Lines, by place in the input."""
    if lines:
        rows = with_line_index(spark.read.text(path))
        return rows.select("sql_idx", F.from_json("value", schema).alias("doc"))
    docs = _json_document(spark, path, f"array<{schema}>")
    return docs.select(F.posexplode("doc").alias("place", "doc")).select(
        F.col("place").cast("long").alias("sql_idx"), "doc"
    )


def read_natsql(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(sql_idx, natsql), by place in the input."""
    docs = _placed_documents(spark, path, "struct<NatSQL:string>", lines)
    return docs.select("sql_idx", strip(F.col("doc.NatSQL")).alias("natsql"))


def read_tables_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Catalog records; mixed index/name arrays are read as text."""
    return spark.read.schema(TABLES_JSON_FIELDS).json(path, multiLine=not lines)


def read_column_schema(spark: SparkSession, path: str) -> DataFrame:
    """(table_name, column_names) of the short schema format."""
    schema = "struct<table:string,col_data:array<struct<column_name:string>>>"
    docs = _json_document(spark, path, f"array<{schema}>")
    return docs.select(F.explode("doc").alias("t")).select(
        F.lower("t.table").alias("table_name"),
        F.transform("t.col_data", lambda c: F.lower(c["column_name"])).alias("column_names"),
    )


def read_descriptions(spark: SparkSession, db_path: str) -> DataFrame:
    """Column descriptions: ``<db>/database_description/<table>.csv``, latin-1.

    Cells are taken by position: column, value description, column description.
    """
    fields = "c0 string, c1 string, c2 string"
    rows = spark.read.csv(
        f"{db_path}/*/database_description/*.csv",
        schema=fields,
        encoding="ISO-8859-1",
        header=False,
        multiLine=True,
        quote='"',
        escape='"',
        mode="PERMISSIVE",
        enforceSchema=True,
    )
    place = F.col("_metadata.file_path")
    pattern = r"([^/]+)/database_description/([^/]+)\.csv$"
    tabbed = lambda c: F.coalesce(F.replace(c, F.lit("\n"), F.lit("\t")), F.lit(""))
    return (
        rows.select(
            F.url_decode(F.regexp_extract(place, pattern, 1)).alias("db_id"),
            F.lower(F.url_decode(F.regexp_extract(place, pattern, 2))).alias("table_name"),
            "c0",
            tabbed(F.col("c2")).alias("column_description"),
            tabbed(F.col("c1")).alias("value_description"),
        )
        .where(F.ltrim(F.col("c0"), F.lit("﻿ï»¿")) != "original_column_name")
        .withColumn("column_name", F.lower("c0"))
        .drop("c0")
        .dropDuplicates(["db_id", "table_name", "column_name"])
    )


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(sql_idx, gold_sql, db_id): split on the last tab, so SQL may hold tabs."""
    line = read_lines(spark, path, "line")
    return line.select(
        "sql_idx",
        F.regexp_extract("line", r"(?s)^(.*)\t[^\t]*$", 1).alias("gold_sql"),
        F.regexp_extract("line", r"\t([^\t]*)$", 1).alias("db_id"),
    )


def read_predictions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(sql_idx, predicted_sql, db_id) from JSON maps of index to text.

    An entry that is not text stands for a missing prediction.
    """
    docs = spark.read.text(path, wholetext=not lines)
    entries = docs.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v"))
    parts = F.split("v", PREDICTION_DELIMITER)
    is_pair = F.col("v").isNotNull() & F.col("v").contains(PREDICTION_DELIMITER)
    return entries.select(
        F.col("k").cast("long").alias("sql_idx"),
        F.when(is_pair, parts[0]).otherwise(MISSING_PREDICTION[0]).alias("predicted_sql"),
        F.when(is_pair, parts[1]).otherwise(MISSING_PREDICTION[1]).alias("db_id"),
    )


def read_train_sql(spark: SparkSession, path: str, mode: str = "generate") -> DataFrame:
    """Training SQL: plain lines (``generate``) or ``sql <tab> db_id`` (``gt``)."""
    if mode == "generate":
        return read_sql_lines(spark, path)
    if mode == "gt":
        return read_gold(spark, path)
    raise ValueError("mode must be 'generate' or 'gt'")


def read_selected_schema(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(sql_idx, used): {table: [columns]} selections, in input order."""
    docs = _placed_documents(spark, path, "map<string,array<string>>", lines)
    return docs.select(
        "sql_idx",
        F.transform(
            F.map_entries("doc"),
            lambda e: F.struct(e["key"].alias("table_name"), e["value"].alias("columns")),
        ).alias("used"),
    )
