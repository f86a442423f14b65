"""Writers of the result formats. All write through Spark, one file per task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlgauge.functions.text import unconcat
from sqlgauge.functions.wordlists import PREDICTION_DELIMITER


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON Lines; ``mode='ignore'`` skips a finished output."""
    df.write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_ordered_lines(df: DataFrame, column: str, path: str, key: str = "sql_idx") -> None:
    """One line per row in key order: part files concatenate to the whole text."""
    one_line = F.regexp_replace(F.col(column), r"[\r\n]+", " ")
    ordered = df.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    ordered.select(one_line.alias("value")).write.mode("overwrite").text(path)


def gold_lines(samples: DataFrame) -> DataFrame:
    """(sql_idx, line) with ``gold_sql <tab> db_id``; incomplete samples are left out.

    The index stays with the line, so leaving a sample out moves no other.
    """
    complete = samples.where(F.col("gold_sql").isNotNull() & F.col("db_id").isNotNull())
    return complete.select("sql_idx", F.concat_ws("\t", "gold_sql", "db_id").alias("line"))


def merge_predictions(predictions: DataFrame, samples: DataFrame) -> DataFrame:
    """(sql_idx, entry): each prediction with the database of its sample."""
    texts = predictions.select("sql_idx", "predicted_sql")
    return texts.join(samples.select("sql_idx", "db_id"), "sql_idx").select(
        "sql_idx",
        F.concat(
            unconcat(F.trim(F.col("predicted_sql"))), F.lit(PREDICTION_DELIMITER), F.col("db_id")
        ).alias("entry"),
    )


def write_predictions(entries: DataFrame, path: str) -> None:
    """JSON Lines of ``{"<index>": "<sql> <delimiter> <db_id>"}``, in index order."""
    ordered = entries.repartitionByRange(F.col("sql_idx")).sortWithinPartitions("sql_idx")
    line = F.to_json(F.create_map(F.col("sql_idx").cast("string"), F.col("entry")))
    ordered.select(line.alias("value")).write.mode("overwrite").text(path)
