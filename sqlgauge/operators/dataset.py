"""Sample sets: slices, chunks, resumption and merging, all by ``sql_idx``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slice_first(samples: DataFrame, n: int) -> DataFrame:
    """Samples ``0 .. n-1``. A predicate on the key, so any order of rows will do."""
    if n <= 0:
        raise ValueError("n must be positive")
    return samples.where(F.col("sql_idx") < n)


def with_chunk(samples: DataFrame, total: int, chunks: int) -> DataFrame:
    """Add ``chunk``: chunk i holds the samples ``i*total//chunks`` up to the next start."""
    chunk = F.expr(f"((sql_idx + 1) * {chunks} - 1) div {total}")
    return samples.withColumn("chunk", chunk.cast("int"))


def remaining(samples: DataFrame, done: DataFrame) -> DataFrame:
    """Samples without a finished row: resumption by key instead of by line count."""
    return samples.join(done.select("sql_idx"), "sql_idx", "left_anti")


def merge_in_order(*parts: DataFrame) -> DataFrame:
    """All parts in index order, range-partitioned for an ordered write."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.repartitionByRange("sql_idx").sortWithinPartitions("sql_idx")


def concatenate(*parts: DataFrame) -> DataFrame:
    """Rows of all parts; columns are matched by name."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole
