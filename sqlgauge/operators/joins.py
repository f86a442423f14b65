"""Joins that stay balanced whatever the keys hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 16
_FIXED_WIDTH = 16


def measured_bytes(df: DataFrame) -> int:
    """Bytes of a stored frame, uncompressed: one narrow aggregation over it."""
    width = F.lit(_FIXED_WIDTH * len(df.columns)).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            text = F.to_json(F.struct(F.col(f.name)))
            width = width + F.coalesce(F.octet_length(text), F.lit(0))
    return df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]


def if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A stored frame, marked for broadcast if its measured size allows it."""
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    salt_by: str,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Inner join of a long ``left`` with a stored, usually much smaller ``right``.

    ``right`` is broadcast if its measured size allows it, which leaves ``left``
    where it is. Otherwise the rows of one key are split over ``SALTS`` tasks by
    the column ``salt_by`` of ``left``, and ``right`` is repeated for each.
    """
    if measured_bytes(right) <= limit:
        return left.join(F.broadcast(right), on)
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(salts)).hint("merge")
    return salted.join(repeated, [*on, "_salt"]).drop("_salt")
