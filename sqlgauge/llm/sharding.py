"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Rows are numbered 0..n-1 in the order of their key (ties: hash of the text). The number is
split into two digits of a mixed-radix product a*b just above n; a few Feistel rounds permute
the product, and values of n or more walk the cycle until they fall below n. The permuted
number gives the shard (remainder) and the slot (quotient), so shard sizes differ by at most
one row, slots have no gaps, and ``place`` computes both for any row number.

Nulls: a null key sorts first; a null text has size 16 and CRC 0. Repeated rows each get a
slot of their own; which of several equal rows gets which is not defined, as they are equal.
An empty table gives an empty result. Only key, size and checksum move, never texts.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, store

PRIME = 2**31 - 1
ROUNDS = 4
_WALK = 64  # a*b exceeds n by a part of about 1/sqrt(n), so longer walks do not occur
_INDEX_BITS = 33  # monotonically_increasing_id() keeps the row of a partition in these


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Multiplier and two addends of each round."""
    draw = random.Random(seed)
    return [tuple(draw.randrange(1, PRIME) for _ in range(3)) for _ in range(ROUNDS)]


def radices(n: int) -> tuple[int, int]:
    """The least a >= sqrt(n) and b with a*b >= n."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def place(number: int, n: int, shards: int, seed: int = 7) -> tuple[int, int]:
    """Shard and slot of one row number, without any table."""
    a, b = radices(n)
    keys = round_keys(seed)
    while True:
        left, right = divmod(number, b)
        for i, (m, c, d) in enumerate(keys):
            if i % 2 == 0:
                left = (left + _scatter(right, m, c, d)) % a
            else:
                right = (right + _scatter(left, m, c, d)) % b
        number = left * b + right
        if number < n:
            return number % shards, number // shards


def _scatter(x, m: int, c: int, d: int):
    t = (x % PRIME * m + c) % PRIME
    return (t * t + d) % PRIME


def _permuted(number: Column, n: int, seed: int) -> Column:
    a, b = radices(n)
    left, right = _div(number, b), number % F.lit(b)
    for i, (m, c, d) in enumerate(round_keys(seed)):
        if i % 2 == 0:
            left = (left + _scatter(right, m, c, d)) % F.lit(a)
        else:
            right = (right + _scatter(left, m, c, d)) % F.lit(b)
    return left * F.lit(b) + right


def _div(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by).cast("long"))


def number_rows(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """``rows`` with a gapless ``row_number`` from 0 in the given order, and their count.

    The sorted partitions are stored before they are counted, so numbers stay the same if an
    executor is lost. Equal rows may be split over partitions; their order is arbitrary.
    """
    spark = rows.sparkSession
    spread = rows.withColumn("_any", F.monotonically_increasing_id())
    placed = store(
        spread.repartitionByRange(partitions(spark), *order, "_any")
        .sortWithinPartitions(*order, "_any")
        .drop("_any")
        .withColumn("_at", F.monotonically_increasing_id()),
        name,
    )
    part = F.shiftright("_at", _INDEX_BITS).alias("_part")
    # one row per partition, whatever the number of rows
    counts = {r[0]: r[1] for r in placed.groupBy(part).count().collect()}
    start, n = {}, 0
    for p in sorted(counts):
        start[p] = n
        n += counts[p]
    if not n:
        return placed.select(*rows.columns, F.lit(0).cast("long").alias("row_number")), 0
    offsets = spark.createDataFrame(sorted(start.items()), "_part long, _start long")
    numbered = placed.withColumn("_part", F.shiftright("_at", _INDEX_BITS)).join(
        F.broadcast(offsets), "_part"
    )
    index = F.col("_at").bitwiseAND(F.lit(2**_INDEX_BITS - 1))
    return numbered.select(*rows.columns, (F.col("_start") + index).alias("row_number")), n


def assign_shards(
    docs: DataFrame, shards: int = 40, seed: int = 7, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard, row_number."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + F.lit(16)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("_tie"),
    )
    numbered, n = number_rows(rows, [key, "_tie"], "shard-rows")
    mixed = numbered.withColumn("_to", _permuted(F.col("row_number"), n, seed))
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(_WALK)),
        F.col("_to"),
        lambda at, _: F.when(at < F.lit(n), at).otherwise(_permuted(at, n, seed)),
    )
    final = mixed.withColumn("_to", F.when(F.col("_to") < F.lit(n), F.col("_to")).otherwise(walked))
    return final.select(
        key,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_to") % F.lit(shards)).cast("int").alias("shard"),
        _div(F.col("_to"), shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


def shards_sql(shards: int = 40, seed: int = 7) -> str:
    """The same assignment in SQL, with the cycle walk as a recursive query."""

    def step(number: str, source: str) -> str:
        inner = f"SELECT *, {number} // b AS l, {number} % b AS r FROM {source}"
        for i, (m, c, d) in enumerate(round_keys(seed)):
            own, other, base = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
            t = f"(({other} % {PRIME} * {m} + {c}) % {PRIME})"
            new = f"({own} + ({t} * {t} + {d}) % {PRIME}) % {base}"
            inner = f"SELECT * REPLACE ({new} AS {own}) FROM ({inner})"
        return inner

    return f"""
WITH RECURSIVE polynomial AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)),
sized AS (
  SELECT doc_id, (strlen(coalesce(text, '')) + 16)::BIGINT AS size,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
           regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: ('0x' || h)::BIGINT)),
           lambda c, x: xor(t[1 + (xor(c, x) & 255)], c >> 8))) AS text_crc32,
         row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS row_number FROM documents, polynomial),
total AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM documents),
base AS (SELECT n, a, ((n + a - 1) // a)::BIGINT AS b FROM total),
walk AS (
  SELECT row_number, (l * b + r)::BIGINT AS num, n, a, b
  FROM ({step("row_number", "(SELECT row_number, n, a, b FROM sized, base)")})
  UNION ALL
  SELECT row_number, (l * b + r)::BIGINT, n, a, b
  FROM ({step("num", "(SELECT row_number, num, n, a, b FROM walk WHERE num >= n)")})
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (num % {shards})::INTEGER AS shard,
       num // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard, row_number
FROM sized JOIN walk USING (row_number) WHERE num < n
"""
