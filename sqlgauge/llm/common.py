"""Helpers shared by the operators: stored frames, byte views of text, word hashes."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
LEAST_LONG = -(2**63)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local sessions."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_sqlgauge_folder", None)
    if folder:
        return folder
    if not context.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    # Spark does not let a running session change the setting itself
    folder = context._sqlgauge_folder = tempfile.mkdtemp(prefix="sqlgauge-")
    return folder


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The files are removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._place = place
    return stored


def release(*frames: DataFrame) -> None:
    """Delete stored frames that no later step reads, and let Spark drop finished shuffles."""
    for df in frames:
        context = df.sparkSession.sparkContext
        df._place.getFileSystem(context._jsc.hadoopConfiguration()).delete(df._place, True)
    gc.collect()
    SparkSession.active().sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Hand at most ``rows`` rows at a time to Python, whatever the length of their texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def partitions(spark: SparkSession) -> int:
    """Partitions for an explicit repartitioning."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and their n+1 offsets; null counts as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(texts: pa.Array, limit: int = 1 << 21):
    """Slices of consecutive rows with about ``limit`` bytes each (one long text may have more)."""
    _, offsets = utf8(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield texts.slice(at, to - at)
        at = to


def byte_table(*kept) -> np.ndarray:
    """True for each byte value named or contained in a named range."""
    table = np.zeros(256, bool)
    for k in kept:
        table[k] = True
    return table


SPACES = byte_table(*SPACE_BYTES)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of True; no run crosses a row's end."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the information of 64-bit values over all their bits."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        back = np.uint64(pow(int(_BASE), -1, 2**64))
        one = np.ones(1, np.uint64)
        _powers = tuple(
            np.concatenate([one, np.cumprod(np.full(size - 1, x, np.uint64))]) for x in (_BASE, back)
        )
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal bytes at any place."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


WORD_BYTES = byte_table(
    range(ord("a"), ord("z") + 1), range(ord("A"), ord("Z") + 1), range(ord("0"), ord("9") + 1), range(0x80, 0x100)
)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and the row of each.

    A word is a longest run of ASCII letters, digits and bytes of other characters.
    """
    data, offsets = utf8(texts)
    starts, ends, row = runs(WORD_BYTES[data], offsets)
    return span_hashes(LOWER[data], starts, ends), row
