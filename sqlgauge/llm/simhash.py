"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

Each text gets a 64-bit fingerprint of its word shingles (XXH64, seed 42; a bit is set if it is
set in more than half of the shingle hashes, repeats counted). Two fingerprints that differ in at
most 3 bits differ in at most 3 of their 8 bytes, so they share at least ``LEAST_SHARED`` = 5
bytes at the same positions. Posting lists on one byte would hold a 256th of all fingerprints;
as any 5 of 8 positions contain 3 of the first four or 3 of the last four, the lists here are
those of three bytes at three positions out of one half (8 for each fingerprint), which no
linked pair can miss. Pairs that meet have all their shared positional bytes tallied, those with
fewer than 5 are dropped, the rest verified by their differing bits.

Equal fingerprints are one entry, so groups of copies never form pairs. In a long posting list a
breadth-first search emits only the links of a spanning forest, not all pairs.

Odd cases: null and blank texts have fingerprint zero and are linked like any other; a text of
fewer words than a shingle is one shingle. A null doc_id counts as smaller than all others, and
a component that reaches one has component_id null. Repeated rows all stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LEAST_LONG, LOWER, SPACES, partitions, pieces, runs, small_batches, store, utf8
from .components import connected_components

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 3
LEAST_SHARED = 8 - RADIUS
# any five of eight positions hold three of one half
POSITIONS = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
_FEW = 24


def shingle_spans(texts: pa.Array, size: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts joined by single spaces, with start, end and row of each shingle."""
    data, offsets = utf8(texts)
    inside = ~SPACES[data]
    starts, ends, row = runs(inside, offsets)
    length = ends - starts
    new_end = np.cumsum(length + 1) - 1
    new_start = new_end - length
    joined = np.full(int(new_end[-1]) + 1 if len(new_end) else 0, 0x20, np.uint8)
    at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(new_start, length)
    joined[at] = LOWER[data[inside]]
    count = np.bincount(row, minlength=len(texts))
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < size))
    begin = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :]) if len(row) >= size else np.zeros(0, np.int64)
    s = np.concatenate([new_start[begin], new_start[first[short]]])
    e = np.concatenate([new_end[begin + size - 1], new_end[first[short] + count[short] - 1]])
    r = np.concatenate([row[begin], short])
    order = np.argsort(r, kind="stable")
    return joined.tobytes(), s[order], e[order], r[order]


def fingerprints(texts: pa.Array, size: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit fingerprint of each text."""
    out = np.zeros(len(texts), np.uint64)
    raw, s, e, row = shingle_spans(texts, size)
    if not len(row):
        return out
    one = xxhash.xxh64_intdigest
    h = np.fromiter((one(raw[a:b], SEED) for a, b in zip(s.tolist(), e.tolist())), np.uint64, len(s))
    heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    total = np.diff(np.concatenate([heads, [len(row)]]))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.zeros((len(heads), 64), np.int64)
    for k, (a, n) in enumerate(zip(heads.tolist(), total.tolist())):
        ones[k] = bits[a : a + n].sum(0, dtype=np.int32)
    packed = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little")
    out[row[heads]] = np.ascontiguousarray(packed).view(np.uint64).ravel()
    return out


def fingerprint_column(text: str, size: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a long with the same bits."""

    @F.arrow_udf(T.LongType())
    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [fingerprints(p, size) for p in pieces(batch, 1 << 20)]
            yield pa.array((np.concatenate(parts) if parts else np.zeros(0, np.uint64)).view(np.int64))

    return make(F.col(text))


def _matches(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Pairs with enough shared positional bytes whose differing bits are then counted."""
    differs = x ^ y
    shared = (differs[..., None].view(np.uint8).reshape(*differs.shape, 8) == 0).sum(-1, dtype=np.uint8)
    near = shared >= 8 - radius
    near[near] = np.bitwise_count(differs[near]) <= radius
    return near


def _forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over one posting list."""
    left = np.arange(len(prints))
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            now, front = front[:16], front[16:]
            near = np.zeros((len(now), len(left)), bool)
            for at in range(0, len(left), 1 << 16):
                part = left[at : at + (1 << 16)]
                near[:, at : at + len(part)] = _matches(prints[now][:, None], prints[part][None, :], radius)
            hit = near.any(0)
            if hit.any():
                a.append(now[near[:, hit].argmax(0)])
                b.append(left[hit])
                front = np.concatenate([front, left[hit]])
                left = left[~hit]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _links(key: np.ndarray, prints: np.ndarray, ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the posting lists of a sorted stretch of the index."""
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([heads, [len(key)]]))
    of = np.repeat(size, size)
    a, b = [], []
    few = np.flatnonzero((of > 1) & (of <= _FEW))
    for d in range(1, _FEW):
        i = few[few + d < len(key)]
        i = i[key[i] == key[i + d]]
        if not len(i):
            break
        i = i[_matches(prints[i], prints[i + d], radius)]
        a.append(ids[i])
        b.append(ids[i + d])
    for h, n in zip(heads[size > _FEW].tolist(), size[size > _FEW].tolist()):
        x, y = _forest(prints[h : h + n], radius)
        a.append(ids[h + x])
        b.append(ids[h + y])
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): enough links to connect all ids whose fingerprints differ in ``radius`` bits or fewer.

    ``prints`` has distinct fingerprints ``fp`` with an ``id`` each; ``radius`` is 3 at most.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError("posting lists of three bytes guarantee up to 3 differing bits")
    spark = prints.sparkSession

    def bytes_at(places) -> int:
        mask = sum(0xFF << (8 * p) for p in places)
        return mask - 2**64 if mask >= 2**63 else mask

    keys = F.array(
        *[
            F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(bytes_at(places)).cast("long")))
            for i, places in enumerate(POSITIONS)
        ]
    )
    index = prints.select(F.explode(keys).alias("key"), "fp", "id")
    dealt = index.repartition(partitions(spark), "key").sortWithinPartitions("key", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            now = tuple(batch[c].to_numpy(zero_copy_only=False) for c in ("key", "fp", "id"))
            if not len(now[0]):
                continue
            if rest is not None:
                now = tuple(np.concatenate(x) for x in zip(rest, now))
            cut = int(np.searchsorted(now[0], now[0][-1], "left"))  # the last list may go on
            if cut:
                yield _as_batch(*_links(now[0][:cut], now[1][:cut].view(np.uint64), now[2][:cut], radius))
            rest = tuple(x[cut:] for x in now)
        if rest is not None and len(rest[0]):
            yield _as_batch(*_links(rest[0], rest[1].view(np.uint64), rest[2], radius))

    return dealt.mapInArrow(search, "a long, b long")


def _as_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, radius: int = RADIUS
) -> DataFrame:
    """(key, row, fp, component_id) of each row of ``docs``; ``row`` is a hash of its text."""
    small_batches(docs.sparkSession)
    prints = store(
        docs.select(
            F.coalesce(F.col(key).cast("long"), F.lit(LEAST_LONG)).alias("_doc"),
            _text_hash(text).alias("row"),
            fingerprint_column(text, size).alias("fp"),
        ),
        "fingerprints",
    )
    distinct = store(prints.groupBy("fp").agg(F.min("_doc").alias("_least")), "distinct-fingerprints")
    # fingerprints name themselves, since one doc_id may stand on several
    links = near_links(distinct.select("fp", F.col("fp").alias("id")), radius)
    parts = connected_components(links, "a", "b").withColumnRenamed("node", "fp")
    named = distinct.join(parts, "fp", "left").withColumn("_part", F.coalesce("component", "fp"))
    least = named.groupBy("_part").agg(F.min("_least").alias("_to"))
    named = named.join(least, "_part").select("fp", "_to")
    real = [F.when(F.col(c) != F.lit(LEAST_LONG), F.col(c)) for c in ("_doc", "_to")]
    return prints.join(named, "fp").select(real[0].alias(key), "row", "fp", real[1].alias("component_id"))


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def keep_one_of_each(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, radius: int = RADIUS
) -> DataFrame:
    """``docs`` with the smallest document of each component; all columns stay.

    Of rows that repeat a doc_id with an equal text one stays.
    """
    found = near_duplicates(docs, key, text, size, radius)
    kept = found.where(F.col(key).eqNullSafe(F.col("component_id"))).select(
        F.coalesce(F.col(key).cast("long"), F.lit(LEAST_LONG)).alias("_doc"), F.col("row").alias("_row")
    )
    marked = docs.select(
        F.struct("*").alias("_all"),
        F.coalesce(F.col(key).cast("long"), F.lit(LEAST_LONG)).alias("_doc"),
        _text_hash(text).alias("_row"),
    )
    once = marked.join(kept.distinct(), ["_doc", "_row"], "left_semi").dropDuplicates(["_doc", "_row"])
    return once.select("_all.*")


def hex_digits(fp: Column) -> Column:
    """Sixteen lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
