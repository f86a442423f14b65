"""Benchmark decontamination: documents that hold a passage of a benchmark.

A passage is found where a window of a document, as many words long as the benchmark item, has
a weighted-shingle similarity (sum of the smaller over sum of the larger counts of each shingle
of five words) of at least ``LEAST`` = 0.8 with the item. Windows start at every word.

1. A window this similar shares at least 0.8 of the item's shingles, so places without enough
   shingles of the benchmark are passed over; this loses nothing.
2. The other windows get a SimHash of ``BITS`` bits over their shingles (sums of all windows come
   from one running sum). Multi-index blocks find the items of the same length within ``RADIUS``
   bits: of 16 blocks of 8 bits at least one differs in at most RADIUS // 16 bits, so looking up
   all block values that close misses no fingerprint within the radius. Windows of similarity 0.8
   differ in about 20 bits of 128 on average; the radius lies more than six standard deviations
   above that.
3. Candidates are verified by their exact weighted similarity.

Words are runs of ASCII letters, digits and other characters' bytes, A-Z lower-cased. Items of
fewer than five words are one shingle. The benchmark is broadcast; its size is measured first,
and larger benchmarks go in several passes of about ``PASS_ITEMS`` items or ``PASS_BYTES`` bytes
of text, whichever is less, one after the other over stored documents.

Odd cases: null or empty texts and items match nothing; equal items are reported each under its
own item_id; several matches of one item in a document are one row with the best. Rows that
repeat a doc_id are reported once per doc_id and item; rows with a null doc_id as one such group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mixed, pieces, release, small_batches, store, words

SHINGLE_WORDS = 5
LEAST = 0.8
BITS = 128
BLOCK_BITS = 8
RADIUS = 47
PASS_ITEMS = 20_000
PASS_BYTES = 1 << 25
PART_PLACES = 1 << 16
PART_WINDOWS = 4096
_STEP = np.uint64(0x9FB21C651E98DF25)
_FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("similarity", T.DoubleType()),
            T.StructField("start_word", T.IntegerType()),
            T.StructField("n_words", T.IntegerType()),
        ]
    )
)


def shingles(h: np.ndarray, row: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the shingle that starts at each word, and whether it fits into its row."""
    out = np.zeros(len(h), np.uint64)
    fits = np.zeros(len(h), bool)
    n = len(h) - size + 1
    if n > 0:
        value = h[:n].copy()
        for k in range(1, size):
            value = mixed(value * _STEP + h[k : n + k])
        out[:n], fits[:n] = value, row[:n] == row[size - 1 :]
    return out, fits


def signs(values: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of ``BITS`` bits of each shingle."""
    salts = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * _STEP
    wide = np.stack([mixed(values + salt) for salt in salts], axis=1)
    bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
    return bits.astype(np.int8) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little")


class BlockIndex:
    """Multi-index of the fingerprints of items of one length, block by block."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])
        near = near <= RADIUS // (BITS // BLOCK_BITS)
        # table[block][value]: bit set of the items with a value that close
        self.table = [np.packbits(near[:, prints[:, b]], axis=1) for b in range(prints.shape[1])]

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all fingerprints within the radius."""
        met = reduce(np.bitwise_or, (t[prints[:, b]] for b, t in enumerate(self.table)))
        window, item = np.nonzero(np.unpackbits(met, axis=1, count=len(self.prints)))
        apart = np.bitwise_count(prints[window] ^ self.prints[item]).sum(1)
        close = apart <= RADIUS
        return window[close], item[close]


class Benchmark:
    """Items by their number of words, with shingle counts and fingerprints."""

    def __init__(self, ids: list[int], texts: list[str]):
        h, row = words(pa.array(texts, pa.string()))
        self.items: dict[int, list[tuple[int, np.ndarray]]] = {}  # words -> (id, sorted shingles)
        known: list[np.ndarray] = []
        length: list[np.ndarray] = []
        value, fits = shingles(h, row)
        for i, item in enumerate(ids):
            own = slice(*np.searchsorted(row, [i, i + 1]))
            n = own.stop - own.start
            if n < 1:
                continue
            s = value[own][fits[own]] if n >= SHINGLE_WORDS else short_shingle(h[own])
            self.items.setdefault(n, []).append((item, np.sort(s)))
            known.append(np.unique(s))
            length.append(np.full(len(known[-1]), n))
        pair = np.unique(np.stack([np.concatenate(known).view(np.int64), np.concatenate(length)], 1), axis=0) if known else np.zeros((0, 2), np.int64)
        self.shingle, first = np.unique(pair[:, 0].view(np.uint64), return_inverse=True)
        order = np.argsort(first, kind="stable")
        self.lengths = pair[order, 1]
        self.from_ = np.searchsorted(first[order], np.arange(len(self.shingle) + 1))
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.shingle >> np.uint64(44)] = True
        self.index = {
            n: BlockIndex(np.concatenate([_packed(signs(s).sum(0, dtype=np.int32)[None]) for _, s in group]))
            for n, group in self.items.items()
        }

    def hits(self, value: np.ndarray, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of benchmark shingles and the number of each in ``shingle``."""
        maybe = np.flatnonzero(self.sieve[value >> np.uint64(44)] & fits)
        number = np.searchsorted(self.shingle, value[maybe])
        number[number == len(self.shingle)] = 0
        real = self.shingle[number] == value[maybe] if len(self.shingle) else np.zeros(0, bool)
        return maybe[real], number[real]

    def find(self, texts: pa.Array) -> list[dict[int, tuple[float, int, int]]]:
        """For each text: item -> (similarity, first word, words) of its best window."""
        found: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(len(texts))]
        h, row = words(texts)
        if not len(h) or not self.items:
            return found
        begin = np.searchsorted(row, np.arange(len(texts) + 1))
        value, fits = shingles(h, row)
        place, number = self.hits(value, fits)
        for n in sorted(self.items):
            if n < SHINGLE_WORDS:
                self._short(n, h, row, begin, found)
                continue
            reach = self.from_[number + 1] - self.from_[number]
            own = self._of_length(number, reach, n)
            self._windows(n, place[own], value, row, begin, found)
        return found

    def _of_length(self, number: np.ndarray, reach: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(number), bool)
        for k in range(int(reach.max(initial=0))):
            more = k < reach
            out[more] |= self.lengths[self.from_[number[more]] + k] == n
        return out

    def _windows(self, n, place, value, row, begin, found) -> None:
        if not len(place):
            return
        inner = n - SHINGLE_WORDS + 1
        need = int(np.ceil(LEAST * inner - 1e-9))
        # windows that could hold enough shingles: starts up to inner-1 before a hit
        start = _union(np.maximum(place - inner + 1, 0), place + 1)
        which = row[start]
        fits = start + n <= begin[which + 1]
        short = np.unique(row[place])
        short = short[begin[short + 1] - begin[short] < n]
        start, size = start[fits], np.full(int(fits.sum()), inner)
        # documents shorter than the item are one window
        whole = begin[short + 1] - begin[short] - SHINGLE_WORDS + 1
        start, size = np.concatenate([start, begin[short]]), np.concatenate([size, whole])
        shared = np.searchsorted(place, start + size) - np.searchsorted(place, start)
        enough = np.flatnonzero(shared >= need)
        enough = enough[np.argsort(start[enough], kind="stable")]
        start, size, shared = start[enough], size[enough], shared[enough]
        if not len(start):
            return
        # windows that begin a bounded number of new places, so that memory is that of one window more
        new = np.minimum(size, np.diff(start + size, prepend=start[0]))
        full = np.diff(np.cumsum(new) // PART_PLACES) + np.diff(np.arange(len(start)) // PART_WINDOWS)
        for own in np.split(np.arange(len(start)), np.flatnonzero(full) + 1):
            self._verify(n, start[own], size[own], shared[own], value, row, begin, found)

    def _verify(self, n, start, size, shared, value, row, begin, found) -> None:
        # shingles of all windows, each once, then running sums of their signs
        place = _union(start, start + size)
        sums = np.zeros((len(place) + 1, BITS), np.int32)
        np.cumsum(signs(value[place]), axis=0, out=sums[1:])
        at = np.searchsorted(place, start)
        prints = _packed(sums[at + size] - sums[at])
        items = self.items[n]
        window, item = self.index[n].candidates(prints)
        # most shared shingles first: later windows mostly cannot be more similar, and are passed over
        order = np.lexsort((start[window], -shared[window]))
        for w, i in zip(window[order].tolist(), item[order].tolist()):
            number, own = items[i]
            a, k = int(start[w]), int(size[w])
            doc = int(row[a])
            best, first, _ = found[doc].get(number, (0.0, 0, 0))
            both = min(int(shared[w]), k)
            most, at = both / (len(own) + k - both), a - int(begin[doc])
            if most < best or (most == best and at >= first):
                continue
            like = weighted_similarity(own, np.sort(value[a : a + k]))
            if like >= LEAST - 1e-12 and (like > best or (like == best and at < first)):
                found[doc][number] = (like, at, k + SHINGLE_WORDS - 1)

    def _short(self, n, h, row, begin, found) -> None:
        """Items of fewer words than a shingle are one shingle and match as a whole."""
        last = len(h) - n + 1
        if last < 1:
            return
        value = np.full(last, n, np.uint64)
        for k in range(n):
            value = mixed(value * _STEP + h[k : last + k])
        for item, own in self.items[n]:
            for a in np.flatnonzero((value == own[0]) & (row[:last] == row[n - 1 :])).tolist():
                found[int(row[a])].setdefault(item, (1.0, a - int(begin[row[a]]), n))


def _union(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All places of ranges whose starts and ends both rise, each place once."""
    start = np.maximum(start, np.concatenate([start[:1], end[:-1]]))
    size = np.maximum(end - start, 0)
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - before, size)


def short_shingle(h: np.ndarray) -> np.ndarray:
    """The one shingle of an item of fewer words than a shingle."""
    value = np.full(1, len(h), np.uint64)
    for k in range(len(h)):
        value = mixed(value * _STEP + h[k : k + 1])
    return value


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller counts over sum of the larger counts of two sorted lists of shingles."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(nx[i], ny[j]).sum())
    return both / (len(a) + len(b) - both) if both else 0.0


_built: dict[int, Benchmark] = {}


def _benchmark(ids: list[int], texts: list[str]) -> Benchmark:
    mark = hash((tuple(ids), tuple(texts)))
    if mark not in _built:
        _built.clear()
        _built[mark] = Benchmark(ids, texts)
    return _built[mark]


def _passes(benchmark: DataFrame, item: str, text: str) -> Iterator[tuple[list[int], list[str]]]:
    """The items in parts of bounded size, each read from the benchmark by its own key range."""
    usable = benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(
        F.col(item).cast("long").alias("i"), F.col(text).alias("t")
    )
    size = usable.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t")).alias("b")).first()
    parts = max(1, -(-size["n"] // PASS_ITEMS), -(-(size["b"] or 0) // PASS_BYTES))
    for k in range(parts):
        own = usable.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k) if parts > 1 else usable
        rows = sorted((r["i"], r["t"]) for r in own.collect())
        yield [r[0] for r in rows], [r[1] for r in rows]


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``_found``: an array of (item_id, similarity, start_word, n_words)."""
    spark = docs.sparkSession
    small_batches(spark)
    stored = None
    for k, (ids, texts) in enumerate(_passes(benchmark, item, item_text)):
        found = _finder(spark.sparkContext.broadcast((ids, texts)))(F.col(text))
        if not k:
            docs = docs.withColumn("_found", found)
            continue
        before, stored = stored, store(docs, "contaminated")
        docs = stored.withColumn("_found", F.concat("_found", found))
        if before is not None:
            release(before)
    return docs


def _finder(shared):
    @F.arrow_udf(_FOUND)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bench = _benchmark(*shared.value)
        for batch in batches:
            out = []
            for part in pieces(batch):
                for best in bench.find(part):
                    out.append(
                        [
                            {"item_id": i, "similarity": s, "start_word": a, "n_words": n}
                            for i, (s, a, n) in sorted(best.items())
                        ]
                    )
            yield pa.array(out, _ARROW_FOUND)

    return search


_ARROW_FOUND = pa.list_(
    pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int32()), ("n_words", pa.int32())])
)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, similarity, start_word, n_words): each document and item it holds, once."""
    slim = docs.select(F.col(key), F.col(text).alias("_text"))
    found = matches(slim, benchmark, "_text").select(key, F.inline("_found"))
    best = F.max_by(F.struct("start_word", "n_words"), F.struct("similarity", -F.col("start_word"))).alias("w")
    return found.groupBy(key, "item_id").agg(F.max("similarity").alias("similarity"), best).select(
        key, "item_id", "similarity", "w.start_word", "w.n_words"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with their columns."""
    whole = docs.select(F.struct("*").alias("_all"), F.col(text).alias("_text"))
    return matches(whole, benchmark, "_text").where(F.size("_found") == 0).select("_all.*")
