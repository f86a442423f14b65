"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

A text is cut into pieces by the vocabulary's pattern. The distinct pieces of a batch that are
not yet known are encoded together: pieces of similar length form the rows of a padded matrix of
token ids, and in each round every row merges its leftmost pair of least rank, found through a
hash table of pairs; the matrix is then compacted, and finished rows leave. Pieces of more than
``LONGEST_ROW`` bytes are merged one by one with a heap in exactly the same order, since a
matrix would take quadratic time. Known pieces are kept in a bounded cache per worker.

Null texts count as empty and give no token. Every text is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

LONGEST_ROW = 256
CACHE_PIECES = 200_000
_NO_PAIR = np.int32(2**31 - 1)
_SLOT_BITS = 18


class PairTable:
    """Rank of each mergeable pair of ids, in an open hash table probed with numpy."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        keys = np.array([(a << 32) | b for a, b in pairs], np.uint64)
        ranks = np.array(list(pairs.values()), np.int32)
        size = 1 << _SLOT_BITS
        while size < 4 * len(keys):
            size *= 2
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.mask = size - 1
        self.keys = np.full(size, 2**64 - 1, np.uint64)
        self.ranks = np.full(size, _NO_PAIR, np.int32)
        self.probes = 0
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            self.probes += 1
            free = self.keys[slot] == np.uint64(2**64 - 1)
            take, where = np.unique(slot[free], return_index=True)
            chosen = np.flatnonzero(free)[where]
            self.keys[take] = keys[left[chosen]]
            self.ranks[take] = ranks[left[chosen]]
            rest = np.ones(len(left), bool)
            rest[chosen] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slot = self._slot(keys.ravel())
        flat = keys.ravel()
        found = self.keys[slot]
        out = np.where(found == flat, self.ranks[slot], _NO_PAIR)
        open_ = np.flatnonzero((found != flat) & (found != np.uint64(2**64 - 1)))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            out[open_] = np.where(found == flat[open_], self.ranks[slot[open_]], out[open_])
            open_ = open_[(found != flat[open_]) & (found != np.uint64(2**64 - 1))]
        return out.reshape(a.shape)


class BytePairCoder:
    """Encoder and decoder for one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.names = {i: str(i) for i in self.token}
        self.single = np.zeros(256, np.int64)
        for i in range(256):
            self.single[i] = ranks[bytes([i])]
        pairs = {}
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                a, b = ranks.get(word[:cut]), ranks.get(word[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.pairs, self.table = pairs, PairTable(pairs)
        self.cache: dict[str, tuple[int, ...]] = {}

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece, by rounds over matrices of pieces of similar length."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            known = self.ranks.get(p)
            if known is not None:
                out[i] = (known,)
            elif len(p) > LONGEST_ROW:
                out[i] = self._by_heap(p)
            elif p:
                buckets.setdefault((len(p) + 3) // 4, []).append(i)
        for width, members in buckets.items():
            step = max(1, (1 << 20) // (4 * width))
            for at in range(0, len(members), step):
                self._rounds(pieces, members[at : at + step], 4 * width, out)
        return out

    def _rounds(self, pieces: list[bytes], members: list[int], width: int, out: list) -> None:
        raw = b"".join(pieces[i].ljust(width, b"\0") for i in members)
        ids = self.single[np.frombuffer(raw, np.uint8)].reshape(-1, width)
        size = np.array([len(pieces[i]) for i in members])
        who = np.array(members)
        place = np.arange(width)
        rank = self.table.look_up(ids[:, :-1], ids[:, 1:])
        rank[place[None, 1:] >= size[:, None]] = _NO_PAIR
        while len(who):
            at = rank.argmin(1)  # the first of the least
            best = rank[np.arange(len(who)), at]
            done = best == _NO_PAIR
            if done.any():
                for i, row, n in zip(who[done].tolist(), ids[done].tolist(), size[done].tolist()):
                    out[i] = tuple(row[:n])
                go = ~done
                who, ids, size, rank, at, best = who[go], ids[go], size[go], rank[go], at[go], best[go]
                if not len(who):
                    break
            # compaction: drop the right half of each merged pair
            keep = place[None, : ids.shape[1]] != (at + 1)[:, None]
            ids[np.arange(len(who)), at] = best
            ids = ids[keep].reshape(len(who), -1)
            size = size - 1
            rank = self._renewed(ids, rank, at, size)

    def _renewed(self, ids: np.ndarray, rank: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Ranks after the merge at ``at``: only the pairs beside it are looked up anew."""
        n, width = ids.shape
        keep = np.arange(width)[None, :] != at[:, None]
        rank = rank[keep].reshape(n, width - 1)
        line = np.arange(n)
        for left in (at - 1, at):
            ok = (left >= 0) & (left + 1 < size)
            r, c = line[ok], left[ok]
            rank[r, c] = self.table.look_up(ids[r, c], ids[r, c + 1])
            end = (left >= 0) & (left + 1 >= size) & (left < width - 1)
            rank[line[end], left[end]] = _NO_PAIR
        return rank

    def _by_heap(self, piece: bytes) -> tuple[int, ...]:
        ids = [int(self.single[b]) for b in piece]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if left >= 0 and right < n and (s := self.pairs.get((ids[left], ids[right]))) is not None:
                    heapq.heappush(heap, (s, left, ids[left], ids[right]))
        return tuple(x for x in ids if x >= 0)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        parts = [self.pattern.findall(t) for t in texts]
        cache = self.cache
        new = {p for part in parts for p in part if p not in cache}
        if new:
            if len(cache) + len(new) > CACHE_PIECES:
                cache.clear()
                new = {p for part in parts for p in part}
            new = list(new)
            cache.update(zip(new, self.encode_pieces([p.encode() for p in new])))
        ids = [list(chain.from_iterable(map(cache.__getitem__, part))) for part in parts]
        if len(cache) > CACHE_PIECES:
            cache.clear()
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.token.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 bytes and rank in each line."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                word, rank = line.split()
                ranks[base64.b64decode(word)] = int(rank)
    return ranks


_coders: dict[tuple[str, str], BytePairCoder] = {}


def coder(path: str, pattern: str) -> BytePairCoder:
    """The coder of a vocabulary file, built once per worker."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = BytePairCoder(read_ranks(path), pattern)
    return _coders[path, pattern]


def _groups(batch: pa.Array, limit: int = 1 << 20) -> Iterator[list[str]]:
    group, size = [], 0
    for t in batch.to_pylist():
        group.append(t or "")
        size += len(group[-1])
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``_ids``, the token ids of each text. ``path`` must be readable by executors."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = coder(path, pattern)
        for batch in batches:
            out = [x for group in _groups(batch) for x in c.encode(group)]
            yield pa.array(out, pa.list_(pa.int32()))

    small_batches(docs.sparkSession)
    return docs.withColumn("_ids", ids(F.col(text)))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "_ids") -> DataFrame:
    """``docs`` with ``_bytes``, decoded from a column of token ids; null ids give no byte."""

    @F.arrow_udf("binary")
    def raw(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = coder(path, pattern)
        for batch in batches:
            yield pa.array([c.decode(x or []) for x in batch.to_pylist()], pa.binary())

    small_batches(docs.sparkSession)
    return docs.withColumn("_bytes", raw(F.col(ids)))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``_code``: the ids of each text, and the bytes decoded from them."""

    @F.arrow_udf("ids array<int>, decoded binary")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = coder(path, pattern)
        for batch in batches:
            ids = [x for group in _groups(batch) for x in c.encode(group)]
            back = pa.array([c.decode(x) for x in ids], pa.binary())
            yield pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), back], ["ids", "decoded"])

    small_batches(docs.sparkSession)
    return docs.withColumn("_code", code(F.col(text)))


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``_code``: n_tokens, ids_sha256 and decoded_sha256, without moving the ids."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = coder(path, pattern)
        for batch in batches:
            sizes, names, back = [], [], []
            for group in _groups(batch):
                for ids in c.encode(group):
                    sizes.append(len(ids))
                    line = " ".join(map(c.names.__getitem__, ids))
                    names.append(hashlib.sha256(line.encode()).hexdigest())
                    back.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int64()), pa.array(names, pa.string()), pa.array(back, pa.string())],
                ["n_tokens", "ids_sha256", "decoded_sha256"],
            )

    small_batches(docs.sparkSession)
    return docs.withColumn("_code", code(F.col(text)))
