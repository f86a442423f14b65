"""Near duplicates by the exact similarity of word shingles, over a prefix-filtered inverted index.

The similarity of two texts is the sum of the smaller over the sum of the larger counts of each
shingle of ``SHINGLE_WORDS`` = 5 words; texts of at least ``LEAST`` = 0.8 are linked. A shingle
that a text repeats counts as one token for each time, so this is the Jaccard index of two token sets.

1. With the tokens of all texts in one order, two sets of n and m tokens that are this similar have
   a token in common among their first n - ceil(0.8 n) + 1 and m - ceil(0.8 m) + 1. The index
   holds these prefixes only and misses no link. Any order is right; the tokens that most texts have
   come last, so that shared passages do not make long posting lists. How many texts have a token is
   read off a table of ``BUCKETS`` counters, filled by all tokens of all texts: tokens that share a counter count
   together. Each task fills its own table and tables are summed, so tokens are never shuffled.
2. SimHash comes first (``simhash``): texts whose fingerprints of the same shingles differ in few bits
   are paired by the inverted index of byte positions, and those pairs that are similar enough are one
   component from then on. Fingerprints guarantee no similarity of 0.8, so the index above finds the rest.
3. A text has a sketch of 64 * ``SKETCH`` bits, each the parity of its tokens there. Sketches differ in no more bits
   than the texts differ in tokens, and similar texts have enough tokens from their first shared one on. Nodes of
   a list become a pair only if both bounds allow 0.8 (``_odds``), so many texts that are a bit
   less similar than that, as are copies of one text with many edits, do not form all their pairs.
4. Each list has ``LEADERS`` leaders. A text is compared with those of best odds in one round with the pairs of
   fingerprints; what the round links is one component, which is not compared again. Then all
   pairs that may be similar and are still in different components are listed; the best
   of each node are compared first, then those that these have not connected.
5. Pairs whose prefixes share too few tokens are dropped; every other pair is decided by its exact
   similarity, from tokens joined to it by Spark. Only texts of such pairs are tokenised again; a
   table of ``MARKS`` bits lets the others go before the shuffle of that join.

Texts with equal tokens are one node, so groups of copies never form pairs. A node is a 64-bit hash
of the tokens and not a doc_id: rows that repeat a doc_id with different texts are different nodes.

Odd cases: null and blank texts are one node without links; a text of fewer words than a shingle
is one shingle. A null doc_id counts as smaller than all others.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LEAST_LONG, mixed, pieces, release, small_batches, span_hashes, store
from .components import connected_components
from .simhash import fingerprints, near_links, shingle_spans

SHINGLE_WORDS = 5
LEAST = 0.8
LEADERS = 3
RANGES = 4
BUCKETS = 1 << 20  # counters of tokens
WIDE = 64  # counters in a row of the summed table
MARKS = 1 << 24  # bits that tell which texts may be asked for
SKETCH = 8  # longs in the sketch of a set of tokens
_STEP = np.uint64(0x9FB21C651E98DF25)
_WORDS = [f"w{i}" for i in range(SKETCH)]


def tokens(texts: pa.Array, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the numbered shingles of all texts, sorted within each text, and the row of each."""
    raw, s, e, row = shingle_spans(texts, size)
    h = span_hashes(np.frombuffer(raw, np.uint8), s, e)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        at = np.arange(len(h))
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (row[1:] == row[:-1])])
        number = at - np.maximum.accumulate(np.where(again, 0, at))
        h = np.where(again, mixed(h + number.astype(np.uint64) * _STEP), h)
    return h, row


def _bounds(row: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(row, np.arange(n + 1))


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def token_column(text: str, size: int) -> Column:
    @F.arrow_udf("array<long>")
    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = [pa.array([], pa.list_(pa.int64()))]
            for part in pieces(batch):
                h, row = tokens(part, size)
                out.append(_lists(h, _bounds(row, len(part))))
            yield pa.concat_arrays(out)

    return make(F.col(text))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def _sketch(h: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """64 * ``SKETCH`` bits of each text: whether an odd number of its tokens falls on the bit.

    Each token that only one of two texts has changes one bit, so sketches differ in as many bits at most.
    """
    width = 64 * SKETCH
    odd = np.bincount(row * width + (h >> np.uint64(32)).astype(np.int64) % width, minlength=n * width) & 1
    words = np.packbits(odd.astype(np.uint8).reshape(n, width), axis=1, bitorder="little")
    words = np.ascontiguousarray(words).view(np.int64).reshape(n, SKETCH)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x)) for x in words.T], _WORDS)


def _entry(texts: pa.Array, size: int, least: float, counts: np.ndarray) -> pa.Array:
    """Node, number of tokens, prefix, fingerprint and sketch of each text; ``counts`` has the counter of each bucket."""
    h, row = tokens(texts, size)
    sketch = _sketch(h, row, len(texts))
    bounds = _bounds(row, len(texts))
    n = np.diff(bounds)
    node = mixed(n.astype(np.uint64))
    some = np.flatnonzero(n)
    if len(some):
        node[some] = mixed(node[some] + np.add.reduceat(mixed(h + _STEP), bounds[some]))
    h = h[np.lexsort((h, counts[_bucket(h)], row))]
    first = np.where(n > 0, n - np.ceil(least * n - 1e-9).astype(np.int64) + 1, 0)
    kept = np.arange(len(h)) - bounds[row] < first[row]
    prefix = _lists(h[kept], np.concatenate([[0], np.cumsum(first)]))
    prints = pa.array(fingerprints(texts, size).view(np.int64))
    columns = [pa.array(node.view(np.int64)), pa.array(n.astype(np.int64)), prefix, prints, sketch]
    return pa.StructArray.from_arrays(columns, ["node", "n", "prefix", "fp", "sketch"])


def _entry_column(text: str, size: int, least: float, shared) -> Column:
    sketch = ", ".join(f"{w}: long" for w in _WORDS)

    @F.arrow_udf(f"node long, n long, prefix array<long>, fp long, sketch struct<{sketch}>")
    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts = shared.value
        for batch in batches:
            parts = [_entry(p, size, least, counts) for p in pieces(batch, 1 << 20)]
            yield pa.concat_arrays(parts) if parts else _entry(batch, size, least, counts)

    return make(F.col(text))


def _summed(docs: DataFrame, size: int) -> DataFrame:
    """(block, c0, c1, ...): ``WIDE`` counters of tokens in a row, over all texts."""
    names = [f"c{i}" for i in range(WIDE)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in pieces(batch["_text"], 1 << 20):
                np.add.at(seen, _bucket(tokens(part, size)[0]), 1)
        seen = seen.reshape(-1, WIDE)
        block = np.flatnonzero(seen.any(1))
        for at in range(0, len(block), 1024):
            part = block[at : at + 1024]
            columns = [pa.array(part), *(pa.array(x) for x in np.ascontiguousarray(seen[part].T))]
            yield pa.RecordBatch.from_arrays(columns, ["block", *names])

    each = docs.select("_text").mapInArrow(count, ", ".join(f"{c} long" for c in ["block", *names]))
    return each.groupBy("block").agg(*(F.sum(c).alias(c) for c in names))


def _counts(docs: DataFrame, size: int) -> np.ndarray:
    """How many texts have the tokens of each bucket.

    The counters decide about the length of posting lists only, never about a link.
    """
    found = _summed(docs, size).toArrow()
    release()
    counts = np.zeros((BUCKETS // WIDE, WIDE), np.int64)
    counts[found["block"].to_numpy()] = np.stack([found[f"c{i}"].to_numpy() for i in range(WIDE)], 1)
    return counts.ravel()


def _possible(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` in ``wanted`` (by ``_doc`` and ``_row``), and few others.

    The table of bits has one size for any input; each wanted row sets one of them.
    """
    bit = F.pmod(F.xxhash64("_doc", "_row"), F.lit(MARKS))
    flag = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    words = wanted.groupBy(F.floor(bit / 64).alias("word")).agg(F.bit_or(flag).alias("bits")).toArrow()
    table = np.zeros(MARKS // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def marked(bits: pa.Array) -> pa.Array:
        at = bits.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[at // 64] >> (at % 64)) & 1 == 1)

    return docs.where(marked(bit))


def _needed(n: Column, m: Column, least: float) -> Column:
    """Tokens that two sets of n and m tokens share at least if they are similar enough."""
    return F.lit(least / (1 + least)) * (n + m) - 1e-9


def _likely(pairs: DataFrame, prefixes: DataFrame, least: float) -> DataFrame:
    """(a, b, odds) of the pairs whose prefixes share enough tokens; no similar pair is missed.

    ``odds`` is the most that they can share over what they must share.

    Of two prefixes one ends first in the order of the tokens. A shared token up to that end is in both
    prefixes; all others are among the rest of the text whose prefix ends first.
    """
    left = prefixes.select(F.col("node").alias("a"), F.col("n").alias("_n"), F.col("prefix").alias("_x"))
    right = prefixes.select(F.col("node").alias("b"), F.col("n").alias("_m"), F.col("prefix").alias("_y"))
    met = pairs.join(left, "a").join(right, "b")
    rest = F.greatest(F.col("_n") - F.size("_x"), F.col("_m") - F.size("_y"))
    shared = F.size(F.array_intersect("_x", "_y"))
    odds = (shared + rest) / _needed(F.col("_n"), F.col("_m"), least)
    return met.select("a", "b", odds.alias("odds")).where("odds >= 1")


def _similar(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose tokens are similar enough."""
    left = held.select(F.col("node").alias("a"), F.col("tokens").alias("_x"))
    right = held.select(F.col("node").alias("b"), F.col("tokens").alias("_y"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "_x", "_y")
    both = F.size(F.array_intersect("_x", "_y"))
    return met.where(both >= _needed(F.size("_x"), F.size("_y"), least)).select("a", "b")


def _posting_lists(prefixes: DataFrame) -> DataFrame:
    """(key, node, n, pos, sketch) of every key that several nodes have; ``pos`` is its place in the prefix, from 0.

    Keys are taken a range at a time, so that only one range of the index lies on disk.
    """
    found = []
    for k in range(RANGES):
        index = prefixes.select("node", "n", F.posexplode("prefix").alias("pos", "key")).where(F.pmod(F.shiftright("key", 8), F.lit(RANGES)) == k)
        ends = index.groupBy("key").agg(F.min("node").alias("_a"), F.max("node").alias("_b")).where("_a < _b")
        met = index.join(ends.select("key"), "key", "left_semi")
        met = met.select("key", "node", "n", "pos").distinct()
        found.append(store(met.join(prefixes.select("node", "sketch"), "node"), "posting-lists"))
        release()
    return functools.reduce(DataFrame.unionByName, found)


def _odds(least: float) -> Column:
    """The most tokens that two nodes share, if they meet at their first shared token, over what similar ones must share.

    They share this token and later ones of both. Those that only one of them has are as many at least as the bits that
    differ in their sketches. Similar nodes have 1 or more where they meet first; the pairs of
    a list that have less need not be made.
    """
    later = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at"))
    differ = functools.reduce(Column.__add__, [F.bit_count(F.col("sketch")[w].bitwiseXOR(F.col("_sketch")[w])) for w in _WORDS])
    return F.least(later, (F.col("n") + F.col("m") - differ) / 2) / _needed(F.col("n"), F.col("m"), least)


def _led(lists: DataFrame, least: float) -> DataFrame:
    """(node, b): for each node the ``LEADERS`` leaders of lists with the best odds."""
    lead = [F.min_by(F.struct("node", "n", "pos", "sketch"), F.xxhash64("node", F.lit(k))) for k in range(LEADERS)]
    leads = lists.groupBy("key").agg(F.array(*lead).alias("_leads")).select("key", F.posexplode("_leads").alias("k", "_lead"))
    names = {"b": "node", "m": "n", "at": "pos", "_sketch": "sketch"}
    other = leads.select("key", "k", *(F.col("_lead")[c].alias(x) for x, c in names.items()))
    met = lists.join(other, "key").where("node <> b").where(_odds(least) >= 1)
    return met.groupBy("node", "k").agg(F.max_by("b", F.struct(_odds(least), "b")).alias("b")).select("node", "b")


def _all_left(named: DataFrame, least: float) -> DataFrame:
    """(node, b): all pairs in different components that may be similar enough, once for each list where they meet so."""
    open_ = named.groupBy("key").agg(F.min("c").alias("_low"), F.max("c").alias("_high")).where("_low < _high")
    mine = named.join(open_.select("key"), "key", "left_semi")
    other = mine.selectExpr("key", "node AS b", "n AS m", "c AS d", "pos AS at", "sketch AS _sketch")
    return mine.join(other, "key").where("c < d").where(_odds(least) >= 1).select("node", "b")


def _by_fingerprint(own: DataFrame) -> DataFrame:
    """(node, b): pairs of nodes that connect all those whose fingerprints are near.

    The nodes of a fingerprint meet the smallest of them only, and that one those of near fingerprints.
    """
    worded = own.where("n > 0")
    lead = store(worded.groupBy("fp").agg(F.min("node").alias("b")), "fingerprints")
    same = worded.join(lead, "fp").where("node <> b").select("node", "b")
    links = near_links(lead.select("fp", F.col("b").alias("id")))
    return same.unionByName(links.select(F.col("a").alias("node"), "b"))


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes are in different components."""
    left = parts.select(F.col("node").alias("a"), F.col("component").alias("_c"))
    right = parts.select(F.col("node").alias("b"), F.col("component").alias("_d"))
    met = pairs.join(left, "a", "left").join(right, "b", "left")
    return met.where(F.coalesce("_c", "a") != F.coalesce("_d", "b")).select(*pairs.columns)


def _best(pairs: DataFrame) -> DataFrame:
    """(a, b): the pair of each node with the best odds."""
    ends = pairs.withColumn("node", F.explode(F.array("a", "b")))
    best = ends.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("odds", "a", "b")).alias("_at"))
    return best.select("_at.*").distinct()


def _components(docs: DataFrame, prints: DataFrame, own: DataFrame, size: int, least: float) -> DataFrame:
    """(node, component) of every linked node."""
    # prefixes of one text of each node; own has few columns, so texts and prefixes of copies do not move far
    prefixes = store(
        prints.join(own.select("_doc", "_row"), ["_doc", "_row"], "left_semi").dropDuplicates(["node"]).select("node", "n", "prefix", "sketch"),
        "node-prefixes",
    )
    release(prints)
    lists = _posting_lists(prefixes)
    links = store(lists.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false"), "similar")
    parts = links.select(F.col("a").alias("node"), F.col("b").alias("component"))

    def decide(pairs: DataFrame) -> None:
        """Adds the similar ones of the stored ``pairs`` to the links."""
        nonlocal links, parts
        if pairs.isEmpty():
            return
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = store(own.join(ends, "node").select("node", "_doc", "_row"), "wanted")
        texts = _possible(docs, wanted).join(wanted, ["_doc", "_row"]).dropDuplicates(["node"])
        held = store(texts.select("node", token_column("_text", size).alias("tokens")), "tokens")
        release()
        before, links = links, store(links.unionByName(_similar(pairs, held, least)), "similar")
        release(before, held, wanted)
        parts = store(connected_components(links, "a", "b"), "components")

    def likely(met: DataFrame) -> DataFrame:
        met = met.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        return store(_likely(met, prefixes, least), "pairs")

    pairs = likely(_by_fingerprint(own).unionByName(_led(lists, least)))
    decide(pairs)
    release(pairs)
    named = lists.join(parts, "node", "left").select(*lists.columns, F.coalesce("component", "node").alias("c"))
    left = likely(_all_left(named, least))
    best = store(_best(left), "best-pairs")
    decide(best)
    before, left = left, store(_apart(left.join(best, ["a", "b"], "left_anti"), parts), "pairs")
    release(before, best)
    decide(left)
    release(left)
    return parts


def keep_one_of_each(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, least: float = LEAST
) -> DataFrame:
    """``docs`` with the row of the smallest ``key`` of each component; all columns stay.

    ``least`` is any similarity above 0 and up to 1.
    """
    if not 0 < least <= 1:
        raise ValueError("the least similarity must be above 0 and at most 1")
    small_batches(docs.sparkSession)
    release()  # the shuffles of earlier steps
    ident = F.coalesce(F.col(key).cast("long"), F.lit(LEAST_LONG)).alias("_doc")
    row = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_row")
    slim = docs.select(ident, row, F.col(text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(_counts(slim, size))
    entry = slim.select("_doc", "_row", _entry_column("_text", size, least, shared).alias("_e"))
    prints = store(entry.select("_doc", "_row", "_e.*"), "shingle-prefixes")
    first = prints.groupBy("node").agg(F.min(F.struct("_doc", "_row", "n", "fp")).alias("_at"))
    own = store(first.select("node", "_at.*"), "nodes")
    release()
    named = own.join(_components(slim, prints, own, size, least), "node", "left")
    least_row = F.min(F.struct("_doc", "_row")).alias("_at")
    best = named.groupBy(F.coalesce("component", "node").alias("c")).agg(least_row).select("_at.*")
    marked = docs.select(F.struct("*").alias("_all"), ident, row)
    once = marked.join(best, ["_doc", "_row"], "left_semi").dropDuplicates(["_doc", "_row"])
    return once.select("_all.*")
