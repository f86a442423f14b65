"""Toxicity scores from a logistic regression trained with FTRL-proximal.

Features are hashed words, pairs of neighbours, and skip-grams (pairs with one word between),
each counted once per text. Training runs over a bounded sample of labelled texts, in an order
given by hashes: per-coordinate learning rates, and an L1 term that leaves most weights at zero.
Only the non-zero weights are broadcast; their number is bounded by the table of ``2**BITS``
features. Features are computed by Spark tasks, for the sample and for scoring alike.

Bounds: ``sample_rows`` gives the most labelled texts of each class, those with the smallest hashes. Scoring
covers every text as a whole.

Odd cases: null and empty texts have no feature and score by the bias alone. A document labelled
twice counts as toxic if any label says so; null labels are left out. Without both classes in
the sample the score is the share of the class found (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mixed, pieces, small_batches, store, words

BITS = 22
ALPHA, BETA, L1, L2 = 0.5, 1.0, 12.0, 0.5
EPOCHS = 8
SAMPLE_ROWS = {1: 3000, 0: 6000}
_PAIR, _SKIP = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xC2B2AE3D27D4EB4F)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, neighbour pairs and skip-grams, and the row of each."""
    h, row = words(texts)
    near, skip = row[1:] == row[:-1], row[2:] == row[:-2]
    pair = mixed(h[:-1] * _PAIR + h[1:])[near]
    gap = mixed(h[:-2] * _SKIP + h[2:] + np.uint64(1))[skip]
    every = np.concatenate([h, pair, gap]) >> np.uint64(64 - BITS)
    return every.astype(np.int32), np.concatenate([row, row[:-1][near], row[:-2][skip]])


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _distinct_features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        lists: list[np.ndarray] = []
        for part in pieces(batch):
            number, row = features(part)
            order = np.argsort(row, kind="stable")
            cuts = np.searchsorted(row[order], np.arange(1, len(part)))
            lists += [np.unique(x) for x in np.split(number[order], cuts)]
        yield pa.array(lists, pa.list_(pa.int32()))


def train(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Numbers and values of the non-zero weights, and the bias."""
    z, n = np.zeros(2**BITS), np.zeros(2**BITS)
    bias, bias_n = 0.0, 0.0
    positive = sum(y for _, y in rows)
    if not rows or positive in (0, len(rows)):
        share = positive / len(rows) if rows else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return np.zeros(0, np.int32), np.zeros(0), float(np.log(share / (1 - share)))
    for _ in range(EPOCHS):
        for index, y in rows:
            zi, ni = z[index], n[index]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30)))
            g = p - y
            z[index] = zi + g - (np.sqrt(ni + g * g) - root) / ALPHA * w
            n[index] = ni + g * g
            bias_n += g * g
            bias -= ALPHA / (BETA + np.sqrt(bias_n)) * g
    live = np.flatnonzero(np.abs(z) > L1)
    w = -(z[live] - np.sign(z[live]) * L1) / ((BETA + np.sqrt(n[live])) / ALPHA + L2)
    return live.astype(np.int32), w, float(bias)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    label: str = "toxic",
    sample_rows: dict[int, int] = SAMPLE_ROWS,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Train on at most ``sample_rows`` labelled texts of each class (label: rows)."""
    spark = docs.sparkSession
    known = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.max(label).cast("int").alias("_y"))
        .withColumn("_h", F.xxhash64("_key", F.lit("toxicity")))
    )
    known = store(known, "toxicity-labels")
    chosen = reduce(
        DataFrame.unionAll,
        [known.where(F.col("_y") == y).orderBy("_h", "_key").limit(n) for y, n in sample_rows.items()],
    )
    picked = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")
    small_batches(spark)
    rows = picked.select("_h", "_y", _distinct_features("_text").alias("f")).toArrow()
    order = np.argsort(rows["_h"].to_numpy(), kind="stable")
    y, f = rows["_y"].to_numpy(), rows["f"].combine_chunks()
    return train([(f[int(i)].values.to_numpy(), int(y[i])) for i in order])


_dense: dict[int, np.ndarray] = {}


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text") -> DataFrame:
    """``docs`` with ``_score``, the probability that a text is toxic."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index, w, bias = shared.value
        mark = hash((index.tobytes(), w.tobytes()))
        if mark not in _dense:
            _dense.clear()
            _dense[mark] = np.zeros(2**BITS, np.float32)
            _dense[mark][index] = w
        dense = _dense[mark]
        for batch in batches:
            out = []
            for part in pieces(batch):
                number, row = features(part)
                hit = dense[number] != 0
                both = np.unique(row[hit] * np.int64(2**BITS) + number[hit])
                total = np.bincount(both >> BITS, weights=dense[both & (2**BITS - 1)], minlength=len(part))
                out.append(1 / (1 + np.exp(-np.clip(total + bias, -30, 30))))
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    small_batches(spark)
    return docs.withColumn("_score", probability(F.col(text)))
