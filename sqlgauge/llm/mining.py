"""Hard negatives of anchors by a vertical scan of vectors (BOND).

Scores are integer inner products of vectors scaled by ``SCALE`` and floored. A block of candidates
is stored dimension by dimension, with the least and greatest value of each. For one anchor the
dimensions are read in the order of the anchor's descending magnitude. After each step the unread
dimensions can add no less and no more than a known sum, so candidates that can neither enter the
best k nor a window of scores leave the bitmap; those left at the end have exact scores.

Two scans: the best candidates of the anchor's own label (positives), then for each positive the best
ones of other labels within a window of scores. Rows are numbered by label and id and cut into
stripes of equally many rows; a task keeps one stripe and streams anchors through it, so neither a
frequent label nor the number of anchors grows a task's memory. Positives are searched in stripes of
the label only. Each task returns the best k, and the best of all tasks are chosen by a window with
k rows for each task and anchor.

Odd cases: rows with a null label, a null vector, or a null or non-finite component take no part.
Vectors of different length have no score. A null id is no anchor and comes before all others in
ties. Rows that repeat an id are rows of their own. Sums that leave the exact range of doubles
are added as whole numbers of any size, compared with up to 38 digits (a pair with more has no
score) and returned as the nearest long. A positive with a negative score has an empty window. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LEAST_LONG, partitions, small_batches, store
from .sharding import _div, number_rows

SCALE = 256
ANCHOR_EVERY = 50
POSITIVES = 5
NEGATIVES = 3
WINDOW = (50, 95)  # per cent of the positive's score
STRIPE = 65_536
_LEAST_STRIPE = 1024
_BLOCK = 8192
_FIRST_STEP = 8  # dimensions read before candidates are dropped for the first time; doubled each time
_EXACT = 2.0**53


def _best(score, ids, rows, k: int) -> np.ndarray:
    """Places of the best k: highest score, then smallest id, then row."""
    if len(score) > 4 * k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        near = np.arange(len(score))
    return near[np.lexsort((rows[near], ids[near], -score[near]))][:k]


class Block:
    """Candidates of one length, one array per dimension."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.rows, self.ids, self.labels = rows, ids, labels
        self.columns = np.ascontiguousarray(vectors.T)
        self.low, self.high = vectors.min(0), vectors.max(0)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Reading order, and what the dimensions from each place on add at least and at most."""
        order = np.argsort(-np.abs(q), kind="stable")
        ends = np.stack([q * self.low, q * self.high])[:, order]
        zero = np.zeros(1, q.dtype)
        down = np.concatenate([np.cumsum(ends.min(0)[::-1])[::-1], zero])
        up = np.concatenate([np.cumsum(ends.max(0)[::-1])[::-1], zero])
        return order, down, up

    def scan(self, q: np.ndarray, alive: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """(candidates, exact scores) of those that ``keep(partial, down, up)`` leaves to the end."""
        order, down, up = self.bounds(q)
        partial = np.zeros(len(alive), q.dtype)
        at, step = 0, _FIRST_STEP
        while True:
            left = keep(partial, down[at], up[at])
            if not left.all():
                alive, partial = alive[left], partial[left]
            if at == len(order) or not len(alive):
                return alive, partial
            dims = order[at : at + step]
            part = self.columns[dims] if len(alive) == len(self.rows) else self.columns[np.ix_(dims, alive)]
            partial = partial + q[dims] @ part
            at, step = at + len(dims), 2 * step


def _split(rows, ids, labels, vectors) -> list[Block]:
    """Blocks of one stripe; vectors are lists of different lengths."""
    sizes = np.array([len(v) for v in vectors])
    found = []
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        for part in np.array_split(at, -(-len(at) // _BLOCK)):
            found.append(Block(rows[part], ids[part], labels[part], np.stack([vectors[i] for i in part])))
    return found


def _fitting(block: Block, q: np.ndarray) -> tuple[Block, np.ndarray]:
    """The block and anchor themselves, or as whole numbers of any size if doubles may round."""
    most = np.maximum(np.abs(block.low), np.abs(block.high)).astype(float)
    if float(np.abs(q) @ most) < _EXACT:
        return block, q
    whole = lambda x: np.array([int(v) for v in x.ravel()], object).reshape(x.shape)
    return Block(block.rows, block.ids, block.labels, whole(block.columns.T)), whole(q)


def positives(blocks: list[Block], row: int, label: int, q: np.ndarray, k: int) -> list[tuple]:
    """(score, id, row) of the best other candidates of the same label."""
    best: list[tuple] = []
    blocks = [b for b in blocks if len(b.columns) == len(q)]
    for block, q_ in sorted((_fitting(b, q) for b in blocks), key=lambda x: -x[0].bounds(x[1])[2][0]):
        least = best[k - 1][0] if len(best) >= k else None

        def keep(partial, down, up, least=least):
            floor = least
            if len(partial) > k:
                kth = np.partition(partial, len(partial) - k)[len(partial) - k] + down
                floor = kth if floor is None else max(floor, kth)
            return np.ones(len(partial), bool) if floor is None else partial + up >= floor

        alive = np.flatnonzero((block.labels == label) & (block.rows != row))
        alive, score = block.scan(q_, alive, keep)
        top = alive[_best(score, block.ids[alive], block.rows[alive], k)]
        exact = dict(zip(alive.tolist(), score.tolist()))
        best += [(int(exact[i]), int(block.ids[i]), int(block.rows[i])) for i in top.tolist()]
        best = sorted(best, key=lambda x: (-x[0], x[1], x[2]))[:k]
    return best


def in_windows(
    blocks: list[Block], label: int, q: np.ndarray, windows: list[tuple[int, int]], k: int
) -> list[list[tuple]]:
    """For each window of scores the best candidates of other labels, as (score, id, row)."""
    best: list[list[tuple]] = [[] for _ in windows]
    for block in blocks:
        if len(block.columns) != len(q):
            continue
        block, q_ = _fitting(block, q)

        def keep(partial, down, up):
            needed = np.zeros(len(partial), bool)
            for (low, high), found in zip(windows, best):
                may = (partial + up >= low) & (partial + down <= high)
                sure = partial[(partial + down >= low) & (partial + up <= high)]
                floor = found[k - 1][0] if len(found) >= k else low
                if len(sure) >= k:
                    floor = max(floor, np.partition(sure, len(sure) - k)[len(sure) - k] + down)
                needed |= may & (partial + up >= floor)
            return needed

        alive, score = block.scan(q_, np.flatnonzero(block.labels != label), keep)
        for w, (low, high) in enumerate(windows):
            inside = np.flatnonzero((score >= low) & (score <= high))
            top = inside[_best(score[inside], block.ids[alive[inside]], block.rows[alive[inside]], k)]
            more = [(int(score[i]), int(block.ids[alive[i]]), int(block.rows[alive[i]])) for i in top.tolist()]
            best[w] = sorted(best[w] + more, key=lambda x: (-x[0], x[1], x[2]))[:k]
    return best


def _vectors(batch: pa.RecordBatch, scale: int) -> list[np.ndarray]:
    column = batch["vector"]
    ends = column.offsets.to_numpy() - column.offsets[0].as_py()
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


_SCORE = pa.decimal128(38, 0)
_TYPES = {
    "anchor": pa.int64(),
    "positive": pa.int64(),
    "positive_id": pa.int64(),
    "positive_score": _SCORE,
    "row": pa.int64(),
    "id": pa.int64(),
    "score": _SCORE,
}
_FOUND = ", ".join(f"{n} {'decimal(38,0)' if t == _SCORE else 'long'}" for n, t in _TYPES.items())


def _rows(found: list[tuple]) -> pa.RecordBatch:
    found = [f for f in found if abs(f[-1]) < 10**38]
    columns = list(zip(*found)) or [()] * len(_TYPES)
    typed = [pa.array([x if x is None or t != _SCORE else Decimal(x) for x in c], t) for c, t in zip(columns, _TYPES.values())]
    return pa.RecordBatch.from_arrays(typed, list(_TYPES))


def _scan(search, scale: int):
    """Keep the candidates of a stripe, then stream its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, blocks = [], None
        for batch in batches:
            kinds = batch["kind"].to_numpy()
            cut = int(np.searchsorted(kinds, 1))
            part = batch.slice(0, cut)
            if len(part):
                numbers = [part[c].to_numpy() for c in ("row", "id", "label")]
                own.append((*numbers, _vectors(part, scale)))
            part = batch.slice(cut)
            if not len(part) or not own:
                continue
            if blocks is None:
                rows, ids, labels = (np.concatenate([o[i] for o in own]) for i in range(3))
                blocks = _split(rows, ids, labels, [v for o in own for v in o[3]])
            goals = part["goals"].to_pylist()
            rows, labels = part["row"].to_numpy().tolist(), part["label"].to_numpy().tolist()
            found = []
            for row, label, q, goal in zip(rows, labels, _vectors(part, scale), goals):
                found += search(blocks, row, label, q, goal)
            yield _rows(found)

    return run


def _search_positives(k: int):
    def search(blocks, row, label, q, goal):
        return [(row, None, None, None, r, i, s) for s, i, r in positives(blocks, row, label, q, k)]

    return search


def _search_windows(k: int, window: tuple[int, int]):
    def search(blocks, row, label, q, goal):
        goal = [{**g, "score": int(g["score"])} for g in goal]
        limits = {g["score"]: (-(-window[0] * g["score"] // 100), window[1] * g["score"] // 100) for g in goal}
        limits = {s: (low, high) for s, (low, high) in limits.items() if low <= high}
        best = dict(zip(limits, in_windows(blocks, label, q, list(limits.values()), k)))
        return [
            (row, g["row"], g["id"], g["score"], r, i, s)
            for g in goal
            for s, i, r in best.get(g["score"], ())
        ]

    return search


def _id(c: Column) -> Column:
    return F.when(c != F.lit(LEAST_LONG), c)


def _nearest_long(c: Column) -> Column:
    most, least = (F.lit(x).cast("decimal(38,0)") for x in (2**63 - 1, -(2**63)))
    return F.least(F.greatest(c, least), most).cast("long")


def hard_negatives(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    anchors: Column | None = None,
    scale: int = SCALE,
    n_positives: int = POSITIVES,
    n_negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on the rows (by default: key divisible by ``ANCHOR_EVERY``).
    """
    spark = vectors.sparkSession
    small_batches(spark, 2048)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(vector)
    asked = F.col(key) % ANCHOR_EVERY == 0 if anchors is None else anchors
    usable = vectors.where(F.col(label).isNotNull() & v.isNotNull() & ~F.exists(v, bad)).select(
        F.coalesce(F.col(key).cast("long"), F.lit(LEAST_LONG)).alias("id"),
        F.col(label).cast("long").alias("label"),
        v.alias("vector"),
        F.coalesce(asked & F.col(key).isNotNull(), F.lit(False)).alias("asked"),
    )
    numbered, n = number_rows(usable, ["label", "id"], "vectors")
    rows = numbered.withColumnRenamed("row_number", "row")
    stripes = max(-(-n // STRIPE), min(partitions(spark), -(-n // _LEAST_STRIPE)), 1)
    size = max(-(-n // stripes), 1)
    goals = F.array().cast("array<struct<row:long,id:long,score:decimal(38,0)>>")
    own = rows.select(
        _div(F.col("row"), size).cast("int").alias("stripe"),
        F.lit(0).alias("kind"),
        "row",
        "id",
        "label",
        "vector",
        goals.alias("goals"),
    )
    reach = rows.groupBy("label").agg(F.min("row").alias("first"), F.max("row").alias("last"))
    seekers = store(rows.where("asked").drop("asked").join(reach, "label"), "anchors")

    def searched(seeking: DataFrame, search) -> DataFrame:
        sent = seeking.select("stripe", F.lit(1).alias("kind"), "row", "id", "label", "vector", "goals")
        placed = own.unionByName(sent).repartitionById(stripes, F.col("stripe"))
        return placed.sortWithinPartitions("kind", "row").mapInArrow(_scan(search, scale), _FOUND)

    def to_stripes(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(_div(first, size).cast("int"), _div(last, size).cast("int"))).alias("stripe")

    best = lambda *of: W.partitionBy(*of).orderBy(F.col("score").desc(), "id", "row")
    near = searched(
        seekers.withColumn("goals", goals).select("*", to_stripes(F.col("first"), F.col("last"))),
        _search_positives(n_positives),
    )
    chosen = (
        near.withColumn("n", F.row_number().over(best("anchor")))
        .where(F.col("n") <= n_positives)
        .groupBy("anchor")
        .agg(F.collect_list(F.struct("row", "id", "score")).alias("goals"))
    )
    # stripes that hold no other label have nothing to give
    foreign = (F.col("stripe") * F.lit(size) < F.col("first")) | (
        (F.col("stripe") + 1) * F.lit(size) > F.col("last") + 1
    )
    ready = store(seekers.join(chosen, F.col("row") == F.col("anchor")).drop("anchor"), "anchors-positives")
    far = searched(
        ready.select("*", to_stripes(F.lit(0).cast("long"), F.lit(max(n - 1, 0)).cast("long"))).where(foreign),
        _search_windows(n_negatives, window),
    )
    ranked = far.withColumn("rank", F.row_number().over(best("anchor", "positive"))).where(F.col("rank") <= n_negatives)
    names = ready.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return ranked.join(names, "anchor").select(
        "anchor_id",
        _id(F.col("positive_id")).alias("positive_id"),
        "rank",
        _id(F.col("id")).alias("negative_id"),
        _nearest_long(F.col("positive_score")).alias("positive_score"),
        _nearest_long(F.col("score")).alias("negative_score"),
    )


HARD_NEGATIVES_SQL = f"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % {ANCHOR_EVERY} = 0),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND {WINDOW[0]} * positive_score <= 100 * score AND 100 * score <= {WINDOW[1]} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
