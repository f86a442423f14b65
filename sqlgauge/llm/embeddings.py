"""Near duplicates among embeddings: a navigable small-world graph per shard.

Distinct vectors are dealt into shards by a hash of their id. A task builds a hierarchical
navigable small-world graph over the vectors of one shard and then streams queries through it:
every vector meets every shard, each pair of shards on one of its two sides. Beams start at
``BEAM`` entries. An audit compares what is found for a sample of queries with brute force: of the
shard's own vectors (``AUDIT_QUERIES``) and of every batch that comes from other shards
(``AUDIT_FOREIGN``). Of the sampled queries that link to another vector, a share of ``AUDIT`` must
have all their links found; else the beam is doubled and the sample searched again. A query whose
beam is full of links goes again with twice the beam, so large groups are found whole. Links are
verified by their cosine in double precision. A task returns counts and the links of a spanning
forest instead of all pairs; components are then united over all shards.

The number of shards is ``max(SHARDS, vectors / SHARD_VECTORS)``, so a graph fits one task.

Odd cases: vectors that are null, empty, zero or hold a null or non-finite component link with
nothing and are kept. Vectors of different length never link. Exact copies are one entry with a
count. Rows that repeat a vec_id are one node of the graph; a null vec_id counts as smaller than
all others and is returned as null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEAST_LONG, small_batches, store
from .components import connected_components

LEAST_COSINE = 0.95
SHARDS = 9
SHARD_VECTORS = 100_000
NEIGHBOURS = 12  # per node in upper layers, twice as many in the ground layer
SPARE = 8  # further links of a node, to nodes that would else be hard to reach
BUILD_BEAM = 48
BEAM = 64
AUDIT = 0.995
AUDIT_QUERIES = 2048
AUDIT_FOREIGN = 64
_BATCH = 256
_WIDTH = 4
_SLACK = 1e-4  # between single and double precision


class SmallWorld:
    """Hierarchical navigable small-world graph over unit vectors, grown in batches."""

    def __init__(self, vectors: np.ndarray, seed: int = 11):
        self.x = np.ascontiguousarray(vectors, np.float32)
        n = len(self.x)
        draw = np.random.default_rng(seed)
        level = np.minimum((-np.log(draw.random(n)) / np.log(NEIGHBOURS)).astype(int), 8) if n else np.zeros(0, int)
        top = int(level.max(initial=0))
        self.links = [np.full((n, NEIGHBOURS * (2 if k == 0 else 1)), -1, np.int32) for k in range(top + 1)]
        order = np.argsort(-level, kind="stable")
        self.entry = int(order[0]) if n else -1
        at = 0
        while at < n:
            own = int(level[order[at]])
            same = int(np.searchsorted(-level[order], -own, "right"))
            to = min(same, at + min(_BATCH, max(16, at)))
            self._insert(order[at:to], own, order[:at])
            at = to
        self._link_back()
        self.starts = self._starts()

    def _link_back(self) -> None:
        """Give each node that no neighbour of its own links to a link from the nearest with room."""
        table = self.links[0]
        n = len(table)
        spare = np.full((n, SPARE), -1, np.int32)
        used = np.zeros(n, int)
        for at in range(0, n, 4096):
            own = table[at : at + 4096]
            back = (table[own] == np.arange(at, at + len(own))[:, None, None]).any(2) & (own >= 0)
            for node in (at + np.flatnonzero(back.sum(1) < 2)).tolist():
                mine = table[node][table[node] >= 0]
                nearest = mine[np.argsort(-(self.x[mine] @ self.x[node]), kind="stable")]
                for to in [x for x in nearest.tolist() if used[x] < SPARE][:2]:
                    spare[to, used[to]] = node
                    used[to] += 1
        self.links[0] = np.concatenate([table, spare[:, : used.max(initial=0)]], 1)

    def _starts(self) -> np.ndarray:
        """The entry, and further entries from which all other nodes of the ground layer are reached."""
        reached = np.zeros(len(self.x), bool)
        starts, front = [], np.array([self.entry] if len(self.x) else [], np.int64)
        while len(front):
            starts.append(int(front[0]))
            reached[front] = True
            while len(front):
                front = np.unique(self.links[0][front])
                front = front[front >= 0]
                front = front[~reached[front]]
                reached[front] = True
            front = np.flatnonzero(~reached)[:1]
        return np.array(starts[1:], np.int64)

    def _insert(self, new: np.ndarray, own: int, before: np.ndarray) -> None:
        near = self.x[new] @ self.x[new].T
        start = np.full((len(new), 1), self.entry, np.int64)
        for layer in range(len(self.links) - 1, -1, -1):
            if layer > own:
                start = self.beam(self.x[new], layer, start, 1)[0]
                continue
            if len(before):
                ids, sims = self.beam(self.x[new], layer, start, BUILD_BEAM)
                start = ids[:, :8]
            else:
                ids, sims = np.zeros((len(new), 0), np.int64), np.zeros((len(new), 0), np.float32)
            # members of one batch see each other as well
            ids = np.concatenate([ids, np.broadcast_to(new, (len(new), len(new)))], 1)
            sims = np.concatenate([sims, near], 1)
            sims[ids == new[:, None]] = -3
            self._connect(new, ids, sims, layer)

    def _connect(self, new: np.ndarray, ids: np.ndarray, sims: np.ndarray, layer: int) -> None:
        table = self.links[layer]
        chosen = self._diverse(ids, sims, NEIGHBOURS)
        table[new, : chosen.shape[1]] = chosen
        # the other direction: each chosen node gets its new neighbours, and the best stay
        to, from_ = chosen.ravel(), np.repeat(new, chosen.shape[1])
        from_, to = from_[to >= 0], to[to >= 0]
        if not len(to):
            return
        order = np.argsort(to, kind="stable")
        to, from_ = to[order], from_[order]
        node, first, count = np.unique(to, return_index=True, return_counts=True)
        more = np.full((len(node), int(count.max())), -1, np.int64)
        line = np.repeat(np.arange(len(node)), count)
        more[line, np.arange(len(to)) - np.repeat(first, count)] = from_
        every = np.concatenate([table[node], more], 1)
        every = np.sort(every, 1)[:, ::-1]
        every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
        for a in range(0, len(node), 512):
            part, who = every[a : a + 512], node[a : a + 512]
            like = np.einsum("nd,nkd->nk", self.x[who], self.x[part], optimize=True)
            like[part < 0] = -3
            table[who] = self._diverse(part, like, table.shape[1])

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Per row its nearest nodes (a third), then nodes nearer to it than to those; then the rest."""
        k = min(ids.shape[1], max(3 * most, 48))
        order = np.argsort(-sims, 1, kind="stable")[:, :k]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        valid = (sims > -2) & (ids >= 0)
        v = self.x[ids]
        taken = np.zeros(ids.shape, bool)
        closest = np.full(ids.shape, -2, np.float32)  # to any node taken so far
        count = np.zeros(len(ids), int)
        for j in range(k):
            ok = valid[:, j] & ((closest[:, j] < sims[:, j]) | (count < most // 3)) & (count < most)
            taken[:, j] = ok
            count += ok
            if ok.any():
                rows = np.flatnonzero(ok)
                closest[rows] = np.maximum(closest[rows], np.einsum("nkd,nd->nk", v[rows], v[rows, j], optimize=True))
        rank = np.where(taken, 0, np.where(valid, 1, 2)) * k + np.arange(k)
        best = np.argsort(rank, 1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(valid, best, 1), np.take_along_axis(ids, best, 1), -1)

    def beam(self, q: np.ndarray, layer: int, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the ``size`` best nodes met from ``start``, best first (-1: none)."""
        table, n = self.links[layer], len(self.x)
        rows = np.arange(len(q))
        ids = np.full((len(q), size), -1, np.int64)
        sims = np.full((len(q), size), -2, np.float32)
        done = np.ones((len(q), size), bool)
        seen = np.zeros((len(q), n + 1), bool)
        fresh = np.sort(np.where(start < 0, n, start), 1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
        active = rows
        while len(active):
            seen[active[:, None], fresh] = True
            none = fresh == n
            at = np.where(none, 0, fresh)
            like = np.einsum("nd,nkd->nk", q[active], self.x[at], optimize=True)
            like[none] = -2
            all_ids = np.concatenate([ids[active], np.where(none, -1, fresh)], 1)
            all_sims = np.concatenate([sims[active], like], 1)
            all_done = np.concatenate([done[active], none], 1)
            best = np.argsort(-all_sims, 1, kind="stable")[:, :size]
            ids[active] = np.take_along_axis(all_ids, best, 1)
            sims[active] = np.take_along_axis(all_sims, best, 1)
            done[active] = np.take_along_axis(all_done, best, 1)
            open_ = ~done[active]
            go = open_.any(1)
            active, open_ = active[go], open_[go]
            if not len(active):
                break
            # the first open entries are the best, as beams are sorted
            turn = np.cumsum(open_, 1)
            width = min(_WIDTH, size)
            pick = np.argsort(~(open_ & (turn <= width)), 1, kind="stable")[:, :width]
            real = np.take_along_axis(open_ & (turn <= width), pick, 1)
            node = np.take_along_axis(ids[active], pick, 1)
            mark = done[active]
            np.put_along_axis(mark, pick, np.take_along_axis(mark, pick, 1) | real, 1)
            done[active] = mark
            step = np.where(real[:, :, None], table[np.where(real, node, 0)], -1).reshape(len(active), -1)
            step = np.where(step < 0, n, step)
            step[seen[active[:, None], step]] = n
            fresh = np.sort(step, 1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
            keep = (fresh < n).any(0)
            fresh = fresh[:, keep] if keep.any() else fresh[:, :1]
        return ids, sims

    def search(self, q: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Best nodes of the ground layer for each query."""
        start = np.full((len(q), 1), self.entry, np.int64)
        for layer in range(len(self.links) - 1, 0, -1):
            start = self.beam(q, layer, start, 2)[0]
        more = np.broadcast_to(self.starts, (len(q), len(self.starts)))
        return self.beam(q, 0, np.concatenate([start, more], 1), size)


class Shard:
    """One shard: its graph, the beam that passed the audit, and its local components."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, raw: np.ndarray, least: float):
        self.ids, self.copies, self.least = ids, copies, least
        self.exact = raw.astype(np.float64)
        self.norm = np.linalg.norm(self.exact, axis=1)
        self.unit = (self.exact / self.norm[:, None]).astype(np.float32)
        self.graph = SmallWorld(self.unit)
        self.beam = min(BEAM, max(1, len(ids)))
        self.recall = 1.0  # lowest share of audited queries found whole, with the final beam of each audit
        self.count = np.zeros(len(ids), np.int64)
        self.label = np.arange(len(ids))

    def links(self, raw: np.ndarray, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all verified links of some vectors; ``own``: they are the shard's."""
        exact = raw.astype(np.float64)
        norm = np.linalg.norm(exact, axis=1)
        unit = (exact / norm[:, None]).astype(np.float32)
        most = AUDIT_QUERIES if own else AUDIT_FOREIGN
        self._audit(unit, np.unique(np.linspace(0, len(unit) - 1, min(most, len(unit))).astype(int)), own)
        query, node = self._found(unit, self.beam)
        cosine = np.einsum("nd,nd->n", exact[query], self.exact[node]) / (norm[query] * self.norm[node])
        good = cosine >= self.least
        return query[good], node[good]

    def _found(self, unit: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        queries, nodes = [], []
        left = np.arange(len(unit))
        while len(left):
            full = []
            step = max(8, min(_BATCH, (1 << 22) // (size * 8), (1 << 27) // (len(self.ids) + 1)))
            for at in range(0, len(left), step):
                now = left[at : at + step]
                ids, sims = self.graph.search(unit[now], size)
                close = (sims >= self.least - _SLACK) & (ids >= 0)
                whole = close[:, -1] & (size < len(self.ids))
                full.append(now[whole])
                close[whole] = False
                r, c = np.nonzero(close)
                queries.append(now[r])
                nodes.append(ids[r, c])
            left, size = np.concatenate(full), min(2 * size, len(self.ids))
        none = np.zeros(0, np.int64)
        return (np.concatenate(queries), np.concatenate(nodes)) if queries else (none, none)

    def _audit(self, unit: np.ndarray, sample: np.ndarray, own: bool) -> None:
        """Widen the beam until enough of the sampled queries have all their links found."""
        while len(sample):
            share = self._found_whole(unit, sample, own)
            if share >= AUDIT or self.beam >= len(self.ids):
                self.recall = min(self.recall, share)
                return
            self.beam = min(2 * self.beam, len(self.ids))

    def _found_whole(self, unit: np.ndarray, sample: np.ndarray, own: bool) -> float:
        """Share of the queries with links to other vectors for which the search finds them all."""
        linked = whole = 0
        for at in range(0, len(sample), 64):
            now = sample[at : at + 64]
            missed = unit[now] @ self.unit.T >= self.least + _SLACK
            if own:
                missed[np.arange(len(now)), now] = False
            some = missed.any(1)
            query, node = self._found(unit[now], self.beam)
            missed[query, node] = False
            linked += int(some.sum())
            whole += int((some & ~missed.any(1)).sum())
        return whole / linked if linked else 1.0

    def join_own(self) -> tuple[np.ndarray, np.ndarray]:
        """Count the links within the shard; the links of a spanning forest."""
        query, node = self.links(self.exact, own=True)
        a, b = np.minimum(query, node), np.maximum(query, node)
        pair = np.unique(np.stack([a, b], 1)[a != b], axis=0)
        np.add.at(self.count, pair[:, 0], self.copies[pair[:, 1]])
        np.add.at(self.count, pair[:, 1], self.copies[pair[:, 0]])
        label = self.label
        while True:  # least label over links, then jumps
            least = label.copy()
            np.minimum.at(least, pair[:, 0], label[pair[:, 1]])
            np.minimum.at(least, pair[:, 1], label[pair[:, 0]])
            least = least[least]
            if (least == label).all():
                break
            label = least
        self.label = label
        tied = np.flatnonzero(label != np.arange(len(label)))
        return self.ids[tied], self.ids[label[tied]]

    def join(self, ids: np.ndarray, copies: np.ndarray, raw: np.ndarray):
        """Counts of other vectors' links into this shard, and one link to each local component."""
        query, node = self.links(raw)
        other = ids[query] != self.ids[node]
        query, node = query[other], node[other]
        np.add.at(self.count, node, copies[query])
        counts = np.bincount(query, weights=self.copies[node], minlength=len(ids)).astype(np.int64)
        pair = np.unique(np.stack([query, self.label[node]], 1), axis=0)
        return counts, ids[pair[:, 0]], self.ids[pair[:, 1]]


def _rows(a, b, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"]
    )


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch["vector"].flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(batch), -1)


def _search(least: float):
    """Build each shard from its first rows, then stream the queries that follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, own, shard = None, [], None

        def built() -> Iterator[pa.RecordBatch]:
            nonlocal shard
            if shard is None and own:
                ids, copies, raw = (np.concatenate(x) for x in zip(*own))
                shard = Shard(ids, copies, raw, least)
                own.clear()
                a, b = shard.join_own()
                yield _rows(a, b, np.zeros(len(a), np.int64))

        def finished() -> Iterator[pa.RecordBatch]:
            yield from built()
            if shard is not None:
                some = np.flatnonzero(shard.count)
                yield _rows(shard.ids[some], pa.nulls(len(some)), shard.count[some])

        for batch in batches:
            key = batch["place"].to_numpy()
            for at in np.split(np.arange(len(key)), np.flatnonzero(key[1:] != key[:-1]) + 1):
                if not len(at):
                    continue
                if place is not None and key[at[0]] != place:
                    yield from finished()
                    shard = None
                place = key[at[0]]
                part = batch.slice(int(at[0]), len(at))
                kind = part["kind"].to_numpy()
                cut = int(np.searchsorted(kind, 1))
                for piece, query in ((part.slice(0, cut), False), (part.slice(cut), True)):
                    if not len(piece):
                        continue
                    row = (piece["id"].to_numpy(), piece["copies"].to_numpy(), _matrix(piece))
                    if not query:
                        own.append(row)
                        continue
                    yield from built()
                    if shard is None:
                        continue
                    counts, a, b = shard.join(*row)
                    some = np.flatnonzero(counts)
                    yield _rows(row[0][some], pa.nulls(len(some)), counts[some])
                    yield _rows(a, b, np.zeros(len(a), np.int64))
        yield from finished()

    return run


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = LEAST_COSINE
) -> DataFrame:
    """One row per row of ``vectors``: key, n_links, component_id, kept."""
    spark = vectors.sparkSession
    small_batches(spark, 2048)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(vector)
    usable = v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(
        F.coalesce(F.col(key).cast("long"), F.lit(LEAST_LONG)).alias("id"),
        F.when(F.coalesce(usable, F.lit(False)), v).alias("vector"),
    )
    good = rows.where(F.col("vector").isNotNull())
    distinct = store(
        good.groupBy("vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "distinct-vectors"
    )
    shards = max(SHARDS, -(-distinct.count() // SHARD_VECTORS)) | 1  # odd: each pair of shards has one side
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    steps = F.sequence(F.lit(0), F.lit(shards // 2))
    dealt = distinct.select(
        "id", "copies", "vector", F.size("vector").alias("dim"), shard.alias("shard"), F.explode(steps).alias("step")
    ).withColumns(
        {
            "place": F.col("dim").cast("long") * F.lit(2**31)
            + F.pmod(F.col("shard") + F.col("step"), F.lit(shards)),
            "kind": (F.col("step") > 0).cast("int"),
        }
    )
    placed = dealt.select("place", "kind", "id", "copies", "vector").repartition(shards, "place")
    found = store(
        placed.sortWithinPartitions("place", "kind").mapInArrow(_search(least), "a long, b long, n long"),
        "vector-links",
    )
    parts = connected_components(found.where("b IS NOT NULL"), "a", "b").withColumnRenamed("node", "id")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    named = (
        distinct.join(counts, "id", "left")
        .join(parts, "id", "left")
        .select(
            F.col("vector").alias("_vector"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component"),
        )
    )
    joined = rows.join(named, F.col("vector") == F.col("_vector"), "left")
    component = F.coalesce("component", "id")
    real = lambda c: F.when(c != F.lit(LEAST_LONG), c)
    return joined.select(
        real(F.col("id")).alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        real(component).alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )
