"""Whitening of embeddings: blockwise QR, Householder bidiagonalisation, dqds, twisted factorisations.

Entries become whole numbers; each distinct vector counts once. Sums are exact, so centred rows are
the exact n*x - S over n. Tasks reduce their centred rows to a triangle by QR, block after block, and
triangles are reduced pairwise up a tree of tasks; only the last few, of d x d numbers each, reach the
driver. There the triangle is made bidiagonal, the quotient-difference algorithm with shifts (dqds)
finds its singular values to high relative accuracy, and a twisted factorisation for each value gives
its vector without squaring the matrix. Values closer to each other than ``_CLOSE`` have no well
separated vectors; theirs are found together in the space that the others leave. A direction is a singular vector over its
standard deviation; its largest entry is positive.

The covariance of the whitened vectors is measured over all distinct vectors, each task's moments
merged up the same tree.

Odd cases: rows whose vector is null or holds a null or non-finite entry drop, and so do vectors of
another length than the most frequent one (ties: the longer one). Components whose variance is zero
(fewer distinct vectors than dimensions, constant or dependent dimensions) have no whitened values and
are not returned; with fewer than two distinct vectors nothing is. A deviation beyond 64 bits is null.
Entries beyond 2**60 count as that. Null and repeated keys stay. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, store

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
_LARGEST = 2**60
_FAN_IN = 16
_CLOSE = 1e-5  # relative gap of variances below which vectors are found together
_EPS = np.finfo(float).eps


# --- dense linear algebra on the d x d triangle -----------------------------------------------


def _reflect(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Householder vector v and first entry a, with (I - 2vv')x = (a, 0, ...)."""
    a = -np.copysign(np.linalg.norm(x), x[0])
    v = x.copy()
    v[0] -= a
    norm = np.linalg.norm(v)
    return (v / norm if norm else v), float(a)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of U'rV, and V, for a square r."""
    b, n = r.astype(float).copy(), len(r)
    right = np.eye(n)
    for k in range(n):
        v, _ = _reflect(b[k:, k])
        b[k:, k:] -= 2 * np.outer(v, v @ b[k:, k:])
        if k < n - 2:
            v, _ = _reflect(b[k, k + 1 :])
            b[k:, k + 1 :] -= 2 * np.outer(b[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ v, v)
    return np.diagonal(b).copy(), np.diagonal(b, 1).copy(), right


def _transform(q: list[float], e: list[float], shift: float):
    """One dqds step: new q and e and the smallest intermediate d; None for too large a shift."""
    d, least, new_q, new_e = q[0] - shift, q[0] - shift, [], []
    for i in range(len(e)):
        total = d + e[i]
        if shift and (d < 0 or total <= 0):
            return None
        ratio = q[i + 1] / total if total else 1.0
        new_q.append(total)
        new_e.append(e[i] * ratio)
        d = (d * ratio if total else q[i + 1]) - shift
        least = min(least, d)
    if shift and d < 0:
        return None
    return new_q + [d], new_e, least


def _lower_bound(q: list[float], e: list[float]) -> float:
    """A bound below the smallest eigenvalue: one over the trace of the inverse."""
    d = q[0]
    total = 1 / d if d > 0 else np.inf
    for i in range(len(e)):
        both = d + e[i]
        d = d * (q[i + 1] / both) if both else q[i + 1]
        total += 1 / d if d > 0 else np.inf
    return 1 / total


def qd_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, falling, by dqds with lower-bound shifts."""
    found: list[float] = []
    work = [((diagonal**2).tolist(), (upper**2).tolist(), 0.0)]
    while work:
        q, e, base = work.pop()
        while len(q) > 1:
            if q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            cut = next((i for i, x in enumerate(e) if x <= _EPS**2 * (base + min(q[i], q[i + 1]))), None)
            if cut is not None:
                work.append((q[: cut + 1], e[:cut], base))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            shift = _lower_bound(q, e) * (1 - 8 * len(q) * _EPS)
            step = None
            while step is None:
                step = _transform(q, e, shift)
                shift, used = (shift / 2 if shift > _EPS * base else 0.0), shift
            q, e = step[:2]
            base += used
        found.append(q[0] + base)
    return np.sort(np.array(found))[::-1]


def twisted_vector(diagonal: np.ndarray, upper: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of B'B for one eigenvalue, from its twisted factorisation at the best index."""
    n = len(diagonal)
    tiny = np.finfo(float).tiny / _EPS + _EPS * _EPS * value
    safe = lambda x: x if abs(x) > tiny else np.copysign(tiny, x)
    d = [safe(x * x) for x in diagonal.tolist()]
    lower = [b / safe(a) for a, b in zip(diagonal.tolist(), upper.tolist())]
    s, down = [-value], []
    for i in range(n - 1):
        down.append(d[i] * lower[i] / safe(s[i] + d[i]))
        s.append(down[i] * lower[i] * s[i] - value)
    p, up = [0.0] * n, [0.0] * (n - 1)
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        ratio = d[i] / safe(d[i] * lower[i] ** 2 + p[i + 1])
        up[i] = lower[i] * ratio
        p[i] = p[i + 1] * ratio - value
    twist = int(np.argmin(np.abs(np.array(s) + np.array(p) + value)))
    z = np.zeros(n)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def singular_vectors(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors of a bidiagonal matrix for its squared singular values, falling.

    Values apart from all others get theirs by twisted factorisation. The rest is decided in the
    space left over by those, where the matrix is reduced to as many columns.
    """
    n = len(values)
    near = np.concatenate([[False], values[:-1] - values[1:] <= _CLOSE * values[:-1], [False]])
    close = near[:-1] | near[1:]
    z = np.zeros((n, n))
    for i in np.flatnonzero(~close).tolist():
        z[:, i] = twisted_vector(diagonal, upper, values[i])
    if close.any():
        rest = np.linalg.qr(z[:, ~close], mode="complete")[0][:, int((~close).sum()) :]
        b = np.diag(diagonal) + np.diag(upper, 1)
        z[:, close] = rest @ np.linalg.svd(b @ rest, full_matrices=False)[2].T
    return z


def components(r: np.ndarray, n: int, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Variances (falling), unit directions as columns, and the trace, from the triangle of n rows."""
    diagonal, upper, right = bidiagonalise(r)
    values = qd_values(diagonal, upper)
    if not values[0]:
        return np.zeros(0), np.zeros((len(r), 0)), 0.0
    limit = (64 * len(r) * _EPS) ** 2 * values[0]
    z = right @ singular_vectors(diagonal, upper, values)
    z = z[:, : min(most, int((values > limit).sum()))]
    z *= np.sign(z[np.abs(z).argmax(0), np.arange(z.shape[1])]) if z.size else 1
    return values[: z.shape[1]] / n, z, float(values.sum() / n)


# --- passes over the vectors ------------------------------------------------------------------


def _whole(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dim)


def _apart(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S exactly: as 64-bit numbers if they fit, else as numbers of any size."""
    largest = max(float(np.abs(x).max(initial=0)) * n, *map(abs, map(float, sums)))
    if largest < 2.0**61:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_apart(x, n, sums) / n).astype(float)


def _deviations(apart: np.ndarray) -> pa.Array:
    """Sum of squares of each row; null beyond 64 bits."""
    if not len(apart):
        return pa.array([], pa.int64())
    if float(np.abs(apart).max()) ** 2 * apart.shape[1] < 2.0**62:
        return pa.array((apart * apart).sum(1))
    big = [sum(v * v for v in map(int, row)) for row in apart]
    return pa.array([v if v < 2**63 else None for v in big], pa.int64())


def _triangle(blocks: list[np.ndarray]) -> np.ndarray:
    r = np.linalg.qr(np.concatenate(blocks), mode="r")
    return np.concatenate([r, np.zeros((r.shape[1] - len(r), r.shape[1]))]) if len(r) < r.shape[1] else r


def _merged(a: tuple, b: tuple) -> tuple:
    """Count, mean and summed products of two sets of rows together."""
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


class _Triangles:
    """Reduces centred rows to one triangle."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return _triangle([_centred(x, self.n, self.sums)])

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _triangle([a, b])

    def pack(self, r: np.ndarray) -> list[float]:
        return r.ravel().tolist()

    def unpack(self, flat: list[float]) -> np.ndarray:
        return np.array(flat).reshape(len(self.sums), -1)


class _Moments:
    """Mean and covariance of whitened rows."""

    def __init__(self, n: int, sums: list[int], directions: np.ndarray):
        self.n, self.sums, self.directions = n, sums, directions

    def of_rows(self, x: np.ndarray) -> tuple:
        w = _centred(x, self.n, self.sums) @ self.directions
        mean = w.mean(0)
        return len(w), mean, (w - mean).T @ (w - mean)

    def merge(self, a: tuple, b: tuple) -> tuple:
        return _merged(a, b)

    def pack(self, m: tuple) -> list[float]:
        return [float(m[0]), *m[1].tolist(), *m[2].ravel().tolist()]

    def unpack(self, flat: list[float]) -> tuple:
        k = self.directions.shape[1]
        return flat[0], np.array(flat[1 : k + 1]), np.array(flat[k + 1 :]).reshape(k, k)


def _reduced(fit: DataFrame, dim: int, parts):
    """One merged state of all rows: within tasks, then up a tree of ``_FAN_IN`` states a task."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = None
        for batch in batches:
            if len(batch):
                new = parts.of_rows(_whole(batch, dim))
                state = new if state is None else parts.merge(state, new)
        if state is not None:
            yield pa.RecordBatch.from_pydict(
                {"part": [TaskContext.get().partitionId()], "state": [parts.pack(state)]}
            )

    def later(table: pa.Table) -> pa.Table:
        part, state = table["part"][0].as_py(), None
        for flat in table["state"]:
            new = parts.unpack(flat.as_py())
            state = new if state is None else parts.merge(state, new)
        return pa.table({"part": [part // _FAN_IN], "state": [parts.pack(state)]})

    states = fit.mapInArrow(first, "part long, state array<double>")
    count = fit.rdd.getNumPartitions()
    while count > _FAN_IN:
        group = F.expr(f"part div {_FAN_IN}").alias("group")
        states = states.groupBy(group).applyInArrow(later, "part long, state array<double>")
        count = -(-count // _FAN_IN)
    state = None
    for r in sorted(states.collect()):  # at most _FAN_IN rows of d x d numbers
        new = parts.unpack(r["state"])
        state = new if state is None else parts.merge(state, new)
    return state


def whole_numbers(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """floor(scale * c) + shift for each entry."""
    scaled = lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(_LARGEST))), F.lit(-float(_LARGEST))))
    return F.transform(vector, lambda c: scaled(c).cast("long") + F.lit(shift).cast("long"))


def whiten(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    most: int = COMPONENTS,
    scale: int = SCALE,
    shift: int = SHIFT,
) -> DataFrame:
    """One row per remaining row and component: key, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    v = F.col(vector)
    rows = vectors.where(v.isNotNull() & ~F.exists(v, bad)).select(
        F.col(key).alias("key"), whole_numbers(v, scale, shift).alias("x")
    )
    schema = (
        f"{key} {vectors.schema[key].dataType.simpleString()}, component int, n long, deviation long, "
        "whitened double, explained double, identity_error double"
    )
    empty = spark.createDataFrame([], schema)
    # one row per length
    lengths = rows.groupBy(F.size("x").alias("dim")).count().sort(F.desc("count"), F.desc("dim")).first()
    dim = lengths["dim"] if lengths else 0
    if not dim:
        return empty
    rows = rows.where(F.size("x") == dim)
    fit = store(rows.select("x").distinct(), "distinct-vectors")
    sums = fit.select(F.posexplode("x")).groupBy("pos").agg(
        F.sum(F.col("col").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")
    )
    totals = sorted((r["pos"], int(r["s"]), r["n"]) for r in sums.collect())  # one row per dimension
    n, sums = totals[0][2], [t[1] for t in totals]
    variances, directions, trace = components(_reduced(fit, dim, _Triangles(n, sums)), n, most)
    k = len(variances)
    if not k:
        return empty
    scaled = directions / np.sqrt(variances)
    _, _, products = _reduced(fit, dim, _Moments(n, sums, scaled))
    error = float(np.abs(products / n - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = _apart(_whole(batch, dim), n, sums)
            w = (apart / n).astype(float) @ scaled
            flat = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), k).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["key"], _deviations(apart), flat], ["key", "deviation", "w"])

    kind = vectors.schema[key].dataType.simpleString()
    projected = rows.mapInArrow(project, f"key {kind}, deviation long, w array<double>")
    shares = F.array(*[F.lit(float(e / trace)) for e in variances])
    return projected.select("key", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        F.col("key").alias(key),
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
