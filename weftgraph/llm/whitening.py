"""Embedding whitening: streaming covariance, merged over partitions, and a symmetric QR eigen-solve.

1. Each entry c of a vector becomes y = floor(64 * c) (x = y + OFFSET is what the result speaks of; a shift changes no
   covariance, and y keeps more digits).  A vector's y are packed in the smallest integer type that holds them.
2. The fit list is each distinct vector once: packed vectors are grouped, with partial groups before the shuffle, so a
   vector that a third of all rows repeat costs one row a task.
3. Welford's rank-one updates run over each task's vectors; the tasks' states (count, exact sums, mean, co-moments) are
   merged by the parallel update formula, FAN at a time in a tree of tasks, until FAN or fewer reach the driver.
4. The driver solves the d x d covariance: Householder tridiagonal form, then implicit QR steps with Wilkinson's shift.
   Components are numbered by falling eigenvalue; the greatest entry of each is positive.
5. A second pass over the fit list takes the covariance of the whitened vectors themselves, for identity_error.
6. All rows are projected, batch by batch.

Only states of d x d numbers are broadcast or reach the driver: their size is that of the model, not of the data.

Edge cases: a vector that is null, or holds a null, NaN or infinite entry, is dropped.  Vectors of each length are a
table of their own with their own components (an empty vector has none, and so no row).  Entries beyond 2**56 count as 2**56.
Directions without variance (eigenvalue at rounding level) are no components, so a fit list of one
vector gives no rows.  Repeated vectors are in the fit list once, and each of their rows is returned; a null vec_id
stays null; a deviation that a long cannot hold is null; equal eigenvalues have components in the order of the solver.
Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, freed, saved

COMPONENTS, SCALE, OFFSET = 16, 64, 1_000_000
FAN = 16  # states merged by one task
_MOST = 2.0**56
_TYPES = ("<i1", "<i2", "<i4", "<i8")
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Moments:
    """Count, exact sums, mean and co-moments of vectors of one length."""

    def __init__(self, d: int):
        self.n, self.total, self.mean, self.m2 = 0, np.zeros(d, object), np.zeros(d), np.zeros((d, d))

    def add(self, rows: np.ndarray) -> None:
        """Welford's rank-one update, vector by vector."""
        step = np.empty_like(self.m2)
        for v in rows.astype(np.float64):
            self.n += 1
            before = v - self.mean
            self.mean += before / self.n
            np.multiply.outer(before, v - self.mean, out=step)
            self.m2 += step
        if rows.dtype.kind == "i":
            low = rows & 0xFFFFFFFF  # two halves: their sums over a batch stay within 64 bits
            self.total += (rows >> 32).sum(0).astype(object) * (1 << 32) + low.sum(0).astype(object)

    def merge(self, other: Moments) -> None:
        """The parallel formula: co-moments of both, and the rank-one term of their means' difference."""
        n = self.n + other.n
        if n:
            gap = other.mean - self.mean
            self.m2 += other.m2 + np.outer(gap, gap) * (self.n * other.n / n)
            self.mean += gap * (other.n / n)
        self.n, self.total = n, self.total + other.total

    def covariance(self) -> np.ndarray:
        return (self.m2 + self.m2.T) / (2 * self.n)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and Q with a = Q T Q', by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0:
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (rows) of a symmetric matrix."""
    n = len(a)
    scale = float(np.abs(a).max(initial=0.0)) or 1.0
    d, e, q = tridiagonal(a / scale)
    q = np.ascontiguousarray(q.T)  # rows are rotated
    eps = np.finfo(float).eps
    hi = n - 1
    while hi > 0:
        small = np.abs(e[:hi]) <= eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1])) + 1e-300
        e[:hi][small] = 0
        if small[hi - 1]:
            hi -= 1
            continue
        lo = hi - 1
        while lo > 0 and e[lo - 1] != 0:
            lo -= 1
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + np.copysign(np.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            p, t, o = d[k], d[k + 1], e[k]
            d[k] = c * c * p + 2 * c * s * o + s * s * t
            d[k + 1] = s * s * p - 2 * c * s * o + c * c * t
            e[k] = (c * c - s * s) * o + c * s * (t - p)
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    vectors = q[order]
    top = vectors[np.arange(n), np.abs(vectors).argmax(1)] if n else np.zeros(0)
    return d[order] * scale, vectors * np.where(top < 0, -1.0, 1.0)[:, None]


class Fit:
    """The components of the vectors of one length."""

    def __init__(self, moments: Moments):
        v = moments.covariance()
        values, vectors = symmetric_qr(v)
        trace = float(np.trace(v))
        k = int((values > 8 * len(v) * np.finfo(float).eps * max(trace, 0.0)).sum()) if trace > 0 else 0
        k = min(k, COMPONENTS)
        self.n, self.total = moments.n, moments.total
        self.to = vectors[:k] / np.sqrt(values[:k])[:, None]
        self.explained = values[:k] / trace if k else values[:0]
        self.identity_error = 0.0

    def _centred(self, y: np.ndarray) -> np.ndarray:
        """n * y - S, exactly: longs where they fit, whole numbers of any size otherwise."""
        most = max(map(abs, self.total.tolist()), default=0)
        if self.n * int(np.abs(y).max(initial=0)) + most < 1 << 62:
            return self.n * y - self.total.astype(np.int64)
        return self.n * y.astype(object) - self.total

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return (self._centred(y) / self.n).astype(np.float64) @ self.to.T

    def deviations(self, y: np.ndarray) -> list:
        gap = self._centred(y)
        if gap.dtype != object:
            most = int(np.abs(gap).max(initial=0))
            if most * most * max(1, gap.shape[1]) < 1 << 63:
                return (gap * gap).sum(1).tolist()
        sums = [sum(int(g) ** 2 for g in row) for row in gap.tolist()]
        return [x if x < 1 << 63 else None for x in sums]


def pack(y: np.ndarray) -> tuple[int, bytes]:
    low, high = int(y.min(initial=0)), int(y.max(initial=0))
    w = next(i for i, t in enumerate(_TYPES) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return w, y.astype(_TYPES[w]).tobytes()


def _unpack(ws: list, ys: list) -> list[np.ndarray]:
    return [np.frombuffer(y, _TYPES[w]).astype(np.int64) for w, y in zip(ws, ys)]


def _clean(column: pa.Array) -> tuple[list[int], list[np.ndarray]]:
    """Places of the usable vectors of a list column, and their y."""
    values = column.flatten()
    nulls = values.is_null().to_numpy(zero_copy_only=False)
    numbers = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate(([0], np.cumsum(nulls | ~np.isfinite(numbers))))
    at = np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
    fine = column.is_valid().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]])
    with np.errstate(over="ignore", invalid="ignore"):
        y = np.floor(np.clip(np.nan_to_num(numbers, posinf=_MOST, neginf=-_MOST) * SCALE, -_MOST, _MOST)).astype(np.int64)
    places = np.flatnonzero(fine).tolist()
    return places, [y[at[i] : at[i + 1]] for i in places]


def fit_list(vectors: DataFrame) -> DataFrame:
    """Each distinct vector once, packed (w, y)."""

    def make():
        def run(column):
            return list(map(list, zip(*map(pack, _clean(column)[1])))) or [[], []]

        return run

    return arrow_map(vectors.select("embedding"), make, "w int, y binary", raw=True).distinct()


def _states(df: DataFrame, take) -> dict[int, Moments]:
    """The states, by length, of what take(lists of w and y) yields, merged in a tree of tasks."""

    class Gather:
        def __init__(self, each):
            self.each, self.kept = each, {}

        def __call__(self, *cols):
            self.each(self.kept, *cols)
            return [[], []]

        def flush(self):
            from pyspark import TaskContext

            return [[TaskContext.get().partitionId()], [pickle.dumps(self.kept)]] if self.kept else [[], []]

    def own(kept, ws, ys):
        for rows in take(_unpack(ws, ys)):
            kept.setdefault(rows.shape[1], Moments(rows.shape[1])).add(rows)

    def join(kept, parts, states):
        for state in states:
            _merge(kept, pickle.loads(state))

    schema = "part int, state binary"
    states = saved(arrow_map(df.select("w", "y"), lambda: Gather(own), schema))
    while (tasks := states.count()) > FAN:
        before = states
        states = saved(arrow_map(states.repartition(-(-tasks // FAN), F.floor(F.col("part") / FAN)), lambda: Gather(join), schema))
        freed(before)
    out: dict = {}
    for r in states.orderBy("part").collect():
        _merge(out, pickle.loads(r.state))
    freed(states)
    return out


def _merge(into: dict, more: dict) -> None:
    for d, m in more.items():
        if d in into:
            into[d].merge(m)
        else:
            into[d] = m


def _by_length(vectors: list[np.ndarray]):
    """Places and stacked vectors of each length."""
    lengths: dict = {}
    for i, v in enumerate(vectors):
        lengths.setdefault(len(v), []).append(i)
    return [(at, np.stack([vectors[i] for i in at])) for at in lengths.values()]


def train(vectors: DataFrame) -> dict[int, Fit]:
    """The fit of each length of vectors (embedding array of numbers)."""
    listed = saved(fit_list(vectors))
    fits = {d: Fit(m) for d, m in _states(listed, lambda v: [rows for _, rows in _by_length(v)]).items() if d}
    for d, fit in fits.items():
        if k := len(fit.to):
            z = _states(listed, lambda v, d=d, fit=fit: [fit.whitened(rows) for _, rows in _by_length(v) if rows.shape[1] == d])
            fit.identity_error = float(np.abs(z[k].covariance() - np.eye(k)).max())
    freed(listed)
    return fits


def whiten(vectors: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """A row for each usable vector and component of its length."""

    def make():
        def run(ids, column):
            places, ys = _clean(column)
            out = [[] for _ in range(7)]
            for at, rows in _by_length(ys):
                fit = fits.get(rows.shape[1])
                if fit is None or not (k := len(fit.to)):
                    continue
                row = pa.array(np.repeat(np.array([places[i] for i in at]), k))
                m = len(at)
                out[0].append(ids.take(row))
                out[1].append(pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)))
                out[2].append(pa.array(np.full(m * k, fit.n, np.int64)))
                out[3].append(pa.array(fit.deviations(rows), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))))
                out[4].append(pa.array(fit.whitened(rows).ravel()))
                out[5].append(pa.array(np.tile(fit.explained, m)))
                out[6].append(pa.array(np.full(m * k, fit.identity_error)))
            return [pa.concat_arrays(c) if c else [] for c in out]

        return run

    return arrow_map(vectors.select(F.col("vec_id").cast("long"), "embedding"), make, SCHEMA, raw=True)


def whitening_digest(embeddings: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    own = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return whiten(own, train(own))
