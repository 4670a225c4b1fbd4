"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Vectors are put on a grid of integers, so that sums and squared deviations are exact. Spark adds up counts and sums, then the scatter of the centred
vectors, entry by entry; what reaches the driver has the size of the scatter (the square of the dimension) however many vectors
there are. There the scatter is factored into L L' with pivoting, and plane rotations make the columns of L orthogonal: their squared
lengths are the scatter's eigenvalues and their directions its eigenvectors. Another pass measures the covariance of the whitened vectors.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, SHIFT = 64.0, 1_000_000
WIDEST = 2.0 ** 52  # scaled entries beyond it count as it, so that they are exact as doubles and longs
ROWS = 4096         # vectors that a worker handles at once


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with a[order][:, order] = L L' for a positive semidefinite matrix: L is lower triangular with a column for each
    pivot above rounding, taken from the largest to the smallest."""
    a = a.copy()
    d = len(a)
    order, least = np.arange(d), d * np.finfo(float).eps * max(a.diagonal().max(initial=0.0), 0.0)
    l = np.zeros((d, d))
    for k in range(d):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if a[p, p] <= least:
            return l[:, :k], order
        if p != k:
            a[[k, p]], l[[k, p]], order[[k, p]] = a[[p, k]], l[[p, k]], order[[p, k]]
            a[:, [k, p]] = a[:, [p, k]]
        l[k:, k] = a[k:, k] / np.sqrt(a[k, k])
        a[k + 1:, k + 1:] -= np.outer(l[k + 1:, k], l[k + 1:, k])
    return l, order


def one_sided_jacobi(l: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Rotates pairs of columns until all are orthogonal. A round takes disjoint pairs, dealt as in a tournament."""
    m = l.copy()
    r = m.shape[1]
    seats = list(range(r)) + [-1] * (r % 2)
    tol = max(len(m), 1) * np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = np.array([(a, b) for a, b in zip(seats[:half], seats[::-1][:half]) if a >= 0 and b >= 0])
            seats = [seats[0], seats[-1], *seats[1:-1]]
            if not len(pairs):
                continue
            x, y = m[:, pairs[:, 0]], m[:, pairs[:, 1]]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(xy) > tol * np.sqrt(xx * yy)
            if not turn.any():
                continue
            turned = True
            zeta = (yy[turn] - xx[turn]) / (2 * xy[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            x, y = x[:, turn], y[:, turn]
            m[:, pairs[turn, 0]], m[:, pairs[turn, 1]] = c * x - s * y, s * x + c * y
        if not turned:
            break
    return m


def principal(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a scatter above rounding, by falling eigenvalue; the largest entry of each vector is positive."""
    l, order = pivoted_cholesky(scatter)
    m = one_sided_jacobi(l)
    norms = np.sqrt((m * m).sum(0))
    by = np.argsort(-norms, kind="stable")
    by = by[norms[by] ** 2 > len(scatter) * np.finfo(float).eps * max(norms.max(initial=0.0), 0.0) ** 2]
    vectors = np.zeros((len(scatter), len(by)))
    vectors[order] = m[:, by] / norms[by]
    if len(by):
        vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(by))] < 0, -1.0, 1.0)
    return norms[by] ** 2, vectors


def on_grid(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, y) for each dimension in a column of lists: the rows without null or non-finite entries, and their
    vectors y = floor(64 c) as whole doubles (x is y plus the shift)."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64())  # skips null lists
    values = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False)
    long = np.maximum(size, 0)
    first = np.cumsum(long) - long
    sound = (size >= 0) & (np.bincount(np.repeat(np.arange(len(size)), long)[~np.isfinite(values)], minlength=len(size)) == 0)
    for d in np.unique(size[sound]):
        rows = np.flatnonzero(sound & (size == d))
        yield int(d), rows, np.floor(np.clip(values[first[rows][:, None] + np.arange(d)] * SCALE, -WIDEST, WIDEST))


def sums(vectors: DataFrame) -> list:
    """(d, i, n, s): vectors of dimension d, and the exact sum of their y in place i; i = -1 for the count alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, rows, y in on_grid(batch.column(0)):
                high = np.floor(y / 2.0 ** 20)
                parts = [[int(v) for v in part.astype(np.int64).sum(0)] for part in (high, y - high * 2.0 ** 20)]
                count[d] = count.get(d, 0) + len(rows)
                total[d] = total.get(d, np.zeros(d, object)) + np.array([(h << 20) + w for h, w in zip(*parts)], object)
        found = [(d, i, n, Decimal(int(s))) for d, n in count.items() for i, s in [(-1, 0), *enumerate(total[d])]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], ["d", "i", "n", "s"])

    return vectors.mapInArrow(run, "d int, i int, n long, s decimal(38,0)").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()


def second_moments(vectors: DataFrame, of: Callable[[np.ndarray], np.ndarray], d: int, width: int) -> np.ndarray:
    """Sum of the outer products of of(y) over the vectors of dimension d: one row per task and entry, added up in Spark."""
    i, j = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for own, rows, y in on_grid(batch.column(0)):
                if own == d:
                    for a in range(0, len(y), ROWS):
                        z = of(y[a:a + ROWS])
                        total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(i))), pa.array(total[i, j])], ["at", "v"])

    found = vectors.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((width, width))
    for at, v in found:
        out[i[at], j[at]] = out[j[at], i[at]] = v
    return out


@dataclass(frozen=True)
class Whitening:
    """A fit: d and n, sums of y, its mean, eigenvalues of the covariance, components as columns, and the trace of the covariance."""
    d: int
    n: int
    total: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return ((y - self.mean) @ self.vectors) / np.sqrt(self.values)

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Exact sum of squares of n y - total (which is n x - S); null where a long can't hold it."""
        if self.n * max(np.abs(y).max(initial=0.0), np.abs(self.mean).max(initial=0.0)) * 2 * np.sqrt(max(self.d, 1)) < 2.0 ** 31:
            e = self.n * y.astype(np.int64) - np.array(self.total, np.int64)
            return (e * e).sum(1).tolist()
        out = []
        for row in y:
            v = sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.total))
            out.append(v if v < 1 << 63 else None)
        return out


def fit(table: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Mean, components and eigenvalues of all vectors on the grid; three passes over them.

    Null vectors and those with null or non-finite entries aren't used. Vectors of several lengths: the most frequent length is
    fitted, the longer one at a tie. Fewer components than asked for come back where the covariance has a lower rank (one vector
    or equal vectors: none). Repeated rows count each.
    """
    vectors = table.select(F.col(vec_col).alias("v"))
    found = sums(vectors)
    n, d = max(((r["n"], r["d"]) for r in found if r["i"] == -1), default=(0, 0))
    by_place = {r["i"]: int(r["s"]) for r in found if r["d"] == d and r["i"] >= 0}
    total = [by_place[i] for i in range(d)] if n else []
    mean = np.array([s / n for s in total], float)
    scatter = second_moments(vectors, lambda y: y - mean, d, d) if n else np.zeros((0, 0))
    values, directions = principal(scatter)
    k = min(components, len(values))
    model = Whitening(d, n, total, mean, values[:k] / max(n, 1), directions[:, :k], float(np.trace(scatter)) / max(n, 1), 0.0)
    if not k:
        return model
    # the whitened mean is that of centred vectors, zero up to rounding
    error = np.abs(second_moments(vectors, model.whitened, d, k) / n - np.eye(k)).max()
    return replace(model, identity_error=float(error))


def whiten(table: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector that was fitted (see ``fit``) and component: vec_id, component, n, deviation, whitened, explained,
    identity_error. ``deviation`` is null where a long can't hold it. Empty table or no component: no rows. Only the two columns are read."""
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v"))
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, y in on_grid(batch.column(1)):
                if d != model.d or not k:
                    continue
                for a in range(0, len(at), ROWS):
                    own, part = at[a:a + ROWS], y[a:a + ROWS]
                    m, each = len(own), np.repeat(np.arange(len(own)), k)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(own[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                        pa.array(model.deviations(part), pa.int64()).take(pa.array(each)), pa.array(model.whitened(part).ravel()),
                        pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, model.identity_error))],
                        ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitening(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``fit`` over the whole table and ``whiten`` of every vector of it."""
    return whiten(table, fit(table, vec_col, components), id_col, vec_col)
