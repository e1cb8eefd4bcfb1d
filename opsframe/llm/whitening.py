"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Vectors become integers x, so their sums are exact. One pass gives their number n and sums S, a second the scatter of
n * x - S, which is centred in whole numbers before it is multiplied; each task adds up a matrix of its own, and Spark adds
those. The driver holds one matrix of dimension by dimension, whatever n is. V = L L' with rows permuted by pivots; plane
rotations of the columns of L make them orthogonal, and as they act on the factor and not on V, small eigenvalues keep
their digits: the squared norms are the eigenvalues, the normalised columns the components. Two more passes measure the
covariance of the whitened vectors and give the rows.

Rows whose vector is null, empty, or holds null or non-finite entries are dropped, as are those of another dimension than
most vectors have (of equally frequent ones the largest dimension counts). Rows that repeat, or whose id is null, are
vectors of their own. Components are those of eigenvalues above zero to working precision, `count` at most: fewer where
vectors lie in a plane, none, and so no rows, where all are equal or the table is empty. Extra columns don't matter.
Entries so large that n * x leaves 62 bits are an error, not a wrong sum. The squares of `deviation` are exact at any n.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000  # fixed values: x = floor(SCALE * c) + SHIFT
COUNT = 32
ROOM = 1 << 62
ROWS = 4096  # vectors multiplied at once
FIELDS = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """A factor with v = factor @ factor.T, in as many columns as v has rank; rows stay in the order of v."""
    v = v.copy()
    left = np.diag(v).copy()
    least = left.max(initial=0.0) * len(v) * np.finfo(float).eps
    columns: list[np.ndarray] = []
    while len(columns) < len(v):
        p = int(np.argmax(left))
        if left[p] <= least:
            break
        column = v[:, p] - sum((c * c[p] for c in columns), np.zeros(len(v)))
        column[left < 0] = 0.0  # pivots of before
        column[p] = left[p]
        column /= math.sqrt(left[p])
        columns.append(column)
        left = np.where(left < 0, left, np.maximum(left - column * column, 0.0))
        left[p] = -1.0
    return np.array(columns).T.reshape(len(v), len(columns))


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components as columns) of factor @ factor.T, by falling eigenvalue.

    In each round of a sweep all columns are paired, each pair once per sweep, and rotated until orthogonal.
    """
    a = factor.T.copy()  # a column of the factor in each row
    k = len(a)
    seats = np.arange(k + k % 2)
    for _ in range(sweeps if k > 1 else 0):
        worst = 0.0
        for _ in range(len(seats) - 1):
            i, j = seats[:len(seats) // 2], seats[::-1][:len(seats) // 2]
            real = (i < k) & (j < k)
            i, j = i[real], j[real]
            x, y = a[i], a[j]
            p, q, r = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            cosine = np.abs(r) / np.sqrt(np.maximum(p * q, np.finfo(float).tiny))
            worst = max(worst, float(cosine.max(initial=0.0)))
            turn = cosine > np.finfo(float).eps
            r = np.where(turn, r, 1.0)
            z = (q - p) / (2 * r)
            t = np.where(z < 0, -1.0, 1.0) / (np.abs(z) + np.hypot(1.0, z))
            c = 1 / np.hypot(1.0, t)
            s = np.where(turn, c * t, 0.0)[:, None]
            c = np.where(turn, c, 1.0)[:, None]
            a[i], a[j] = c * x - s * y, s * x + c * y
            seats[1:] = np.roll(seats[1:], 1)
        if worst <= 2 * np.finfo(float).eps:
            break
    norms = np.sqrt((a * a).sum(1))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, (a[order] / norms[order, None]).T if k else a.T


@dataclass(frozen=True)
class Fit:
    """Sums of the fit list; later its components, falling eigenvalues, their shares, and the error of whitening."""

    n: int
    sums: np.ndarray
    components: np.ndarray | None = None
    values: np.ndarray | None = None
    explained: np.ndarray | None = None
    error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        if len(x) and max(int(x.max()), -int(x.min()), int(np.abs(self.sums).max()) // self.n + 1) * self.n >= ROOM // 2:
            raise OverflowError("n * x leaves 62 bits: scale the vectors")
        return x * np.int64(self.n) - self.sums

    def whitened(self, z: np.ndarray) -> np.ndarray:
        return (z / self.n) @ (self.components / np.sqrt(self.values))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x array<double>) of the rows whose vector is whole, of the most frequent dimension."""
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].cast("array<double>").alias("x"))
    rows = rows.where(F.size("x") > 0).where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("x") == (sizes.d if sizes else 0))


def integers(batch: pa.RecordBatch, d: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, x of up to ROWS rows)."""
    for first in range(0, batch.num_rows, ROWS):
        c = batch.column(1).slice(first, ROWS).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        scaled = np.floor(c * SCALE)
        if np.abs(scaled).max(initial=0.0) >= ROOM:
            raise OverflowError("an entry leaves 62 bits: scale the vectors")
        yield first, scaled.astype(np.int64) + SHIFT


def _sums(rows: DataFrame, d: int) -> Fit:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            for _, x in integers(batch, d):
                n += len(x)
                high, low = high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)],
                                             ["i", "n", "high", "low"])

    each = rows.mapInArrow(run, "i int, n long, high long, low long").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("i").collect()
    sums = [(int(r.high) << 32) + int(r.low) for r in each]
    if max(map(abs, sums), default=0) >= ROOM:
        raise OverflowError("sums of entries leave 62 bits: scale the vectors")
    return Fit(each[0].n if each else 0, np.array(sums, np.int64))


def _covariance(rows: DataFrame, fit: Fit, whiten: bool) -> np.ndarray:
    """Covariance, divisor n, of the centred vectors or of the whitened ones less their mean."""
    d = len(fit.sums)
    size = fit.components.shape[1] if whiten else d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums, some = np.zeros((size, size)), np.zeros(size), False
        for batch in batches:
            for _, x in integers(batch, d):
                z = fit.centred(x)
                y = fit.whitened(z) if whiten else z / fit.n
                total, sums, some = total + y.T @ y, sums + y.sum(0), True
        if some:
            of = np.repeat(np.arange(size, dtype=np.int32), size + 1)
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.tile(np.arange(size + 1, dtype=np.int32), size)),
                                              pa.array(np.hstack([total, sums[:, None]]).ravel())], ["i", "j", "v"])

    both = np.zeros((size, size + 1))
    for r in rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        both[r.i, r.j] = r.v
    mean = both[:, -1] / fit.n  # zero but for rounding
    v = both[:, :-1] / fit.n - np.outer(mean, mean)
    return (v + v.T) / 2


def fitted(rows: DataFrame, count: int) -> Fit:
    """The fit over `rows` of `usable`."""
    first = rows.select(F.size("x").alias("d")).first()
    if not first:
        return Fit(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    fit = _sums(rows, first.d)
    v = _covariance(rows, fit, False)
    values, components = one_sided_jacobi(pivoted_cholesky(v))
    values, components = values[:count], components[:, :count]
    fit = Fit(fit.n, fit.sums, components, values, values / np.trace(v) if len(values) else values)
    error = np.abs(_covariance(rows, fit, True) - np.eye(len(values))).max() if len(values) else 0.0
    return Fit(fit.n, fit.sums, components, values, fit.explained, float(error))


def deviations(z: np.ndarray) -> pa.Array:
    """Exact sums of squares per row."""
    if len(z) and float(np.square(z.astype(float)).sum(1).max()) < 2**62:
        return pa.array((z * z).sum(1)).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(sum(v * v for v in row)) for row in z.tolist()], pa.decimal128(38, 0))


def whitened(vectors: DataFrame, count: int = COUNT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    rows = usable(vectors, id_col, vector_col)
    fit = fitted(rows, count)
    d, k = len(fit.sums), len(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x in integers(batch, d):
                z = fit.centred(x)
                of = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(x)).take(of), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, fit.n)), deviations(z).take(of), pa.array(fit.whitened(z).ravel()),
                    pa.array(np.tile(fit.explained, len(x))), pa.array(np.full(len(x) * k, fit.error))],
                    ["vec_id", *(f.split()[0] for f in FIELDS.split(", "))])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return (rows if k else rows.limit(0)).mapInArrow(run, f"vec_id {kind}, {FIELDS}")
