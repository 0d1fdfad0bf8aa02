"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries become integers, x = floor(64 * c) + 1000000. The fit list is each distinct vector once. Its sums S are
exact; its scatter is summed by tasks from rows that are centred first, (n * x - S) / n, where n * x - S is an
exact integer. What reaches the driver has the size of the scatter, dimensions squared, whatever the input.
There, P'GP = LL' with the largest remaining diagonal as the next pivot; plane rotations from the right make L's
columns orthogonal, L W = U D. The squared norms D^2 of the rotated columns, over n, are the eigenvalues of the
covariance, and the columns divided by their norms, their pivoting undone, its components.

Defined cases: rows whose vector is null or empty, or holds null or non-finite entries, are dropped, as are rows
of another length than most remaining rows have (the longer one of equals); entries beyond 2^50 / 64 count as that;
components whose eigenvalue is not told from 0 (below 1e-14 of the largest) have no rows, so a table with fewer than
two distinct vectors gives none; a deviation beyond a long is null; repeated rows and null ids get rows of their
own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fixed_lists, staged, table, tune

#: Fixed values of the task.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LIMIT = float(1 << 50)
#: Eigenvalues below this share of the largest one are rounding.
RANK = 1e-14
SWEEPS = 40
SAFE = 1 << 62


@dataclass
class Model:
    n: int
    #: Exact sums of each dimension.
    sums: list[int]
    #: Descending eigenvalues of the covariance and, as columns, their unit vectors.
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id, x of the rows that remain."""
    e = F.col("embedding").cast("array<double>")
    whole = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(e, lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-LIMIT)), F.lit(LIMIT))) + SHIFT)
    rows = embeddings.where(e.isNotNull() & (F.size(e) > 0) & whole).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    most = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "d"))["d"]).first()[0]
    return rows.where(F.size("x") == F.lit(most or 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(df: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum, over the rows of df (x), of a square matrix that of makes from some of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), fixed_lists(total)], ["row", "v"])

    cells = df.select("x").mapInArrow(run, "row int, v array<double>").select("row", F.posexplode("v").alias("col", "v")).groupBy("row", "col").agg(F.sum("v").alias("v"))
    rows = cells.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "v"))).alias("v")).select("row", "v.v").orderBy("row").collect()  # dimensions squared
    return np.array([r[1] for r in rows])


def exact_sums(fit_list: DataFrame) -> tuple[int, list[int]]:
    """Rows of fit_list (x) and the sums of their dimensions, as integers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                small = np.abs(x).max(initial=0) < SAFE // len(x)
                part = np.array(x.sum(axis=0).tolist() if small else x.astype(object).sum(axis=0), object)
                total, n = part if total is None else total + part, n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array([Decimal(int(v)) for v in (n, *total)], pa.decimal128(38, 0))], ["d", "v"])

    rows = fit_list.select("x").mapInArrow(run, "d int, v decimal(38, 0)").groupBy("d").agg(F.sum("v").alias("v")).orderBy("d").collect()  # a row for each dimension
    return (int(rows[0][1]), [int(r[1]) for r in rows[1:]]) if rows else (0, [])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as 64-bit integers if they fit, else as Python's."""
    small = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0)) < SAFE // 2
    return x * n - np.array(sums, np.int64) if small else x.astype(object) * n - np.array(sums, object)


def pivoted_cholesky(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order): g[order][:, order] = L L' with L lower trapezoidal, of as many columns as pivots are told from 0."""
    g, d = g.copy(), len(g)
    order, lower = np.arange(d), np.zeros((d, d))
    first = np.diag(g).max(initial=0.0)
    for k in range(d):
        p = k + int(np.argmax(np.diag(g)[k:]))
        if g[p, p] <= RANK * first:
            return lower[:, :k], order
        for a in (order, lower, g, g.T):
            a[[k, p]] = a[[p, k]]
        lower[k, k] = np.sqrt(g[k, k])
        lower[k + 1 :, k] = g[k + 1 :, k] / lower[k, k]
        g[k + 1 :, k + 1 :] -= np.outer(lower[k + 1 :, k], lower[k + 1 :, k])
    return lower, order


def one_sided_jacobi(a: np.ndarray) -> np.ndarray:
    """a's columns rotated in pairs until all are orthogonal. In each of a sweep's rounds, every column is in one
    pair (the tables of a round-robin tournament), so that a round is one step on whole matrices."""
    a, r = a.copy(), a.shape[1]
    seats = np.arange(r + r % 2)  # an odd number of columns: one sits out
    for _ in range(SWEEPS):
        moved = False
        for _ in range(len(seats) - 1):
            i, j = seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1]
            i, j = i[(i < r) & (j < r)], j[(i < r) & (j < r)]
            x, y = a[:, i], a[:, j]
            p, q, dot = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            turn = np.abs(dot) > 1e-15 * np.sqrt(p * q)
            if turn.any():
                moved = True
                z = (q[turn] - p[turn]) / (2 * dot[turn])
                t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1, z))
                c = 1 / np.hypot(1, t)
                x, y, i, j = x[:, turn], y[:, turn], i[turn], j[turn]
                a[:, i], a[:, j] = c * (x - t * y), c * (t * x + y)
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not moved:
            break
    return a


def decomposed(scatter: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of scatter / n, falling, and their unit vectors as columns."""
    lower, order = pivoted_cholesky(scatter)
    turned = one_sided_jacobi(lower)
    norms = np.sqrt((turned * turned).sum(axis=0))
    by = np.argsort(-norms, kind="stable")
    by = by[norms[by] ** 2 > RANK * (norms.max(initial=0.0) ** 2)]
    vectors = np.zeros((len(scatter), len(by)))
    vectors[order] = turned[:, by] / norms[by]
    return norms[by] ** 2 / n, vectors


def whitened(x: np.ndarray, model: Model, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(exact deviations, whitened rows)."""
    y = deviations(x, model.n, model.sums)
    return y, (y / model.n).astype(np.float64) @ (model.vectors[:, :components] / np.sqrt(model.values[:components]))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Model:
    """Fitted on each distinct x of rows once."""
    listed = staged(rows.select("x").distinct(), "fit_list")
    n, sums = exact_sums(listed)
    if n < 2:
        return Model(n, sums, np.zeros(0), np.zeros((len(sums), 0)), 0.0)

    def scatter(x: np.ndarray) -> np.ndarray:
        c = (deviations(x, n, sums) / n).astype(np.float64)
        return c.T @ c

    g = _summed(listed, scatter)
    model = Model(n, sums, *decomposed(g, n), float(np.trace(g)) / n)
    k = min(components, len(model.values))
    if not k:
        return model

    def moments(x: np.ndarray) -> np.ndarray:
        w = np.concatenate([np.ones((len(x), 1)), whitened(x, model, k)[1]], axis=1)
        return w.T @ w

    m = _summed(listed, moments) / n
    model.identity_error = float(np.abs(m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) - np.eye(k)).max())
    return model


def projected(rows: DataFrame, model: Model, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every row of rows."""
    k = min(components, len(model.values))
    explained = model.values[:k] / model.trace if k else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            y, w = whitened(_matrix(batch.column(1)), model, k)
            if y.dtype == object or int(np.abs(y).max()) ** 2 * y.shape[1] >= SAFE:
                exact = [int(v) for v in (y.astype(object) ** 2).sum(axis=1)]
                deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            else:
                deviation = pa.array((y * y).sum(axis=1))
            m = len(w)
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), deviation.take(at), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op12_cholesky_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    rows = integers(table(spark, sf_dir, "embeddings"))
    return projected(rows, fit(rows))
