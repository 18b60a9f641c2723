"""Whitening of embeddings by a one-sided Jacobi SVD of a blockwise QR.

Entries are taken on a grid of 1/256, x = floor(256 * c). The model is fitted to the list of distinct x
vectors, so copies count once. Its sums are exact integers. The rows x - S/n go through a QR decomposition
block by block inside each task, the triangles of the tasks meet in groups of FAN until one is left
(TSQR), and only this one, as large as the dimension squared whatever the number of rows, reaches the driver.
Plane rotations make its columns orthogonal; their product holds the components, the column norms the
standard deviations. The covariance is never formed, so small deviations keep their digits.

Edge cases: rows with a null vector, or with a null or non-finite entry, are left out; other columns
are not looked at; repeated ids are rows of their own; shorter vectors count as if zeros followed; entries beyond 2**53 after
scaling are taken as 2**53; a deviation that does not fit in 64 bits is null; with fewer dimensions than
components there are as many components as dimensions; where nothing varies along a component (one
distinct vector, constant dimensions) whitened is null and explained 0; with no variance at all explained and
identity_error are null; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.base import stage, unstage

COMPONENTS = 4
GRID = 256
FARTHEST = 2**53
#: Triangles that one task stacks.
FAN = 16
#: Rows that are decomposed at once, as a multiple of the dimension.
BLOCK = 8
SWEEPS = 60
_LONG = 1 << 63


def gridded(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows with a whole finite vector, and x."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    near = lambda c: F.greatest(F.least(c * GRID, F.lit(float(FARTHEST))), F.lit(-float(FARTHEST)))
    return vectors.where(v.isNotNull() & finite).withColumn("x", F.transform(v, lambda c: F.floor(near(c))))


def padded(width: int) -> Column:
    return F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))).alias("x")


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.asarray(batch.column("x").flatten()).astype(np.int64).reshape(batch.num_rows, width)


def exact_sum(x: np.ndarray) -> np.ndarray:
    """Column sums as Python integers."""
    if len(x) and np.abs(x).max() >= 1 << 40:
        x = x.astype(object)
    return x.sum(axis=0).astype(object)


def sum_task(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, object)
        for batch in batches:
            total = total + exact_sum(matrix(batch, width))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], ["dim", "total"])

    return run


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def qr_task(mean: np.ndarray):
    """One triangle for all rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, r = len(mean), None
        for batch in batches:
            x = matrix(batch, d)
            for low in range(0, len(x), BLOCK * d):
                rows = x[low : low + BLOCK * d] - mean
                r = triangle(rows if r is None else np.vstack([r, rows]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], ["part", "r"])

    return run


def stack_task(width: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        rows = np.asarray(group["r"].combine_chunks().flatten()).reshape(-1, width)
        return pa.table([pa.array([group["part"][0].as_py() // FAN], pa.int64()), pa.array([triangle(rows).ravel()], pa.list_(pa.float64()))], ["part", "r"])

    return run


def tsqr(fit: DataFrame, mean: np.ndarray) -> np.ndarray:
    """The triangle of all centred rows."""
    form = "part long, r array<double>"
    rows = stage(fit.select("x").mapInArrow(qr_task(mean), form), "whiten-triangles")
    last = rows.agg(F.max("part")).first()[0]
    while last > 0:
        stacked = stage(rows.groupBy(F.floor(F.col("part") / FAN).alias("group")).applyInArrow(stack_task(len(mean)), form), "whiten-triangles")
        unstage(rows)
        rows, last = stacked, last // FAN
    r = np.array(rows.first()["r"]).reshape(-1, len(mean))
    unstage(rows)
    return r


def rounds(d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of d columns as rounds of disjoint pairs, by the circle method."""
    ring = list(range(d + d % 2))
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(a, b) for a, b in zip(ring[:half], ring[: half - 1 : -1], strict=True) if max(a, b) < d]
        yield np.array([p for p, _ in pairs]), np.array([q for _, q in pairs])
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of r, falling, and right singular vectors as columns."""
    a, d = r.astype(float), r.shape[1]
    v, least = np.eye(d), np.sqrt(max(d, 2)) * np.finfo(float).eps
    nothing = (np.finfo(float).eps ** 2) * (a * a).sum()  # squared norm of what rounding leaves of a column
    for _ in range(SWEEPS):
        turned = False
        for p, q in rounds(d) if d > 1 else ():
            left, right = a[:, p], a[:, q]
            alpha, beta, gamma = (left * left).sum(axis=0), (right * right).sum(axis=0), (left * right).sum(axis=0)
            far = (np.abs(gamma) > least * np.sqrt(alpha * beta)) & (np.minimum(alpha, beta) > nothing)
            if not far.any():
                continue
            turned = True
            zeta = np.where(far, (beta - alpha) / np.where(far, 2 * gamma, 1), 0)
            t = np.where(far, np.where(zeta < 0, -1, 1) / (np.abs(zeta) + np.hypot(1, zeta)), 0)
            c = 1 / np.hypot(1, t)
            s = c * t
            a[:, p], a[:, q] = c * left - s * right, s * left + c * right
            v[:, p], v[:, q] = c * v[:, p] - s * v[:, q], s * v[:, p] + c * v[:, q]
        if not turned:
            break
    else:
        raise RuntimeError("rotations did not settle")
    sigma = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-sigma, kind="stable")
    return sigma[order], v[:, order]


@dataclass
class Whitening:
    """n fitted vectors with exact sums; components as columns, with standard deviations and shares of all variance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # Python rounds the exact quotient once

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN along components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.deviations > 0, (x - self.mean) @ self.axes / self.deviations, np.nan)

    def distances(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n * x - S)**2 over the dimensions of each row."""
        sums = np.array(self.sums, object)
        most = max(self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0), 1)
        if most * most * max(x.shape[1], 1) < _LONG:
            off = self.n * x - sums.astype(np.int64)
            return (off * off).sum(axis=1).tolist()
        if np.abs(x).max() >= 1 << 25:
            off = self.n * x.astype(object) - sums
            found = (off * off).sum(axis=1)
        else:  # products of rows and sums by limbs of 25 bits, so that only three big numbers are met per row
            squares, cross, rest, k = (x * x).sum(axis=1).astype(object), 0, np.abs(sums), 0
            sign = np.array([-1 if s < 0 else 1 for s in self.sums], np.int64)
            while rest.any():
                cross = cross + (x @ ((rest & ((1 << 25) - 1)).astype(np.int64) * sign)).astype(object) * (1 << 25 * k)
                rest, k = rest >> 25, k + 1
            found = self.n * self.n * squares - 2 * self.n * cross + int((sums * sums).sum())
        return [int(f) if f < _LONG else None for f in found]


def moment_task(model: Whitening):
    """Sums of products of the components of whitened rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.deviations)
        total = np.zeros((k + 1, k))
        for batch in batches:
            y = np.nan_to_num(model.project(matrix(batch, len(model.sums))))
            total += np.vstack([y.T @ y, y.sum(axis=0)])
        i, j = np.indices(total.shape, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "total"])

    return run


def fitted(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> Whitening | None:
    """The model of a table of vectors, None if it has no vector with an entry."""
    fit = stage(gridded(vectors, column).select("x").distinct(), "whiten-fit")
    least, width, n = fit.agg(F.min(F.size("x")), F.max(F.size("x")), F.count("*")).first()
    if not width:
        return None
    if least < width:
        ragged, fit = fit, stage(fit.select(padded(width)).distinct(), "whiten-fit")
        unstage(ragged)
        n = fit.count()
    sums = dict(fit.mapInArrow(sum_task(width), "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total")).collect())  # one row a dimension
    model = Whitening(n, [int(sums[k]) for k in range(width)], np.zeros((width, 0)), np.zeros(0), np.zeros(0))
    sigma, axes = jacobi(tsqr(fit, model.mean))
    sigma = np.where(sigma > width * np.finfo(float).eps * sigma[0], sigma, 0.0)
    model.axes, model.deviations = axes[:, :components], sigma[:components] / np.sqrt(n)
    whole = (sigma * sigma).sum()
    model.explained = sigma[:components] ** 2 / whole if whole else np.full(min(components, width), np.nan)
    varied = np.flatnonzero(model.deviations > 0)
    if len(varied):
        found = fit.mapInArrow(moment_task(model), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total")).collect()
        moments = np.zeros((len(model.deviations) + 1, len(model.deviations)))
        for i, j, total in found:
            moments[i, j] = total / n
        cov = moments[:-1] - np.outer(moments[-1], moments[-1])
        model.identity_error = float(np.abs(cov - np.eye(len(cov)))[np.ix_(varied, varied)].max())
    unstage(fit)
    return model


def whiten_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.deviations)
        for batch in batches:
            x = matrix(batch, len(model.sums))
            rows = np.repeat(np.arange(len(x)), k)
            y = model.project(x).ravel()
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(model.distances(x), pa.int64()).take(pa.array(rows)),
                pa.array(y, mask=np.isnan(y)), pa.array(np.tile(model.explained, len(x)), mask=np.tile(np.isnan(model.explained), len(x))),
            ], ["id", "component", "deviation", "whitened", "explained"])

    return run


def whitened(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, component, n, deviation, whitened, explained and identity_error of each vector and component."""
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    model = fitted(vectors, components, column)
    form = f"id {kind}, component int, deviation long, whitened double, explained double"
    if model is None:
        found, n, error = spark.createDataFrame([], form), 0, None
    else:
        rows = gridded(vectors.select(F.col(key).alias("id"), F.col(column)), column).select("id", padded(len(model.sums)))
        found, n, error = rows.mapInArrow(whiten_task(spark.sparkContext.broadcast(model)), form), model.n, model.identity_error
    return found.select(F.col("id").alias(key), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).cast("double").alias("identity_error"))
