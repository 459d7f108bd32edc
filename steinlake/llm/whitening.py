"""Embedding whitening: a distributed covariance, and its eigenvectors by mixed-precision refinement.

Components are x = floor(256 * c). The fit list is every distinct vector x once. Its covariance is gathered from tasks: a task centres each
block before it multiplies and joins blocks by the pairwise update of mean and products, tasks are joined by the same update in a tree of
fan-in FAN over panels of PANEL rows, and one matrix of d x d reaches the driver (d at most DIMENSIONS, else the job stops with a message).

Eigenvectors start as those of the matrix in float32. Ogita-Aishima iterations refine them by matrix products in extended precision: with
R = I - X'X and S = X'AX, a pair of eigenvalues farther apart than the error bound gets the correction (S_ij + l_j R_ij) / (l_j - l_i), all others R_ij / 2.
Where eigenvalues are nearer than that bound, the vectors of the cluster are turned by a sub-solve: the cluster's shifted block X_J'(A - mu I)X_J is
small, so its eigenvectors in float64 resolve gaps far below the rounding of A. Steps repeat until the bound stops falling.

Sums are exact integers. identity_error is measured, not assumed: the whitened fit list's covariance in a second pass.

Cases: rows with a null vector, or null or non-finite components, take no part; rows with equal or null vec_id stay rows; repeated vectors count once in
the fit and each give their rows; shorter vectors are filled up with zeros; d < 4 gives d components; a component without variance (eigenvalue below
d * 2**-52 of the largest) has whitened null, and is left out of identity_error; an empty table gives no rows. Columns of other names are not read.
Components beyond 64 bits and deviations beyond 38 digits stop the job.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, fields, prepared, stored
from .vectors import blocks, packed, sound

FACTOR, COMPONENTS, DIMENSIONS, PANEL, FAN, STEPS = 256.0, 4, 2048, 64, 32, 12
Extended = np.longdouble
RESULT = T.StructType(
    fields("vec_id long, component int, n long").fields + [T.StructField("deviation", T.DecimalType(38, 0))] + fields("whitened double, explained double, identity_error double").fields
)


class Moments:
    """Number, exact sums (where the values are integers), mean and centred products of rows."""

    def __init__(self, n: int, total: list[int], mean: np.ndarray, products: np.ndarray):
        self.n, self.total, self.mean, self.products = n, total, mean, products

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        if x.dtype == np.int64:
            fits = float(np.abs(x.astype(float)).max(initial=0)) * max(1, len(x)) < 2.0**62
            total = [int(s) for s in (x if fits else x.astype(object)).sum(axis=0)]
            mean = np.array([s / len(x) for s in total])
        else:
            total, mean = [], x.mean(axis=0)
        centred = x - mean
        return cls(len(x), total, mean, centred.T @ centred)

    def joined(self, other: Moments, rows: slice = slice(None)) -> Moments:
        """Both together; products may hold only these rows of the matrix."""
        n = self.n + other.n
        apart = other.mean - self.mean
        products = self.products + other.products + np.outer(apart[rows], apart) * (self.n / n * other.n)
        return Moments(n, [a + b for a, b in zip(self.total, other.total, strict=True)], self.mean + apart * (other.n / n), products)


_PARTIAL = fields("part int, panel int, n long, total binary, mean binary, products binary")


def _row(part: int, panel: int, m: Moments, products: np.ndarray) -> tuple:
    return part, panel, m.n, b"".join(s.to_bytes(24, "little", signed=True) for s in m.total), m.mean.tobytes(), products.tobytes()


def _moments(row) -> Moments:
    mean = np.frombuffer(row.mean)
    total = [int.from_bytes(row.total[a : a + 24], "little", signed=True) for a in range(0, len(row.total), 24)]
    return Moments(int(row.n), total, mean, np.frombuffer(row.products).reshape(-1, len(mean)))


def moments(fit: DataFrame, dims: int, turn: np.ndarray | None = None, centre: np.ndarray | None = None) -> Moments | None:
    """The moments of the packed vectors fit(v), or of (v - centre) @ turn."""

    def make():
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                for _, _, x in blocks(batch.column(0).to_pylist(), dims):
                    new = Moments.of(x if turn is None else (x - centre) @ turn)
                    held = new if held is None else held.joined(new)
            if held is not None:
                part = TaskContext.get().partitionId()
                rows = [_row(part, a // PANEL, held, held.products[a : a + PANEL]) for a in range(0, len(held.mean), PANEL)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], _PARTIAL.names)

        return each

    def together(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        rows = list(held.sort_values("part").itertuples())
        panel = int(rows[0].panel)
        out = _moments(rows[0])
        for row in rows[1:]:
            out = out.joined(_moments(row), slice(panel * PANEL, (panel + 1) * PANEL))
        return pd.DataFrame([_row(int(rows[0].part) // FAN, panel, out, out.products)], columns=_PARTIAL.names)

    partial = stored(fit.mapInArrow(make(), _PARTIAL), "moments")
    while True:
        last = partial.agg(F.max("part")).first()[0]
        if last is None:
            return None
        partial = partial.groupBy("panel", F.floor(F.col("part") / FAN).alias("_group")).applyInPandas(together, _PARTIAL)
        if last < FAN:  # one part is left: d rows of d numbers
            found = [_moments(r) for r in partial.orderBy("panel").collect()]
            return Moments(found[0].n, found[0].total, found[0].mean, np.concatenate([m.products for m in found]))
        partial = stored(partial, "moments")


def clusters(values: np.ndarray, bound: float) -> list[slice]:
    """Runs of ascending values of which each is within bound of the one before."""
    cuts = np.flatnonzero(np.diff(values) > bound) + 1
    edges = [0, *cuts.tolist(), len(values)]
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a > 1]


def eigenpairs(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix, to double precision."""
    scale = float(np.abs(matrix).max(initial=0))
    if scale == 0:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    a = ((matrix + matrix.T) / 2 / scale).astype(Extended)
    one = np.eye(len(a), dtype=Extended)
    _, start = np.linalg.eigh(a.astype(np.float32))
    x, last, best = start.astype(Extended), np.inf, None
    for _ in range(STEPS):
        r, s = one - x.T @ x, x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(values, kind="stable")
        x, values, r, s = x[:, order], values[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        off = np.sqrt(np.square(s - np.diag(values)).sum() + np.square(r).sum() * np.square(a).sum())
        bound = float(2 * off)
        if best is None or bound < last:
            best = (values, x)
        if not bound < last / 2:
            break
        last = bound
        gap = values[None, :] - values[:, None]
        far = np.abs(gap) > bound
        x = x + x @ np.where(far, (s + values[None, :] * r) / np.where(far, gap, 1), r / 2)
        for j in clusters(values, bound):
            mine = x[:, j]
            small = mine.T @ (a @ mine - values[j].mean() * mine)
            top = np.abs(small).max()
            if top > 0:
                _, turn = np.linalg.eigh(((small + small.T) / 2 / top).astype(float))
                x[:, j] = mine @ turn.astype(Extended)
    values, x = best
    x = x / np.sqrt(np.square(x).sum(axis=0))
    values, x = (values[::-1] * scale).astype(float), x[:, ::-1].astype(float)
    sign = np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(x))])
    return values, x * np.where(sign == 0, 1, sign)


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[Decimal]:
    """The exact sum of (n * x - total)**2 of each row."""
    most = n * int(np.abs(x.astype(float)).max(initial=0)) + max((abs(s) for s in total), default=0) + n
    if most * most * max(1, len(total)) < 2**62:
        return [Decimal(int(v)) for v in np.square(n * x - np.array(total, np.int64)).sum(axis=1)]
    far = n * x.astype(object) - np.array(total, object)
    return [Decimal(v) for v in (far * far).sum(axis=1)]


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, factor: float = FACTOR) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each sound vector and component."""
    spark = prepared(rows.sparkSession)
    whole = sound(rows, {"vec_id": rows["vec_id"].cast("long")}, vector)
    dims = whole.agg(F.max(F.size("x"))).first()[0] or 0
    if dims > DIMENSIONS:
        raise ValueError(f"vectors have {dims} components; a covariance of more than {DIMENSIONS} does not fit the driver")
    if not dims:
        return spark.createDataFrame([], RESULT)
    vectors = packed(whole, factor)
    fit = stored(vectors.select("v").distinct(), "fit")
    found = moments(fit, dims)
    values, axes = eigenpairs(found.products / found.n)
    k = min(components, dims)
    trace = float(np.trace(found.products) / found.n)
    varies = values[:k] > dims * 2.0**-52 * max(values[0], 0.0)
    turn = np.where(varies, axes[:, :k] / np.sqrt(np.where(varies, values[:k], 1.0)), 0.0)
    centre, n, total = np.array([s / found.n for s in found.total]), found.n, found.total
    explained = values[:k] / trace if trace > 0 else np.zeros(k)
    error = 0.0
    if varies.any():
        told = moments(fit, dims, turn[:, varies], centre)
        error = float(np.abs(told.products / told.n - np.eye(int(varies.sum()))).max())

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids = batch.column(0)
            for a, b, x in blocks(batch.column(1).to_pylist(), dims):
                m = b - a
                white = (x - centre) @ turn
                far = np.repeat(np.array(deviations(x, n, total), object), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(np.arange(a, b), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n)),
                        pa.array(far.tolist(), pa.decimal128(38, 0)),
                        pa.array(white.ravel(), mask=~np.tile(varies, m)),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    RESULT.names,
                )

        return each

    return arrow_map(vectors, make, RESULT)
