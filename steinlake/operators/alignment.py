"""Soft alignment of vector sequences by dynamic programming, batched over pairs in Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import sqdist
from ..functions.kernels import squares

#: Bytes of the squared distances that one step of SoftAlignment.block holds.
STEP_BYTES = 64 << 20


def log_alignment(log_k: np.ndarray, gamma: float = 1.0) -> np.ndarray:
    """For a batch of matrices of log kernel values, log_k + gamma * logsumexp of the three cells before, at the last cell."""
    n, h, w = log_k.shape
    last = np.full((n, w + 1), -np.inf)
    last[:, 0] = 0.0
    for i in range(h):
        now = np.full((n, w + 1), -np.inf)
        for j in range(w):
            three = np.stack([last[:, j], last[:, j + 1], now[:, j]]) / gamma
            top = three.max(axis=0)
            safe = np.where(np.isfinite(top), top, 0.0)
            now[:, j + 1] = log_k[:, i, j] + gamma * (safe + np.log(np.exp(three - safe).sum(axis=0)))
        last = now
    return last[:, -1]


def soft_alignment(pairs: DataFrame, sigma: float = 1.0, gamma: float = 1.0) -> DataFrame:
    """(a_i, b_i, log_k) of pairs with a_points and b_points: arrays of points, of any two lengths from 1."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = np.empty(len(f))
            shapes = [(len(p), len(q)) for p, q in zip(f["a_points"], f["b_points"], strict=True)]
            for shape in set(shapes):
                at = [k for k, s in enumerate(shapes) if s == shape]
                p, q = (np.stack([np.stack(list(v)) for v in f[c].iloc[at]]) for c in ("a_points", "b_points"))
                d = ((p[:, :, None, :] - q[:, None, :, :]) ** 2).sum(-1)
                out[at] = log_alignment(-d / (2 * sigma**2), gamma)
            yield pd.DataFrame({"a_i": f["a_i"], "b_i": f["b_i"], "log_k": out})

    return pairs.select("a_i", "b_i", "a_points", "b_points").mapInPandas(run, "a_i long, b_i long, log_k double")


@dataclass(frozen=True)
class SoftAlignment:
    """exp(log_k - log_scale) of the soft alignment of two sequences of points, with a Gaussian kernel on points.

    expr folds over the points inside the row, so sequences may have any lengths from 1, and work grows with the product of two
    lengths; sequences without points have no alignment (0). block takes stacks of sequences of one length: (rows, length, dimensions).
    """

    sigma: float = 1.0
    gamma: float = 1.0
    log_scale: float = 0.0

    def log_expr(self, a, b) -> Column:
        a, b = (F.col(v) if isinstance(v, str) else v for v in (a, b))
        never = F.lit(float("-inf"))

        def cell(last: Column, now: Column, p: Column, j: Column) -> Column:
            three = F.array(F.get(last, j), F.get(last, j + 1), F.get(now, j))
            top = F.array_max(three)
            total = F.aggregate(three, F.lit(0.0), lambda s, v: s + F.exp((v - top) / self.gamma))
            return -sqdist(p, F.get(b, j)) / (2 * self.sigma**2) + F.when(top == never, never).otherwise(top + self.gamma * F.log(total))

        def row(last: Column, p: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.array(never), lambda now, j: F.concat(now, F.array(cell(last, now, p, j))))

        start = F.concat(F.array(F.lit(0.0)), F.array_repeat(never, F.size(b)))
        last = F.aggregate(a, start, row)
        return F.when((F.size(a) > 0) & (F.size(b) > 0), F.element_at(last, -1)).when(a.isNotNull() & b.isNotNull(), never)

    def expr(self, a, b) -> Column:
        return F.exp(self.log_expr(a, b) - self.log_scale)

    def block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        step = max(1, STEP_BYTES // (8 * max(1, len(b) * a.shape[1] * b.shape[1])))
        out = np.empty((len(a), len(b)))
        flat = b.reshape(-1, b.shape[2])
        for at in range(0, len(a), step):
            part = a[at : at + step]
            d = squares(part.reshape(-1, part.shape[2]), flat).reshape(len(part), part.shape[1], len(b), b.shape[1])
            logs = log_alignment(-d.transpose(0, 2, 1, 3).reshape(-1, part.shape[1], b.shape[1]) / (2 * self.sigma**2), self.gamma)
            out[at : at + step] = np.exp(logs - self.log_scale).reshape(len(part), len(b))
        return out
