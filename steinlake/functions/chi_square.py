"""Chi-square distributions in numpy, and the median distance of two Gaussian models."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lower_gamma(a: float, x: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function by its power series, all terms positive; 1 where the tail is below 1e-16."""
    far = a + 12 * math.sqrt(a) + 80
    x = np.maximum(np.asarray(x, float), 1e-300)
    near = np.minimum(x, far)
    term = np.exp(a * np.log(near) - near - math.lgamma(a + 1))
    total, k = term.copy(), 0
    while np.any(term > 1e-16 * np.maximum(total, 1e-300)):
        k += 1
        term = term * near / (a + k)
        total += term
    return np.where(x >= far, 1.0, np.minimum(total, 1.0))


def chi2_cdf(x: np.ndarray, d: float) -> np.ndarray:
    return np.where(x > 0, lower_gamma(d / 2, np.maximum(x, 0) / 2), 0.0)


def noncentral_cdf(x: np.ndarray, d: float, shift: np.ndarray) -> np.ndarray:
    """A Poisson mixture of chi-square distributions, over arrays of points and shifts.

    Summed from its last term of weight down to its first: P(a, x) is P(a + 1, x) and a positive term, so one series serves all terms.
    """
    x, half = np.broadcast_arrays(np.maximum(x, 0) / 2, np.asarray(shift, float) / 2)
    if not x.size:
        return np.zeros(x.shape)
    last, first = (half.max() + 12 * math.sqrt(half.max()) + 60), (half.min() - 12 * math.sqrt(half.min()) - 60)
    log_x, log_half = np.log(np.maximum(x, 1e-300)), np.log(np.maximum(half, 1e-300))
    p, total = lower_gamma(d / 2 + int(last), x), np.zeros(x.shape)
    for k in range(int(last), max(0, int(first)) - 1, -1):
        if k < int(last):
            a = d / 2 + k
            p = p + np.exp(a * log_x - x - math.lgamma(a + 1))
        total += np.exp(k * log_half - half - math.lgamma(k + 1)) * p
    return np.where(x > 0, np.minimum(total, 1.0), 0.0)


def mixture_cdf(x: np.ndarray, d: int, vp: np.ndarray, vq: np.ndarray, gap2: np.ndarray) -> np.ndarray:
    """P(|Z - Z'|^2 <= x) for Z, Z' drawn from either of two Gaussians with equal chance."""
    own = (chi2_cdf(x / (2 * vp), d) + chi2_cdf(x / (2 * vq), d)) / 4
    return own + noncentral_cdf(x / (vp + vq), d, gap2 / (vp + vq)) / 2


def median_distance(d: int, sp: np.ndarray, sq: np.ndarray, gap2: np.ndarray) -> np.ndarray:
    """The medians of the distance of two draws from the equal mixture of two Gaussians, by bisection over all at once."""
    sp, sq, gap2 = (np.asarray(v, float) for v in np.broadcast_arrays(sp, sq, gap2))
    vp, vq = sp * sp, sq * sq
    low, high = np.zeros(vp.shape), 4 * (d + 4) * np.maximum(vp, vq) + 4 * gap2
    for _ in range(100):
        middle = (low + high) / 2
        above = mixture_cdf(middle, d, vp, vq, gap2) < 0.5
        low, high = np.where(above, middle, low), np.where(above, high, middle)
        if np.all(high - low <= 1e-12 * high):
            break
    return np.sqrt((low + high) / 2)


def gaussian_median(d: Column, sp: Column, sq: Column, gap2: Column) -> Column:
    """median_distance() of each row, by Arrow batches (the root of a series has no built-in form)."""

    @F.pandas_udf(T.DoubleType())
    def each(d: pd.Series, sp: pd.Series, sq: pd.Series, gap2: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, d.index, dtype=float)
        known = pd.concat([d, sp, sq, gap2], axis=1).notna().all(axis=1)
        # Rows whose shifts are alike have nearly the same terms of weight, so they are summed together.
        alike = np.floor(np.sqrt(gap2 / (sp * sp + sq * sq) / 2) / 6)
        for (n, _), at in d[known].groupby([d[known], alike[known]]).groups.items():
            out[at] = median_distance(int(n), sp[at].to_numpy(), sq[at].to_numpy(), gap2[at].to_numpy())
        return out

    return each(d.cast("double"), sp.cast("double"), sq.cast("double"), gap2.cast("double"))
