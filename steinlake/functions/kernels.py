"""Kernels as column expressions, each with a numpy twin for tiles.

expr(a, b) takes two columns; block(a, b) takes two stacked arrays and returns the matrix of all pairs.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import hamming, sqdist


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs."""
    out = (-2 * a) @ b.T
    out += (a * a).sum(1)[:, None]
    out += (b * b).sum(1)
    return np.maximum(out, 0, out=out)


@dataclass(frozen=True)
class Gaussian:
    """exp(-|x - y|^2 / (2 sigma^2))."""

    sigma: float = 1.0

    def expr(self, a, b) -> Column:
        return F.exp(-sqdist(a, b) / (2 * self.sigma**2))

    def block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = squares(a, b)
        out *= -1 / (2 * self.sigma**2)
        return np.exp(out, out=out)

    # Derivatives in the second and first argument, and the trace of the mixed one, over the kernel's value.
    def over_second(self, a, b, direction) -> Column:
        """<gradient in b, direction> / k."""
        return F.aggregate(F.zip_with(F.zip_with(a, b, lambda x, y: x - y), direction, lambda u, s: u * s), F.lit(0.0), lambda s, t: s + t) / self.sigma**2

    def trace(self, a, b, dimension) -> Column:
        return dimension / self.sigma**2 - sqdist(a, b) / self.sigma**4


@dataclass(frozen=True)
class ModifiedGaussian:
    """k/2 / (1 - k/2) of a Gaussian kernel k."""

    sigma: float = 1.0

    def expr(self, a, b) -> Column:
        half = Gaussian(self.sigma).expr(a, b) / 2
        return half / (1 - half)

    def block(self, a, b) -> np.ndarray:
        half = Gaussian(self.sigma).block(a, b) / 2
        return half / (1 - half)


def lagged(diff: Column, width: int) -> Column:
    """Of 0/1 differences by place, the places whose next `width` places (itself first) hold a difference."""
    n = F.size(diff)
    return F.when(n < 1, F.lit(0)).otherwise(F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_max(F.slice(diff, i, width))), F.lit(0), lambda s, d: s + d))


def lag_window(lag: int, mode: str) -> int:
    """Window of the k-mer distance: lag itself ('kmer'), or 1 + lag (lag - 1) / 2 ('cumulative')."""
    if mode not in ("kmer", "cumulative"):
        raise ValueError(mode)
    return lag if mode == "kmer" else 1 + lag * (lag - 1) // 2


def lag_hamming(s, t, lag: int = 1, mode: str = "cumulative") -> Column:
    """Hamming distance of sequences of k-mers; windows at the end are cut short."""
    width = lag_window(lag, mode)
    if width == 1:
        return hamming(s, t)
    return lagged(F.zip_with(s, t, lambda a, b: F.when(a.eqNullSafe(b), 0).otherwise(1)), width)


def differences(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """The k-mer distances of all pairs of two stacks of encoded sequences of one length, place by place in bounded memory."""
    length = a.shape[1]
    if width == 1:
        known = [np.unique(a[:, i]) for i in range(length)]
        if sum(map(len, known)) <= 16 * length:
            # Few letters: the places that agree are a product of indicators, exact in single precision.
            mark = lambda x: np.concatenate([x[:, i, None] == v for i, v in enumerate(known)], axis=1).astype("f4")
            return float(length) - (mark(a) @ mark(b).T).astype(float)
    out = np.zeros((len(a), len(b)))
    for i in range(length):
        window = slice(i, min(i + width, length))
        out += (a[:, None, window] != b[None, :, window]).any(-1)
    return out


@dataclass(frozen=True)
class HammingIMQ:
    """((1 + alpha) / (alpha + d)) ** beta of the k-mer Hamming distance d; not normalised, k(x, x) is ((1 + alpha) / alpha) ** beta."""

    alpha: float = 1.0
    beta: float = 0.5
    lag: int = 1
    mode: str = "cumulative"

    def expr(self, a, b) -> Column:
        return F.pow((1 + self.alpha) / (self.alpha + lag_hamming(a, b, self.lag, self.mode)), F.lit(self.beta))

    def block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        values = ((1 + self.alpha) / (self.alpha + np.arange(a.shape[1] + 1.0))) ** self.beta
        return values[differences(a, b, lag_window(self.lag, self.mode)).astype(np.intp)]


@dataclass(frozen=True)
class HammingExp:
    """exp(-lam * Hamming distance)."""

    lam: float = 1.0

    def expr(self, a, b) -> Column:
        return F.exp(-self.lam * hamming(a, b))

    def block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.exp(-self.lam * differences(a, b, 1))


@dataclass(frozen=True)
class TensorProduct:
    """A product of kernels, one per component; arguments are tuples of columns or arrays."""

    parts: tuple

    def expr(self, a, b) -> Column:
        out = F.lit(1.0)
        for k, x, y in zip(self.parts, a, b, strict=True):
            out = out * k.expr(x, y)
        return out

    def block(self, a, b) -> np.ndarray:
        out = 1.0
        for k, x, y in zip(self.parts, a, b, strict=True):
            out = out * k.block(x, y)
        return out


# Mean embeddings: <p, q>^n / n! is a sum of products of monomials, so the mean of a Gaussian kernel over two sets of points is one inner product.

#: Features of an embedding at most, and the error of a kernel's value that they may leave.
FEATURES, ERROR = 1400, 1e-11


def _orders(dimension: int) -> list[int]:
    """How many monomials there are up to each degree, as far as FEATURES goes."""
    out = [1]
    while (n := math.comb(len(out) + dimension, dimension)) <= FEATURES:
        out.append(n)
    return out


@functools.lru_cache
def _monomials(dimension: int) -> list[tuple[list[int], np.ndarray]]:
    """By degree from 1: for each variable the first monomial of the degree before that it multiplies, and 1 / sqrt(n!) of the powers made.

    A monomial comes once: its variables in falling order, so each variable meets those that begin with none before it.
    """
    out, begins, powers = [], [0] * dimension, np.zeros((1, dimension), int)
    for _ in _orders(dimension)[1:]:
        sizes = [len(powers) - b for b in begins]
        powers = np.concatenate([powers[b:] + np.eye(dimension, dtype=int)[k] for k, b in enumerate(begins)])
        out.append((begins, np.array([math.prod(map(math.factorial, p)) ** -0.5 for p in powers.tolist()])))
        begins = [sum(sizes[:k]) for k in range(dimension)]
    return out


def embedding(points: np.ndarray, sigma: float, strip: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Stacks of points (rows, points, dimensions) as means of their features (rows, features), by rising degree, and each row's largest norm over sigma."""
    rows, count, dimension = points.shape
    out, reach = np.empty((rows, _orders(dimension)[-1])), np.empty(rows)
    for at in range(0, rows, strip):
        part = points[at : at + strip]
        x = part.transpose(2, 1, 0).reshape(dimension, -1) / sigma
        norm = (x * x).sum(0)
        reach[at : at + strip] = np.sqrt(norm.reshape(count, -1).max(0))
        level, done = np.exp(-norm / 2)[None] / count, 1
        out[at : at + strip, :1] = level.reshape(1, count, -1).sum(1).T
        for begins, scales in _monomials(dimension):
            level = np.concatenate([x[k] * level[b:] for k, b in enumerate(begins)])
            out[at : at + strip, done : done + len(level)] = (level.reshape(len(level), count, -1).sum(1) * scales[:, None]).T
            done += len(level)
    return out, reach


def enough(reach: float, dimension: int) -> int | None:
    """How many features leave at most ERROR where inner products of points go up to `reach`; None where FEATURES are too few."""
    for degree, n in enumerate(_orders(dimension)):
        if reach ** (degree + 1) <= ERROR * math.factorial(degree + 1):
            return n
    return None
