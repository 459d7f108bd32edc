"""Smooth kernels with their derivatives, and score functions: what a Stein kernel is made of.

A kernel here is a function of r = |x - y|^2 and t = <x, y>. A Jet carries such a function's value and its partial derivatives up to the second
order through sums, products, powers and exponentials, so whoever writes a kernel writes its value only. Jets hold
Spark columns, or numpy matrices for tiles; both do the same arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import dot, sqdist
from .kernels import squares


def _plus(a, b):
    return b if isinstance(a, float) and a == 0 else a if isinstance(b, float) and b == 0 else a + b


def _times(a, b):
    for x, y in ((a, b), (b, a)):
        if isinstance(x, float) and x in (0.0, 1.0):
            return y if x else 0.0
    return a * b


@dataclass(frozen=True)
class Jet:
    """A value and its derivatives in r and t; plain numbers stand for constants."""

    v: object
    r: object = 0.0
    t: object = 0.0
    rr: object = 0.0
    rt: object = 0.0
    tt: object = 0.0

    def __add__(self, other) -> Jet:
        o = other if isinstance(other, Jet) else Jet(float(other))
        return Jet(*(_plus(a, b) for a, b in zip(self.parts(), o.parts(), strict=True)))

    def __mul__(self, other) -> Jet:
        o = other if isinstance(other, Jet) else Jet(float(other))
        two = lambda x, y: _plus(_times(x, o.v), _times(self.v, y))
        return Jet(
            _times(self.v, o.v), two(self.r, o.r), two(self.t, o.t),
            _plus(two(self.rr, o.rr), _times(2.0, _times(self.r, o.r))),
            _plus(two(self.rt, o.rt), _plus(_times(self.r, o.t), _times(self.t, o.r))),
            _plus(two(self.tt, o.tt), _times(2.0, _times(self.t, o.t))),
        )

    __radd__, __rmul__ = __add__, __mul__

    def __neg__(self) -> Jet:
        return self * -1.0

    def __sub__(self, other) -> Jet:
        return self + (-other if isinstance(other, Jet) else -float(other))

    def __truediv__(self, by: float) -> Jet:
        return self * (1 / by)

    def parts(self) -> tuple:
        return self.v, self.r, self.t, self.rr, self.rt, self.tt

    def chain(self, f, f1, f2) -> Jet:
        """A function of this one, from its value and first two derivatives."""
        return Jet(
            f, _times(f1, self.r), _times(f1, self.t),
            _plus(_times(f2, _times(self.r, self.r)), _times(f1, self.rr)),
            _plus(_times(f2, _times(self.r, self.t)), _times(f1, self.rt)),
            _plus(_times(f2, _times(self.t, self.t)), _times(f1, self.tt)),
        )

    def exp(self) -> Jet:
        e = F.exp(self.v) if isinstance(self.v, Column) else np.exp(self.v)
        return self.chain(e, e, e)

    def __pow__(self, p: float) -> Jet:
        if p < 0 and not isinstance(self.v, Column):  # by division, as numpy's powers are slow; there is no 0 / 0
            f = 1 / np.sqrt(self.v) if p == -0.5 else self.v**p
            f1 = f / self.v
            return self.chain(f, p * f1, p * (p - 1) * (f1 / self.v))
        power = (lambda q: F.pow(self.v, F.lit(float(q)))) if isinstance(self.v, Column) else (lambda q: self.v**q)
        return self.chain(power(p), p * power(p - 1), p * (p - 1) * power(p - 2))


@dataclass(frozen=True)
class Smooth:
    """A kernel k(x, y) = form(r, t), with its Stein kernel as a column and over blocks."""

    form: Callable[[Jet, Jet], Jet]
    #: Whether it is known to be positive definite; its Stein kernel then is too.
    definite: bool = False

    def jet(self, r, t) -> Jet:
        return self.form(Jet(r, r=1.0), Jet(t, t=1.0))

    def expr(self, a, b) -> Column:
        return self.jet(sqdist(a, b), dot(a, b)).v

    def block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.jet(squares(a, b), a @ b.T).v

    def stein(self, x, y, sx, sy) -> Column:
        """k <sx, sy> + <sx, grad_y k> + <sy, grad_x k> + trace of the mixed derivative, from points and scores."""
        # Bound once: every sum over the dimensions is evaluated once per pair, however often the formula has it.
        sums = F.struct(sqdist(x, y).alias("r"), dot(x, y).alias("t"), dot(sx, sy).alias("ss"), (dot(sx, x) - dot(sx, y) - dot(sy, x) + dot(sy, y)).alias("su"), (dot(sx, x) + dot(sy, y)).alias("sp"), F.size(x).cast("double").alias("d"))
        return F.get(F.transform(F.array(sums), lambda q: self._stein(q["r"], q["t"], q["ss"], q["su"], q["sp"], q["d"])), F.lit(0))

    def stein_block(self, x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
        own = [(s * z).sum(1) for s, z in ((sx, x), (sy, y))]
        sp = own[0][:, None] + own[1]
        return self._stein(squares(x, y), x @ y.T, sx @ sy.T, sp - sx @ y.T - x @ sy.T, sp, float(x.shape[1]))

    def _stein(self, r, t, ss, su, sp, d):
        """su: <sx - sy, x - y>; sp: <sx, x> + <sy, y>. The gradients are 2 k_r (x - y) + k_t y and -2 k_r (x - y) + k_t x."""
        k = self.jet(r, t)
        first = _plus(_times(-2.0, _times(k.r, su)), _times(k.t, sp))
        trace = _plus(_times(d, _plus(k.t, _times(-2.0, k.r))), _plus(_times(r, _plus(_times(-4.0, k.rr), _times(2.0, k.rt))), _times(t, k.tt)))
        return _plus(_times(k.v, ss), _plus(first, trace))


def gaussian(sigma: float = 1.0) -> Smooth:
    """exp(-r / (2 sigma^2))."""
    return Smooth(lambda r, t: (r / (-2 * sigma**2)).exp(), True)


def inverse_multiquadric(sigma: float = 1.0, beta: float = -0.5) -> Smooth:
    """(1 + r / sigma^2) ** beta."""
    return Smooth(lambda r, t: (r / sigma**2 + 1.0) ** beta, beta < 0)


def polynomial(degree: float = 2.0, offset: float = 1.0) -> Smooth:
    """(<x, y> + offset) ** degree."""
    return Smooth(lambda r, t: (t + offset) ** degree)


def combined(*parts: Smooth, product: bool = False) -> Smooth:
    """The sum or the product of kernels."""

    def form(r: Jet, t: Jet) -> Jet:
        out = parts[0].form(r, t)
        for k in parts[1:]:
            out = out * k.form(r, t) if product else out + k.form(r, t)
        return out

    return Smooth(form, all(k.definite for k in parts))


# Scores: the gradient of log density at a point, as a column of the row. They are added before pairs are formed, so once per row.


def normal_score(y, mean, s=1.0) -> Column:
    """Of N(mean, s^2 I)."""
    return F.zip_with(mean, y, lambda m, v: (m - v) / (s * s))


def mixture_score(y, centres, s=1.0, weights=None) -> Column:
    """Of a mixture of N(c, s^2 I) over an array of centres, weighted equally or by an array of weights."""
    s = s if isinstance(s, Column) else F.lit(float(s))
    weights = weights if weights is not None else F.transform(centres, lambda c: F.lit(1.0))
    logs = F.zip_with(centres, weights, lambda c, w: F.struct(c.alias("c"), (F.log(w) - sqdist(c, y) / (2 * s * s)).alias("l")))

    def scored(q: Column) -> Column:
        top = F.array_max(F.transform(q, lambda p: p["l"]))
        shares = F.transform(q, lambda p: F.struct(p["c"].alias("c"), F.exp(p["l"] - top).alias("w")))
        total = F.aggregate(shares, F.lit(0.0), lambda a, p: a + p["w"])
        zero = F.transform(y, lambda v: F.lit(0.0))
        mean = F.aggregate(shares, zero, lambda a, p: F.zip_with(a, p["c"], lambda m, c: m + p["w"] / total * c))
        return F.zip_with(mean, y, lambda m, v: (m - v) / (s * s))

    return F.get(F.transform(F.array(logs), scored), F.lit(0))
