"""Arithmetic on array columns with built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(c, start: int | None = None, length: int | None = None) -> Column:
    """An array as doubles (cast first, so that sums are sums of doubles), or a slice of it from 1-based start."""
    c = col(c).cast("array<double>")
    return c if start is None else F.slice(c, start, length)


def bound(c, f) -> Column:
    """f(c), with c evaluated once however often f has it, also inside lambdas: a lambda evaluates what it holds for every element."""
    return F.get(F.transform(F.array(col(c)), f), F.lit(0))


def total(c) -> Column:
    return F.aggregate(col(c), F.lit(0.0), lambda s, t: s + t)


def dot(x, y) -> Column:
    return total(F.zip_with(col(x), col(y), lambda a, b: a * b))


def sqnorm(x) -> Column:
    return total(F.transform(col(x), lambda a: a * a))


def sqdist(x, y) -> Column:
    return total(F.zip_with(col(x), col(y), lambda a, b: (a - b) * (a - b)))


def hamming(s, t) -> Column:
    """Places where two arrays differ; the shorter is filled up with nulls, and two nulls are equal."""
    return F.aggregate(F.zip_with(col(s), col(t), lambda a, b: F.when(a.eqNullSafe(b), 0).otherwise(1)), F.lit(0), lambda u, d: u + d)


def logsumexp(c) -> Column:
    """log of the sum of exponentials, without overflow."""
    top = F.array_max(col(c))
    return F.log(total(F.transform(col(c), lambda a: F.exp(a - top)))) + top


def scaled(c, by) -> Column:
    return F.transform(col(c), lambda a: a * by)


def plus(x, y) -> Column:
    return F.zip_with(col(x), col(y), lambda a, b: a + b)


def minus(x, y) -> Column:
    return F.zip_with(col(x), col(y), lambda a, b: a - b)


def has_nan(c) -> Column:
    """Whether a vector is null or holds a null or NaN."""
    return F.coalesce(F.exists(col(c), lambda e: e.isNull() | F.isnan(e)), F.lit(True))


def rounded(c, digits: int = 6) -> Column:
    """Rounded, with -0.0 made 0.0."""
    return F.round(col(c), digits) + F.lit(0.0)


def mean_pool(tokens, skip_first: int = 0, skip_last: int = 0) -> Column:
    """The mean of an array of vectors, without some at the ends (start and stop marks); null where none is left."""
    kept = F.slice(col(tokens), skip_first + 1, F.greatest(F.size(col(tokens)) - skip_first - skip_last, F.lit(0)))
    n = F.size(kept)
    sums = F.aggregate(F.slice(kept, 2, F.greatest(n - 1, F.lit(0))), F.get(kept, 0), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return F.when(n > 0, F.transform(sums, lambda x: x / n))


def pad_infinite(c, to: int) -> Column:
    """An array filled up with infinities."""
    c = col(c).cast("array<double>")
    return F.when(F.size(c) < to, F.concat(c, F.array_repeat(F.lit(float("inf")), to - F.size(c)))).otherwise(c)
