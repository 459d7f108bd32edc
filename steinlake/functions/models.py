"""Gaussian and particle models: expectations of a Gaussian kernel, and distances of models, as column expressions.

A Gaussian model is a mean array and a standard deviation; particles are an array of points with equal weights.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import dot, sqdist, sqnorm


def _size(x) -> Column:
    return F.size(x).cast("double")


def expect_one(mu, s, y, sk: float) -> Column:
    """E k(X, y), X ~ N(mu, s^2 I)."""
    return F.exp(-(_size(mu) * F.log1p(F.pow(s / sk, 2)) + sqdist(mu, y) / (s * s + sk * sk)) / 2)


def expect_both(m1, s1, m2, s2, sk: float) -> Column:
    """E k(X, Y) of two independent Gaussians."""
    return F.exp(-(_size(m1) * F.log1p(F.pow(s1 / sk, 2) + F.pow(s2 / sk, 2)) + sqdist(m1, m2) / (s1 * s1 + s2 * s2 + sk * sk)) / 2)


def mmd2(m1, s1, m2, s2, sk: float) -> Column:
    """Squared maximum mean discrepancy of two Gaussians."""
    return expect_both(m1, s1, m1, s1, sk) + expect_both(m2, s2, m2, s2, sk) - 2 * expect_both(m1, s1, m2, s2, sk)


def mmd(m1, s1, m2, s2, sk: float) -> Column:
    """Its root; a square below zero by rounding counts as zero."""
    return F.sqrt(F.greatest(mmd2(m1, s1, m2, s2, sk), F.lit(0.0)))


def wasserstein2(m1, s1, m2, s2) -> Column:
    """Squared 2-Wasserstein distance of two isotropic Gaussians."""
    return sqdist(m1, m2) + _size(m1) * (s1 - s2) * (s1 - s2)


def fisher(mp, sp, mq, sq, mb, sb) -> Column:
    """Generalised Fisher divergence of two Gaussians under a Gaussian base measure."""
    b = 1 / (sp * sp) - 1 / (sq * sq)
    a = F.zip_with(mp, mq, lambda x, y: x / (sp * sp) - y / (sq * sq))
    return (_size(mp) * sb * sb + sqnorm(mb)) * b * b - 2 * b * dot(mb, a) + sqnorm(a)


def kernel_fisher(mp, sp, mq, sq, mb, sb, sk: float) -> Column:
    """Kernelised generalised Fisher divergence with a Gaussian ground kernel, in closed form."""
    b2, d = sb * sb, _size(mp)
    c = F.sqrt(b2 * sk * sk / (2 + sk * sk / b2)) / b2
    rest = F.pow(1 + 2 * b2 / (sk * sk), -(d - 1) / 2)
    shift = b2 / (2 + sk * sk / b2)
    triples = F.zip_with(F.zip_with(mp, mq, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), mb, lambda t, m: F.struct(t["p"].alias("p"), t["q"].alias("q"), m.alias("b")))

    def one(t: Column) -> Column:
        p, q, m = t["p"], t["q"], t["b"]
        r = m * m + shift
        vp, vq = sp * sp, sq * sq
        return (r - 2 * m * p + p * p) / (vp * vp) - 2 * (r - m * (p + q) + p * q) / (vp * vq) + (r - 2 * m * q + q * q) / (vq * vq)

    return rest * c * F.aggregate(triples, F.lit(0.0), lambda s, t: s + one(t))


def mean_over(points, f) -> Column:
    """The mean of f over an array of points."""
    return F.aggregate(points, F.lit(0.0), lambda s, v: s + f(v)) / F.size(points)


def particles_one(points, y, kernel) -> Column:
    """E k(X, y) over equally weighted points."""
    return mean_over(points, lambda v: kernel.expr(v, y))


def particles_both(p, q, kernel) -> Column:
    """E k(X, Y) over two sets of points."""
    return mean_over(p, lambda v: mean_over(q, lambda w: kernel.expr(v, w)))


def gaussian_score(mu, s):
    """The score function of a Gaussian model: x -> (mu - x) / s^2."""
    return lambda x: F.zip_with(mu, x, lambda m, v: (m - v) / (s * s))


def fisher_over(base, score_p, score_q) -> Column:
    """The Fisher divergence of two score functions under a base measure of equally weighted samples (an array of points)."""
    return mean_over(base, lambda x: sqdist(score_p(x), score_q(x)))


def kernel_fisher_over(base, score_p, score_q, kernel) -> Column:
    """Its kernelised form, over all pairs of the base samples; their number is bounded by whoever draws them."""
    both = F.transform(base, lambda x: F.struct(x.alias("x"), F.zip_with(score_p(x), score_q(x), lambda u, v: u - v).alias("d")))
    return mean_over(both, lambda u: mean_over(both, lambda v: kernel.expr(u["x"], v["x"]) * dot(u["d"], v["d"])))
