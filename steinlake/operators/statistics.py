"""The pairwise functions h(z, z') of the six tests, as columns over a_* and b_* and as numpy twins over blocks.

Rows have columns: x, y (arrays of doubles), mu, s (a Gaussian model), points (a particle model: an array of points).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import models as M
from ..functions.arrays import dot, minus, scaled
from ..functions.jets import Smooth
from ..functions.kernels import Gaussian, embedding, enough, squares

Rows = dict[str, np.ndarray]


def c(side: str, name: str) -> Column:
    return F.col(f"{side}_{name}")


@dataclass(frozen=True)
class Statistic:
    """expr: the column of h; block: the matrix of h for two blocks; needs: the columns a row must have."""

    name: str
    needs: tuple[str, ...]
    expr: Callable[[], Column]
    block: Callable[[Rows, Rows], np.ndarray] | None = None
    #: Columns that a block needs once, however many blocks it meets, made of its own; one row each, like the others.
    prepare: Callable[[Rows], Rows] = lambda rows: {}
    #: Where h is a product of two positive definite kernels whose features may be few: both, as matrices like block's, of prepared rows.
    factors: tuple[Callable[[Rows, Rows], np.ndarray], Callable[[Rows, Rows], np.ndarray]] | None = None

    @property
    def tiled(self) -> bool:
        """Whether the complete form, in tiles, exists."""
        return self.block is not None

    @property
    def on_particles(self) -> bool:
        """Whether models enter as particles, so that any model that can be sampled will do."""
        return "points" in self.needs


def mmd(kernel=Gaussian(1.0)) -> Statistic:
    """k(x, x') + k(y, y') - k(x, y') - k(x', y)."""

    def expr() -> Column:
        k = kernel.expr
        return k(c("a", "x"), c("b", "x")) + k(c("a", "y"), c("b", "y")) - k(c("a", "x"), c("b", "y")) - k(c("b", "x"), c("a", "y"))

    def block(a: Rows, b: Rows) -> np.ndarray:
        k = kernel.block
        return k(a["x"], b["x"]) + k(a["y"], b["y"]) - k(a["x"], b["y"]) - k(a["y"], b["x"])

    return Statistic("mmd", ("x", "y"), expr, block)


def joint_mmd(kx=Gaussian(1.0), ky=Gaussian(1.0), second: str = "y2") -> Statistic:
    """Two-sample statistic of (x, y) against (x, y2), for two models' outputs under the same x and a product of kernels.

    Both samples share x, so its kernel is a factor of all four terms.
    """

    def expr() -> Column:
        k, y, z = ky.expr, [c(t, "y") for t in "ab"], [c(t, second) for t in "ab"]
        return kx.expr(c("a", "x"), c("b", "x")) * (k(y[0], y[1]) + k(z[0], z[1]) - k(y[0], z[1]) - k(y[1], z[0]))

    def block(a: Rows, b: Rows) -> np.ndarray:
        k = ky.block
        return kx.block(a["x"], b["x"]) * (k(a["y"], b["y"]) + k(a[second], b[second]) - k(a["y"], b[second]) - k(a[second], b["y"]))

    return Statistic("joint_mmd", ("x", "y", second), expr, block)


def stein(k: Gaussian, x, y, sx, sy) -> Column:
    """The Stein kernel of a Gaussian kernel, from points and scores."""
    u, v = minus(x, y), k.sigma**2
    return k.expr(x, y) * (dot(sx, sy) + (dot(sx, u) - dot(sy, u)) / v + k.trace(x, y, F.size(x).cast("double")))


def stein_block(k: Gaussian, x, y, sx, sy) -> np.ndarray:
    v = k.sigma**2
    su = (sx * x).sum(1)[:, None] - sx @ y.T
    tu = x @ sy.T - (sy * y).sum(1)
    return k.block(x, y) * (sx @ sy.T + (su - tu) / v + x.shape[1] / v - squares(x, y) / v**2)


def ksd(k: Gaussian = Gaussian(1.0)) -> Statistic:
    """Stein discrepancy of x from N(0, I), whose score is -x."""
    return Statistic("ksd", ("x",), lambda: stein(k, c("a", "x"), c("b", "x"), scaled(c("a", "x"), -1.0), scaled(c("b", "x"), -1.0)), lambda a, b: stein_block(k, a["x"], b["x"], -a["x"], -b["x"]))


def kcsd(kx: Gaussian = Gaussian(1.0), ky: Gaussian = Gaussian(1.0)) -> Statistic:
    """Conditional Stein discrepancy of y from N(x, I), whose score is x - y."""

    def expr() -> Column:
        s = [minus(c(t, "x"), c(t, "y")) for t in "ab"]
        return kx.expr(c("a", "x"), c("b", "x")) * stein(ky, c("a", "y"), c("b", "y"), *s)

    return Statistic("kcsd", ("x", "y"), expr, lambda a, b: kx.block(a["x"], b["x"]) * stein_block(ky, a["y"], b["y"], a["x"] - a["y"], b["x"] - b["y"]))


def _one(m, s, y, sk) -> np.ndarray:
    v = s * s
    out = squares(m, y)
    out *= (-0.5 / (v + sk**2))[:, None]
    np.exp(out, out=out)
    out *= np.exp(-y.shape[1] * np.log1p(v / sk**2) / 2)[:, None]
    return out


def _both(m, s, n, t, sk) -> np.ndarray:
    w = 1 / ((s * s)[:, None] + t * t + sk**2)
    out = squares(m, n)
    out *= w
    out *= -0.5
    np.exp(out, out=out)
    # (1 + v / sk^2) ** (-d / 2), by products: logarithms of a whole matrix are slow.
    w *= sk**2
    half, odd = divmod(m.shape[1], 2)
    if odd:
        out *= np.sqrt(w)
    while half:
        if half & 1:
            out *= w
        half >>= 1
        if half:
            w *= w
    return out


def _own(m, s, sk) -> np.ndarray:
    return np.exp(-m.shape[1] * np.log1p(2 * s * s / sk**2) / 2)


@dataclass(frozen=True)
class ModelKernel:
    """exp(-d / (2 sigma^2)) of the models of two rows, from a squared distance d; block: the matrix of d for two blocks."""

    needs: tuple[str, ...]
    squared: Callable[[], Column]
    sigma: float = 1.0
    block_squared: Callable[[Rows, Rows], np.ndarray] | None = None
    prepare: Callable[[Rows], Rows] = lambda rows: {}
    #: Where block_squared can be had from the matrix of E k(X, X') of the models of two rows: from that matrix.
    block_from: Callable[[Rows, Rows, np.ndarray], np.ndarray] | None = None
    #: The bandwidth of that k.
    ground: float | None = None
    #: Whether it is known to be positive definite: d is a squared distance of embeddings.
    definite: bool = False

    def expr(self) -> Column:
        return F.exp(-self.squared() / (2 * self.sigma**2))

    def block(self, a: Rows, b: Rows) -> np.ndarray:
        return self._exp(self.block_squared(a, b))

    def block_with(self, a: Rows, b: Rows, both: np.ndarray) -> np.ndarray:
        """The same, from the matrix of E k(X, X')."""
        return self._exp(self.block_from(a, b, both))

    def _exp(self, squared: np.ndarray) -> np.ndarray:
        return np.exp(squared * (-1 / (2 * self.sigma**2)))


def _models() -> list[Column]:
    return [c(side, name) for side in "ab" for name in ("mu", "s")]


def exp_mmd(sk: float = 1.0, sigma: float = 1.0) -> ModelKernel:
    """By the discrepancy of Gaussian models under a Gaussian kernel, in closed form."""

    def block_from(a: Rows, b: Rows, both: np.ndarray) -> np.ndarray:
        out = both * -2
        out += _own(a["mu"], a["s"], sk)[:, None]
        out += _own(b["mu"], b["s"], sk)
        return out

    def block(a: Rows, b: Rows) -> np.ndarray:
        return block_from(a, b, _both(a["mu"], a["s"], b["mu"], b["s"], sk))

    return ModelKernel(("mu", "s"), lambda: M.mmd2(*_models(), sk), sigma, block, block_from=block_from, ground=sk)


def exp_mmd_particles(k=Gaussian(1.0), sigma: float = 1.0) -> ModelKernel:
    """By the discrepancy of particle models under any kernel on points."""

    def own(r: Rows) -> np.ndarray:
        if "own" in r:
            return r["own"]
        if isinstance(k, Gaussian):
            p = r["points"]
            return np.exp(sum(-((p[:, :, None, i] - p[:, None, :, i]) ** 2) for i in range(p.shape[2])) / (2 * k.sigma**2)).mean((1, 2))
        return np.array([k.block(p, p).mean() for p in r["points"]])

    def block(a: Rows, b: Rows) -> np.ndarray:
        out = _particles_between(a, b, k)
        out *= -2
        out += own(a)[:, None]
        out += own(b)
        return out

    return ModelKernel(("points",), lambda: particle_mmd2(k), sigma, block, lambda r: {"own": own(r)} | _embedded(r, "points", k), definite=isinstance(k, Gaussian))


def exp_wasserstein(sigma: float = 1.0) -> ModelKernel:
    """By the 2-Wasserstein distance of Gaussian models."""
    return ModelKernel(("mu", "s"), lambda: M.wasserstein2(*_models()), sigma, lambda a, b: squares(a["mu"], b["mu"]) + a["mu"].shape[1] * (a["s"][:, None] - b["s"]) ** 2)


def exp_fisher(base: list[list[float]], sigma: float = 1.0, k=None, score=M.gaussian_score, needs: tuple[str, ...] = ("mu", "s")) -> ModelKernel:
    """By the Fisher divergence under base samples that all pairs of rows share; kernelised, where a kernel k on points is given.

    score(*model) gives the score function of a row's model, whose columns are named by needs.
    """

    def squared() -> Column:
        p, q = (score(*(c(side, n) for n in needs)) for side in "ab")
        points = F.lit(base)
        return M.fisher_over(points, p, q) if k is None else M.kernel_fisher_over(points, p, q, k)

    return ModelKernel(needs, squared, sigma)


def model_kernel(sk: float, sigma: float) -> Column:
    """exp(-MMD^2 / (2 sigma^2)) of the Gaussian models of two rows."""
    return exp_mmd(sk, sigma).expr()


def model_kernel_block(a: Rows, b: Rows, sk: float, sigma: float) -> np.ndarray:
    return exp_mmd(sk, sigma).block(a, b)


def _residual(sk: float) -> Column:
    k = Gaussian(sk)
    a, b = [[c(t, n) for n in ("mu", "s", "y")] for t in "ab"]
    return k.expr(a[2], b[2]) - M.expect_one(a[0], a[1], b[2], sk) - M.expect_one(b[0], b[1], a[2], sk) + M.expect_both(a[0], a[1], b[0], b[1], sk)


def _residual_block(a: Rows, b: Rows, sk: float, both: np.ndarray | None = None) -> np.ndarray:
    out = Gaussian(sk).block(a["y"], b["y"])
    out -= _one(a["mu"], a["s"], b["y"], sk)
    out -= _one(b["mu"], b["s"], a["y"], sk).T
    out += _both(a["mu"], a["s"], b["mu"], b["s"], sk) if both is None else both
    return out


def skce(sk: float = 1.0, sigma: float = 1.0, kernel: ModelKernel | None = None) -> Statistic:
    """Calibration error with Gaussian models: k_p(p, p') times the kernel of the residuals of y under the models.

    k_p is any kernel on models, and the exponential of their discrepancy where none is given.
    """
    kp = kernel or exp_mmd(sk, sigma)

    def block(a: Rows, b: Rows) -> np.ndarray:
        both = _both(a["mu"], a["s"], b["mu"], b["s"], sk)
        out = kp.block_with(a, b, both) if kp.block_from and kp.ground == sk else kp.block(a, b)
        out *= _residual_block(a, b, sk, both)
        return out

    return Statistic("skce", tuple(dict.fromkeys((*kp.needs, "mu", "s", "y"))), lambda: kp.expr() * _residual(sk), block if kp.block_squared else None, kp.prepare)


def cgof(kx=Gaussian(1.0), sk: float = 1.0) -> Statistic:
    """Conditional goodness of fit with Gaussian models: k_x(x, x') times the same residual term.

    k_x is any kernel on x, of sequences too. Tiles take x of one length, of numbers or of points.
    """
    return Statistic("cgof", ("x", "mu", "s", "y"), lambda: kx.expr(c("a", "x"), c("b", "x")) * _residual(sk), lambda a, b: kx.block(a["x"], b["x"]) * _residual_block(a, b, sk))


def kccsd(sk: float = 1.0, sigma: float = 1.0, ky: Gaussian = Gaussian(1.0)) -> Statistic:
    """Conditional Stein discrepancy of y from the rows' Gaussian models, with a kernel on models; the score is (mu - y) / s^2."""

    def expr() -> Column:
        s = [scaled(minus(c(t, "mu"), c(t, "y")), 1 / (c(t, "s") * c(t, "s"))) for t in "ab"]
        return model_kernel(sk, sigma) * stein(ky, c("a", "y"), c("b", "y"), *s)

    def block(a: Rows, b: Rows) -> np.ndarray:
        s = [(r["mu"] - r["y"]) / (r["s"] * r["s"])[:, None] for r in (a, b)]
        return model_kernel_block(a, b, sk, sigma) * stein_block(ky, a["y"], b["y"], *s)

    return Statistic("kccsd", ("mu", "s", "y"), expr, block)


def ksd_scored(k: Smooth, point: str = "x", score: str = "score") -> Statistic:
    """Stein discrepancy of a column of points from the law whose score, at those points, is a column of the row; any smooth kernel."""

    def expr() -> Column:
        return k.stein(c("a", point), c("b", point), c("a", score), c("b", score))

    return Statistic("ksd_scored", (point, score), expr, lambda a, b: k.stein_block(a[point], b[point], a[score], b[score]))


def kcsd_scored(kx, ky: Smooth, condition: str = "x", point: str = "y", score: str = "score") -> Statistic:
    """Its conditional form: any kernel on conditions times the Stein kernel of the points; score is that of the point given its condition."""

    def expr() -> Column:
        return kx.expr(c("a", condition), c("b", condition)) * ky.stein(c("a", point), c("b", point), c("a", score), c("b", score))

    def block(a: Rows, b: Rows) -> np.ndarray:
        return kx.block(a[condition], b[condition]) * ky.stein_block(a[point], b[point], a[score], b[score])

    return Statistic("kcsd_scored", (condition, point, score), expr, block)


def kccsd_scored(kp: ModelKernel, ky: Smooth, point: str = "y", score: str = "score") -> Statistic:
    """Its form with a kernel on models (closed forms, particles, divergences) in place of one on conditions."""
    stein_of = lambda a, b: ky.stein_block(a[point], b[point], a[score], b[score])
    block = (lambda a, b: kp.block(a, b) * stein_of(a, b)) if kp.block_squared else None
    factors = (kp.block, stein_of) if kp.definite and ky.definite else None
    return Statistic("kccsd_scored", tuple(dict.fromkeys((*kp.needs, point, score))), lambda: kp.expr() * ky.stein(c("a", point), c("b", point), c("a", score), c("b", score)), block, kp.prepare, factors)


def _particle_residual(k: Gaussian) -> Column:
    pa, ya, pb, yb = c("a", "points"), c("a", "y"), c("b", "points"), c("b", "y")
    return k.expr(ya, yb) - M.particles_one(pa, yb, k) - M.particles_one(pb, ya, k) + M.particles_both(pa, pb, k)


def _particles_one(p: np.ndarray, y: np.ndarray, k) -> np.ndarray:
    """E k(X, y) of stacks of particle models (rows, particles, dimensions) and of points, one matrix of blocks at a time."""
    return sum(k.block(p[:, u], y) for u in range(p.shape[1])) / p.shape[1]


def _particles_both(p: np.ndarray, q: np.ndarray, k) -> np.ndarray:
    return sum(_particles_one(p, q[:, v], k) for v in range(q.shape[1])) / q.shape[1]


def _embedded(rows: Rows, column: str, k) -> Rows:
    """The mean embeddings of a column of points, or of stacks of them, under a Gaussian kernel (of others: nothing), with the rows' largest norms."""
    if not isinstance(k, Gaussian):
        return {}
    p = rows[column]
    phi, reach = embedding(p[:, None] if p.ndim == 2 else p, k.sigma)
    return {f"{column} phi": phi, f"{column} reach": reach}


def _features(a: Rows, b: Rows, columns: tuple[str, ...], dimension: int) -> int | None:
    """How many features the pairs of two prepared blocks need; None where they are not embedded, or points are too far out."""
    if any(f"{x} reach" not in r for r in (a, b) for x in columns):
        return None
    out = [max(float(r[f"{x} reach"].max()) for x in columns) for r in (a, b)]
    return enough(out[0] * out[1], dimension)


def _particles_between(a: Rows, b: Rows, k) -> np.ndarray:
    """E k(X, X') of the particle models of two blocks."""
    n = _features(a, b, ("points",), a["points"].shape[2])
    if n is None:
        return _particles_both(a["points"], b["points"], k)
    return a["points phi"][:, :n] @ b["points phi"][:, :n].T


def _residual_embedded(rows: Rows, k) -> Rows:
    """The embedding of y less that of the particles: the residual term of two rows is their inner product."""
    out = {**_embedded(rows, "points", k), **_embedded(rows, "y", k)}
    if not out:
        return {}
    return {"points reach": out["points reach"], "y reach": out["y reach"], "residual phi": out["y phi"] - out["points phi"]}


def _particle_residual_block(a: Rows, b: Rows, k) -> np.ndarray:
    pa, ya, pb, yb = a["points"], a["y"], b["points"], b["y"]
    n = _features(a, b, ("points", "y"), ya.shape[1])
    if n is not None and "residual phi" in a and "residual phi" in b:
        return a["residual phi"][:, :n] @ b["residual phi"][:, :n].T
    return k.block(ya, yb) - _particles_one(pa, yb, k) - _particles_one(pb, ya, k).T + _particles_both(pa, pb, k)


def particle_mmd2(k: Gaussian) -> Column:
    pa, pb = c("a", "points"), c("b", "points")
    return M.particles_both(pa, pa, k) + M.particles_both(pb, pb, k) - 2 * M.particles_both(pa, pb, k)


def skce_particles(k: Gaussian = Gaussian(1.0), sigma: float = 1.0, kernel: ModelKernel | None = None) -> Statistic:
    """Calibration error with particle models of a bounded number of points; the kernel on models as in skce."""
    kp = kernel or exp_mmd_particles(k, sigma)
    residual = lambda a, b: _particle_residual_block(a, b, k)
    block = (lambda a, b: kp.block(a, b) * residual(a, b)) if kp.block_squared else None
    factors = (kp.block, residual) if kp.definite and isinstance(k, Gaussian) else None
    return Statistic("skce_particles", tuple(dict.fromkeys((*kp.needs, "points", "y"))), lambda: kp.expr() * _particle_residual(k), block, lambda r: kp.prepare(r) | _residual_embedded(r, k), factors)


def cgof_particles(kx=Gaussian(1.0), k: Gaussian = Gaussian(1.0)) -> Statistic:
    """Conditional goodness of fit with particle models; tiles take one number of particles for all rows."""
    return Statistic("cgof_particles", ("x", "points", "y"), lambda: kx.expr(c("a", "x"), c("b", "x")) * _particle_residual(k), lambda a, b: kx.block(a["x"], b["x"]) * _particle_residual_block(a, b, k), lambda r: _residual_embedded(r, k))
