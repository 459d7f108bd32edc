"""Hypothesis tests as plans: pairs, statistic, null distribution, decision, all lazy and one row at the end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jets import Smooth
from ..functions.kernels import Gaussian
from ..operators import bandwidth, null, pairs, particles, tiles
from ..operators import statistics as S
from ..operators.chains import ChainConfig, ChainTable, Density


@dataclass(frozen=True)
class TestConfig:
    """num_permutations: bootstrap draws; diagonals: None for the complete statistic, 1 for disjoint neighbours, R for R
    super-diagonals; analytic: with diagonals=1, the normal quantile in place of draws; seed: of every hash.
    """

    num_permutations: int = 100
    alpha: float = 0.05
    diagonals: int | None = None
    analytic: bool = True
    seed: str = "0"
    bandwidth_cap: int = 5_000

    __test__ = False

    @property
    def has_analytic_null(self) -> bool:
        """Whether the null quantile has a closed form: only over disjoint neighbours, whose terms are independent."""
        return self.diagonals == 1 and self.analytic


def pair_values(rows: DataFrame, statistic: S.Statistic, diagonals: int) -> DataFrame:
    """(a_i, b_i, h) over neighbours or super-diagonals: linear in the rows. Signs e of the rows are kept as a_e and b_e."""
    chosen = pairs.adjacent(rows) if diagonals == 1 else pairs.superdiagonals(rows, diagonals)
    return chosen.select("a_i", "b_i", statistic.expr().alias("h"), *(c for c in ("a_e", "b_e") if c in chosen.columns))


def unbiased_estimate(rows: DataFrame, statistic: S.Statistic, config: TestConfig = TestConfig()) -> DataFrame:
    """(m, val, mean_h2) without a null distribution."""
    if config.diagonals is None:
        return tiles.complete(rows, statistic)
    h = pair_values(rows, statistic, config.diagonals)
    return h.agg(F.count("h").alias("m"), F.avg("h").alias("val"), F.avg(F.col("h") * F.col("h")).alias("mean_h2"))


def run_test(rows: DataFrame, statistic: S.Statistic, config: TestConfig = TestConfig()) -> DataFrame:
    """One row: m, val, quantile, p_value, reject (and for bootstrap tests p_value_plus1, num_permutations, h0)."""
    if config.has_analytic_null:
        x = unbiased_estimate(rows, statistic, config)
        q = null.analytic_quantile(config.alpha, F.col("mean_h2"), F.col("m"))
        z = F.col("val") / (F.sqrt("mean_h2") / F.sqrt("m"))
        return x.select("m", "val", q.alias("quantile"), null.upper_tail(z).alias("p_value"), (F.col("val") > q).alias("reject"))
    if config.diagonals is None:
        return null.decide(tiles.complete(rows, statistic, config.num_permutations, config.seed), config.alpha)
    h = pair_values(null.with_signs(rows, config.num_permutations, config.seed), statistic, config.diagonals)
    return null.decide(null.bootstrap_row(h), config.alpha)


def sweep(rows: DataFrame, statistics: dict[str, S.Statistic], alpha: float = 0.05) -> DataFrame:
    """(name, m, val, quantile, p_value, reject): a linear-time test for each named statistic, in one pass over the pairs.

    For experiments over a grid of parameters: the rows are read and paired once, whatever the number of statistics.
    """
    each = F.array(*(F.struct(F.lit(name).alias("name"), s.expr().alias("h")) for name, s in statistics.items()))
    h = pairs.adjacent(rows).select(F.explode(each).alias("t")).select("t.name", "t.h")
    x = h.groupBy("name").agg(F.count("h").alias("m"), F.avg("h").alias("val"), F.avg(F.col("h") * F.col("h")).alias("mean_h2"))
    q = null.analytic_quantile(alpha, F.col("mean_h2"), F.col("m"))
    z = F.col("val") / (F.sqrt("mean_h2") / F.sqrt("m"))
    return x.select("name", "m", "val", q.alias("quantile"), null.upper_tail(z).alias("p_value"), (F.col("val") > q).alias("reject"))


def joint_mmd_test(rows: DataFrame, config: TestConfig = TestConfig(), band: int = 5, second: str = "y2") -> DataFrame:
    """Outputs y against `second` of two models under the same x, Gaussian kernels by medians over a band of pairs."""
    near = pairs.superdiagonals(rows, band)
    sx = bandwidth.gaussian_bandwidth(near, "x").first()[0]
    both = near.select(*(F.col(f"{t}_{n}").alias(f"{t}_{m}") for t in "ab" for n, m in (("y", "x"), (second, "y"))))
    sy = bandwidth.exact_quantile(bandwidth.union_distances(both)).first()[0]
    return run_test(rows, S.joint_mmd(Gaussian(sx), Gaussian(sy), second), config)


def median_bandwidth(rows: DataFrame, n: int, column: str, config: TestConfig = TestConfig()) -> float:
    """The one scalar that crosses the driver before a tuned test: a median over at most bandwidth_cap drawn pairs."""
    return bandwidth.gaussian_bandwidth(pairs.drawn(rows, n, config.bandwidth_cap, int(config.seed)), column).first()[0]


def mmd_test(rows: DataFrame, config: TestConfig = TestConfig(), sigma: float = 1.0) -> DataFrame:
    """Two-sample test of x against y."""
    return run_test(rows, S.mmd(Gaussian(sigma)), config)


def ksd_test(rows: DataFrame, config: TestConfig = TestConfig(), sigma: float = 1.0) -> DataFrame:
    return run_test(rows, S.ksd(Gaussian(sigma)), config)


def kcsd_test(rows: DataFrame, config: TestConfig = TestConfig()) -> DataFrame:
    return run_test(rows, S.kcsd(), config)


def kccsd_test(rows: DataFrame, config: TestConfig = TestConfig(), kernel: S.ModelKernel | None = None, ky: Smooth | None = None) -> DataFrame:
    """Stein discrepancy with a kernel on models: of Gaussian models in closed form, or, with a kernel and ky, of any models whose
    scores at y are a column of the rows.
    """
    return run_test(rows, S.kccsd() if kernel is None else S.kccsd_scored(kernel, ky), config)


def kccsd_estimate(rows: DataFrame, kernel: S.ModelKernel, ky: Smooth, config: TestConfig = TestConfig()) -> DataFrame:
    """(m, val, mean_h2) of the Stein discrepancy with a kernel on models; rows have y and score, the models' scores at y."""
    return unbiased_estimate(rows, S.kccsd_scored(kernel, ky), config)


def sampled(rows: DataFrame, m: int, seed: str) -> DataFrame:
    """rows with points: m particles of each row's Gaussian model, drawn once, before any pair is formed."""
    return rows.join(particles.gaussian_particles(rows, m, seed), "i")


def approximated(rows: DataFrame, density: Density, config: ChainConfig = ChainConfig(), folder: str | None = None) -> DataFrame:
    """rows with points: particles of each row's model from chains, moved once, before any pair is formed. With a folder, chains
    that an earlier run left there go on from where they stopped.
    """
    return rows.join(ChainTable(rows, density, config, folder).particles(), "i")


def _with_points(rows: DataFrame, config: TestConfig, m: int | None, density: Density | None, chains: ChainConfig, folder: str | None) -> DataFrame | None:
    if density is not None:
        return approximated(rows, density, chains, folder)
    return None if m is None else sampled(rows, m, config.seed)


def skce_test(rows: DataFrame, config: TestConfig = TestConfig(), kernel: S.ModelKernel | None = None, m: int | None = None, density: Density | None = None, chains: ChainConfig = ChainConfig(), folder: str | None = None) -> DataFrame:
    """Calibration test, with a kernel on models. In place of closed forms: with m, m particles of each row's Gaussian model; with a
    density, particles of any model from chains (kept in folder, if one is named).
    """
    drawn = _with_points(rows, config, m, density, chains, folder)
    return run_test(rows, S.skce(kernel=kernel), config) if drawn is None else run_test(drawn, S.skce_particles(kernel=kernel), config)


def cgof_test(rows: DataFrame, config: TestConfig = TestConfig(), kernel=Gaussian(1.0), m: int | None = None, density: Density | None = None, chains: ChainConfig = ChainConfig(), folder: str | None = None) -> DataFrame:
    """Conditional goodness of fit, with a kernel on x; m, density, chains and folder as in skce_test."""
    drawn = _with_points(rows, config, m, density, chains, folder)
    return run_test(rows, S.cgof(kernel), config) if drawn is None else run_test(drawn, S.cgof_particles(kernel), config)
