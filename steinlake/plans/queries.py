"""The registered queries over the given tables, each with its SQL where SQL can express it.

embeddings: x is dimensions 1-32, y 33-64, a Gaussian model has mean 1-8 and deviation 0.5 + label / 10, particles are the
eight points of four dimensions in 9-40, and model tests take y from dimensions 41-48 (41-44 for particles). lineitem lines
stand for residues, orders for chains, part for metadata and short sequences, documents for texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import models as M
from ..functions.arrays import dot, doubles, hamming, rounded, sqdist, sqnorm
from ..functions.randomness import digest, index, sign
from ..operators import bandwidth, constraints, dataset, metrics, null, pairs, structure, tiles
from ..operators import statistics as S
from . import hypothesis as H

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of embeddings as test inputs (see the module's text)."""
    e = pairs.dense(read(spark, sf_dir, "embeddings"), "vec_id")
    v = F.col("v")
    points = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice(v, 9 + 4 * k, 4))
    return e.select(F.col("vec_id").alias("i"), "label", doubles("embedding").alias("v")).select(
        "i", "label", F.slice(v, 1, 32).alias("x"), F.slice(v, 33, 32).alias("y"), F.slice(v, 1, 8).alias("mu"), (0.5 + F.col("label") / 10).alias("s"), points.alias("points"), F.slice(v, 41, 8).alias("z"), F.slice(v, 41, 4).alias("z4"))


E_SQL = """e AS MATERIALIZED (SELECT vec_id AS i, label, v, v[1:32] AS x, v[33:64] AS y, v[1:8] AS mu, 0.5 + label / 10.0 AS s, v[41:48] AS z, v[41:44] AS z4,
  [v[9:12], v[13:16], v[17:20], v[21:24], v[25:28], v[29:32], v[33:36], v[37:40]] AS points FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings))"""
ADJACENT = "FROM e a JOIN e b ON b.i = a.i + 1 WHERE a.i % 2 = 0"
BAND5 = "FROM e a JOIN e b ON b.i > a.i AND b.i <= a.i + 5"
ALL_PAIRS = "FROM e a JOIN e b ON a.i < b.i"
Z95 = "1.6448536269514715"


def sq(x: str, y: str) -> str:
    return f"list_sum(list_transform(list_zip({x}, {y}), lambda q: (q[1] - q[2]) * (q[1] - q[2])))"


def dt(x: str, y: str) -> str:
    return f"list_inner_product({x}, {y})"


def k_sql(x: str, y: str, s: float = 1.0) -> str:
    return f"exp(-{sq(x, y)} / {2 * s * s})"


MMD_SQL = f"{k_sql('a.x', 'b.x')} + {k_sql('a.y', 'b.y')} - {k_sql('a.x', 'b.y')} - {k_sql('b.x', 'a.y')}"
KSD_SQL = f"{k_sql('a.x', 'b.x')} * ({dt('a.x', 'b.x')} - {sq('a.x', 'b.x')} + 32 - {sq('a.x', 'b.x')})"


def stein_sql(x: str, y: str, sx: str, sy: str, d: int) -> str:
    u = f"list_transform(list_zip({x}, {y}), lambda q: q[1] - q[2])"
    return f"({k_sql(x, y)} * ({dt(sx, sy)} + {dt(sx, u)} - {dt(sy, u)} + {d} - {sq(x, y)}))"


def diff_sql(x: str, y: str, by: str = "1") -> str:
    return f"list_transform(list_zip({x}, {y}), lambda q: (q[1] - q[2]) / ({by}))"


KCSD_SQL = f"{k_sql('a.x', 'b.x')} * {stein_sql('a.y', 'b.y', diff_sql('a.x', 'a.y'), diff_sql('b.x', 'b.y'), 32)}"


def one_sql(m: str, s: str, y: str) -> str:
    return f"exp(-(8 * ln(1 + {s} * {s}) + {sq(m, y)} / ({s} * {s} + 1)) / 2)"


def both_sql(m: str, s: str, n: str, t: str) -> str:
    return f"exp(-(8 * ln(1 + {s} * {s} + {t} * {t}) + {sq(m, n)} / ({s} * {s} + {t} * {t} + 1)) / 2)"


MMD2_SQL = f"({both_sql('a.mu', 'a.s', 'a.mu', 'a.s')} + {both_sql('b.mu', 'b.s', 'b.mu', 'b.s')} - 2 * {both_sql('a.mu', 'a.s', 'b.mu', 'b.s')})"
RESIDUAL_SQL = f"({k_sql('a.z', 'b.z')} - {one_sql('a.mu', 'a.s', 'b.z')} - {one_sql('b.mu', 'b.s', 'a.z')} + {both_sql('a.mu', 'a.s', 'b.mu', 'b.s')})"
SKCE_SQL = f"exp(-{MMD2_SQL} / 2) * {RESIDUAL_SQL}"
CGOF_SQL = f"{k_sql('a.x', 'b.x')} * {RESIDUAL_SQL}"
KCCSD_SQL = f"exp(-{MMD2_SQL} / 2) * {stein_sql('a.z', 'b.z', diff_sql('a.mu', 'a.z', 'a.s * a.s'), diff_sql('b.mu', 'b.z', 'b.s * b.s'), 8)}"


def _pmean(p: str, body: str, v: str) -> str:
    return f"(list_sum(list_transform({p}, lambda {v}: {body})) / len({p}))"


def _p1(p: str, y: str) -> str:
    return _pmean(p, k_sql("v1", y).replace("lambda q", "lambda q"), "v1")


def _p2(p: str, r: str) -> str:
    return _pmean(p, _pmean(r, k_sql("v1", "w1"), "w1"), "v1")


PMMD2_SQL = f"({_p2('a.points', 'a.points')} + {_p2('b.points', 'b.points')} - 2 * {_p2('a.points', 'b.points')})"
PRES_SQL = f"({k_sql('a.z4', 'b.z4')} - {_p1('a.points', 'b.z4')} - {_p1('b.points', 'a.z4')} + {_p2('a.points', 'b.points')})"


def linear_sql(h: str, over: str = ADJACENT) -> str:
    return f"WITH {E_SQL}, h AS (SELECT {h} AS h {over}) SELECT count(*) AS m, round(avg(h), 6) + 0.0 AS val, round({Z95} * sqrt(avg(h * h)) / sqrt(count(*)), 6) AS quantile, avg(h) > {Z95} * sqrt(avg(h * h)) / sqrt(count(*)) AS reject FROM h"


def mean_sql(h: str, over: str) -> str:
    return f"WITH {E_SQL}, h AS (SELECT {h} AS h {over}) SELECT count(*) AS m, round(avg(h), 6) + 0.0 AS val, round(avg(h * h), 6) AS mean_h2 FROM h"


def _linear(rows: DataFrame, statistic: S.Statistic) -> DataFrame:
    out = H.run_test(rows, statistic, H.TestConfig(diagonals=1))
    return out.select("m", rounded("val").alias("val"), rounded("quantile").alias("quantile"), "reject")


def _mean(out: DataFrame) -> DataFrame:
    return out.select("m", rounded("val").alias("val"), rounded("mean_h2").alias("mean_h2"))


def _model_rows(spark, sf_dir) -> DataFrame:
    return samples(spark, sf_dir).select("i", "x", "mu", "s", F.col("z").alias("y"))


def _particle_rows(spark, sf_dir) -> DataFrame:
    return samples(spark, sf_dir).select("i", "x", "points", F.col("z4").alias("y"))


# Linear-time tests.


@query(linear_sql(MMD_SQL))
def mmd_r1(spark, sf_dir):
    return _linear(samples(spark, sf_dir).select("i", "x", "y"), S.mmd())


@query(linear_sql(KSD_SQL))
def ksd_r1(spark, sf_dir):
    return _linear(samples(spark, sf_dir).select("i", "x"), S.ksd())


@query(linear_sql(KCSD_SQL))
def kcsd_r1(spark, sf_dir):
    return _linear(samples(spark, sf_dir).select("i", "x", "y"), S.kcsd())


@query(linear_sql(KCCSD_SQL))
def kccsd_gauss(spark, sf_dir):
    return _linear(_model_rows(spark, sf_dir), S.kccsd())


@query(linear_sql(SKCE_SQL))
def skce_gauss_r1(spark, sf_dir):
    return _linear(_model_rows(spark, sf_dir), S.skce())


@query(linear_sql(CGOF_SQL))
def cgof_gauss_r1(spark, sf_dir):
    return _linear(_model_rows(spark, sf_dir), S.cgof())


@query(linear_sql(f"exp(-{PMMD2_SQL} / 2) * {PRES_SQL}"))
def skce_particles(spark, sf_dir):
    return _linear(_particle_rows(spark, sf_dir), S.skce_particles())


@query(linear_sql(f"{k_sql('a.x', 'b.x')} * {PRES_SQL}"))
def cgof_particles(spark, sf_dir):
    return _linear(_particle_rows(spark, sf_dir), S.cgof_particles())


# Incomplete and complete statistics.


@query(mean_sql(MMD_SQL, BAND5))
def mmd_superdiag_r5(spark, sf_dir):
    return _mean(H.unbiased_estimate(samples(spark, sf_dir).select("i", "x", "y"), S.mmd(), H.TestConfig(diagonals=5)))


@query(mean_sql(MMD_SQL, ALL_PAIRS))
def mmd_complete(spark, sf_dir):
    return _mean(tiles.complete(samples(spark, sf_dir).select("i", "x", "y"), S.mmd()))


@query(mean_sql(KSD_SQL, ALL_PAIRS))
def ksd_complete(spark, sf_dir):
    return _mean(tiles.complete(samples(spark, sf_dir).select("i", "x"), S.ksd()))


@query(mean_sql(KCSD_SQL, ALL_PAIRS))
def kcsd_complete(spark, sf_dir):
    return _mean(tiles.complete(samples(spark, sf_dir).select("i", "x", "y"), S.kcsd()))


@query(mean_sql(SKCE_SQL, ALL_PAIRS))
def skce_gauss(spark, sf_dir):
    return _mean(tiles.complete(_model_rows(spark, sf_dir), S.skce()))


@query(mean_sql(CGOF_SQL, ALL_PAIRS))
def cgof_gauss(spark, sf_dir):
    return _mean(tiles.complete(_model_rows(spark, sf_dir), S.cgof()))


@query(mean_sql(KCCSD_SQL, ALL_PAIRS))
def kccsd_complete(spark, sf_dir):
    return _mean(tiles.complete(_model_rows(spark, sf_dir), S.kccsd()))


@query(f"WITH {E_SQL}, n AS (SELECT count(*) AS n FROM e) SELECT round((2 * (SELECT sum({k_sql('a.x', 'b.x')} + {k_sql('a.y', 'b.y')} - {k_sql('a.x', 'b.y')} - {k_sql('b.x', 'a.y')}) {ALL_PAIRS}) + (SELECT sum(2 - 2 * {k_sql('x', 'y')}) FROM e)) / (n * n), 6) AS mmd2 FROM n")
def mmd_vstat(spark, sf_dir):
    """The biased statistic: all ordered pairs, those of a row with itself too."""
    rows = samples(spark, sf_dir).select("i", "x", "y")
    own = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(2 - 2 * K.Gaussian(1.0).expr(F.col("x"), F.col("y"))).alias("own"))
    total = tiles.complete(rows, S.mmd()).select((F.col("val") * F.col("m")).alias("t"))
    return own.crossJoin(total).select(rounded((2 * F.col("t") + F.col("own")) / (F.col("n") * F.col("n"))).alias("mmd2"))


@query(f"WITH {E_SQL}, n AS (SELECT count(*) AS n FROM e) SELECT round((2 * (SELECT sum({KSD_SQL}) {ALL_PAIRS}) + (SELECT sum({dt('x', 'x')} + 32) FROM e)) / (n * n), 6) AS ksd2 FROM n")
def ksd_vstat(spark, sf_dir):
    rows = samples(spark, sf_dir).select("i", "x")
    own = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(sqnorm("x") + 32).alias("own"))
    total = tiles.complete(rows, S.ksd()).select((F.col("val") * F.col("m")).alias("t"))
    return own.crossJoin(total).select(rounded((2 * F.col("t") + F.col("own")) / (F.col("n") * F.col("n"))).alias("ksd2"))


def _pair_sql(on: str) -> str:
    return f"WITH {E_SQL} SELECT a.i AS a_i, b.i AS b_i, round({k_sql('a.x', 'b.x')}, 6) AS k FROM e a JOIN e b ON {on}"


def _pair_kernel(p: DataFrame) -> DataFrame:
    return p.select("a_i", "b_i", rounded(K.Gaussian(1.0).expr(F.col("a_x"), F.col("b_x"))).alias("k"))


@query(_pair_sql("b.i > a.i AND b.i <= a.i + 3"))
def pairs_superdiag(spark, sf_dir):
    return _pair_kernel(pairs.superdiagonals(samples(spark, sf_dir).select("i", "x"), 3))


@query(_pair_sql("a.i > b.i AND a.i <= b.i + 3"))
def pairs_subdiag(spark, sf_dir):
    return _pair_kernel(pairs.subdiagonals(samples(spark, sf_dir).select("i", "x"), 3))


@query(_pair_sql("a.i <> b.i AND abs(a.i - b.i) <= 3"))
def pairs_bothdiag(spark, sf_dir):
    return _pair_kernel(pairs.both_diagonals(samples(spark, sf_dir).select("i", "x"), 3))


@query(f"""WITH {E_SQL}, n AS (SELECT count(*) AS n FROM e),
d AS (SELECT ('0x' || substr(md5('7:' || k || ':i'), 1, 8))::BIGINT % n AS x, ('0x' || substr(md5('7:' || k || ':j'), 1, 8))::BIGINT % n AS y FROM range(5000) t(k), n),
p AS (SELECT DISTINCT least(x, y) AS ai, greatest(x, y) AS bi FROM d WHERE x <> y)
SELECT ai AS a_i, bi AS b_i, round({k_sql('a.x', 'b.x')}, 6) AS k FROM p JOIN e a ON a.i = ai JOIN e b ON b.i = bi""")
def pairs_capped(spark, sf_dir):
    """A bounded number of pairs drawn by hashes, as for a bandwidth."""
    rows = samples(spark, sf_dir).select("i", "x")
    return _pair_kernel(pairs.drawn(rows, rows.count(), 5000, 7))


# Null distributions.

SIGN = "CASE WHEN substr(md5('{seed}:' || b || ':' || {i}), 1, 1) < '8' THEN 1 ELSE -1 END"
BOOT_COMPLETE_SQL = f"""WITH {E_SQL}, h AS MATERIALIZED (SELECT a.i AS ai, b.i AS bi, {MMD_SQL} AS h {ALL_PAIRS}),
s AS MATERIALIZED (SELECT b, i, {SIGN.format(seed='0', i='i')} AS s FROM range(100) t(b), e),
v AS MATERIALIZED (SELECT s.b, sum(h * s.s * r.s) / count(*) AS v FROM h JOIN s ON s.i = ai JOIN s r ON r.i = bi AND r.b = s.b GROUP BY s.b)"""


@query(BOOT_COMPLETE_SQL + " SELECT b::INTEGER AS b, round(v, 6) + 0.0 AS v FROM v")
def wild_bootstrap_complete(spark, sf_dir):
    out = tiles.complete(samples(spark, sf_dir).select("i", "x", "y"), S.mmd(), 100, "0")
    return out.select(F.posexplode("h0").alias("b", "v")).select("b", rounded("v").alias("v"))


BOOT_BAND_SQL = f"""WITH {E_SQL}, h AS MATERIALIZED (SELECT a.i AS ai, b.i AS bi, {MMD_SQL} AS h {BAND5}),
v AS MATERIALIZED (SELECT b, avg(h * ({SIGN.format(seed='0', i='ai')}) * ({SIGN.format(seed='0', i='bi')})) AS v FROM h, range(100) t(b) GROUP BY b)"""


@query(BOOT_BAND_SQL + " SELECT b::INTEGER AS b, round(v, 6) + 0.0 AS v FROM v")
def wild_bootstrap_incomplete(spark, sf_dir):
    h = H.pair_values(null.with_signs(samples(spark, sf_dir).select("i", "x", "y"), 100, "0"), S.mmd(), 5)
    return null.wild_bootstrap(h).select("b", rounded("v").alias("v"))


@query(BOOT_COMPLETE_SQL + ", o AS (SELECT avg(h) AS val, count(*) AS m FROM h) SELECT (SELECT m FROM o) AS m, (SELECT round(val, 6) + 0.0 FROM o) AS val, round(quantile_cont(v, 0.95), 6) + 0.0 AS quantile, round(avg(CASE WHEN v > (SELECT val FROM o) THEN 1.0 ELSE 0.0 END), 6) AS p_value, (SELECT val FROM o) > quantile_cont(v, 0.95) AS reject FROM v")
def mmd_test_full(spark, sf_dir):
    out = H.mmd_test(samples(spark, sf_dir).select("i", "x", "y"))
    return out.select("m", rounded("val").alias("val"), rounded("quantile").alias("quantile"), rounded("p_value").alias("p_value"), "reject")


@query(BOOT_BAND_SQL + ", o AS (SELECT avg(h) AS val, count(*) AS m FROM h) SELECT (SELECT m FROM o) AS m, round(quantile_cont(v, 0.95), 6) + 0.0 AS quantile, round(avg(CASE WHEN v > (SELECT val FROM o) THEN 1.0 ELSE 0.0 END), 6) AS p_value, (SELECT val FROM o) > quantile_cont(v, 0.95) AS reject FROM v")
def null_quantile(spark, sf_dir):
    out = H.run_test(samples(spark, sf_dir).select("i", "x", "y"), S.mmd(), H.TestConfig(diagonals=5))
    return out.select("m", rounded("quantile").alias("quantile"), rounded("p_value").alias("p_value"), "reject")


# Bandwidths.


@query(f"WITH {E_SQL} SELECT round(quantile_cont(sqrt({sq('a.x', 'b.x')}), 0.5), 6) AS sigma {BAND5}")
def median_heuristic(spark, sf_dir):
    return bandwidth.gaussian_bandwidth(pairs.superdiagonals(samples(spark, sf_dir).select("i", "x"), 5)).select(rounded("sigma").alias("sigma"))


@query(f"WITH {E_SQL} SELECT round(quantile_cont(sqrt({sq('a.x', 'b.x')}), 0.9), 6) AS sigma {BAND5}")
def quantile_heuristic(spark, sf_dir):
    return bandwidth.gaussian_bandwidth(pairs.superdiagonals(samples(spark, sf_dir).select("i", "x"), 5), q=0.9).select(rounded("sigma").alias("sigma"))


@query(f"WITH {E_SQL} SELECT round(quantile_cont(d, 0.5), 6) AS sigma FROM (SELECT unnest([sqrt({sq('a.x', 'b.x')}), sqrt({sq('a.y', 'b.y')}), sqrt({sq('a.x', 'b.y')}), sqrt({sq('b.x', 'a.y')})]) AS d {BAND5})")
def mmd_median_union(spark, sf_dir):
    d = bandwidth.union_distances(pairs.superdiagonals(samples(spark, sf_dir).select("i", "x", "y"), 5))
    return bandwidth.exact_quantile(d).select(rounded("sigma").alias("sigma"))


@query(f"WITH {E_SQL}, d AS (SELECT a.i, unnest(a.points) AS p, b.points AS r {ADJACENT}), d2 AS (SELECT i, p, unnest(r) AS r FROM d) SELECT round(quantile_cont(m, 0.5), 6) AS sigma FROM (SELECT i, quantile_cont(sqrt({sq('p', 'r')}), 0.5) AS m FROM d2 GROUP BY i)")
def median_of_medians_particles(spark, sf_dir):
    return bandwidth.median_of_medians(pairs.adjacent(samples(spark, sf_dir).select("i", "points"))).select(rounded("sigma").alias("sigma"))


# Model kernels and divergences.


@query(f"WITH {E_SQL} SELECT i, round({one_sql('mu', 's', 'z')}, 6) AS e FROM e")
def gauss_expectation(spark, sf_dir):
    return samples(spark, sf_dir).select("i", rounded(M.expect_one(F.col("mu"), F.col("s"), F.col("z"), 1.0)).alias("e"))


def _ab(spark, sf_dir, *names) -> DataFrame:
    return pairs.adjacent(samples(spark, sf_dir).select("i", *names))


def _models() -> list:
    return [F.col(c) for c in ("a_mu", "a_s", "b_mu", "b_s")]


@query(f"WITH {E_SQL} SELECT a.i AS a_i, round({both_sql('a.mu', 'a.s', 'b.mu', 'b.s')}, 6) AS e {ADJACENT}")
def gauss_biv_expectation(spark, sf_dir):
    return _ab(spark, sf_dir, "mu", "s").select("a_i", rounded(M.expect_both(*_models(), 1.0)).alias("e"))


@query(f"WITH {E_SQL} SELECT a.i AS a_i, round({MMD2_SQL}, 6) + 0.0 AS mmd2, round(exp(-{MMD2_SQL} / 2), 6) AS k {ADJACENT}")
def mmd_gauss_models(spark, sf_dir):
    return _ab(spark, sf_dir, "mu", "s").select("a_i", rounded(M.mmd2(*_models(), 1.0)).alias("mmd2"), rounded(S.model_kernel(1.0, 1.0)).alias("k"))


@query(f"WITH {E_SQL} SELECT a.i AS a_i, round(exp(-({sq('a.mu', 'b.mu')} + 8 * (a.s - b.s) * (a.s - b.s)) / 2), 6) AS k {ADJACENT}")
def wasserstein_kernel(spark, sf_dir):
    return _ab(spark, sf_dir, "mu", "s").select("a_i", rounded(F.exp(-M.wasserstein2(*_models()) / 2)).alias("k"))


FISHER_SQL = "(8 + 0) * power(1 / (a.s * a.s) - 1 / (b.s * b.s), 2) + list_sum(list_transform(list_zip(a.mu, b.mu), lambda q: power(q[1] / (a.s * a.s) - q[2] / (b.s * b.s), 2)))"


@query(f"WITH {E_SQL} SELECT a.i AS a_i, round({FISHER_SQL}, 6) AS f, round(exp(-({FISHER_SQL}) / 2), 6) AS k {ADJACENT}")
def fisher_gauss(spark, sf_dir):
    zero = F.transform(F.col("a_mu"), lambda _: F.lit(0.0))
    f = M.fisher(*_models(), zero, F.lit(1.0))
    return _ab(spark, sf_dir, "mu", "s").select("a_i", rounded(f).alias("f"), rounded(F.exp(-f / 2)).alias("k"))


KFISHER_SQL = "power(3, -3.5) * sqrt(1 / 3.0) * list_sum(list_transform(list_zip(a.mu, b.mu), lambda q: (1 / 3.0 + q[1] * q[1]) / power(a.s, 4) - 2 * (1 / 3.0 + q[1] * q[2]) / (a.s * a.s * b.s * b.s) + (1 / 3.0 + q[2] * q[2]) / power(b.s, 4)))"


@query(f"WITH {E_SQL} SELECT a.i AS a_i, round({KFISHER_SQL}, 6) + 0.0 AS f {ADJACENT}")
def kfisher_gauss(spark, sf_dir):
    zero = F.transform(F.col("a_mu"), lambda _: F.lit(0.0))
    return _ab(spark, sf_dir, "mu", "s").select("a_i", rounded(M.kernel_fisher(*_models(), zero, F.lit(1.0), 1.0)).alias("f"))


@query(f"WITH {E_SQL} SELECT a.i AS a_i, round({PMMD2_SQL}, 6) + 0.0 AS mmd2, round(exp(-{PMMD2_SQL} / 2), 6) AS k {ADJACENT}")
def exp_mmd_discrete(spark, sf_dir):
    d = S.particle_mmd2(K.Gaussian(1.0))
    return _ab(spark, sf_dir, "points").select("a_i", rounded(d).alias("mmd2"), rounded(F.exp(-d / 2)).alias("k"))


SCORE_SQL = "list_transform(list_zip({m}, p), lambda q: (q[1] - q[2]) / ({s} * {s}))"


def _base(spark, sf_dir) -> DataFrame:
    """Pairs of Gaussian models on dimensions 1-4; the particles of the first row are the base samples."""
    return pairs.adjacent(samples(spark, sf_dir).select("i", F.slice("mu", 1, 4).alias("m"), "s", "points"))


def _scores() -> list:
    return [M.gaussian_score(F.col(f"{t}_m"), F.col(f"{t}_s")) for t in "ab"]


BASE_SQL = f"""WITH {E_SQL}, b AS (SELECT a.i AS i, unnest(range(8)) AS n, unnest(a.points) AS p, a.mu[1:4] AS am, a.s AS s1, b.mu[1:4] AS bm, b.s AS s2 {ADJACENT}),
d AS MATERIALIZED (SELECT i, n, p, list_transform(list_zip(am, bm, p), lambda q: (q[1] - q[3]) / (s1 * s1) - (q[2] - q[3]) / (s2 * s2)) AS d FROM b)"""


@query(BASE_SQL + f" SELECT i AS a_i, round(avg({dt('d', 'd')}), 6) AS f FROM d GROUP BY i")
def fisher_discrete(spark, sf_dir):
    """The Fisher divergence with a base measure of samples."""
    return _base(spark, sf_dir).select("a_i", rounded(M.fisher_over(F.col("a_points"), *_scores())).alias("f"))


@query(BASE_SQL + f" SELECT c.i AS a_i, round(sum({k_sql('c.p', 'g.p')} * {dt('c.d', 'g.d')}) / 64, 6) + 0.0 AS f FROM d c JOIN d g ON c.i = g.i GROUP BY c.i")
def kfisher_discrete(spark, sf_dir):
    """Its kernelised form, over all pairs of the samples."""
    return _base(spark, sf_dir).select("a_i", rounded(M.kernel_fisher_over(F.col("a_points"), *_scores(), K.Gaussian(1.0))).alias("f"))


@query(f"""WITH {E_SQL}, k AS (SELECT a.i AS a_i, b.i AS b_i, round({k_sql('a.x', 'b.x')} * {k_sql('a.y', 'b.y')}, 6) AS k {BAND5}) SELECT * FROM k""")
def tensor_product_gram(spark, sf_dir):
    k = K.TensorProduct((K.Gaussian(1.0), K.Gaussian(1.0)))
    p = pairs.superdiagonals(samples(spark, sf_dir).select("i", "x", "y"), 5)
    return p.select("a_i", "b_i", rounded(k.expr((F.col("a_x"), F.col("a_y")), (F.col("b_x"), F.col("b_y")))).alias("k"))


@query(f"WITH {E_SQL} SELECT a.i AS a_i, b.i AS b_i, round((h / 2) / (1 - h / 2), 6) AS k FROM (SELECT a, b, {k_sql('a.x', 'b.x')} AS h {ADJACENT})")
def modified_gaussian_gram(spark, sf_dir):
    return _ab(spark, sf_dir, "x").select("a_i", "b_i", rounded(K.ModifiedGaussian(1.0).expr(F.col("a_x"), F.col("b_x"))).alias("k"))
