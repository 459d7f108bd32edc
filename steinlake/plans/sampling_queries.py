"""Registered queries on chains of models, Stein kernels from scores, and sampling along a decoding order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import jets as J
from ..functions import kernels as K
from ..functions.arrays import rounded, scaled
from ..functions.randomness import uniform
from ..operators import bandwidth, chains, decoding
from ..operators import statistics as S
from ..operators.pairs import superdiagonals
from . import hypothesis as H
from .queries import ADJACENT, ALL_PAIRS, BAND5, E_SQL, PMMD2_SQL, _linear, _mean, _model_rows, _particle_rows, dt, k_sql, linear_sql, mean_sql, query, read, samples, sq

# Chains in place of closed forms: MALA draws are no SQL; tests hold them against plain loops and against the closed forms.


@query()
def skce_chains(spark, sf_dir):
    """The calibration test with ten particles per row from adapted MALA chains, as for a model known up to a constant."""
    out = H.skce_test(_model_rows(spark, sf_dir), H.TestConfig(diagonals=1), density=chains.gaussian_density(), chains=chains.ChainConfig(seed="31"))
    return out.select("m", "val", "quantile", "reject")


@query()
def cgof_chains(spark, sf_dir):
    """Conditional goodness of fit of mixture models, sampled by chains."""
    rows = samples(spark, sf_dir).select("i", "x", F.slice("points", 1, 3).alias("centres"), "s", F.col("z4").alias("y"))
    out = H.cgof_test(rows, H.TestConfig(diagonals=1), density=chains.mixture_density(), chains=chains.ChainConfig(particles=12, chains=4, warm_up=20, thin=2, seed="32"))
    return out.select("m", "val", "quantile", "reject")


@query()
def chain_states(spark, sf_dir):
    """The chains themselves after their warm-up: one row per row and chain."""
    table = chains.ChainTable(_model_rows(spark, sf_dir), chains.gaussian_density(), chains.ChainConfig(particles=4, seed="33"))
    out = table.chains()
    return out.select("i", "chain", "step", F.size("position").alias("dimension"), "step_size", "rate")


# Stein tests with any smooth kernel and any score. The score is a column, made before pairs are.


def _stein_imq_sql(x: str, y: str, sx: str, sy: str, d: int) -> str:
    u = f"list_transform(list_zip({x}, {y}), lambda q: q[1] - q[2])"
    w = f"(1 + {sq(x, y)})"
    return f"({dt(sx, sy)} / sqrt{w} + ({dt(sx, u)} - {dt(sy, u)} + {d}) * power{w[:-1]}, -1.5) - 3 * {sq(x, y)} * power{w[:-1]}, -2.5))"


def _mixture_sql(centres: list[str], y: str, s: str = "1") -> str:
    """The score of an equal mixture, in SQL, dimension by dimension."""
    logs = "[" + ", ".join(f"-{sq(c, y)} / (2 * ({s}) * ({s}))" for c in centres) + "]"
    shares = f"list_transform({logs}, lambda l: exp(l - list_max({logs})))"
    terms = " + ".join(f"{c}[k] * {shares}[{n}]" for n, c in enumerate(centres, 1))
    return f"list_transform(range(1, len({y}) + 1), lambda k: (({terms}) / list_sum({shares}) - {y}[k]) / (({s}) * ({s})))"


def _scored_sql(score: str, over: str) -> str:
    return over.replace("e a JOIN e b", f"(SELECT *, {score} AS score FROM e) a JOIN (SELECT *, {score} AS score FROM e) b")


ONES, MINUS = "list_transform(range(1, 33), lambda j: 0.25::DOUBLE)", "list_transform(range(1, 33), lambda j: -0.25::DOUBLE)"
KSD_SCORE = _mixture_sql([f"({ONES})", f"({MINUS})"], "x")


def _ksd_rows(spark, sf_dir):
    rows = samples(spark, sf_dir).select("i", "x")
    two = F.array(*(F.array_repeat(F.lit(v), 32) for v in (0.25, -0.25)))
    return rows.withColumn("score", J.mixture_score(F.col("x"), two))


@query(linear_sql(_stein_imq_sql("a.x", "b.x", "a.score", "b.score", 32), _scored_sql(KSD_SCORE, ADJACENT)))
def ksd_imq_mixture_r1(spark, sf_dir):
    """Stein discrepancy from a mixture of two Gaussians, with the inverse multiquadric kernel."""
    return _linear(_ksd_rows(spark, sf_dir), S.ksd_scored(J.inverse_multiquadric()))


@query(mean_sql(_stein_imq_sql("a.x", "b.x", "a.score", "b.score", 32), _scored_sql(KSD_SCORE, ALL_PAIRS)))
def ksd_imq_mixture(spark, sf_dir):
    """Its complete form, in tiles."""
    return _mean(H.unbiased_estimate(_ksd_rows(spark, sf_dir), S.ksd_scored(J.inverse_multiquadric())))


KCSD_SCORE = _mixture_sql(["x", "list_transform(x, lambda j: -j)"], "y")


@query(mean_sql(f"{k_sql('a.x', 'b.x')} * {_stein_imq_sql('a.y', 'b.y', 'a.score', 'b.score', 32)}", _scored_sql(KCSD_SCORE, BAND5)))
def kcsd_imq_mixture(spark, sf_dir):
    """The conditional form: y from an equal mixture of N(x, I) and N(-x, I)."""
    rows = samples(spark, sf_dir).select("i", "x", "y")
    rows = rows.withColumn("score", J.mixture_score(F.col("y"), F.array("x", scaled("x", -1.0))))
    return _mean(H.unbiased_estimate(rows, S.kcsd_scored(K.Gaussian(1.0), J.inverse_multiquadric()), H.TestConfig(diagonals=5)))


KCCSD_SCORE = _mixture_sql([f"points[{k}]" for k in range(1, 9)], "z4")
KCCSD_MIX_SQL = f"exp(-{PMMD2_SQL} / 2) * {_stein_imq_sql('a.z4', 'b.z4', 'a.score', 'b.score', 4)}"


def _kccsd_rows(spark, sf_dir):
    rows = _particle_rows(spark, sf_dir)
    return rows.withColumn("score", J.mixture_score(F.col("y"), F.col("points")))


@query(linear_sql(KCCSD_MIX_SQL, _scored_sql(KCCSD_SCORE, ADJACENT)))
def kccsd_imq_mixture_r1(spark, sf_dir):
    """The form with a kernel on models: mixtures around the particles, compared by the particles' discrepancy."""
    return _linear(_kccsd_rows(spark, sf_dir), S.kccsd_scored(S.exp_mmd_particles(), J.inverse_multiquadric()))


@query(mean_sql(KCCSD_MIX_SQL, _scored_sql(KCCSD_SCORE, ALL_PAIRS)))
def kccsd_imq_mixture(spark, sf_dir):
    return _mean(H.kccsd_estimate(_kccsd_rows(spark, sf_dir), S.exp_mmd_particles(), J.inverse_multiquadric()))


_T, _R, _G = dt("a.mu", "b.mu"), sq("a.mu", "b.mu"), k_sql("a.mu", "b.mu", 2.0)
SUM_STEIN_SQL = f"(({_G} + power({_T} + 1, 2)) * {_T} + {_G} * (8 / 4.0 - {_R} / 16 - {_R} / 4) + 2 * ({_T} + 1) * (8 - {dt('a.mu', 'a.mu')} - {dt('b.mu', 'b.mu')}) + 2 * {_T})"


@query(linear_sql(SUM_STEIN_SQL))
def ksd_sum_kernel_r1(spark, sf_dir):
    """A kernel put together from others: a Gaussian plus a polynomial, whose derivatives follow from its parts."""
    rows = samples(spark, sf_dir).select("i", F.col("mu").alias("x")).withColumn("score", scaled("x", -1.0))
    return _linear(rows, S.ksd_scored(J.combined(J.gaussian(2.0), J.polynomial())))


# Quantiles: several in one evaluation of the distances, and distances that are not finite.


@query(f"""WITH {E_SQL}, d AS (SELECT CASE WHEN a.label = b.label THEN 'inf'::DOUBLE ELSE sqrt({sq('a.x', 'b.x')}) END AS d {BAND5})
SELECT round(quantile_cont(d, 0.25), 6) AS q25, round(quantile_cont(d, 0.5), 6) AS q50, round(quantile_cont(d, 0.85), 6) AS q85, quantile_cont(d, 1.0) AS q100 FROM d""")
def distance_quantiles(spark, sf_dir):
    """Four quantiles of distances over a band, where rows of one label are infinitely far."""
    near = superdiagonals(samples(spark, sf_dir).select("i", "x", "label"), 5)
    d = F.when(F.col("a_label") == F.col("b_label"), float("inf")).otherwise(F.sqrt(bandwidth.sqdist("a_x", "b_x")))
    found = bandwidth.exact_quantiles(near.select(d.alias("d")), [0.25, 0.5, 0.85, 1.0])
    return spark.createDataFrame([tuple(found)], "q25 double, q50 double, q85 double, q100 double").select(*(rounded(c).alias(c) for c in ("q25", "q50", "q85")), "q100")


# Sampling of letters: orders are structures, return flags chains, lines residues; four letters.

PLACE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
_U = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0"


def _sampling_rows(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    pos = F.row_number().over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy(*PLACE))
    d, t, q, k = (F.col(c) for c in ("l_discount", "l_tax", "l_quantity", "l_linenumber"))
    none, profile = F.lit(0.0), F.array(*map(F.lit, (0.1, 0.2, 0.3, 0.4)))
    rows = line.withColumn("pos", pos).select(
        F.col("l_orderkey").alias("name"), F.col("l_returnflag").alias("chain"), "pos", F.array(q / 25, d * 10, t * 10, (k % 3) / 2).alias("logits"), F.array(none, none, d * 5, none).alias("bias"),
        F.array(F.lit(False), k % 4 == 1, F.lit(False), F.lit(False)).alias("omit"), profile.alias("profile"), (d * 5).alias("profile_weight"), F.array(F.lit(True), F.lit(True), t > 0.04, F.lit(True)).alias("allowed"),
        (k % 5 != 4).alias("designed"), (q > 3).alias("mask"), (k % 4).alias("native"), uniform("21", F.col("l_orderkey"), F.col("l_returnflag"), F.col("pos")).alias("noise"))
    ties = rows.filter("pos <= 2").select("name", "chain", "pos", F.col("pos").alias("tie"), F.when(F.col("chain") == "A", 1.0).otherwise(-0.5).alias("beta"), F.ascii("chain").alias("member"))
    return rows, ties


#: Logits that a letter adds to those of the next step.
NEXT = [[((3 * last + 2 * k) % 5) / 10 for k in range(4)] for last in range(4)]


def _after(state, member):
    return F.when(state["last"].isNull(), F.array(*(F.lit(0.0) for _ in range(4)))).otherwise(F.get(F.array(*(F.array(*map(F.lit, w)) for w in NEXT)), state["last"]))


_NEXT_SQL = "[" + ", ".join(str([float(x) for x in w]) for w in NEXT) + "]"
SAMPLING_SQL = f"""WITH RECURSIVE l AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY {', '.join(PLACE)}) AS INTEGER) AS pos FROM lineitem),
r AS (SELECT l_orderkey AS name, l_returnflag AS chain, pos, [l_quantity / 25, l_discount * 10, l_tax * 10, (l_linenumber % 3) / 2.0::DOUBLE] AS logits, l_discount * 5 AS five, l_linenumber % 4 = 1 AS no1, l_tax > 0.04 AS ok2,
  l_linenumber % 5 <> 4 AND l_quantity > 3 AS designed, l_quantity > 3 AS mask, CAST(l_linenumber % 4 AS INTEGER) AS native,
  ((l_linenumber % 5 <> 4 AND l_quantity > 3)::INT::DOUBLE + 1e-4) * ({_U.format("'21:' || l_orderkey || ':' || l_returnflag || ':' || pos")}) AS place,
  CASE WHEN pos <= 2 THEN 'tie' || pos ELSE l_returnflag || ':' || pos END AS grp, CASE WHEN pos <= 2 AND l_returnflag <> 'A' THEN -0.5 ELSE 1.0 END::DOUBLE AS beta FROM l),
g AS (SELECT name, grp, count(*) AS n, min({{'p': place, 'c': chain, 'q': pos}}) AS f, sum(beta) AS betas, sum(beta * logits[1] ORDER BY chain) AS z1, sum(beta * logits[2] ORDER BY chain) AS z2, sum(beta * logits[3] ORDER BY chain) AS z3, sum(beta * logits[4] ORDER BY chain) AS z4,
  max_by({{'five': five, 'no1': no1, 'ok2': ok2, 'designed': designed, 'native': native}}, chain) AS t, min_by(native, chain) FILTER (WHERE NOT mask) AS missing FROM r GROUP BY 1, 2),
s AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY f) - 1 AS INTEGER) AS step, {_U.format("'22:draw:' || name || ':' || f.c || ':' || f.q")} AS u FROM g),
w AS (SELECT {_NEXT_SQL} AS w),
f AS (SELECT DISTINCT name, -1 AS step, NULL::INTEGER AS letter, NULL::VARCHAR AS grp, NULL::DOUBLE AS p FROM s
 UNION ALL SELECT name, step, CASE WHEN missing IS NOT NULL THEN missing WHEN t.designed THEN CAST((CASE WHEN q4[1] > u * total THEN 0 WHEN q4[1] + q4[2] > u * total THEN 1 WHEN q4[1] + q4[2] + q4[3] > u * total THEN 2 ELSE 3 END) AS INTEGER) ELSE t.native END AS letter, grp,
   CASE WHEN missing IS NULL THEN q4[1 + CASE WHEN t.designed THEN CASE WHEN q4[1] > u * total THEN 0 WHEN q4[1] + q4[2] > u * total THEN 1 WHEN q4[1] + q4[2] + q4[3] > u * total THEN 2 ELSE 3 END ELSE t.native END] END AS p FROM
 (SELECT *, list_sum(q4) AS total FROM (SELECT *, list_transform(q3, lambda x, k: CASE WHEN t.no1 AND k = 2 THEN 0.0 ELSE x END / (list_sum(q3) - CASE WHEN t.no1 THEN q3[2] ELSE 0.0 END)) AS q4 FROM
 (SELECT *, list_transform(q2, lambda x: x / list_sum(q2)) AS q3 FROM (SELECT *, list_transform(q1, lambda x, k: x * CASE WHEN k = 3 AND NOT t.ok2 THEN 0.001 ELSE 1.001 END) AS q2 FROM
 (SELECT *, list_transform(q0, lambda x, k: (1 - 0.3 * t.five) * x / list_sum(q0) + 0.3 * t.five * k / 10.0) AS q1 FROM (SELECT *, list_transform(z, lambda x: exp(x - list_max(z))) AS q0 FROM
 (SELECT s.*, list_transform([z1, z2, z3, z4], lambda x, k: (x + betas * CASE WHEN f.letter IS NULL THEN 0 ELSE w.w[f.letter + 1][k] END) / n / 0.5 + CASE WHEN k = 1 THEN 0.1 ELSE 0 END / 0.5 + CASE WHEN k = 3 THEN t.five ELSE 0 END / 0.5) AS z
  FROM f JOIN s ON s.name = f.name AND s.step = f.step + 1, w)))))))),
o AS (SELECT * FROM f WHERE step >= 0)
SELECT r.name, r.chain, r.pos, o.step, o.letter, round(o.p, 6) AS p FROM r JOIN o USING (name, grp)"""


@query(SAMPLING_SQL)
def tied_sampling(spark, sf_dir):
    """Letters sampled in decoding order: the first two places of all chains of a structure are tied, each letter shifts the next step's logits."""
    rows, ties = _sampling_rows(spark, sf_dir)
    out = decoding.sampled(rows, ties, seed="22", temperature=0.5, bias=[0.1, 0.0, 0.0, 0.0], profile_share=0.3, context=_after)
    return out.withColumn("p", rounded("p"))
