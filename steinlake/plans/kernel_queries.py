"""Registered queries on kernels of sequences and of models inside the tests, their tuning, and relations of chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import closed_forms as C
from ..functions import kernels as K
from ..functions import models as M
from ..functions.arrays import rounded, scaled
from ..operators import alignment, bandwidth, pairs, particles, structure
from ..operators import statistics as S
from . import hypothesis as H
from .queries import ADJACENT, ALL_PAIRS, E_SQL, KFISHER_SQL, MMD2_SQL, PMMD2_SQL, PRES_SQL, RESIDUAL_SQL, Z95, _ab, _linear, _mean, _model_rows, _models, _particle_rows, dt, k_sql, linear_sql, mean_sql, query, read, samples
from .table_queries import NODES_SQL, _nodes

# Sequences: the letters are the integer parts of twice a vector's values.


def _letters(c: str):
    return F.transform(c, lambda v: F.floor(2 * v))


def _lettered(over: str) -> str:
    e = "(SELECT *, list_transform(x, lambda v: floor(2 * v)) AS tx, list_transform(y, lambda v: floor(2 * v)) AS ty FROM e)"
    return over.replace("e a JOIN e b", f"{e} a JOIN {e} b")


def _imq_sql(x: str, y: str, width: int = 1) -> str:
    differ = f"list_transform(list_zip({x}, {y}), lambda q: CASE WHEN q[1] = q[2] THEN 0 ELSE 1 END)"
    d = f"list_sum({differ})" if width == 1 else f"list_sum(list_transform(range(1, 33), lambda k: list_max(({differ})[k:k + {width - 1}])))"
    return f"power(2.0 / (1 + {d}), 0.5)"


@query(linear_sql(f"{_imq_sql('a.tx', 'b.tx')} * {RESIDUAL_SQL}", _lettered(ADJACENT)))
def cgof_hamming_r1(spark, sf_dir):
    """Conditional goodness of fit where conditions are sequences."""
    return _linear(_model_rows(spark, sf_dir).withColumn("x", _letters("x")), S.cgof(K.HammingIMQ()))


@query(mean_sql(f"{_imq_sql('a.tx', 'b.tx')} * {RESIDUAL_SQL}", _lettered(ALL_PAIRS)))
def cgof_hamming(spark, sf_dir):
    rows = _model_rows(spark, sf_dir).withColumn("x", _letters("x"))
    return _mean(H.unbiased_estimate(rows, S.cgof(K.HammingIMQ())))


@query(linear_sql(" ".join(f"{sign} {_imq_sql(x, y, 3)}" for sign, x, y in (("", "a.tx", "b.tx"), ("+", "a.ty", "b.ty"), ("-", "a.tx", "b.ty"), ("-", "b.tx", "a.ty"))), _lettered(ADJACENT)))
def mmd_kmer_r1(spark, sf_dir):
    """The two-sample test of sequences, by their k-mers of three letters."""
    rows = samples(spark, sf_dir).select("i", _letters("x").alias("x"), _letters("y").alias("y"))
    return _linear(rows, S.mmd(K.HammingIMQ(lag=3, mode="kmer")))


# Kernels on models.

BASE = particles.base_samples(8, 8, "21")
BASE_LIST = f"CAST('{BASE}' AS DOUBLE[][])"
DIFF = "list_transform(list_zip(a.mu, b.mu, x), lambda q: (q[1] - q[3]) / (a.s * a.s) - (q[2] - q[3]) / (b.s * b.s))"
SHARED_SQL = f"list_avg(list_transform({BASE_LIST}, lambda x: list_sum(list_transform({DIFF}, lambda d: d * d))))"


@query(f"""WITH {E_SQL}, d AS MATERIALIZED (SELECT a.i AS a_i, {SHARED_SQL} AS f, {BASE_LIST} AS base, list_transform({BASE_LIST}, lambda x: {DIFF}) AS d {ADJACENT}),
k AS (SELECT a_i, f, list_avg(list_transform(range(1, 9), lambda u: list_avg(list_transform(range(1, 9), lambda v: {k_sql('base[u]', 'base[v]', 2.0)} * {dt('d[u]', 'd[v]')})))) AS kf FROM d)
SELECT a_i, round(exp(-f / 200), 6) AS k_fisher, round(exp(-kf / 200), 6) AS k_kernel_fisher FROM k""")
def exp_fisher_shared_base(spark, sf_dir):
    """Both exponential Fisher kernels, with base samples that all pairs share."""
    plain, kernelised = S.exp_fisher(BASE, 10.0), S.exp_fisher(BASE, 10.0, K.Gaussian(2.0))
    return _ab(spark, sf_dir, "mu", "s").select("a_i", rounded(plain.expr()).alias("k_fisher"), rounded(kernelised.expr()).alias("k_kernel_fisher"))


@query(f"WITH {E_SQL} SELECT a.i AS a_i, round(exp(-({KFISHER_SQL}) / 2), 6) AS k {ADJACENT}")
def exp_kfisher_gauss(spark, sf_dir):
    zero = F.transform("a_mu", lambda _: F.lit(0.0))
    kernel = S.ModelKernel(("mu", "s"), lambda: M.kernel_fisher(*_models(), zero, F.lit(1.0), 1.0))
    return _ab(spark, sf_dir, "mu", "s").select("a_i", rounded(kernel.expr()).alias("k"))


@query(f"WITH {E_SQL} SELECT a.i AS a_i, round(sqrt(greatest({MMD2_SQL}, 0)), 6) AS mmd {ADJACENT}")
def mmd_gauss_distance(spark, sf_dir):
    return _ab(spark, sf_dir, "mu", "s").select("a_i", rounded(M.mmd(*_models(), 1.0)).alias("mmd"))


@query(linear_sql(f"exp(-{SHARED_SQL} / 200) * {RESIDUAL_SQL}"))
def skce_exp_fisher(spark, sf_dir):
    """The calibration test with a Fisher kernel on models."""
    return _linear(_model_rows(spark, sf_dir), S.skce(kernel=S.exp_fisher(BASE, 10.0)))


WASSERSTEIN_SQL = "list_sum(list_transform(list_zip(a.mu, b.mu), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) + 8 * (a.s - b.s) * (a.s - b.s)"


@query(mean_sql(f"exp(-({WASSERSTEIN_SQL}) / 8) * {RESIDUAL_SQL}", ALL_PAIRS))
def skce_wasserstein(spark, sf_dir):
    """The complete calibration statistic with a Wasserstein kernel on models."""
    return _mean(H.unbiased_estimate(_model_rows(spark, sf_dir), S.skce(kernel=S.exp_wasserstein(2.0))))


def _ground(sql: str) -> str:
    """The SQL of a particle expression, with the tuned bandwidth sg of the kernel on points."""
    return sql.replace("/ 2.0)", "/ (2 * sg * sg))")


POINTS_SQL = "sqrt(list_sum(list_transform(list_zip(p, r), lambda q: (q[1] - q[2]) * (q[1] - q[2]))))"
WITH_GROUND = "FROM e a JOIN e b ON b.i = a.i + 1 CROSS JOIN g WHERE a.i % 2 = 0"


@query(f"""WITH {E_SQL}, d AS (SELECT a.i, unnest(a.points) AS p, b.points AS r {ADJACENT}), d2 AS (SELECT i, p, unnest(r) AS r FROM d),
g AS MATERIALIZED (SELECT quantile_cont(m, 0.5) AS sg FROM (SELECT i, quantile_cont({POINTS_SQL}, 0.5) AS m FROM d2 GROUP BY i)),
f AS MATERIALIZED (SELECT {_ground(PMMD2_SQL)} AS d2, {_ground(PRES_SQL)} AS r {WITH_GROUND}), t AS MATERIALIZED (SELECT quantile_cont(sqrt(greatest(d2, 0)), 0.5) AS st FROM f),
h AS (SELECT exp(-d2 / (2 * st * st)) * r AS h FROM f CROSS JOIN t)
SELECT round((SELECT sg FROM g), 6) AS ground, round((SELECT st FROM t), 6) AS sigma, count(*) AS m, round(avg(h), 6) + 0.0 AS val, round({Z95} * sqrt(avg(h * h)) / sqrt(count(*)), 6) AS quantile, avg(h) > {Z95} * sqrt(avg(h * h)) / sqrt(count(*)) AS reject FROM h""")
def skce_exp_mmd_tuned(spark, sf_dir):
    """The calibration test on particles, both bandwidths by medians: that of points, then that of models under it."""
    rows = _particle_rows(spark, sf_dir)
    ground, kernel = bandwidth.tuned_on_particles(pairs.adjacent(rows.select("i", "points")))
    out = _linear(rows, S.skce_particles(ground, kernel=kernel))
    return out.select(F.round(F.lit(ground.sigma), 6).alias("ground"), F.round(F.lit(kernel.sigma), 6).alias("sigma"), *out.columns)


@query(mean_sql(f"exp(-{PMMD2_SQL} / 2) * {PRES_SQL}", ALL_PAIRS))
def skce_particles_complete(spark, sf_dir):
    """The complete calibration statistic of particle models, in tiles."""
    return _mean(H.unbiased_estimate(_particle_rows(spark, sf_dir), S.skce_particles()))


@query(mean_sql(f"{k_sql('a.x', 'b.x')} * {PRES_SQL}", ALL_PAIRS))
def cgof_particles_complete(spark, sf_dir):
    return _mean(H.unbiased_estimate(_particle_rows(spark, sf_dir), S.cgof_particles()))


@query()
def cgof_alignment_r1(spark, sf_dir):
    """Conditional goodness of fit where conditions are sequences of points under the alignment kernel (dynamic programming, not SQL)."""
    rows = samples(spark, sf_dir).select("i", F.col("points").alias("x"), "mu", "s", F.col("z").alias("y"))
    return _linear(rows, S.cgof(alignment.SoftAlignment(log_scale=8.0)))


@query()
def skce_gauss_tuned(spark, sf_dir):
    """The calibration test of Gaussian models, both bandwidths by medians (the first is the root of a series, not SQL)."""
    rows = _model_rows(spark, sf_dir)
    ground, kernel = bandwidth.tuned_on_gaussians(pairs.adjacent(rows.select("i", "mu", "s")))
    out = _linear(rows, S.skce(ground.sigma, kernel=kernel))
    return out.select(F.round(F.lit(ground.sigma), 6).alias("ground"), F.round(F.lit(kernel.sigma), 6).alias("sigma"), *out.columns)


@query()
def skce_sampled_particles(spark, sf_dir):
    """The calibration test with three seeded particles of each row's model in place of the closed forms."""
    return H.skce_test(_model_rows(spark, sf_dir), H.TestConfig(diagonals=1, seed="12"), m=3).select("m", "val", "quantile", "reject")


def _tail_sql(p: str, q: str) -> str:
    return f"(((1 - 2 * {p}) * (1 - 2 * {q}) + w * (2 * {p} * (1 - 2 * {p}) / (1 - 2 * {p} * w) * (1 - 2 * {q}) + 2 * {q} * (1 - 2 * {q}) / (1 - 2 * {q} * w) * (1 - 2 * {p}))) / (1 - 2 * {p} * {q} * (1 + w)))"


@query(f"""WITH g AS (SELECT 0.25 + s_nationkey * 0.008::DOUBLE AS p, count(*) AS n FROM supplier GROUP BY 1), w AS (SELECT exp(-1.0) AS w),
t AS (SELECT a.n * b.n AS n, w, {_tail_sql('a.p', 'b.p')} AS t, {_tail_sql('a.p', 'a.p')} + {_tail_sql('b.p', 'b.p')} AS own FROM g a, g b, w)
SELECT round(sum(n * exp(-(1 + 0.18 * (1 - w)) * (own - 2 * t) / 2) * 0.18 * (1 - w) * t) / sum(n), 9) AS discrepancy FROM t""")
def conditional_discrepancy_calibration(spark, sf_dir):
    """The composite closed form with the kernel on the sequence models themselves."""
    g = read(spark, sf_dir, "supplier").groupBy((0.25 + F.col("s_nationkey") * 0.008).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    delta = F.lit(0.3)
    out = C.composite(g, delta, 1.0, lambda p, q: F.exp(-C.sequence_models_mmd2(p, q, delta, 1.0) / 2))
    return out.select(F.round("discrepancy", 9).alias("discrepancy"))


# Experiments: two models under the same conditions, and a grid of them.


def _joint_rows(spark, sf_dir, *scales: float):
    """x and two outputs of eight dimensions; with scales, the second output at each temperature."""
    y2 = {"y2": F.slice("x", 9, 8)} | {f"y{t}": scaled("z", t) for t in scales}
    return samples(spark, sf_dir).select("i", F.col("mu").alias("x"), F.col("z").alias("y"), *(v.alias(k) for k, v in y2.items()))


def _sq_sql(x: str, y: str) -> str:
    return f"list_sum(list_transform(list_zip({x}, {y}), lambda q: (q[1] - q[2]) * (q[1] - q[2])))"


BAND = "FROM e a JOIN e b ON b.i > a.i AND b.i <= a.i + 5"


@query(f"""WITH {E_SQL.replace("e AS MATERIALIZED", "e0 AS MATERIALIZED")}, e AS MATERIALIZED (SELECT i, mu AS x, z AS y, x[9:16] AS y2 FROM e0),
s AS MATERIALIZED (SELECT (SELECT quantile_cont(sqrt({_sq_sql('a.x', 'b.x')}), 0.5) {BAND}) AS sx, (SELECT quantile_cont(d, 0.5) FROM (SELECT unnest([{', '.join(f"sqrt({_sq_sql(*p)})" for p in (('a.y', 'b.y'), ('a.y2', 'b.y2'), ('a.y', 'b.y2'), ('b.y', 'a.y2')))}]) AS d {BAND})) AS sy),
h AS (SELECT exp(-{_sq_sql('a.x', 'b.x')} / (2 * sx * sx)) * ({' '.join(f"{g} exp(-{_sq_sql(p, r)} / (2 * sy * sy))" for g, p, r in (('', 'a.y', 'b.y'), ('+', 'a.y2', 'b.y2'), ('-', 'a.y', 'b.y2'), ('-', 'b.y', 'a.y2')))}) AS h FROM e a JOIN e b ON b.i = a.i + 1 CROSS JOIN s WHERE a.i % 2 = 0)
SELECT count(*) AS m, round(avg(h), 6) + 0.0 AS val, round({Z95} * sqrt(avg(h * h)) / sqrt(count(*)), 6) AS quantile, avg(h) > {Z95} * sqrt(avg(h * h)) / sqrt(count(*)) AS reject FROM h""")
def mmd_joint_tuned(spark, sf_dir):
    """Two models' outputs under the same conditions, a product of kernels, both bandwidths by medians."""
    out = H.joint_mmd_test(_joint_rows(spark, sf_dir), H.TestConfig(diagonals=1))
    return out.select("m", rounded("val").alias("val"), rounded("quantile").alias("quantile"), "reject")


TEMPERATURES = (0.5, 1.0, 2.0)


@query(f"""WITH {E_SQL}, h AS (SELECT t, {k_sql('a.mu', 'b.mu')} * ({' '.join(f"{g} exp(-{_sq_sql(p, r)} / 2)" for g, p, r in (('', 'a.z', 'b.z'), ('+', 'list_transform(a.z, lambda v: v * t)', 'list_transform(b.z, lambda v: v * t)'), ('-', 'a.z', 'list_transform(b.z, lambda v: v * t)'), ('-', 'b.z', 'list_transform(a.z, lambda v: v * t)')))}) AS h
  FROM e a JOIN e b ON b.i = a.i + 1 CROSS JOIN (SELECT unnest([0.5, 1.0, 2.0]::DOUBLE[]) AS t) WHERE a.i % 2 = 0)
SELECT t AS temperature, count(*) AS m, round(avg(h), 6) + 0.0 AS val, round({Z95} * sqrt(avg(h * h)) / sqrt(count(*)), 6) AS quantile FROM h GROUP BY t""")
def mmd_temperature_sweep(spark, sf_dir):
    """A model against itself at several temperatures, in one pass; at temperature 1 both are the same and all terms vanish."""
    out = H.sweep(_joint_rows(spark, sf_dir, *TEMPERATURES).withColumnsRenamed({f"y{t}": f"t{k}" for k, t in enumerate(TEMPERATURES)}), {str(t): S.joint_mmd(second=f"t{k}") for k, t in enumerate(TEMPERATURES)})
    return out.select(F.col("name").cast("double").alias("temperature"), "m", rounded("val").alias("val"), rounded("quantile").alias("quantile"))


# Relations of chains: orders are structures, return flags chains.

CHAINS_SQL = """c AS (SELECT l_orderkey AS name, l_returnflag AS chain, count(*) AS n, sum(l_quantity::DOUBLE) AS q FROM lineitem GROUP BY 1, 2),
m AS (SELECT a.name, a.chain AS chain_a, b.chain AS chain_b, least(a.n, b.n) / greatest(a.n, b.n) AS seqid, a.n / (a.n + b.q) AS tm_ab, b.n / (b.n + a.q) AS tm_ba FROM c a JOIN c b ON a.name = b.name AND a.chain < b.chain),
p AS (SELECT * FROM m UNION ALL SELECT name, chain_b, chain_a, seqid, tm_ba, tm_ab FROM m UNION ALL SELECT DISTINCT name, x, x, 1.0, 1.0, 1.0 FROM (SELECT name, unnest([chain_a, chain_b]) AS x FROM m))"""


def _chain_pairs(spark, sf_dir):
    c = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("name"), F.col("l_returnflag").alias("chain")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("double")).alias("q"))
    a, b = (c.select("name", *(F.col(x).alias(f"{x}_{t}") for x in ("chain", "n", "q"))) for t in "ab")
    both = a.join(b, "name").filter("chain_a < chain_b")  # chains of a structure are few
    measured = both.select("name", "chain_a", "chain_b", (F.least("n_a", "n_b") / F.greatest("n_a", "n_b")).alias("seqid"), (F.col("n_a") / (F.col("n_a") + F.col("q_b"))).alias("tm_ab"), (F.col("n_b") / (F.col("n_b") + F.col("q_a"))).alias("tm_ba"))
    one = F.lit(1.0)
    return structure.chain_pairs(measured, ["name"], "chain", {"seqid": ("seqid", one), "tm_ab": ("tm_ba", one), "tm_ba": ("tm_ab", one)})


@query(f"WITH {CHAINS_SQL} SELECT name, chain_a, chain_b, round(seqid, 6) AS seqid, round(tm_ab, 6) AS tm_ab, round(tm_ba, 6) AS tm_ba FROM p")
def chain_pair_scores(spark, sf_dir):
    """Measured pairs of chains, mirrored, and each chain with itself."""
    return _chain_pairs(spark, sf_dir).withColumns({x: rounded(x) for x in ("seqid", "tm_ab", "tm_ba")})


@query(f"WITH {CHAINS_SQL} SELECT name, chain_a AS chain, list_sort(list(DISTINCT chain_b)) AS others FROM p WHERE seqid > 0.7 GROUP BY 1, 2")
def homologous_chains(spark, sf_dir):
    return structure.homologous(_chain_pairs(spark, sf_dir), ["name"])


@query("""WITH c AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus = 'F' AS masked FROM orders)
SELECT o_custkey, o_orderkey, o_orderpriority, masked OR EXISTS (SELECT 1 FROM c d WHERE d.o_custkey = c.o_custkey AND d.o_orderpriority = c.o_orderpriority AND d.masked) AS masked FROM c""")
def identical_promoted(spark, sf_dir):
    """Visible chains whose sequence equals a masked one of the same structure become masked."""
    c = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "F").alias("masked"))
    return structure.promote_identical(c, ["o_custkey"], "o_orderpriority").select("o_custkey", "o_orderkey", "o_orderpriority", "masked")


@query("""WITH a AS (SELECT l_orderkey AS name, l_suppkey % 3 AS assembly, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS chains FROM lineitem GROUP BY 1, 2),
w AS (SELECT DISTINCT l_orderkey AS name, l_returnflag AS chain FROM lineitem WHERE l_quantity > 45) SELECT name, chain, assembly, chains FROM a JOIN w USING (name) WHERE list_contains(string_split(chains, ', '), chain)""")
def assembly_search(spark, sf_dir):
    """Assemblies whose list of chains holds a wanted chain."""
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_returnflag").alias("chain"), "l_suppkey", "l_quantity")
    a = line.groupBy("name", (F.col("l_suppkey") % 3).alias("assembly")).agg(F.array_join(F.array_sort(F.collect_set("chain")), ", ").alias("chains"))
    return structure.assemblies_with(a, line.filter("l_quantity > 45")).select("name", "chain", "assembly", "chains")


@query(f"""WITH {NODES_SQL}, d AS (SELECT a.name, a.node AS src, b.node AS dst, sqrt(list_sum(list_transform(list_zip(a.xyz, b.xyz), lambda q: (q[1] - q[2]) * (q[1] - q[2])))) AS dist FROM n a JOIN n b ON a.name = b.name AND a.node <> b.node),
k AS (SELECT name, src, dst, 0 AS kind FROM d WHERE dist < 10 AND abs(src - dst) >= 2 UNION ALL SELECT name, src, dst, 1 FROM d WHERE abs(src - dst) <= 2)
SELECT name, src, dst, list_sort(list(DISTINCT kind)) AS kinds FROM k GROUP BY 1, 2, 3""")
def residue_graph(spark, sf_dir):
    """Spatial and sequential edges as one table, each edge with its kinds."""
    n = _nodes(spark, sf_dir)
    return structure.edge_union(structure.radius_edges(n, 10.0, apart=2), structure.sequential_edges(n))
