"""Chains against plain loops, stopping and resuming; Stein kernels against numerical derivatives; sampling against a plain loop."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from steinlake.functions import jets as J
from steinlake.functions.randomness import counter_normals, counter_uniforms
from steinlake.operators import chains, decoding
from steinlake.operators import statistics as S
from steinlake.plans import hypothesis as H


def model_rows(spark, n=12, d=3):
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(k, rng.normal(size=d).tolist(), float(0.6 + rng.random()), rng.normal(size=d).tolist(), rng.normal(size=2).tolist()) for k in range(n)], "i long, mu array<double>, s double, y array<double>, x array<double>")


def plain_chain(i, k, mu, s, config, steps):
    """One chain by hand: the positions after each step."""
    key = chains.keys_of(np.array([i]), config)[k : k + 1]
    d = len(mu)
    x, log_step, seen = counter_normals(key, 1 << 40, d)[0], np.log(config.step), []
    logp = lambda z: -(((z - mu) ** 2).sum()) / (2 * s * s)
    seen.append(x)
    for t in range(steps):
        e = np.exp(log_step)
        g = (mu - x) / s**2
        y = x + e * g + np.sqrt(2 * e) * counter_normals(key, t, d)[0]
        back = ((x - y - e * (mu - y) / s**2) ** 2).sum()
        ratio = logp(y) - logp(x) + (((y - x - e * g) ** 2).sum() - back) / (4 * e)
        if t < config.warm_up and config.adapt:
            log_step += (np.exp(min(0.0, ratio)) - config.target) / np.sqrt(t + 1)
        if np.log(counter_uniforms(key, t, 2 * d + 1)[0, -1]) < ratio:
            x = y
        seen.append(x)
    return seen


@pytest.mark.parametrize("config", [chains.ChainConfig(particles=5, seed="a"), chains.ChainConfig(particles=7, chains=3, warm_up=4, thin=2, seed="b"), chains.ChainConfig(particles=4, chains=2, warm_up=0, adapt=False)])
def test_chains_against_plain_loops(spark, config):
    rows = model_rows(spark)
    got = {r.i: r.points for r in chains.ChainTable(rows, chains.gaussian_density(), config).particles().collect()}
    for r in rows.collect():
        seen = [plain_chain(r.i, k, np.array(r.mu), r.s, config, config.steps) for k in range(config.count)]
        kept = [seen[k][t] for t in range(config.warm_up, config.steps + 1, config.thin) for k in range(config.count)][: config.particles]
        assert np.array(got[r.i]) == pytest.approx(np.array(kept), abs=1e-12) and len(got[r.i]) == config.particles


def test_chains_stop_and_resume(spark, tmp_path):
    rows, config = model_rows(spark), chains.ChainConfig(particles=6, chains=3, warm_up=9, seed="c")
    whole = chains.ChainTable(rows, chains.gaussian_density(), config).particles().orderBy("i").collect()
    folder = f"file://{tmp_path}/chains"
    first = chains.ChainTable(rows, chains.gaussian_density(), config, folder)
    first.advanced(4)
    assert first.committed() == [0, 4]
    # A version that was never committed, as a killed run leaves it, is not read.
    half = tmp_path / "chains" / first.folder.rsplit("/", 1)[1] / "step=8"
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"half")
    second = chains.ChainTable(rows.repartition(3), chains.gaussian_density(), config, folder)
    assert second.advanced(every=3).select("i", "points").orderBy("i").collect() == whole
    assert second.committed() == [0, 4, 7, 10]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    second.advanced()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - jobs <= 1  # the footer is read, no chain moves
    assert chains.ChainTable(rows, chains.gaussian_density(), chains.ChainConfig(particles=6, seed="other"), folder).committed() == []
    test = H.TestConfig(diagonals=1)
    one = H.skce_test(rows, test, density=chains.gaussian_density(), chains=config, folder=folder).first()
    assert one == H.skce_test(rows, test, density=chains.gaussian_density(), chains=config).first() and one.m == 6


def test_chains_reach_their_law(spark):
    rows = spark.createDataFrame([(k, [1.5, -0.5], 0.7) for k in range(40)], "i long, mu array<double>, s double")
    config = chains.ChainConfig(particles=100, warm_up=40, seed="d")
    points = np.concatenate([np.array(r.points) for r in chains.ChainTable(rows, chains.gaussian_density(), config).particles().collect()])
    assert points.mean(0) == pytest.approx([1.5, -0.5], abs=0.05) and points.std(0) == pytest.approx([0.7, 0.7], abs=0.05)
    told = chains.ChainTable(rows, chains.gaussian_density(), config).chains()
    rate = told.agg(F.avg("rate"), F.count(F.lit(1)), F.max("step")).first()
    assert 0.35 < rate[0] < 0.75 and rate[1:] == (4000, 40)


def test_mixture_density_and_shapes(spark):
    """Rows of different numbers of centres move too; the gradient is the log density's."""
    rows = spark.createDataFrame([(0, [[-2.0, 0.0], [2.0, 1.0]], 0.5), (1, [[0.0, 0.0]], 1.0), (2, [[1.0]], 1.0)], "i long, centres array<array<double>>, s double")
    got = {r.i: np.array(r.points) for r in chains.ChainTable(rows, chains.mixture_density(), chains.ChainConfig(particles=30, warm_up=30)).particles().collect()}
    assert got[0].shape == (30, 2) and got[1].shape == (30, 2) and got[2].shape == (30, 1)
    assert (got[0][:, 0] > 0).any() and (got[0][:, 0] < 0).any()
    model, v = chains.mixture_density(), {"centres": np.array([[[-2.0, 0.0], [2.0, 1.0]]]), "s": np.array([0.5])}
    x, h = np.array([[0.3, 0.4]]), 1e-6
    numeric = [(model.log_density(x + h * e, v) - model.log_density(x - h * e, v))[0] / (2 * h) for e in np.eye(2)]
    assert model.gradient(x, v)[0] == pytest.approx(numeric, abs=1e-5)
    assert chains.ChainTable(rows.limit(0), chains.mixture_density()).particles().count() == 0


# Stein kernels.

KERNELS = {
    "gaussian": J.gaussian(1.3),
    "imq": J.inverse_multiquadric(0.8, -0.7),
    "polynomial": J.polynomial(3.0, 0.5),
    "sum": J.combined(J.gaussian(2.0), J.polynomial()),
    "product": J.combined(J.inverse_multiquadric(), J.polynomial(), J.gaussian(3.0), product=True),
}


def numeric_stein(k, x, y, sx, sy, h=1e-4):
    f = lambda a, b: float(k.block(a[None], b[None])[0, 0])
    e = np.eye(len(x)) * h
    gx = np.array([(f(x + d, y) - f(x - d, y)) / (2 * h) for d in e])
    gy = np.array([(f(x, y + d) - f(x, y - d)) / (2 * h) for d in e])
    trace = sum((f(x + d, y + d) - f(x + d, y - d) - f(x - d, y + d) + f(x - d, y - d)) / (4 * h * h) for d in e)
    return f(x, y) * sx @ sy + sx @ gy + sy @ gx + trace


@pytest.mark.parametrize("name", KERNELS)
def test_stein_kernels_against_differences(spark, name):
    k = KERNELS[name]
    rng = np.random.default_rng(6)
    x, y, sx, sy = (rng.normal(size=(5, 4)) for _ in range(4))
    block = k.stein_block(x, y, sx, sy)
    expected = np.array([[numeric_stein(k, x[i], y[j], sx[i], sy[j]) for j in range(5)] for i in range(5)])
    assert block == pytest.approx(expected, rel=1e-4, abs=1e-4)
    rows = [(*map(np.ndarray.tolist, (x[i], y[j], sx[i], sy[j])), float(block[i, j]), float(k.block(x[i : i + 1], y[j : j + 1])[0, 0])) for i in range(5) for j in range(5)]
    df = spark.createDataFrame(rows, "x array<double>, y array<double>, sx array<double>, sy array<double>, h double, k double")
    for r in df.select(k.stein(F.col("x"), F.col("y"), F.col("sx"), F.col("sy")).alias("got"), "h", k.expr("x", "y").alias("value"), "k").collect():
        assert r.got == pytest.approx(r.h, rel=1e-10, abs=1e-12) and r.value == pytest.approx(r.k, rel=1e-10)


def test_scored_forms_are_the_known_ones(spark):
    """With a Gaussian kernel and a normal score, the scored statistics are the closed ones, by pairs and in tiles."""
    rows = model_rows(spark).withColumn("score", J.normal_score(F.col("y"), F.col("mu"), F.col("s")))
    for config in (H.TestConfig(diagonals=3), H.TestConfig()):
        a = H.unbiased_estimate(rows, S.kccsd(), config).first()
        b = H.kccsd_estimate(rows, S.exp_mmd(), J.gaussian(), config).first()
        assert b.val == pytest.approx(a.val, rel=1e-9) and b.mean_h2 == pytest.approx(a.mean_h2, rel=1e-9)
    assert H.kccsd_test(rows, H.TestConfig(diagonals=1), S.exp_mmd(), J.gaussian()).first().val == pytest.approx(H.kccsd_test(rows, H.TestConfig(diagonals=1)).first().val)
    given = model_rows(spark).withColumn("score", F.zip_with("x", F.slice("y", 1, 2), lambda p, q: p - q)).withColumn("y", F.slice("y", 1, 2))
    assert H.unbiased_estimate(given, S.kcsd_scored(S.Gaussian(1.0), J.gaussian())).first().val == pytest.approx(H.unbiased_estimate(given, S.kcsd()).first().val)


def test_mixture_score_is_a_gradient(spark):
    centres, y, w, s, h = np.array([[0.0, 1.0], [2.0, -1.0], [30.0, 0.0]]), np.array([0.7, 0.1]), np.array([1.0, 2.5, 0.5]), 0.9, 1e-6
    log_q = lambda z: np.log((w * np.exp(-((z - centres) ** 2).sum(1) / (2 * s * s))).sum())
    numeric = [(log_q(y + h * e) - log_q(y - h * e)) / (2 * h) for e in np.eye(2)]
    df = spark.createDataFrame([(y.tolist(), centres.tolist(), w.tolist())], "y array<double>, c array<array<double>>, w array<double>")
    assert df.select(J.mixture_score(F.col("y"), F.col("c"), s, F.col("w"))).first()[0] == pytest.approx(numeric, abs=1e-6)


# Sampling.


def uniform(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296


def plain_sampling(residues, ties, seed, temperature, omitted, bias, share, after):
    """The same by loops over one structure's positions."""
    tie_of = {(t["chain"], t["pos"]): t for t in ties}
    place = {k: ((r["designed"] and r["mask"]) + 1e-4) * r["noise"] for k, r in residues.items()}
    order, done, last, out, step = sorted(residues, key=lambda k: (place[k], k)), set(), None, {}, 0
    for k in order:
        if k in done:
            continue
        group = sorted((m for m in residues if m in tie_of and tie_of[m]["tie"] == tie_of[k]["tie"]), key=lambda m: tie_of[m]["member"]) if k in tie_of else [k]
        z, missing = np.zeros(3), None
        for m in group:
            r = residues[m]
            if not r["mask"] and missing is None:
                missing = r["native"]
            extra = after[last] if last is not None else np.zeros(3)
            z += (tie_of[m]["beta"] if m in tie_of else 1.0) * (np.array(r["logits"]) + extra) / len(group)
        r = residues[group[-1]]
        z = z / temperature - np.array([1e8 if a in omitted else 0 for a in range(3)]) + np.array(bias) / temperature + np.array(r["bias"]) / temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        p = (1 - share * r["profile_weight"]) * p + share * r["profile_weight"] * np.array(r["profile"])
        p = p * np.where(r["allowed"], 1.001, 0.001)
        p = p / p.sum() * ~np.array(r["omit"])
        p = p / p.sum()
        if missing is not None:
            letter = missing
        elif r["designed"]:
            letter = int((np.cumsum(p)[:-1] <= uniform(seed, "draw", "s", *k) * p.sum()).sum())
        else:
            letter = r["native"]
        for m in group:
            out[m] = (step, letter, None if missing is not None else p[letter])
            done.add(m)
        last, step = letter, step + 1
    return out


@pytest.mark.parametrize("tied", [True, False])
def test_sampling_against_a_plain_loop(spark, tied):
    rng = np.random.default_rng(12)
    residues = {}
    for c in "ABC":
        for p in range(1, 9):
            profile = rng.random(3)
            residues[c, p] = dict(logits=rng.normal(size=3).tolist(), noise=float(rng.random()), designed=bool(rng.random() < 0.8), mask=bool(rng.random() < 0.85), native=int(rng.integers(3)), bias=rng.normal(size=3).tolist(),
                                  omit=[False, bool(rng.random() < 0.3), False], profile=(profile / profile.sum()).tolist(), profile_weight=float(rng.random()), allowed=[True, bool(rng.random() < 0.5), True])
    ties = [dict(tie=p, chain=c, pos=p, beta=float(rng.normal()), member="BCA".index(c)) for p in (2, 5, 6) for c in "ABC"] if tied else []
    after = rng.normal(size=(3, 3))
    kind = "chain string, pos int, logits array<double>, noise double, designed boolean, mask boolean, native int, bias array<double>, omit array<boolean>, profile array<double>, profile_weight double, allowed array<boolean>"
    df = spark.createDataFrame([(c, p, *r.values()) for (c, p), r in residues.items()], kind).withColumn("name", F.lit("s")).repartition(3)
    two = df.unionByName(df.withColumn("name", F.lit("other")))
    linked = spark.createDataFrame([(n, t["tie"], t["chain"], t["pos"], t["beta"], t["member"]) for t in ties for n in ("s", "other")], "name string, tie int, chain string, pos int, beta double, member int") if tied else None
    context = lambda state, m: F.when(state["last"].isNull(), F.array(*(F.lit(0.0) for _ in range(3)))).otherwise(F.get(F.array(*(F.array(*map(F.lit, map(float, w))) for w in after)), state["last"]))
    got = decoding.sampled(two, linked, seed="9", temperature=0.7, omitted=[2], bias=[0.2, 0.0, 0.1], profile_share=0.5, context=context).collect()
    expected = plain_sampling(residues, ties, "9", 0.7, [2], [0.2, 0.0, 0.1], 0.5, after)
    mine = {(r.chain, r.pos): (r.step, r.letter, r.p) for r in got if r.name == "s"}
    assert len(got) == 48 and mine.keys() == expected.keys()
    for k, (step, letter, p) in expected.items():
        assert mine[k][:2] == (step, letter) and mine[k][2] == (pytest.approx(p, abs=1e-9) if p is not None else None)


def test_sampling_defaults_and_frequencies(spark):
    """Only logits given: one position of each of many structures, whose letters come at the softmax's rates."""
    z = [0.0, np.log(2.0), np.log(5.0)]
    df = spark.range(4000).select(F.col("id").alias("name"), F.lit("A").alias("chain"), F.lit(1).alias("pos"), F.array(*map(F.lit, map(float, z))).alias("logits"))
    out = decoding.sampled(df).groupBy("letter").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p")).orderBy("letter").collect()
    assert [r.n / 4000 for r in out] == pytest.approx([1 / 8, 2 / 8, 5 / 8], abs=0.03) and [r.p for r in out] == pytest.approx([1 / 8, 2 / 8, 5 / 8])
    assert decoding.sampled(df.limit(0)).count() == 0
