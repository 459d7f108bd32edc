"""Statistics against numpy twins, properties of tests, and closed forms."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from steinlake.functions import closed_forms, kernels, models
from steinlake.functions import jets as J
from steinlake.operators import alignment, bandwidth, landmarks, null, pairs, tiles
from steinlake.operators import statistics as S
from steinlake.plans import hypothesis as H

RNG = np.random.default_rng(5)


def frame(spark, n=37, d=3, shift=0.0):
    rows = [(i, RNG.normal(size=d).tolist(), (RNG.normal(size=d) + shift).tolist(), RNG.normal(size=d).tolist(), float(0.5 + RNG.random())) for i in range(n)]
    return spark.createDataFrame(rows, "i long, x array<double>, y array<double>, mu array<double>, s double")


@pytest.mark.parametrize("make", [S.mmd, S.ksd, S.kcsd, S.skce, S.cgof, S.kccsd])
def test_column_and_tile_agree(spark, make):
    """The complete statistic in tiles is the mean of the column over all super-diagonals."""
    rows, statistic = frame(spark).persist(), make()
    tiled = tiles.complete(rows, statistic, block=8).first()
    band = H.unbiased_estimate(rows, statistic, H.TestConfig(diagonals=36)).first()
    assert tiled["m"] == band["m"] == 37 * 36 // 2
    assert tiled["val"] == pytest.approx(band["val"], rel=1e-9, abs=1e-12)
    assert tiled["mean_h2"] == pytest.approx(band["mean_h2"], rel=1e-9)


def test_bootstrap_in_tiles_is_the_dense_form(spark):
    rows = frame(spark, 21).persist()
    out = tiles.complete(rows, S.mmd(), 7, "9", block=5).first()
    data = sorted(rows.collect())
    x, y = (np.array([r[c] for r in data]) for c in ("x", "y"))
    h = S.mmd().block({"x": x, "y": y}, {"x": x, "y": y})
    e = np.array([[1 if hashlib.md5(f"9:{b}:{i}".encode()).hexdigest()[0] < "8" else -1 for i in range(21)] for b in range(7)])
    expected = [(v @ (h - np.diag(np.diag(h))) @ v) / (21 * 20) for v in e]
    assert out["h0"] == pytest.approx(expected)


def test_symmetry_and_self_value(spark):
    rows = frame(spark, 2)
    p = pairs.both_diagonals(rows, 1)
    h = [r[0] for r in p.select(S.skce().expr()).collect()]
    assert h[0] == pytest.approx(h[1])
    imq = kernels.HammingIMQ(1.0, 0.5)
    one = spark.createDataFrame([(["a", "b"],)], "s array<string>")
    assert one.select(imq.expr(F.col("s"), F.col("s"))).first()[0] == pytest.approx(math.sqrt(2))


def test_lag_windows():
    assert [kernels.lag_window(k, "cumulative") for k in range(1, 6)] == [1, 2, 4, 7, 11]
    assert kernels.lag_window(3, "kmer") == 3
    with pytest.raises(ValueError):
        kernels.lag_window(3, "other")


def test_rejects_a_shift_and_keeps_the_null(spark):
    config = H.TestConfig(num_permutations=50)
    far = H.mmd_test(frame(spark, 60, shift=2.0), config).first()
    assert far["reject"] and far["p_value"] == 0.0 and 0 < far["p_value_plus1"] < 0.05
    same = H.mmd_test(frame(spark, 60), config).first()
    assert 0.0 <= same["p_value"] <= 1.0 and same["num_permutations"] == 50 and len(same["h0"]) == 50


def test_odd_last_row_is_left_out_of_neighbours(spark):
    assert [tuple(r) for r in pairs.adjacent(frame(spark, 5)).select("a_i", "b_i").orderBy("a_i").collect()] == [(0, 1), (2, 3)]


def test_pair_counts(spark):
    rows = frame(spark, 12).persist()
    assert pairs.superdiagonals(rows, 4).count() == 12 * 4 - 4 * 5 // 2 == pairs.subdiagonals(rows, 4).count()
    drawn = pairs.drawn(rows, 12, 40, 1).select("a_i", "b_i").collect()
    assert len(set(drawn)) == len(drawn) <= 40 and all(a < b for a, b in drawn)


def test_dense_index(spark):
    rows = spark.createDataFrame([(x,) for x in (9, 3, 7, 1, 5)], "k long")
    assert [tuple(r) for r in pairs.dense_index(rows, "k").orderBy("k").select("k", "i").collect()] == [(1, 0), (3, 1), (5, 2), (7, 3), (9, 4)]


def test_upper_tail(spark):
    z = spark.createDataFrame([(x,) for x in (-8.0, -1.5, 0.0, 0.3, 1.6448536269514722, 3.0, 8.0)], "z double")
    got = [r[0] for r in z.select(null.upper_tail(F.col("z"))).collect()]
    assert got == pytest.approx([0.5 * math.erfc(r[0] / math.sqrt(2)) for r in z.collect()], abs=1e-8)


def test_gaussian_expectation_against_samples(spark):
    rng = np.random.default_rng(1)
    m, s, y = np.array([0.3, -0.2]), 0.7, np.array([0.1, 0.4])
    draws = m + s * rng.normal(size=(200_000, 2))
    row = spark.createDataFrame([(m.tolist(), s, y.tolist())], "m array<double>, s double, y array<double>")
    got = row.select(models.expect_one(F.col("m"), F.col("s"), F.col("y"), 1.0)).first()[0]
    assert got == pytest.approx(np.exp(-((draws - y) ** 2).sum(1) / 2).mean(), abs=2e-3)


def test_fisher_forms_against_samples(spark):
    rng = np.random.default_rng(2)
    mp, sp, mq, sq, mb, sb = np.array([0.3, 0.1]), 0.8, np.array([-0.2, 0.5]), 1.1, np.array([0.2, -0.1]), 0.9
    z = mb + sb * rng.normal(size=(4000, 2))
    d = (mp - z) / sp**2 - (mq - z) / sq**2
    row = spark.createDataFrame([(mp.tolist(), sp, mq.tolist(), sq, mb.tolist(), sb)], "mp array<double>, sp double, mq array<double>, sq double, mb array<double>, sb double")
    c = [F.col(x) for x in ("mp", "sp", "mq", "sq", "mb", "sb")]
    plain, kernel = row.select(models.fisher(*c), models.kernel_fisher(*c, 1.0)).first()
    assert plain == pytest.approx((d * d).sum(1).mean(), rel=0.05)
    k = np.exp(-((z[:, None] - z) ** 2).sum(-1) / 2)
    both = (k * (d @ d.T)).sum() - (np.diag(k) * (d * d).sum(1)).sum()
    assert kernel == pytest.approx(both / (4000 * 3999), rel=0.08)


def test_closed_form_of_the_sequence_model(spark):
    """The published form against direct sums over all sequences up to a length at which the rest is negligible."""
    p, q, delta, lam, depth = 0.2, 0.25, 0.1, 1.0, 9
    w = math.exp(-lam)

    def law(r, first):
        out = {"": 1 - 2 * r}
        level = {"A": r + first, "B": r - first}
        for _ in range(depth):
            nxt = {}
            for s, v in level.items():
                out[s] = v * (1 - 2 * r)
                nxt[s + "A"] = nxt[s + "B"] = v * r
            level = nxt
        return out

    def signed(r):
        a, b = law(r, delta), law(r, 0.0)
        return {s: a[s] - b[s] for s in a if a[s] != b[s]}

    def k(s, t):
        n = max(len(s), len(t))
        return w ** sum(x != y for x, y in zip(s.ljust(n), t.ljust(n), strict=True))

    def exact(r, t):
        a, b = signed(r), signed(t)
        top = lambda d: sorted(d.items(), key=lambda x: -abs(x[1]))[:400]
        return sum(u * v * k(s, z) for s, u in top(a) for z, v in top(b))

    row = spark.range(1).select(closed_forms.discrepancy(F.lit(p), F.lit(delta), lam), closed_forms.discrepancy_pair(F.lit(p), F.lit(q), F.lit(delta), lam), closed_forms.discrepancy_pair(F.lit(p), F.lit(p), F.lit(delta), lam)).first()
    assert row[0] == pytest.approx(row[2])
    assert row[0] == pytest.approx(exact(p, p), rel=0.02)
    assert row[1] == pytest.approx(exact(p, q), rel=0.02)


def lettered(spark, n=29, length=6):
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(0, 3, length).tolist(), rng.normal(size=3).tolist(), rng.normal(size=3).tolist(), float(0.5 + rng.random())) for i in range(n)]
    return spark.createDataFrame(rows, "i long, x array<long>, y array<double>, mu array<double>, s double")


@pytest.mark.parametrize("kernel", [kernels.HammingIMQ(), kernels.HammingIMQ(0.5, 0.7, 3), kernels.HammingIMQ(lag=3, mode="kmer"), kernels.HammingExp(0.3)])
def test_sequence_kernels_in_tiles(spark, kernel):
    """Kernels of sequences over blocks are their columns over all pairs; windows at the end are cut short in both."""
    rows, statistic = lettered(spark).persist(), S.cgof(kernel)
    tiled = tiles.complete(rows, statistic, block=8).first()
    band = H.unbiased_estimate(rows, statistic, H.TestConfig(diagonals=28)).first()
    assert tiled["m"] == band["m"] and tiled["val"] == pytest.approx(band["val"], rel=1e-9) and tiled["mean_h2"] == pytest.approx(band["mean_h2"], rel=1e-9)


def test_wasserstein_kernel_in_tiles(spark):
    rows, statistic = frame(spark, 23).persist(), S.skce(kernel=S.exp_wasserstein(1.5))
    tiled = tiles.complete(rows, statistic, block=8).first()
    band = H.unbiased_estimate(rows, statistic, H.TestConfig(diagonals=22)).first()
    assert tiled["val"] == pytest.approx(band["val"], rel=1e-9)


def test_statistics_say_what_they_can(spark):
    fisher = S.skce(kernel=S.exp_fisher([[0.0, 0.0, 0.0]]))
    assert not fisher.tiled and not fisher.on_particles and S.skce().tiled and S.cgof_particles().on_particles
    with pytest.raises(ValueError, match="diagonals"):
        H.unbiased_estimate(frame(spark, 5), fisher)
    assert H.TestConfig(diagonals=1).has_analytic_null and not H.TestConfig(diagonals=5).has_analytic_null


def test_fisher_kernels_against_numpy(spark):
    base = np.random.default_rng(3).normal(size=(6, 3))
    rows = frame(spark, 8).persist()
    p = {r.i: (np.array(r.mu), r.s) for r in rows.collect()}
    plain, kernelised = S.exp_fisher(base.tolist(), 5.0), S.exp_fisher(base.tolist(), 5.0, kernels.Gaussian(1.5))
    for r in pairs.adjacent(rows).select("a_i", "b_i", plain.expr().alias("f"), kernelised.expr().alias("kf")).collect():
        d = np.subtract(*(((m - base) / s**2) for m, s in (p[r.a_i], p[r.b_i])))
        k = np.exp(-((base[:, None] - base) ** 2).sum(-1) / 4.5)
        assert r.f == pytest.approx(math.exp(-(d**2).sum(1).mean() / 50)) and r.kf == pytest.approx(math.exp(-(k * (d @ d.T)).mean() / 50))


def test_sampled_calibration_against_numpy(spark):
    """The calibration test on drawn particles, recomputed from the same draws."""
    from steinlake.operators import bandwidth, particles

    rows = frame(spark, 13).persist()
    out = H.skce_test(rows, H.TestConfig(diagonals=1, seed="4"), m=3).first()
    points = {r.i: np.array(r.points) for r in particles.gaussian_particles(rows, 3, "4").collect()}
    y = {r.i: np.array(r.y) for r in rows.collect()}
    k = lambda a, b: np.exp(-((np.atleast_2d(a)[:, None] - np.atleast_2d(b)) ** 2).sum(-1) / 2).mean()
    h, d2 = [], []
    for a, b in ((2 * j, 2 * j + 1) for j in range(6)):
        d2.append(k(points[a], points[a]) + k(points[b], points[b]) - 2 * k(points[a], points[b]))
        h.append(math.exp(-d2[-1] / 2) * (k(y[a], y[b]) - k(points[a], y[b]) - k(points[b], y[a]) + k(points[a], points[b])))
    assert out.m == 6 and out.val == pytest.approx(np.mean(h))
    tuned = bandwidth.tuned(S.exp_mmd_particles(), pairs.adjacent(H.sampled(rows, 3, "4")))
    assert tuned.sigma == pytest.approx(np.median(np.sqrt(np.maximum(d2, 0))))


def test_sequence_models_by_enumeration(spark):
    """The squared discrepancy of sequence models, against all sequences up to a length that holds nearly all weight."""
    from itertools import product

    lam, delta, longest = 1.0, 0.1, 9
    words = ["".join(t) for n in range(longest + 1) for t in product("AB", repeat=n)]

    def law(p):
        first = {"A": p + delta, "B": p - delta}
        return np.array([(1 - 2 * p) * (first[t[0]] * p ** (len(t) - 1) if t else 1.0) for t in words])

    encoded = np.array([[ord(c) for c in t.ljust(longest, "-")] for t in words])
    k = np.exp(-lam * np.array([(e != encoded).sum(1) for e in encoded]))
    d = law(0.1) - law(0.15)
    p, q = F.lit(0.1), F.lit(0.15)
    got = spark.range(1).select(closed_forms.sequence_models_mmd2(p, q, F.lit(delta), lam)).first()[0]
    assert got == pytest.approx(d @ k @ d, rel=1e-4)


def test_joint_mmd_forms_agree(spark):
    """Tiles against all pairs; a sweep's test is the single test of the same statistic."""
    rows = frame(spark, 21).withColumnRenamed("mu", "y2").persist()
    tiled = tiles.complete(rows, S.joint_mmd(), block=8).first()
    band = H.unbiased_estimate(rows, S.joint_mmd(), H.TestConfig(diagonals=20)).first()
    assert tiled["val"] == pytest.approx(band["val"], rel=1e-9)
    grid = {r.name: r for r in H.sweep(rows, {"a": S.joint_mmd(), "b": S.joint_mmd(kernels.Gaussian(2.0))}).collect()}
    for name, kx in (("a", kernels.Gaussian(1.0)), ("b", kernels.Gaussian(2.0))):
        one = H.run_test(rows, S.joint_mmd(kx), H.TestConfig(diagonals=1)).first()
        assert (grid[name].m, grid[name].reject) == (one.m, one.reject) and grid[name].val == pytest.approx(one.val) and grid[name].p_value == pytest.approx(one.p_value)


def particle_frame(spark, n):
    """Rows with x (a sequence of three points), y, and a particle model of four points."""
    rng = np.random.default_rng(17)
    data = [(i, rng.normal(size=(3, 2)).tolist(), rng.normal(size=2).tolist(), rng.normal(size=(4, 2)).tolist()) for i in range(n)]
    return spark.createDataFrame(data, "i long, x array<array<double>>, y array<double>, points array<array<double>>")


@pytest.mark.parametrize("statistic", [S.skce_particles(), S.skce_particles(kernels.Gaussian(2.0), sigma=0.5), S.cgof_particles(alignment.SoftAlignment(0.8, 1.5, 0.5))])
def test_particle_models_in_tiles(spark, statistic):
    """Tiles of particle models, and of sequences of points under the alignment kernel, against all pairs in columns."""
    rows = particle_frame(spark, 21).persist()
    tiled = tiles.complete(rows, statistic, block=8).first()
    band = H.unbiased_estimate(rows, statistic, H.TestConfig(diagonals=20)).first()
    assert tiled["m"] == band["m"] == 210 and tiled["val"] == pytest.approx(band["val"], rel=1e-9) and tiled["mean_h2"] == pytest.approx(band["mean_h2"], rel=1e-9)


def test_alignment_kernel_against_loops(spark, monkeypatch):
    """Columns and blocks against the recurrence in plain loops, over lengths from 1; empty and null sequences."""

    def brute(a, b, sigma, gamma):
        m = np.full((len(a) + 1, len(b) + 1), -np.inf)
        m[0, 0] = 0.0
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                m[i + 1, j + 1] = -sum((u - v) ** 2 for u, v in zip(p, q)) / (2 * sigma**2) + gamma * np.logaddexp.reduce(np.array([m[i, j], m[i, j + 1], m[i + 1, j]]) / gamma)
        return m[-1, -1]

    rng = np.random.default_rng(5)
    shapes = [(1, 1), (1, 2), (2, 1), (3, 5), (6, 4)]
    data = [(rng.normal(size=(h, 2)).tolist(), rng.normal(size=(w, 2)).tolist()) for h, w in shapes]
    kernel = alignment.SoftAlignment(0.7, 1.3, 2.0)
    got = spark.createDataFrame([*data, ([], data[0][1]), (None, data[0][1])], "a array<array<double>>, b array<array<double>>").select(kernel.log_expr("a", "b"), kernel.expr("a", "b")).collect()
    for (a, b), r in zip(data, got):
        want = brute(a, b, 0.7, 1.3)
        assert r[0] == pytest.approx(want) and r[1] == pytest.approx(math.exp(want - 2.0))
    assert got[-2][1] == 0.0 and got[-1][1] is None
    monkeypatch.setattr(alignment, "STEP_BYTES", 8 * 7 * 3 * 4 * 2)
    a, b = rng.normal(size=(5, 3, 2)), rng.normal(size=(7, 4, 2))
    want = [[math.exp(brute(p, q, 0.7, 1.3) - 2.0) for q in b] for p in a]
    assert np.allclose(kernel.block(a, b), want)


def test_tuned_on_gaussians(spark):
    """The bandwidth on points against sampled distances of the mixture; that on models against the definition."""
    rows = frame(spark, 9).persist()
    both = pairs.adjacent(rows)
    ground, kernel = bandwidth.tuned_on_gaussians(both)
    rng, medians = np.random.default_rng(2), []
    for r in both.collect():
        draw = lambda: np.where(rng.random((40_000, 1)) < 0.5, np.array(r.a_mu) + r.a_s * rng.normal(size=(40_000, len(r.a_mu))), np.array(r.b_mu) + r.b_s * rng.normal(size=(40_000, len(r.a_mu))))  # noqa: B023, E731
        medians.append(np.median(np.sqrt(((draw() - draw()) ** 2).sum(1))))
    assert ground.sigma == pytest.approx(np.median(medians), rel=0.02)
    d2 = [r[0] for r in both.select(models.mmd2(F.col("a_mu"), F.col("a_s"), F.col("b_mu"), F.col("b_s"), ground.sigma)).collect()]
    assert kernel.sigma == pytest.approx(np.median(np.sqrt(np.maximum(d2, 0))))


def test_signs_travel_as_bits():
    bits = tiles.sign_bits("9", 5, np.array([3, 4, 70]))
    expected = [[1 if hashlib.md5(f"9:{b}:{i}".encode()).hexdigest()[0] < "8" else -1 for i in (3, 4, 70)] for b in range(5)]
    assert len(bits) == 2 and tiles.signs(bits, 5, 3).tolist() == expected
    assert tiles.sign_bits("9", 0, np.arange(4)) == b"" and tiles.signs(b"", 0, 4).shape == (0, 4)


def test_every_tile_is_dealt_once(spark):
    """Many sides: each pair of rows is counted in one tile, and tiles have tasks of their own."""
    rows = frame(spark, 90).persist()
    got = tiles.tile_sums(rows, S.mmd(), 3, "9", block=2)
    assert got.rdd.getNumPartitions() == 45
    parts = got.select("n_pairs", F.spark_partition_id().alias("p")).collect()
    assert sum(r.n_pairs for r in parts) == 90 * 89 // 2 and len({r.p for r in parts}) == len(parts) == 45


@pytest.mark.parametrize("ids", [[0, 1, 3], [0, 1, 1], [0, None, 1], [0, 1, 1, 3], [0, 2, 2, 2, 4]])
def test_an_index_with_gaps_or_repeats_stops(spark, ids):
    rows = lambda v: spark.createDataFrame([(i,) for i in v], "i long")
    with pytest.raises(ValueError, match="dense index"):
        pairs.dense(rows(ids))
    assert pairs.dense(rows([7, 5, 6])).count() == 3 and pairs.dense(rows([])).count() == 0


def test_embedded_particles_equal_their_pairs():
    """A block's pairs of particle models as inner products of embeddings; points too far out are met pair by pair."""
    rng = np.random.default_rng(5)
    for size, prepared in ((0.3, True), (4.0, False)):
        rows = [{"x": rng.normal(size=(n, 3)), "y": size * rng.uniform(-0.5, 0.5, (n, 4)), "points": size * rng.uniform(-0.5, 0.5, (n, 8, 4))} for n in (70, 5)]
        for k in (kernels.Gaussian(1.0), kernels.Gaussian(1.5)):
            for statistic in (S.skce_particles(k), S.cgof_particles(k=k)):
                plain = statistic.block(*rows)
                made = [r | statistic.prepare(r) for r in rows]
                assert (S._features(*made, ("points", "y"), 4) is not None) == prepared
                assert all(len(v) == len(r["x"]) for r in made for v in r.values())
                assert np.allclose(statistic.block(*made), plain, rtol=0, atol=1e-10)


def test_blocks_of_pairs_make_few_matrices():
    """Letters that agree are counted by products; the same numbers as place by place, for few letters and for many."""
    rng = np.random.default_rng(6)
    for letters in (3, 10_000):
        a, b = (rng.integers(0, letters, (n, 7)).astype(float) for n in (40, 9))
        b[:5] = a[:5]
        expected = (a[:, None] != b[None]).sum(-1)
        assert (kernels.differences(a, b, 1) == expected).all()
        assert np.allclose(kernels.HammingIMQ(alpha=2.0, beta=0.3).block(a, b), (3.0 / (2.0 + expected)) ** 0.3)


def test_gaussian_models_of_odd_and_even_dimensions():
    """The expectation over two models, whose power of the variance is made by products."""
    rng = np.random.default_rng(7)
    for d in (1, 2, 7, 8):
        m, n, s, t = rng.normal(size=(4, d)), rng.normal(size=(3, d)), rng.uniform(0.2, 2, 4), rng.uniform(0.2, 2, 3)
        v = s[:, None] ** 2 + t**2
        far = ((m[:, None] - n) ** 2).sum(-1)
        assert np.allclose(S._both(m, s, n, t, 1.3), (1 + v / 1.69) ** (-d / 2) * np.exp(-far / (2 * (v + 1.69))), rtol=1e-12)


def particle_models(n, size=0.13, seed=8):
    """Rows with eight particles, a point and a score of four dimensions, of any size."""
    rng = np.random.default_rng(seed)
    return [(i, (size * rng.normal(size=(8, 4))).tolist(), (size * rng.normal(size=4)).tolist(), (size * rng.normal(size=4)).tolist()) for i in range(n)]


def without_tiles(*_):
    raise AssertionError("pairs were made")


@pytest.mark.parametrize("statistic", [S.skce_particles(), S.kccsd_scored(S.exp_mmd_particles(), J.inverse_multiquadric())], ids=["skce_particles", "kccsd_scored"])
def test_products_of_kernels_without_pairs(spark, monkeypatch, statistic):
    """Rows outside the pool too: the sums over all pairs are those of tiles, and no pair is made."""
    rows = spark.createDataFrame(particle_models(900, 0.02), "i long, points array<array<double>>, y array<double>, score array<double>")
    tiled = tiles.complete(rows, statistic, block=64).first()
    monkeypatch.setattr(tiles, "LINEAR", 0)
    monkeypatch.setattr(landmarks, "POOL", 600)
    monkeypatch.setattr(landmarks, "FAR", 100)
    monkeypatch.setattr(tiles, "block_sums", without_tiles)
    found = tiles.complete(rows, statistic, block=64).first()
    assert found["m"] == tiled["m"] == 900 * 899 // 2
    assert found["val"] == pytest.approx(tiled["val"], rel=1e-8, abs=1e-11) and found["mean_h2"] == pytest.approx(tiled["mean_h2"], rel=1e-8)


def test_tiles_where_landmarks_leave_too_much(spark, monkeypatch):
    """Points far apart, or one that is no number: the bound over all rows does not hold, and pairs are made."""
    monkeypatch.setattr(tiles, "LINEAR", 0)
    monkeypatch.setattr(landmarks, "POOL", 40)
    monkeypatch.setattr(landmarks, "FAR", 10)
    wide = particle_models(200, 2.0)
    broken = [*particle_models(199, 0.01), (199, [[float("nan")] * 4] * 8, [0.0] * 4, [0.0] * 4)]
    for made in (wide, broken):
        rows = spark.createDataFrame(made, "i long, points array<array<double>>, y array<double>, score array<double>")
        found = tiles.complete(rows, S.skce_particles(), block=64).first()
        monkeypatch.setattr(tiles, "LINEAR", 1000)
        tiled = tiles.complete(rows, S.skce_particles(), block=64).first()
        monkeypatch.setattr(tiles, "LINEAR", 0)
        assert found["m"] == tiled["m"] and found["val"] == pytest.approx(tiled["val"], nan_ok=True)
    assert np.isnan(found["val"])


def test_landmarks_of_repeated_rows():
    """Equal rows are one landmark, and features give the kernel back."""
    rng = np.random.default_rng(3)
    x = {"x": np.repeat(rng.normal(size=(300, 2)), 2, axis=0)}
    kernel = lambda a, b: kernels.Gaussian(1.0).block(a["x"], b["x"])
    picked = landmarks.pivots(kernel, x)
    assert len({k // 2 for k in picked}) == len(picked) < 300
    space = landmarks.Features(kernel, landmarks.part(x, picked))
    e, own, rest = space.of(x)
    assert np.allclose(e @ e.T, kernel(x, x), atol=1e-7) and np.allclose(own, 1) and rest.mean() < 1e-8
    assert not S.skce_particles(kernel=S.exp_wasserstein()).factors and not S.cgof_particles().factors
    ours = [S.kccsd_scored(S.exp_mmd_particles(), k).factors for k in (J.inverse_multiquadric(beta=0.5), J.combined(J.gaussian(), J.polynomial()), J.gaussian())]
    assert [f is not None for f in ours] == [False, False, True]
