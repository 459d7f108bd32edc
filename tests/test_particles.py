"""Samplers by their moments, chi-square forms against draws, and the external-model interface."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from steinlake.functions import chi_square as X
from steinlake.operators import particles


def test_chi_square_values():
    assert X.chi2_cdf(np.array([0.454936423]), 1)[0] == pytest.approx(0.5, abs=1e-8)
    assert X.chi2_cdf(np.array([2 * np.log(2)]), 2)[0] == pytest.approx(0.5, abs=1e-12)
    assert X.noncentral_cdf(np.array([3.0]), 4, 0.0)[0] == pytest.approx(X.chi2_cdf(np.array([3.0]), 4)[0])
    draws = ((np.random.default_rng(1).normal(size=(400_000, 3)) + [2.0, 0.0, 0.0]) ** 2).sum(1)
    assert X.noncentral_cdf(np.array([6.0]), 3, 4.0)[0] == pytest.approx((draws <= 6).mean(), abs=3e-3)


def test_median_distance_against_draws(spark):
    rng = np.random.default_rng(2)
    mp, mq, sp, sq = np.zeros(3), np.array([2.0, 1.0, 0.0]), 0.5, 1.5
    which = rng.random((2, 300_000)) < 0.5
    z = [np.where(w[:, None], mp + sp * rng.normal(size=(300_000, 3)), mq + sq * rng.normal(size=(300_000, 3))) for w in which]
    expected = np.median(np.sqrt(((z[0] - z[1]) ** 2).sum(1)))
    got = spark.range(1).select(X.gaussian_median(F.lit(3), F.lit(sp), F.lit(sq), F.lit(5.0))).first()[0]
    assert got == pytest.approx(expected, rel=5e-3)


def models(spark):
    return spark.createDataFrame([(i, [1.0, -2.0], 0.5) for i in range(40)], "i long, mu array<double>, s double")


def test_gaussian_particles(spark):
    rows = models(spark)
    p = {r.i: np.array(r.points) for r in particles.gaussian_particles(rows, 50, "a").collect()}
    allp = np.concatenate(list(p.values()))
    assert allp.mean(0) == pytest.approx([1.0, -2.0], abs=0.05) and allp.std(0) == pytest.approx([0.5, 0.5], abs=0.05)
    again = {r.i: np.array(r.points) for r in particles.gaussian_particles(rows.repartition(7), 50, "a").collect()}
    assert all(np.array_equal(p[i], again[i]) for i in p) and not np.array_equal(p[0], p[1])
    wide = particles.as_rows(particles.gaussian_particles(rows, 5, "a"))
    assert wide.count() == 200 and wide.agg(F.sum("w")).first()[0] == pytest.approx(40)


@pytest.mark.parametrize("adjusted", [True, False])
def test_langevin_particles(spark, adjusted):
    density = lambda x, v: -(((x - v[0]) ** 2).sum()) / (2 * v[1] ** 2)
    gradient = lambda x, v: -(x - v[0]) / v[1] ** 2
    got = particles.langevin_particles(models(spark), ["mu", "s"], density, gradient, 2, 20, "b", step=0.02, warm_up=150, adjusted=adjusted)
    allp = np.concatenate([np.array(r.points) for r in got.collect()])
    assert allp.mean(0) == pytest.approx([1.0, -2.0], abs=0.08) and allp.std(0) == pytest.approx([0.5, 0.5], abs=0.08)


def test_autoregressive_particles(spark):
    rows = spark.createDataFrame([(i, 0.3) for i in range(30)], "i long, p double")
    law = lambda prefix, v: np.array([v[0], v[0], 1 - 2 * v[0]])
    got = particles.autoregressive_particles(rows, ["p"], law, 20, 2, 100, "c").collect()
    lengths = [len(s) for r in got for s in r.sequences]
    assert np.mean(lengths) == pytest.approx(0.6 / 0.4, abs=0.1) and {t for r in got for s in r.sequences for t in s} == {0, 1}


def test_external_model_gives_failing_rows_as_nulls(spark):
    def load():
        def model(f: pd.DataFrame) -> pd.DataFrame:
            if (f["i"] == 3).any():
                raise ValueError("bad row")
            return pd.DataFrame({"i": f["i"], "nll": f["i"] * 0.5})

        return model

    got = particles.external(spark.range(6).withColumnRenamed("id", "i"), load, "i long, nll double").collect()
    assert {r.i: r.nll for r in got} == {i: None if i == 3 else i * 0.5 for i in range(6)}


def test_median_distance_of_many_rows(spark):
    """Each row as alone, whatever rows share its batch; models far apart; null parts give null."""
    rows = [(8, 0.5, 0.7, 4.0), (8, 1.4, 0.5, 0.0), (3, 0.2, 0.3, 9.0), (3, 0.1, 0.1, 36.0), (3, None, 0.3, 9.0)]
    out = spark.createDataFrame(rows, "d int, p double, q double, g double").coalesce(1).select(X.gaussian_median(*(F.col(c) for c in "dpqg"))).collect()
    for row, r in zip(rows[:4], out):
        assert r[0] == pytest.approx(float(X.median_distance(row[0], *(np.array([v]) for v in row[1:]))[0]), rel=1e-9)
    assert out[4][0] is None or np.isnan(out[4][0])
    rng = np.random.default_rng(3)
    side = lambda: rng.normal(size=(200_000, 3)) * 0.1 + np.where(rng.random((200_000, 1)) < 0.5, 0.0, 6 / np.sqrt(3))
    far = np.sqrt(((side() - side()) ** 2).sum(1))
    assert (far <= out[3][0]).mean() == pytest.approx(0.5, abs=0.005)
