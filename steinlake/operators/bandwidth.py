"""Bandwidths: exact medians and quantiles of distances over pairs.

Distances are computed once and stored. Wanted ranks are bracketed by a mergeable quantile sketch (percentile_approx) and then found by
counting: what lies strictly between the two ends of a bracket is a few ten-thousandths of all, so one more round, at most, leaves
SORTED distances to sort. The sketch decides only how much is counted, never the result. Order: -inf, finite numbers, inf, NaN.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import sqdist
from ..functions.chi_square import gaussian_median
from ..functions.kernels import Gaussian
from ..session import shared_folder
from .statistics import ModelKernel, exp_mmd, exp_mmd_particles

#: Distances that may be sorted in one place, and the sketch's accuracy (its error in ranks is one of so many).
SORTED, ACCURACY = 100_000, 10_000


def _runs(ranks: list[int]) -> list[list[int]]:
    """Neighbouring ranks together: they share a bracket."""
    out: list[list[int]] = []
    for r in ranks:
        if out and r - out[-1][-1] <= 1:
            out[-1].append(r)
        else:
            out.append([r])
    return out


def _ranked(values: DataFrame, n: int, ranks: list[int]) -> dict[int, float]:
    """rank (from 0, ascending) -> value, of n finite values(d)."""
    if not ranks:
        return {}
    if n <= SORTED:
        d = F.array_sort(F.collect_list("d"))
        return dict(zip(ranks, values.agg(d.alias("d")).select(*(F.get("d", r) for r in ranks)).first(), strict=True))
    room = 2 * -(-n // ACCURACY) + 1
    runs = _runs(ranks)
    marks = values.agg(F.percentile_approx("d", [min(max(x / n, 0.0), 1.0) for run in runs for x in (run[0] - room, run[-1] + 1 + room)], ACCURACY)).first()[0]
    ends = list(zip(marks[::2], marks[1::2], strict=True))
    counts = values.agg(*(F.count_if(c) for low, high in ends for c in (F.col("d") < low, F.col("d") == low, (F.col("d") > low) & (F.col("d") < high), (F.col("d") == high) & F.lit(low != high)))).first()
    found: dict[int, float] = {}
    for k, (run, (low, high)) in enumerate(zip(runs, ends, strict=True)):
        below, at_low, between, at_high = counts[4 * k : 4 * k + 4]
        first, last, end = below + at_low, below + at_low + between, below + at_low + between + at_high
        found |= {r: low for r in run if below <= r < first} | {r: high for r in run if last <= r < end}
        # Each of these holds fewer values than all, as low and high are values too.
        for part, size, begin, mine in (
            (F.col("d") < low, below, 0, [r for r in run if r < below]),
            ((F.col("d") > low) & (F.col("d") < high), between, first, [r for r in run if first <= r < last]),
            (F.col("d") > high, n - end, end, [r for r in run if r >= end]),
        ):
            found |= {r + begin: v for r, v in _ranked(values.filter(part), size, [r - begin for r in mine]).items()}
    return found


def exact_quantiles(values: DataFrame, quantiles: list[float]) -> list[float | None]:
    """The quantiles of values(d), with linear interpolation between ranks, in one evaluation of the distances; None without values.

    Nulls are left out; infinities and NaN take the ranks that they have in Spark's order. This runs at once, and scalars cross the driver.
    """
    shared_folder(values.sparkSession)
    d = values.select(F.col("d").cast("double").alias("d")).filter("d is not null").checkpoint()
    inf = float("inf")
    few = d.limit(SORTED + 1).toPandas()["d"].to_numpy()
    if len(few) <= SORTED:  # all of them
        few = np.sort(few)  # NaN last
        n, at = len(few), lambda r: float(few[r])
        return [None if not n else _between(at, (n - 1) * q) for q in quantiles]
    finite = ~F.isnan("d") & (F.abs("d") < inf)
    n, below, inside, above = d.agg(F.count("d"), F.count_if(F.col("d") == -inf), F.count_if(finite), F.count_if(F.col("d") == inf)).first()
    places = [(n - 1) * q for q in quantiles]
    ranks = sorted({r for p in places for r in (int(p), int(p) + (p > int(p)))})
    found = {r: -inf if r < below else inf if r < below + inside + above else float("nan") for r in ranks}
    found |= {r + below: v for r, v in _ranked(d.filter(finite), inside, [r - below for r in ranks if below <= r < below + inside]).items()}
    return [_between(found.__getitem__, p) for p in places]


def _between(at: Callable[[int], float], place: float) -> float:
    """The value at a place between two ranks."""
    low = int(place)
    a, b = at(low), at(low + (place > low))
    return a if a == b or place == low else a + (b - a) * (place - low)


def exact_quantile(values: DataFrame, q: float = 0.5) -> DataFrame:
    """(sigma): one quantile of values(d) as in exact_quantiles; null without values."""
    return values.sparkSession.createDataFrame([(exact_quantiles(values, [q])[0],)], "sigma double")


def distance_quantile(pairs: DataFrame, distance: Column, q: float = 0.5) -> DataFrame:
    """(sigma): the exact quantile, with linear interpolation, of a distance over pairs."""
    return exact_quantile(pairs.select(distance.alias("d")), q)


def gaussian_bandwidth(pairs: DataFrame, column: str = "x", q: float = 0.5) -> DataFrame:
    return distance_quantile(pairs, F.sqrt(sqdist(f"a_{column}", f"b_{column}")), q)


def union_distances(pairs: DataFrame) -> DataFrame:
    """(d): the four distances of x and y of two rows, as for the union of both samples."""
    sides = [(f"{s}_{n}", f"{t}_{m}") for s, n, t, m in (("a", "x", "b", "x"), ("a", "y", "b", "y"), ("a", "x", "b", "y"), ("b", "x", "a", "y"))]
    return pairs.select(F.explode(F.array(*(F.sqrt(sqdist(x, y)) for x, y in sides))).alias("d"))


def median_of_medians(pairs: DataFrame, inner: float = 0.5, outer: float = 0.5) -> DataFrame:
    """(sigma): for particle models, the quantile over pairs of rows of the quantile over their particles' distances.

    A pair has a bounded number of particle pairs, so its own quantile is sorted in place.
    """
    d = F.array_sort(F.flatten(F.transform("a_points", lambda v: F.transform("b_points", lambda w: F.sqrt(sqdist(v, w))))))
    n = F.size("d")
    place = (n - 1) * inner
    low = F.floor(place).cast("int")
    at = lambda k: F.get(F.col("d"), F.least(k, n - 1))
    inner_quantiles = pairs.select(d.alias("d")).select((at(low) + (at(low + 1) - at(low)) * (place - low)).alias("d"))
    return exact_quantile(inner_quantiles, outer)


def tuned(kernel: ModelKernel, pairs: DataFrame, q: float = 0.5) -> ModelKernel:
    """The kernel with the quantile of its distances over pairs as sigma; that scalar crosses the driver."""
    distance = F.sqrt(F.greatest(kernel.squared(), F.lit(0.0)))
    return replace(kernel, sigma=distance_quantile(pairs, distance, q).first()[0])


def tuned_on_particles(pairs: DataFrame, q: float = 0.5) -> tuple[Gaussian, ModelKernel]:
    """Both bandwidths of the exponential discrepancy of particle models: the kernel on points first, then that on models."""
    ground = Gaussian(median_of_medians(pairs, q, q).first()[0])
    return ground, tuned(exp_mmd_particles(ground), pairs, q)


def gaussian_models_bandwidth(pairs: DataFrame, q: float = 0.5) -> DataFrame:
    """(sigma): for Gaussian models, the quantile over pairs of rows of the median distance under the equal mixture of both."""
    d = gaussian_median(F.size("a_mu"), F.col("a_s"), F.col("b_s"), sqdist("a_mu", "b_mu"))
    return exact_quantile(pairs.select(d.alias("d")), q)


def tuned_on_gaussians(pairs: DataFrame, q: float = 0.5) -> tuple[Gaussian, ModelKernel]:
    """Both bandwidths of the exponential discrepancy of Gaussian models: the kernel on points first, then that on models."""
    ground = Gaussian(gaussian_models_bandwidth(pairs, q).first()[0])
    return ground, tuned(exp_mmd(ground.sigma), pairs, q)
