"""Null distributions: wild bootstrap, analytic quantile, p-value and decision."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.randomness import sign


def with_signs(rows: DataFrame, draws: int, seed: str) -> DataFrame:
    """rows(i, ...) with e: the signs of all draws, hashed once per row and not once per pair."""
    return rows.withColumn("e", F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda b: sign(seed, b, F.col("i")).cast("byte")))


def wild_bootstrap(pairs: DataFrame) -> DataFrame:
    """(b, v, val, m): for each draw, the mean of e_i e_j h over pairs(h, a_e, b_e), and the mean and number of h. A partition keeps one sum for each draw."""
    signed = F.zip_with("a_e", "b_e", lambda x, y: x * y)
    wide = pairs.select("h", F.posexplode(signed).alias("b", "e"))
    return wide.groupBy("b").agg(F.avg(F.col("h") * F.col("e")).alias("v"), F.avg("h").alias("val"), F.count("h").alias("m"))


def bootstrap_row(pairs: DataFrame) -> DataFrame:
    """One row (m, val, h0) of the draws in order."""
    draws = F.transform(F.array_sort(F.collect_list(F.struct("b", "v"))), lambda x: x["v"])
    return wild_bootstrap(pairs).agg(F.max("m").alias("m"), F.max("val").alias("val"), draws.alias("h0"))


def analytic_quantile(alpha: float, mean_h2: Column, m: Column) -> Column:
    """Normal quantile of the mean of m independent pairs under the null."""
    return F.lit(NormalDist().inv_cdf(1 - alpha)) * F.sqrt(mean_h2) / F.sqrt(m)


def decide(result: DataFrame, alpha: float) -> DataFrame:
    """A row with val and h0 (array): val, quantile, p_value, p_value_plus1, reject, num_permutations, h0."""
    x = result.withColumn("_sorted", F.array_sort("h0"))
    n = F.size("h0")
    place = (n - 1) * (1 - alpha)
    low = F.floor(place).cast("int")
    at = lambda k: F.get(F.col("_sorted"), F.least(k, n - 1))
    above = F.size(F.filter("h0", lambda v: v > F.col("val")))
    return x.select("m", "val", (at(low) + (at(low + 1) - at(low)) * (place - low)).alias("quantile"), (above / n).alias("p_value"), ((above + 1) / (n + 1)).alias("p_value_plus1"), n.alias("num_permutations"), "h0").withColumn("reject", F.col("val") > F.col("quantile"))


def upper_tail(z: Column, terms: int = 60) -> Column:
    """1 - Phi(z) as a column: the series of Phi around 0 up to |z| = 6, and 0 or 1 beyond, to about 1e-9."""
    x = F.least(F.greatest(z, F.lit(-6.0)), F.lit(6.0))
    # Phi(x) - 1/2 = phi(x) * (x + x^3/3 + x^5/15 + ...), each term x^2 / (2k + 1) times the one before.
    step = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(x.alias("s"), x.alias("t")), lambda a, k: F.struct((a["s"] + a["t"] * x * x / (2 * k + 1)).alias("s"), (a["t"] * x * x / (2 * k + 1)).alias("t")))["s"]
    return F.least(F.greatest(0.5 - F.exp(-x * x / 2) / 2.5066282746310002 * step, F.lit(0.0)), F.lit(1.0))
