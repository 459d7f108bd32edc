"""Metrics of model outputs and summaries of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def masked_mean(value: Column, mask: Column) -> Column:
    """Sum of masked values over the sum of the mask; null without any."""
    return F.sum(F.when(mask, value)) / F.sum(F.when(mask, 1))


def perplexity(loss: Column, mask: Column) -> Column:
    return F.exp(masked_mean(loss, mask))


def smoothed_loss(loss: Column, mean_loss: Column, weight: float) -> Column:
    """Label-smoothed loss from the loss of the true letter and the mean loss of all letters."""
    return (1 - weight) * loss + weight * mean_loss


def recovery(native: Column, sample: Column, unknown: str = "X") -> Column:
    """Share of places where two equally long strings agree, without those whose native letter is unknown."""
    pairs = F.filter(F.arrays_zip(F.split(native, "").alias("a"), F.split(sample, "").alias("b")), lambda p: (p["a"] != unknown) & (p["a"] != ""))
    return F.size(F.filter(pairs, lambda p: p["a"] == p["b"])) / F.when(F.size(pairs) > 0, F.size(pairs))


def binomial_error(p: Column, n: Column) -> Column:
    return F.sqrt(p * (1 - p) / n)


def group_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mean, std, n): mean and sample standard deviation."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def pivot_summary(df: DataFrame, key: str, by: str, names: list, value: str) -> DataFrame:
    """One row per key with mean and std columns for each name of `by` (listed, so no extra pass finds them)."""
    return df.groupBy(key).pivot(by, names).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def running_mean(df: DataFrame, group: str, order: list[str], value: str, n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn("running", F.avg(value).over(w))


def label_rollup(df: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Summaries of every prefix of a hierarchy of labels."""
    return df.rollup(*levels).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def label(*levels: str) -> Column:
    """A dotted label of hierarchy levels."""
    return F.concat_ws(".", *(F.col(c).cast("string") for c in levels))


def score_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mean, std, n): mean and population standard deviation, as of scores over decoding orders."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def two_losses(loss: Column, designed: Column, mask: Column) -> tuple[Column, Column]:
    """The mean loss over designed places, and over all places that count."""
    return masked_mean(loss, designed & mask), masked_mean(loss, mask)


def max_normalised(df: DataFrame, value: str) -> DataFrame:
    """df with the value divided by its largest; one scalar is pre-aggregated and broadcast."""
    top = df.agg(F.max(value).alias("_top"))
    return df.crossJoin(F.broadcast(top)).withColumn(value, F.col(value) / F.col("_top")).drop("_top")
