"""Pair sets over rows with a dense index i from 0: bands and neighbours by equi-joins, never a theta join over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.randomness import index


def dense_index(df: DataFrame, *order: str, name: str = "i") -> DataFrame:
    """df with a dense index in the given order: a range partitioning, local numbers, and offsets of one row per partition.

    The order should be total; the numbered rows are checkpointed, since both passes must see the same partitions.
    """
    local = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_k")).checkpoint()
    counts = local.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.withColumn("_o", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return local.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.col("_k")).drop("_p", "_k", "_o")


def dense(df: DataFrame, name: str = "i") -> DataFrame:
    """df, whose column is said to be a dense index; a gap, a repeated number or a null stops the job here, where pairs would be lost without a word.

    One pass over that column. That its numbers are n, n + 1, ... follows from their count, least, largest and sums of first and second powers in all cases but contrived ones.
    """
    i = F.col(name).cast("decimal(38,0)")
    n, known, low, high, total, squares = df.agg(F.count(F.lit(1)), F.count(name), F.min(i), F.max(i), F.sum(i), F.sum(i * i)).first()
    if n:
        whole = known == n and high - low + 1 == n and 2 * int(total) == n * int(low + high)
        power = lambda m: m * (m + 1) * (2 * m + 1) // 6
        if not whole or int(squares) != power(int(high)) - power(int(low) - 1):
            raise ValueError(f"{name} is no dense index of the rows; make one with dense_index")
    return df


def _sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.select(*(F.col(c).alias(f"a_{c}") for c in df.columns)), df.select(*(F.col(c).alias(f"b_{c}") for c in df.columns))


def superdiagonals(df: DataFrame, r: int) -> DataFrame:
    """All pairs with 0 < j - i <= r, as columns a_* and b_*."""
    a, b = _sides(df)
    wide = a.withColumn("_j", F.explode(F.sequence(F.col("a_i") + 1, F.col("a_i") + r)))
    return wide.join(b, F.col("_j") == F.col("b_i")).drop("_j")


def subdiagonals(df: DataFrame, r: int) -> DataFrame:
    """All pairs with 0 < i - j <= r."""
    a, b = _sides(df)
    wide = b.withColumn("_i", F.explode(F.sequence(F.col("b_i") + 1, F.col("b_i") + r)))
    return wide.join(a, F.col("_i") == F.col("a_i")).drop("_i").select(*a.columns, *b.columns)


def both_diagonals(df: DataFrame, r: int) -> DataFrame:
    """All pairs with 0 < |i - j| <= r."""
    return superdiagonals(df, r).unionByName(subdiagonals(df, r))


def adjacent(df: DataFrame) -> DataFrame:
    """The disjoint pairs (2k, 2k + 1); an odd last row is left out. One exchange by k, whose groups have two rows.

    An index that is not dense makes fewer pairs; one that repeats stops the job.
    """
    half = F.shiftright("i", 1)
    both = df.groupBy(half.alias("_k")).agg(F.first(F.when(F.col("i") % 2 == 0, F.struct(*df.columns)), ignorenulls=True).alias("_a"), F.first(F.when(F.col("i") % 2 == 1, F.struct(*df.columns)), ignorenulls=True).alias("_b"), F.count(F.lit(1)).alias("_n"))
    whole = both.filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    whole = whole.filter(F.when(F.col("_n") > 2, F.raise_error(F.lit("an index of rows repeats"))).otherwise(True))
    return whole.select(*(F.col(f"_{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in df.columns))


def drawn(df: DataFrame, n: int, cap: int, seed: int) -> DataFrame:
    """At most cap different pairs i < j, drawn by hashes; linear in cap however many pairs there are.

    Draws with i = j are left out, and of equal pairs one stays, so a little under cap pairs come back.
    """
    spark = df.sparkSession
    k = F.col("id")
    ij = spark.range(cap).select(index(seed, F.lit(n), k, F.lit("i")).alias("x"), index(seed, F.lit(n), k, F.lit("j")).alias("y")).filter("x <> y")
    ij = ij.select(F.least("x", "y").alias("a_i"), F.greatest("x", "y").alias("b_i")).distinct()
    a, b = _sides(df)
    return ij.join(a, "a_i").join(b, "b_i")
