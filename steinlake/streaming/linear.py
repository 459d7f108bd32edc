"""A linear-time statistic kept up to date over a stream: sums of h and h^2, a count, and rows whose neighbour has not come yet.

Neighbours are rows 2k and 2k + 1. A row whose neighbour is not in its micro-batch is carried to the next one, so results do not
depend on where batches are cut; at most the rows that still wait are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import null, pairs
from ..operators.statistics import Statistic


def unpaired(rows: DataFrame) -> DataFrame:
    """The rows whose neighbour is not among them."""
    pair = F.floor(F.col("i") / 2)
    alone = rows.groupBy(pair.alias("_pair")).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("_pair")
    return rows.withColumn("_pair", pair).join(alone, "_pair", "left_semi").drop("_pair")


def batch_sums(rows: DataFrame, statistic: Statistic) -> DataFrame:
    """One row of sums of a micro-batch: its disjoint neighbours by the index i."""
    h = pairs.adjacent(rows).select(statistic.expr().alias("h"))
    return h.agg(F.count("h").alias("m"), F.coalesce(F.sum("h"), F.lit(0.0)).alias("sum_h"), F.coalesce(F.sum(F.col("h") * F.col("h")), F.lit(0.0)).alias("sum_h2"))


def start(stream: DataFrame, statistic: Statistic, path: str, checkpoint: str):
    """Writes each micro-batch's sums and waiting rows under its number, so that a repeated batch replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        rows = batch
        if number > 0:
            rows = batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}-waiting/batch={number - 1}"))
        rows = rows.persist()  # a batch is bounded by its source, and read for sums and for what waits
        batch_sums(rows, statistic).write.mode("overwrite").parquet(f"{path}/batch={number}")
        unpaired(rows).write.mode("overwrite").parquet(f"{path}-waiting/batch={number}")
        rows.unpersist()
        if number > 1:  # the batch before may be repeated, and needs the one before itself
            _remove(batch.sparkSession, f"{path}-waiting/batch={number - 2}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def _remove(spark, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def current(spark, path: str, alpha: float = 0.05) -> DataFrame:
    """The test's result over all batches so far."""
    s = spark.read.parquet(path).agg(F.sum("m").alias("m"), F.sum("sum_h").alias("a"), F.sum("sum_h2").alias("b"))
    q = null.analytic_quantile(alpha, F.col("b") / F.col("m"), F.col("m"))
    return s.select("m", (F.col("a") / F.col("m")).alias("val"), q.alias("quantile"), (F.col("a") / F.col("m") > q).alias("reject"))
