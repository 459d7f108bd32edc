"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder, ship

#: Rows and bytes of one Arrow batch: a Python worker holds one at a time, so this bounds its memory with long texts too.
BATCH_ROWS, BATCH_BYTES = 1024, 32 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """The session with this package on its workers, bounded Arrow batches and a checkpoint folder (set only where the cluster names none)."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    shared_folder(spark)
    return spark


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses, with its scheme, so that Spark and other readers mean the same place."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lost executors cost a read, not the work before it."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema) -> DataFrame:
    """mapInArrow with a function made once per task: make() loads what a task needs and returns the batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)

    return df.mapInArrow(run, schema)


def join_spread(rows: DataFrame, few: DataFrame, keys: list[str], value: str, n: str, by: F.Column, hot: int = 1_000) -> DataFrame:
    """rows, and few's value for their keys, or null. few, a stored table, has one row for each key and in column n how many rows have it.

    Keys of more than `hot` rows, and of more than a hundred-thousandth of all, are answered by broadcast: at most 100,000 keys.
    Their rows are then dealt out by `by`, so that no key gathers more rows than those.
    """
    limit = max(hot, int(few.agg(F.sum(n)).first()[0] or 0) // 100_000)
    often = few.filter(F.col(n) > limit).select(*keys, F.struct(F.col(value).alias("v")).alias("_often"))
    rest = few.filter(F.col(n) <= limit).select(*keys, F.col(value).alias("_rest"), F.lit(0).alias("_salt"))
    known = rows.join(F.broadcast(often), keys, "left")
    known = known.withColumn("_salt", F.when(F.col("_often").isNotNull(), F.pmod(by, F.lit(9973)) + 1).otherwise(0).cast("int"))
    joined = known.join(rest, [*keys, "_salt"], "left").withColumn(value, F.when(F.col("_often").isNotNull(), F.col("_often.v")).otherwise(F.col("_rest")))
    return joined.drop("_often", "_rest", "_salt")


_KINDS = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def fields(text: str) -> T.StructType:
    """A schema of simple columns, "name kind, name kind", that needs no session (workers load it too)."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in text.split(", "))])


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
