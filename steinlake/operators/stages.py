"""Stages kept on disk: a stage whose inputs, parameters and version are those of an earlier run is read and not computed.

A stage's key is a hash of what its result depends on: its name and version, its parameters, the analysed plans of its inputs (with the numbers of
expressions taken out), and the path, length and time of every file that the inputs read. A change of any of these is another key. Functions in Python are
opaque to a plan, so a stage that uses one names its version. A result counts once Spark has committed it (_SUCCESS); what a killed
run left half-written is written again.

Two forms: `stage` keeps a whole table. `batches` keeps a table in parts by batch, each part committed for itself: a run that stopped goes on
with the batches that are missing, a batch that comes again is not added twice, and the rows of committed batches are not even read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def plan_text(df: DataFrame) -> str:
    """The analysed plan, without what differs between equal plans: numbers of expressions, plans and lambda variables."""
    text = df._jdf.queryExecution().analyzed().canonicalized().toString()
    return re.sub(r"#\d+L?|\b(?:plan_id|x|y|z)_?\d+\b", "", text)


def file_versions(df: DataFrame) -> list[tuple[str, int, int]]:
    """(path, length, modified) of every file that a DataFrame reads, by path."""
    spark = df.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    out = []
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((name, int(status.getLen()), int(status.getModificationTime())))
    return out


class StageCache:
    """Results of stages under a folder of the shared file system (by default `stages` in the checkpoint folder)."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/stages"

    def key(self, name: str, inputs: list[DataFrame], params: dict | None = None, version: str = "1") -> str:
        told = [name, version, params or {}, [(plan_text(df), file_versions(df)) for df in inputs]]
        return f"{name}-{hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()[:32]}"

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def committed(self, path: str) -> bool:
        return self._exists(f"{path}/_SUCCESS")

    def stage(self, name: str, build: Callable[..., DataFrame], inputs: list[DataFrame], params: dict | None = None, version: str = "1") -> DataFrame:
        """build(*inputs, **params), or what an earlier run made of the same."""
        path = f"{self.folder}/{self.key(name, inputs, params, version)}"
        if not self.committed(path):
            build(*inputs, **(params or {})).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def batches(self, name: str, build: Callable[..., DataFrame], source: DataFrame, batch: Column, count: int, params: dict | None = None, version: str = "1") -> DataFrame:
        """build(rows of a batch, **params) of every batch 0 .. count - 1, in parts; batch gives a row's number.

        build must treat rows, or groups within a batch, for themselves. A batch's key holds the source's plan and files, so a part
        is of this source only.
        """
        path = f"{self.folder}/{self.key(name, [source], (params or {}) | {'batches': count}, version)}"
        for b in self.missing(path, count):
            build(source.filter(batch == b), **(params or {})).write.mode("overwrite").parquet(f"{path}/batch={b}")
        return self.spark.read.option("basePath", path).parquet(*(f"{path}/batch={b}" for b in range(count)))

    def missing(self, path: str, count: int) -> list[int]:
        return [b for b in range(count) if not self.committed(f"{path}/batch={b}")]


def append_new(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Appends to a Parquet log the rows whose keys it does not have yet, once each, and returns how many these are.

    A batch that is written again adds nothing. Of rows with equal keys in one batch any one is kept.
    """
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    new = rows.dropDuplicates(keys)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        new = new.join(spark.read.schema(rows.schema).parquet(path).select(*keys), keys, "left_anti")
    new = new.checkpoint()  # counted and written from one evaluation
    n = new.count()
    if n:
        new.select(*rows.columns).write.mode("append").parquet(path)
    return n


def hash_batch(count: int, *columns: str) -> Column:
    """A row's batch by a hash of its key."""
    return F.pmod(F.xxhash64(*columns), F.lit(count)).cast("int")
