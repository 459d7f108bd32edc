"""Sharding of indivisible groups by Karmarkar-Karp differencing.

Documents with equal texts are one group and stay together. Differencing combines the two partial partitions with the largest
spread, the fullest part of one with the emptiest of the other, until one partial partition is left. Light groups are differenced in
hash buckets of about BUCKET groups, a task each and as many as it takes, where every shard's heavy load takes part with the
bucket's share of it, so that light groups fill what heavy ones leave. Heavy groups, those that reach a quarter of a bucket's fair
share of a shard, are at most 64 for each bucket; they are sharded in the same way first, down to a level that is one bucket.

Cases: the law is `bytes`; a null text counts as no bytes (size 1) and groups with the empty text; repeated rows are rows of
their own; null ids are kept; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, fields, join_spread, prepared, stored

SHARDS, BUCKET = 16, 20_000


def difference(vectors: list[list[tuple[int, object]]], shards: int) -> list[tuple[int, object]]:
    """Combines partial partitions to one: a partial partition is a list of at most `shards` (size, members), members a nested pair."""
    heap = []
    for k, parts in enumerate(vectors):
        parts = sorted(parts, key=lambda x: -x[0])
        low = parts[-1][0] if len(parts) == shards else 0
        heap.append((low - parts[0][0], k, parts))
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        a = a + [(0, None)] * (shards - len(a))
        b = [(0, None)] * (shards - len(b)) + b[::-1]
        both = [(x + y, (m, n) if m is not None and n is not None else m if n is None else n) for (x, m), (y, n) in zip(a, b, strict=True)]
        both.sort(key=lambda x: -x[0])
        low = both[-1][0]
        while both and both[-1][1] is None:
            both.pop()
        count += 1
        heapq.heappush(heap, ((low if len(both) == shards else 0) - both[0][0], count, both))
    return heap[0][2] if heap else []


def members(tree) -> Iterator[int]:
    """The leaves of nested pairs."""
    stack = [] if tree is None else [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack.extend(x)
        else:
            yield x


def shard_groups(groups: DataFrame, shards: int = SHARDS, bucket: int = BUCKET) -> DataFrame:
    """(key, shard) of groups(key, size): one row per key, sizes at least 0. groups is read several times, so it should be stored."""
    n, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, -(-n // bucket))
    schema = T.StructType([groups.schema["key"], *fields("shard int")])
    load, light, heavy = [0] * shards, groups, None
    if buckets > 1:
        # At most 4 * shards * buckets groups can be this large, and at most a quarter of all.
        limit = max(1, -(-int(total) // (4 * shards * buckets)), -(-4 * int(total) // n))
        large, light = groups.filter(F.col("size") >= limit), groups.filter(F.col("size") < limit)
        if not large.isEmpty():
            large = stored(large, "heavy")
            heavy = stored(shard_groups(large, shards, bucket), "placed")
            for r in heavy.join(large, "key").groupBy("shard").agg(F.sum("size").alias("n")).collect():  # a row per shard
                load[r["shard"]] = int(r["n"])
    whole = int(total) - sum(load) or 1

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "key"], ascending=[False, True], ignore_index=True)
        share = int(frame["size"].sum())
        start = [[(n, k)] for k, n in enumerate(frame["size"].tolist())]
        # Each shard is a part of one partial partition, marked by a negative leaf; parts of one partition never meet.
        start.append([(x * share // whole, -1 - s) for s, x in enumerate(load)])
        shard = np.zeros(len(frame), np.int32)
        for _, tree in difference(start, shards):
            at = list(members(tree))
            shard[[x for x in at if x >= 0]] = next(-1 - x for x in at if x < 0)
        return pd.DataFrame({"key": frame["key"], "shard": shard})

    dealt = light.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    placed = dealt.groupBy("bucket").applyInPandas(one, schema)
    return placed if heavy is None else placed.unionByName(heavy)


def with_slots(rows: DataFrame, group: str) -> DataFrame:
    """rows with slot: gapless from 0 within each value of the integer column group.

    Each task numbers its own rows by group; the table is stored, the counts of each task and group are summed up to offsets,
    and the offsets joined back, so no group is ever gathered in one task.
    """
    schema = T.StructType([*rows.schema.fields, *fields("_task long, _local long")])
    at = rows.columns.index(group)

    def make():
        seen: dict[int, int] = {}
        task = TaskContext.get().partitionId()

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            g = batch.column(at).to_numpy(zero_copy_only=False)
            order = np.argsort(g, kind="stable")
            values, first, counts = np.unique(g[order], return_index=True, return_counts=True)
            local = np.empty(len(g), np.int64)
            base = np.array([seen.get(int(v), 0) for v in values], np.int64)
            local[order] = np.arange(len(g)) - np.repeat(first - base, counts)
            seen.update({int(v): int(b + c) for v, b, c in zip(values, base, counts, strict=True)})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(g), task)), pa.array(local)], schema.names)

        return each

    numbered = stored(arrow_map(rows, make, schema), "numbered")
    counts = numbered.groupBy(F.col(group).alias("_group"), F.col("_task").alias("_from")).agg(F.count(F.lit(1)).alias("n"))
    # A row per task and group: summing up within a group handles as many rows as there are tasks.
    offsets = counts.withColumn("_offset", F.sum("n").over(Window.partitionBy("_group").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    joined = numbered.join(offsets, (F.col(group) == F.col("_group")) & (F.col("_task") == F.col("_from")))
    return joined.withColumn("slot", F.coalesce("_offset", F.lit(0)) + F.col("_local")).drop("_task", "_local", "_group", "_from", "_offset")


def shard_documents(docs: DataFrame, shards: int = SHARDS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    prepared(docs.sparkSession)
    raw = F.coalesce(docs["text"].cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(docs["doc_id"].alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("key"))
    rows = stored(rows, "sizes")
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")), "groups")
    where = stored(shard_groups(groups.select("key", "size"), shards, bucket).join(groups.select("key", "rows"), "key"), "placed")
    placed = join_spread(rows, where, ["key"], "shard", "rows", F.xxhash64("doc_id")).select("doc_id", "size", "text_crc32", "shard")
    return with_slots(placed, "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
