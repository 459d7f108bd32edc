"""Exact top-k by inner product as a Voronoi kNN join.

Vectors are grouped by their nearest pivot: about sqrt(n) / 2 rows, at most PIVOTS, chosen by a hash of the id. A summary of each
group holds its k + 1 longest vectors, at most SUMMARY bytes in all. Scores with these give every query a score that its k-th
best reaches at least. The queries of a group have a radius r around their pivot p and a least such score; a vector v can be of use to
them only if p . v + r |v|, which no query of the group exceeds, reaches that. So each vector is sent to the groups of queries that need it, and to
no other. Small groups of queries that lie near each other are gathered to sets of about BLOCK queries, and crowded ones, as one vector
repeated many times, are cut; a set's vectors are dealt out in parts of at most about BLOCK, which the set's queries all
meet. Every part returns its best k scores that reach a query's least, and the final ranking of a query sees only those.

Components are floor(64 * x), scores are integers: sums are exact in doubles up to 2**53, computed in 64-bit integers
beyond, and in Python's integers where a sum may pass those. A component or a score of the result that no 64-bit integer holds stops the job.

Cases: vectors that are null or hold a null or non-finite component take no part, nor do rows without an id; a shorter vector
is filled up with zeros; repeated rows of one query id are one query (the least of its vectors by bytes); a query meets every row but those with its own id;
repeated candidate rows are candidates each; no queries, or no other row, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, fields, prepared, stored
from .vectors import integers, sound

K, PIVOTS, BLOCK, SUMMARY = 20, 4096, 20_000, 24 << 20


def quantised(rows: DataFrame, query: F.Column) -> DataFrame:
    """(vec_id, query, v): v holds the integer components, all of the largest dimension."""
    whole = sound(rows, {"vec_id": rows["vec_id"].cast("long"), "query": F.coalesce(query, F.lit(False))}).filter(F.col("vec_id").isNotNull())
    dims = whole.agg(F.max(F.size("x"))).first()[0] or 0
    schema = fields("vec_id long, query boolean, v binary")

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            flat, ends = integers(batch.column(2), 64.0)
            full = np.zeros((batch.num_rows, dims), np.int64)
            size = np.diff(ends)
            full[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(ends[:-1], size)] = flat
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([x.tobytes() for x in full], pa.binary())], schema.names)

        return each

    return arrow_map(whole, make, schema)


def matrix(col, kind=np.int64) -> np.ndarray:
    col = list(col)
    return np.frombuffer(b"".join(col), np.int64).reshape(len(col), -1).astype(kind)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; Python's integers where 64 bits may not do."""
    top = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, a.shape[1])
    if top < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T if top < 2**62 else a.astype(object) @ b.T.astype(object)


def gathered(points: np.ndarray, homes: np.ndarray, counts: np.ndarray, block: int) -> dict[int, tuple[int, int]]:
    """home -> (first set, sets): groups of queries in an order that keeps near pivots together, gathered or cut to about `block` queries a set."""
    if not len(homes):
        return {}
    p = points[homes]
    few = p[:: max(1, int(len(p) ** 0.5))]
    near = ((p * p).sum(axis=1)[:, None] - 2 * p @ few.T + (few * few).sum(axis=1)).argmin(axis=1)
    out, now, held = {}, 0, 0
    for k in np.lexsort((homes, near)):
        n = int(counts[k])
        if held and held + n > block:
            now, held = now + 1, 0
        sets = -(-n // block)
        out[int(homes[k])] = (now, sets)
        now, held = (now + sets, 0) if sets > 1 else (now, held + n)
    return out


def placed_queries(queries: DataFrame, shared, tops: np.ndarray, k: int) -> DataFrame:
    """(query_id, v, home, far, least) of queries(query_id, v): the nearest pivot, the distance from it, and a score that the k-th best reaches."""
    spark = queries.sparkSession
    best = spark.sparkContext.broadcast(tops)

    def make():
        p, t = shared.value, best.value
        half = (p * p).sum(axis=1) / 2
        as_float = t.astype(float)

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            v = batch.column(1).to_pylist()
            x = matrix(v, float)
            exact = float(np.abs(x).max(initial=0)) * float(np.abs(as_float).max(initial=0)) * max(1, x.shape[1]) < 2**53
            home = (x @ p.T - half).argmax(axis=1)
            far = np.sqrt(((x - p[home]) ** 2).sum(axis=1))
            least = np.full(len(x), np.iinfo(np.int64).min)
            if len(t) > k:  # the query itself may be one of them
                for a in range(0, len(x), 64):
                    scores = x[a : a + 64] @ as_float.T if exact else products(matrix(v[a : a + 64]), t)
                    kth = np.sort(scores, axis=1)[:, len(t) - k - 1] if scores.dtype == object else np.partition(scores, len(t) - k - 1, axis=1)[:, len(t) - k - 1]
                    # A bound may be lower than it could be, so one beyond 64 bits is cut down to them.
                    least[a : a + 64] = [min(int(s), 2**63 - 1) if s > -(2**63) else -(2**63) for s in kth]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(far), pa.array(least)], ["query_id", "v", "home", "far", "least"])

        return each

    return arrow_map(queries, make, fields("query_id long, v binary, home int, far double, least long"))


def needed(vectors: DataFrame, shared, groups: np.ndarray, radius: np.ndarray, least: np.ndarray, sets: np.ndarray, n_sets: int) -> DataFrame:
    """(q_set, vec_id, v, turn): each vector once for every set of queries that it can be of use to; turn counts a task's rows.

    sets: a row (group, set) for each group's sets.
    """
    told = vectors.sparkSession.sparkContext.broadcast((groups, radius, least.astype(float), sets))

    def make():
        p = shared.value
        g, r, low, of = told.value
        p = p[g]
        member = np.zeros((len(g), n_sets), np.float32)
        member[of[:, 0], of[:, 1]] = 1
        turn = 0

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal turn
            x = matrix(batch.column(1).to_pylist(), float)
            reach = x @ p.T + np.sqrt((x * x).sum(axis=1))[:, None] * r
            # The bounds are rounded, so they get a little room.
            to = reach + np.abs(reach) * 1e-9 + 1e-6 >= low
            row, q_set = np.nonzero(to.astype(np.float32) @ member)
            for a in range(0, len(row), 8192):
                at = pa.array(row[a : a + 8192])
                yield pa.RecordBatch.from_arrays([pa.array(q_set[a : a + 8192].astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.arange(turn, turn + len(at)))], ["q_set", "vec_id", "v", "turn"])
                turn += len(at)

        return each

    return arrow_map(vectors, make, fields("q_set int, vec_id long, v binary, turn long"))


def knn_join(rows: DataFrame, query: F.Column, k: int = K, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows, ties to the smaller vec_id."""
    spark = prepared(rows.sparkSession)
    vectors = stored(quantised(rows, query), "vectors")
    n, wide = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.length("v")), F.lit(8))).first()
    most = max(1, min(pivots, int(n**0.5) // 2, SUMMARY // (max(wide, 8) * (k + 1))))
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("v").collect()  # at most `pivots` rows
    points = np.unique(matrix(r["v"] for r in chosen), axis=0).astype(float) if chosen else np.zeros((1, 0))
    shared = spark.sparkContext.broadcast(points)

    def longest():
        p = shared.value
        half = (p * p).sum(axis=1) / 2

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            x = matrix(batch.column(1).to_pylist(), float)
            home, norm = (x @ p.T - half).argmax(axis=1), (x * x).sum(axis=1)
            order = np.lexsort((-norm, home))
            place = np.arange(len(order)) - np.searchsorted(home[order], home[order])
            at = order[place <= k]  # of a batch, each group's k + 1 longest
            yield pa.RecordBatch.from_arrays([pa.array(home[at].astype(np.int32)), pa.array(norm[at]), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], ["home", "norm", "vec_id", "v"])

        return each

    top = arrow_map(vectors.select("vec_id", "v"), longest, fields("home int, norm double, vec_id long, v binary"))
    rank = F.row_number().over(Window.partitionBy("home").orderBy(F.desc("norm"), "vec_id"))
    tops = [r["v"] for r in top.withColumn("rank", rank).filter(F.col("rank") <= k + 1).select("v").collect()]  # at most SUMMARY bytes
    if not tops:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries = vectors.filter("query").select(F.col("vec_id").alias("query_id"), "v").groupBy("query_id").agg(F.min("v").alias("v"))
    queries = stored(placed_queries(queries, shared, matrix(tops), k), "queries")
    # One row per pivot that has queries.
    summary = queries.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.min("least").alias("least")).orderBy("home").toPandas()
    groups = summary["home"].to_numpy()
    sets = gathered(points, groups, summary["n"].to_numpy(), block)
    pairs = [(k_, s) for k_, g in enumerate(groups.tolist()) for s in range(sets[g][0], sets[g][0] + sets[g][1])]
    n_sets = 1 + max((s for _, s in pairs), default=-1)
    routed = stored(needed(vectors.select("vec_id", "v"), shared, groups, summary["far"].to_numpy(), summary["least"].to_numpy(), np.array(pairs, int).reshape(-1, 2), n_sets), "needed")
    # A row per set of queries: no more than pivots, and one for each `block` queries. Broadcast, so that a set which needs many vectors is no hot key.
    sizes = routed.groupBy("q_set").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    where = spark.createDataFrame([(g, first, n) for g, (first, n) in sets.items()], "home int, first int, n int")
    asked = queries.join(F.broadcast(where), "home").withColumn("q_set", (F.col("first") + F.pmod(F.xxhash64("query_id"), F.col("n"))).cast("int"))
    asked = asked.join(F.broadcast(sizes), "q_set").select("q_set", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"), "query_id", F.col("v").alias("q"), "least")
    data = routed.join(F.broadcast(sizes), "q_set").select("q_set", F.pmod(F.xxhash64("vec_id", "turn"), F.col("parts")).cast("int").alias("part"), "vec_id", "v")

    def solve(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("vec_id")
            ids, x = right["vec_id"].to_numpy(), matrix(right["v"])
            for a in range(0, len(left), 256):
                part = left.iloc[a : a + 256]
                scores = products(matrix(part["q"]), x)
                for query_id, least, s in zip(part["query_id"], part["least"], scores, strict=True):
                    at = np.flatnonzero((s >= least) & (ids != query_id))
                    if len(at) > k:  # all that reach the k-th score; then the first k by score and id
                        at = at[s[at] >= (sorted(s[at])[len(at) - k] if s.dtype == object else np.partition(s[at], len(at) - k)[len(at) - k])]
                    at = at[np.argsort(-s[at], kind="stable")[:k]]
                    out.append(np.stack([np.full(len(at), query_id), ids[at], np.array([int(x) for x in s[at]], np.int64)], axis=1))
        found = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = asked.groupBy("q_set", "part").cogroup(data.groupBy("q_set", "part")).applyInPandas(solve, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
