"""Selecting, aligning and sampling rows of metadata, encodings and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as Q
from ..functions.arrays import has_nan
from ..functions.randomness import digest, index
from .pairs import dense_index


def where_equal(df: DataFrame, query: dict) -> DataFrame:
    """Rows that equal every entry of the query; an empty query keeps all. Plain filters, so they reach a Parquet scan."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]).isNull() if kv[1] is None else F.col(kv[0]) == F.lit(kv[1])), query.items(), df)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an explicit order."""
    return df.orderBy(*order).limit(n)


def alphabet_report(df: DataFrame, seq: str, alphabet: str, longest: int) -> DataFrame:
    """(reason, n): rows kept or discarded, and why."""
    bad = ~F.col(seq).rlike(f"^[{alphabet}]*$")
    reason = F.when(bad, "bad_chars").when(F.length(seq) > longest, "too_long").otherwise("kept")
    return df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def groups_with(df: DataFrame, keys: list[str], condition: Column, more_than: int) -> DataFrame:
    """(keys, n, size): groups in which more than so many rows meet a condition."""
    return df.groupBy(*keys).agg(F.sum(F.when(condition, 1).otherwise(0)).alias("n"), F.count(F.lit(1)).alias("size")).filter(F.col("n") > more_than)


def reindex(ids: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Every id with its value, null where there is none."""
    return ids.join(values, key, "left")


def align(x: DataFrame, y: DataFrame, key: str, vectors: tuple[str, ...] = ()) -> DataFrame:
    """Rows that both sides have, without vectors that are null or hold NaN. Ids are joined, so no position can slip."""
    both = x.join(y, key)
    return reduce(lambda d, c: d.filter(~has_nan(c)), vectors, both)


def data_set(reference: DataFrame, query: dict, keys: list[str], x: DataFrame, y: DataFrame, limit: int | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """The entries of a reference table that equal a query, with their x and y: a row for every entry, null where one has none.

    x: (keys, x); y: (keys, y). With limit, the first entries in an order (by default that of the keys).
    """
    chosen = where_equal(reference, query)
    if limit is not None:
        chosen = head(chosen, limit, *(order or keys))
    return chosen.join(x.select(*keys, "x"), keys, "left").join(y.select(*keys, "y"), keys, "left")


def aligned_xy(data: DataFrame, vectors: tuple[str, ...] = ("x",)) -> DataFrame:
    """The rows of a data set that have both x and y; vectors are those of them that may also hold nulls or NaN."""
    return reduce(lambda d, c: d.filter(~has_nan(c)), vectors, data.filter(F.col("x").isNotNull() & F.col("y").isNotNull()))


def group_sizes(df: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """(keys, n): the distinct groups of at least so many rows, and their sizes."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def upsample(rows: DataFrame, n: int, to: int, seed: str) -> DataFrame:
    """`to` draws with replacement from rows with a dense index i < n: (draw, ...)."""
    draws = rows.sparkSession.range(to).select(F.col("id").alias("draw"), index(seed, F.lit(n), F.col("id")).alias("i"))
    return draws.join(rows, "i")


def pick_one(df: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """One member of each group, by the least hash; a pre-aggregated minimum, so a large group costs nothing more."""
    return df.groupBy(group).agg(F.min_by(key, F.struct(digest(seed, F.col(key)), F.col(key))).alias(key))


def route_splits(df: DataFrame, key: str, valid: DataFrame, test: DataFrame) -> DataFrame:
    """df with split: valid or test where the id lists say so, train otherwise."""
    v = valid.select(F.col(key)).distinct().withColumn("_v", F.lit(1))
    t = test.select(F.col(key)).distinct().withColumn("_t", F.lit(1))
    out = df.join(v, key, "left").join(t, key, "left")
    return out.withColumn("split", F.when(F.col("_v") == 1, "valid").when(F.col("_t") == 1, "test").otherwise("train")).drop("_v", "_t")


def grid(spark, **values: list) -> DataFrame:
    """All combinations of a few parameter lists (driver-side lists, a small table)."""
    out = None
    for name, items in values.items():
        one = spark.createDataFrame([(x,) for x in items], [name])
        out = one if out is None else out.crossJoin(one)
    return out


def length_batches(df: DataFrame, key: str, length: str, most: int, within: list[str]) -> DataFrame:
    """df with batch: rows of each group in order of length, cut where the running length passes multiples of `most`.

    The row that passes a multiple begins the next batch, so none is lost. Groups (within) must be bounded, for example a
    hash bucket of the key.
    """
    w = Window.partitionBy(*within).orderBy(length, key)
    return df.withColumn("batch", F.floor((F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1) / most))


def where_in(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose column is among values(column); a list of any size, so it is a semi-join."""
    return df.join(values.select(column).distinct(), column, "left_semi")


def cross_section(df: DataFrame, levels: dict) -> DataFrame:
    """Rows at fixed values of some index levels, without those levels."""
    return where_equal(df, levels).drop(*levels)


def with_presence(ids: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """ids with present: whether found has their key."""
    return ids.join(found.select(key).distinct().withColumn("present", F.lit(True)), key, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def beside(key: str, *frames: DataFrame) -> DataFrame:
    """Columns of several frames side by side: rows of equal keys, whichever frames have them."""
    return reduce(lambda a, b: a.join(b, key, "full"), frames)


def looked_up(df: DataFrame, dictionary: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with the value of its keys in a dictionary(keys, value); a key that is missing there stops the job."""
    out = df.join(dictionary.select(*keys, F.struct(F.col(value).alias("v")).alias("_found")), keys, "left")
    missing = F.raise_error(F.concat(F.lit("no entry for "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))))
    return out.withColumn(value, F.when(F.col("_found").isNotNull(), F.col("_found.v")).otherwise(missing)).drop("_found")


def zipped(values: DataFrame, mask: DataFrame, group: str, pos: str, value: str) -> DataFrame:
    """mask(group, pos, mask) with the values that fill its true places in order; a mask beyond the values gets nulls.

    Groups are bounded (one structure's places).
    """
    w = Window.partitionBy(group).orderBy(pos)
    given = values.select(group, F.row_number().over(w).alias("_n"), value)
    places = mask.withColumn("_n", F.when(F.col("mask"), F.sum(F.col("mask").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return places.join(given, [group, "_n"], "left").drop("_n")


def shuffled(df: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """df with place: a random order of each (bounded) group, by hashes of the key."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(digest(seed, F.col(key)), key)))


def padded_batches(df: DataFrame, key: str, length: str, most: int, within: list[str]) -> DataFrame:
    """df with batch: rows of each (bounded) group in order of length, closed where the padded size, longest times rows, would pass `most`.

    A row that is longer than `most` by itself is a batch of its own.
    """
    one = df.groupBy(*within).agg(F.array_sort(F.collect_list(F.struct(F.col(length).cast("long").alias("l"), F.col(key).alias("k")))).alias("_rows"))
    start = F.struct(F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("count"), F.array().cast("array<bigint>").alias("out"))

    def step(a, x):
        full = (a["count"] > 0) & (x["l"] * (a["count"] + 1) > most)
        batch = F.when(full, a["batch"] + 1).otherwise(a["batch"])
        return F.struct(batch.alias("batch"), F.when(full, F.lit(1).cast("long")).otherwise(a["count"] + 1).alias("count"), F.concat(a["out"], F.array(batch)).alias("out"))

    packed = one.withColumn("_batch", F.aggregate("_rows", start, step)["out"])
    return packed.select(*within, F.explode(F.arrays_zip(F.col("_rows").alias("r"), F.col("_batch").alias("b"))).alias("x")).select(*within, F.col("x.r.k").alias(key), F.col("x.r.l").alias(length), F.col("x.b").alias("batch"))


def padded_to_longest(df: DataFrame, column: str, fill: Column, keys: list[str] | None = None, extra: int = 0) -> DataFrame:
    """df with arrays of one length in each group of equal keys (of all rows, without keys): that of the longest, and `extra` places more.

    The lengths are pre-aggregated, a row per group, and joined back; rows move only where the groups are too many to be sent to all tasks. Null keys
    are one group. A null array stays null.
    """
    keys = keys or []
    sizes = df.groupBy(*keys).agg(F.coalesce(F.max(F.size(column)), F.lit(0)).alias("_n"))
    if not keys:
        wide = df.crossJoin(F.broadcast(sizes))
    else:
        sizes = sizes.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), "_n")
        wide = df.join(sizes, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys))))
    to = F.greatest(F.col("_n"), F.lit(0)) + extra
    return wide.withColumn(column, F.when(F.col(column).isNotNull(), Q.padded(F.col(column), to, fill))).select(*df.columns)


def condition_index(df: DataFrame, columns: list[str], name: str = "k") -> DataFrame:
    """The different values of some columns, numbered from 0 in their order, nulls first; repeats are taken out before anything is sorted."""
    return dense_index(df.select(*columns).distinct(), *columns, name=name)
