"""Hard-negative mining with Four-Russians scoring.

A candidate is stored as bit planes: plane b holds bit b of all its components in two's complement, eight dimensions to a byte. For eight dimensions of an
anchor, a table holds the sums of all 256 subsets of its components, each made from a smaller one by one addition. A plane's
inner product with the anchor is one lookup for each byte; planes are joined from the highest (which counts negative) by doubling and
adding. The scores are exact inner products of all pairs that meet: nothing is estimated or left out.

Two rounds meet anchors and candidates in bounded groups: blocks of at most about ANCHORS anchors, parts of at most about PART candidates.
First the rows of an anchor's label, for its positives (labels are hashed to BINS bins; a bin is cut to blocks and parts by its counts, so a
hot label has many groups). Then all anchors with all rows, where each distinct score of a positive opens a window of scores and every part
returns the best rows of other labels in it. Only those are ranked. All anchors against all rows is the task itself; it is done in blocks, and no
row per pair exists.

Cases: rows with a null label, id or vector, or a null or non-finite component, take no part; repeated rows of one anchor id are one anchor (the
least by label, then planes); candidates are every row whose id is not the anchor's, repeated ones each; a shorter vector is filled up
with zeros; an anchor without positives, or a positive without negatives, gives no rows; ties go to the smaller vec_id; an
empty table gives no rows. Scores beyond 64 bits stop the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, fields, prepared, stored
from .vectors import CELLS, integers, sound

FACTOR, POSITIVES, NEGATIVES, LEAST, MOST = 256.0, 5, 5, 80, 100
ANCHORS, PART, BINS = 4096, 8192, 256
#: Bytes of the tables that a task holds at a time, and candidates that are looked up at a time.
TABLES, STEP = 32 << 20, 256


def bit_planes(x: np.ndarray) -> list[bytes]:
    """Rows of integers as bytes: the number of planes, then the planes, lowest first, without the groups of zeros at the end."""
    n, dims = x.shape
    groups = -(-dims // 8)
    wide = np.zeros((n, groups * 8), np.int64)
    wide[:, :dims] = x
    size = np.maximum(wide.max(axis=1, initial=0), ~wide.min(axis=1, initial=0)).astype(np.uint64)  # of a negative number, one less
    planes = np.array([1 + int(v).bit_length() for v in size], int)
    last = np.where(wide.any(axis=1), groups * 8 - 1 - np.argmax(wide[:, ::-1] != 0, axis=1), -1) if dims else np.full(n, -1)
    bits = (wide[:, None, :] >> np.arange(int(planes.max(initial=1)), dtype=np.int64)[:, None]) & 1
    rows = np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")
    return [bytes([int(p)]) + r[:p, : e // 8 + 1].tobytes() for p, e, r in zip(planes, last, rows, strict=True)]


def stacked(col: list[bytes], groups: int) -> np.ndarray:
    """(rows, planes, groups) of bit planes, signs carried on to the largest number of planes; groups beyond are left out."""
    most = max((raw[0] for raw in col), default=1)
    out = np.zeros((len(col), most, groups), np.uint8)
    for k, raw in enumerate(col):
        p = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)[:, :groups]
        out[k, : len(p), : p.shape[1]] = p
        out[k, len(p) :, : p.shape[1]] = p[-1]
    return out


def values(planes: np.ndarray) -> np.ndarray:
    """The integers of bit planes, one row each."""
    bits = np.unpackbits(planes, axis=2, bitorder="little").astype(np.int64)
    weight = np.left_shift(np.int64(1), np.arange(planes.shape[1], dtype=np.int64))
    weight[-1:] = -weight[-1:]
    return np.einsum("npd,p->nd", bits, weight)


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): for each group of eight dimensions the sums of all subsets of each anchor's components."""
    n, dims = anchors.shape
    each = anchors.T.reshape(dims // 8, 8, n)
    out = np.zeros((dims // 8, 256, n), anchors.dtype)
    for j in range(8):
        out[:, 1 << j : 2 << j] = out[:, : 1 << j] + each[:, j : j + 1]
    return out


def looked_up(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(candidates, anchors): exact scores by lookups and doubling."""
    n, most, groups = planes.shape
    score = np.zeros((n, tables.shape[2]), tables.dtype)
    for b in range(most - 1, -1, -1):
        plane = np.zeros_like(score)
        for g in range(groups):
            plane += tables[g].take(planes[:, b, g], axis=0)
        score = -plane if b == most - 1 else score + score + plane
    return score


def scores(anchors: list[bytes], candidates: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first anchor, scores of anchors by candidates) of runs of anchors."""
    groups = max((max(1, (len(raw) - 1) // raw[0]) for raw in anchors), default=1)
    a, c = stacked(anchors, groups), stacked(candidates, groups)
    bits = a.shape[1] + c.shape[1] + int(groups * 8).bit_length() + 7  # and room for a factor of 100
    kind = np.int32 if bits < 38 else np.int64 if bits < 63 else object
    x = values(a).astype(kind)
    run = max(1, min(512, TABLES // (groups * 256 * 8)))
    for at in range(0, len(x), run):
        tables = subset_sums(x[at : at + run])
        found = [looked_up(tables, c[k : k + STEP]) for k in range(0, len(c), STEP)]
        whole = np.concatenate(found) if found else np.zeros((0, tables.shape[2]), kind)
        yield at, whole.T.astype(object if kind is object else np.int64)


def first(score: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the places at, in order of their ids, the k best by score, ties to the earlier place."""
    s = score[at]
    if len(at) > k:
        least = np.partition(s, len(at) - k)[len(at) - k] if s.dtype != object else sorted(s)[len(at) - k]
        at = at[s >= least]
    return at[np.argsort(-score[at], kind="stable")[:k]]


def planes_of(rows: DataFrame, factor: float) -> DataFrame:
    """(vec_id, label, anchor, p): bit planes in place of the vectors."""
    schema = fields("vec_id long, label long, anchor boolean, p binary")

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            x, ends = integers(batch.column(3), factor)
            size = np.diff(ends)
            out, row = [], 0
            while row < len(size):  # runs of equal length, of bounded cells
                d = int(size[row])
                stop = row + 1
                while stop < len(size) and size[stop] == d and (stop - row) * d * 16 < CELLS:
                    stop += 1
                out += bit_planes(x[ends[row] : ends[stop]].reshape(stop - row, d))
                row = stop
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], schema.names)

        return each

    return arrow_map(rows, make, schema)


def _positives(key: tuple, asked: pd.DataFrame, held: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(asked) and len(held):
        held = held.sort_values("vec_id")
        ids, labels = held["vec_id"].to_numpy(), held["label"].to_numpy()
        who, of = asked["anchor_id"].to_numpy(), asked["label"].to_numpy()
        for a, found in scores(asked["p"].tolist(), held["p"].tolist()):
            for i, s in enumerate(found, a):
                at = first(s, np.flatnonzero((labels == of[i]) & (ids != who[i])), k)
                out += zip([who[i]] * len(at), ids[at].tolist(), s[at].tolist(), strict=True)
    return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"])


def _negatives(key: tuple, asked: pd.DataFrame, held: pd.DataFrame, k: int, low: int, high: int) -> pd.DataFrame:
    out = []
    if len(asked) and len(held):
        held = held.sort_values("vec_id")
        ids, labels = held["vec_id"].to_numpy(), held["label"].to_numpy()
        who, of, opened = asked["anchor_id"].to_numpy(), asked["label"].to_numpy(), asked["scores"].tolist()
        for a, found in scores(asked["p"].tolist(), held["p"].tolist()):
            for i, s in enumerate(found, a):
                hundred = 100 * s
                other = (labels != of[i]) & (ids != who[i])
                for positive in opened[i]:
                    p = int(positive)
                    at = np.flatnonzero(other & _between(hundred, low * p, high * p))
                    at = first(s, at, k)
                    out += zip([who[i]] * len(at), [p] * len(at), ids[at].tolist(), s[at].tolist(), strict=True)
    return pd.DataFrame(out, columns=["anchor_id", "positive_score", "negative_id", "negative_score"])


def _between(values_: np.ndarray, low: int, high: int) -> np.ndarray:
    """low <= value <= high, also where the bounds are beyond 64 bits."""
    if values_.dtype != object:
        low, high = max(low, -(2**63)), min(high, 2**63 - 1)
        if low > high:
            return np.zeros(len(values_), bool)
    return ((values_ >= low) & (values_ <= high)).astype(bool)


def mine_negatives(
    rows: DataFrame, anchor: F.Column, label: F.Column, vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LEAST, high: int = MOST, factor: float = FACTOR, block: int = ANCHORS, part: int = PART, bins: int = BINS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each anchor and each of its first `positives` other rows of its label: the first `negatives` rows of other labels
    with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark = prepared(rows.sparkSession)
    whole = sound(rows, {"vec_id": rows["vec_id"].cast("long"), "label": label.cast("long"), "anchor": F.coalesce(anchor, F.lit(False))}, vector)
    data = stored(planes_of(whole.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull()), factor).withColumn("bin", F.pmod(F.xxhash64("label"), F.lit(bins)).cast("int")), "planes")
    least = F.min(F.struct("label", "p", "bin")).alias("a")
    anchors = stored(data.filter("anchor").groupBy(F.col("vec_id").alias("anchor_id")).agg(least).select("anchor_id", "a.label", "a.p", "a.bin"), "anchors")
    n, n_anchors = data.count(), anchors.count()
    turn = F.xxhash64("vec_id", F.monotonically_increasing_id())  # rows of one id are dealt out too

    # At most `bins` rows.
    shape = anchors.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).join(data.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts")), "bin").collect()
    few = F.broadcast(spark.createDataFrame([tuple(r) for r in shape], "bin int, blocks int, parts int"))
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asked = anchors.join(few, "bin").withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.col("blocks")).cast("int")).withColumn("part", numbers("parts"))
    held = data.join(few, "bin").withColumn("part", F.pmod(turn, F.col("parts")).cast("int")).withColumn("block", numbers("blocks")).select("bin", "block", "part", "vec_id", "label", "p")
    keys = ["bin", "block", "part"]
    found = asked.select(*keys, "anchor_id", "label", "p").groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(lambda key, x, y: _positives(key, x, y, positives), "anchor_id long, positive_id long, positive_score long")
    best = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    near = stored(found.withColumn("place", best).filter(F.col("place") <= positives).drop("place"), "positives")

    blocks_, parts_ = max(1, -(-n_anchors // block)), max(1, -(-n // part))
    opened = near.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("scores"))  # at most `positives` numbers
    asked = anchors.join(opened, "anchor_id").select(F.pmod(F.xxhash64("anchor_id"), F.lit(blocks_)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts_ - 1))).alias("part"), "anchor_id", "label", "p", "scores")
    held = data.withColumn("part", F.pmod(turn, F.lit(parts_)).cast("int")).select(F.explode(F.sequence(F.lit(0), F.lit(blocks_ - 1))).alias("block"), "part", "vec_id", "label", "p")
    keys = ["block", "part"]
    met = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(lambda key, x, y: _negatives(key, x, y, negatives, low, high), "anchor_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = met.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return near.join(ranked, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
