"""Complete statistics in tiles: blocks of rows meet, and each pair of blocks returns a few sums.

The statistic is defined over all pairs, so the work is quadratic; what moves is far less. Rows are packed into blocks of BLOCK,
and up to GROUP blocks are a side of a tile: a task gets the blocks of two sides once, and does all their matrix products, so a block is
sent only to as many tiles as there are sides. A tile's result is one short row: no row per pair ever exists, and neither a block nor a
tile grows with the input. A row's signs are hashed once, when its block is packed, and travel in it as bits.

From LINEAR rows on, statistics that are products of two positive definite kernels are summed without pairs where that is exact enough (see landmarks).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import landmarks
from .statistics import Rows, Statistic

BLOCK = 512
#: Blocks of a tile's side at most, and sides that there should be at least, so that small inputs are spread too.
GROUP, SIDES = 16, 8
#: Rows of one side whose matrix of pairs is made at once, so that it stays in the processor's cache.
STRIP = 128
#: Rows from which sums without pairs are tried: below, picking landmarks takes about as long as the pairs.
LINEAR = 65_536


def sign_bits(seed: str, draws: int, ids) -> bytes:
    """Rademacher signs by draw and row, a bit each (1 is +1), from the same hashes as functions.randomness.sign."""
    first = [hashlib.md5(f"{seed}:{b}:{i}".encode()).digest()[0] < 128 for b in range(draws) for i in ids]
    return np.packbits(np.array(first, bool)).tobytes()


def signs(bits: bytes, draws: int, rows: int) -> np.ndarray:
    """The signs of sign_bits as numbers, by draw and row."""
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=draws * rows).reshape(draws, rows) * 2.0 - 1.0


def pack_blocks(rows: DataFrame, statistic: Statistic, draws: int, seed: str, block: int) -> tuple[DataFrame, Callable[[object], Rows]]:
    """The rows in checkpointed blocks of the statistic's columns, and what makes a block's columns again."""
    if not statistic.tiled:
        raise ValueError(f"{statistic.name} has no form over blocks; use diagonals")
    wide = {c: kind for c, kind in rows.dtypes if c in statistic.needs}
    nested = {c for c, kind in wide.items() if kind.startswith("array<array")}
    parts = [F.flatten(c).cast("array<double>") if c in nested else F.col(c).cast("array<double>") if "array" in wide[c] else F.array(F.col(c).cast("double")) for c in statistic.needs]
    # Sizes of the flat parts, then of one point of those that are arrays of points.
    sizes = F.array(*(F.size(p) for p in parts), *(F.size(F.get(c, F.lit(0))) if c in nested else F.lit(1) for c in statistic.needs))
    packed = rows.select(F.col("i").cast("long").alias("i"), sizes.alias("sizes"), F.concat(*parts).alias("v"), F.floor(F.col("i") / block).cast("long").alias("block"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        return pd.DataFrame({"block": frame["block"].iloc[:1], "ids": [frame["i"].to_numpy()], "sizes": [frame["sizes"].iloc[0]], "data": [np.vstack(frame["v"].to_list()).astype("<f8").tobytes()], "signs": [sign_bits(seed, draws, frame["i"])]})

    blocks = packed.groupBy("block").applyInPandas(pack, "block long, ids array<long>, sizes array<int>, data binary, signs binary").checkpoint()

    def unpack(row) -> Rows:
        m = np.frombuffer(row.data, "<f8").reshape(len(row.ids), -1)
        flat, point = np.split(np.asarray(row.sizes), 2)
        found = zip(statistic.needs, np.split(m, np.cumsum(flat)[:-1], axis=1), point, strict=True)
        return {c: x.reshape(len(x), -1, size) if c in nested else x if "array" in wide[c] else x[:, 0] for c, x, size in found}

    return blocks, unpack


def tile_sums(rows: DataFrame, statistic: Statistic, draws: int = 0, seed: str = "0", block: int = BLOCK) -> DataFrame:
    """(n_pairs, sum_h, sum_h2, boot) per tile of two sides. rows: i and the statistic's columns; boot[b] is the sum of e_i e_j h over i < j."""
    blocks, unpack = pack_blocks(rows, statistic, draws, seed, block)
    return block_sums(blocks, unpack, statistic, draws)


def block_sums(blocks: DataFrame, unpack: Callable[[object], Rows], statistic: Statistic, draws: int = 0) -> DataFrame:
    """The same, from blocks."""
    count = int(blocks.agg(F.max("block")).first()[0] or 0) + 1
    group = max(1, min(GROUP, count // SIDES))
    sides = -(-count // group)
    side = F.floor(F.col("block") / group).cast("long")
    # Each block goes once to every tile that its side is part of.
    tiles = F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), lambda k: F.struct(F.least(side, k.cast("long")).alias("low"), F.greatest(side, k.cast("long")).alias("high")))
    dealt = blocks.select("*", F.explode(tiles).alias("t")).select("block", "ids", "sizes", "data", "signs", "t.low", "t.high")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [(r, (x := unpack(r)) | statistic.prepare(x), signs(r.signs, draws, len(r.ids)) if draws else None) for r in frame.sort_values("block").itertuples()]
        low, high = frame["low"].iloc[0], frame["high"].iloc[0]
        n, total, squares, boot = 0, 0.0, 0.0, np.zeros(draws)
        for a, x, ea in rows:
            for b, y, eb in rows:
                if a.block > b.block or a.block // group != low or b.block // group != high:
                    continue
                size = len(a.ids)
                n += size * len(b.ids) if a.block < b.block else size * (size - 1) // 2
                for k in range(0, size, STRIP):
                    h = statistic.block({c: v[k : k + STRIP] for c, v in x.items()}, y)
                    if a.block == b.block:
                        h = np.triu(h, 1 + k)
                    total += float(h.sum())
                    squares += float(np.vdot(h, h))
                    if draws:
                        boot += ((ea[:, k : k + STRIP] @ h) * eb).sum(1)
        return pd.DataFrame({"n_pairs": [n], "sum_h": [total], "sum_h2": [squares], "boot": [boot]})

    # A tile is much work for few bytes: there are as many tasks as tiles, and tiles are dealt by their number, so that no task has two while another has none.
    tasks = max(1, min(100_000, sides * (sides + 1) // 2))
    place = F.col("low") * sides - F.floor(F.col("low") * (F.col("low") - 1) / 2) + F.col("high") - F.col("low")
    spread = dealt.withColumn("task", F.pmod(place, F.lit(tasks)).cast("int")).repartitionById(tasks, F.col("task"))
    sums = spread.groupBy("task", "low", "high").applyInPandas(run, "n_pairs long, sum_h double, sum_h2 double, boot array<double>")
    number = lambda v: F.coalesce(v, F.lit(float("nan")))  # noqa: E731  # pandas hands NaN over as null, which sums would leave out
    return sums.select("n_pairs", number(F.col("sum_h")).alias("sum_h"), number(F.col("sum_h2")).alias("sum_h2"), F.transform("boot", number).alias("boot"))


def complete(rows: DataFrame, statistic: Statistic, draws: int = 0, seed: str = "0", block: int = BLOCK) -> DataFrame:
    """One row: m (pairs), val (their mean), mean_h2, and h0 (the bootstrap draws in order, an array)."""
    blocks, unpack = pack_blocks(rows, statistic, draws, seed, block)
    if not draws and statistic.factors:
        count = int(blocks.agg(F.sum(F.size("ids"))).first()[0] or 0)
        found = landmarks.complete(blocks, count, unpack, statistic.factors, statistic.prepare) if count >= max(2, LINEAR) else None
        if found is not None:
            return found
    sums = block_sums(blocks, unpack, statistic, draws)
    if not draws:
        return sums.agg(F.sum("n_pairs").alias("m"), (F.sum("sum_h") / F.sum("n_pairs")).alias("val"), (F.sum("sum_h2") / F.sum("n_pairs")).alias("mean_h2"))
    total = sums.agg(F.sum("n_pairs").alias("m"), (F.sum("sum_h") / F.sum("n_pairs")).alias("val"), (F.sum("sum_h2") / F.sum("n_pairs")).alias("mean_h2"), *(F.sum(F.col("boot")[b]).alias(f"v{b}") for b in range(draws)))
    return total.select("m", "val", "mean_h2", F.array(*(F.col(f"v{b}") / F.col("m") for b in range(draws))).alias("h0"))
