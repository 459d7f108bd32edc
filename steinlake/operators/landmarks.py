"""Complete statistics without pairs, for a product of two positive definite kernels: work and memory are linear in the rows.

With features E and R of the two kernels, the sum over all ordered pairs of K(a, b) G(a, b) is the squared norm of the sum over rows of E(a) R(a)', one matrix
that tasks add up; so is the sum of squares, with features of K^2 and G^2. Features come from landmarks: rows of a bounded pool, picked as the pivots
of a Cholesky decomposition, with E(a) = L^-1 K(landmarks, a). Every row enters the sums; the pool, drawn by hashes and from the rows of largest h with themselves,
only decides on the landmarks.

What features leave of a kernel is positive definite too, so what they leave of a pair is at most the geometric mean of what they leave of its two rows
with themselves, and that is added up over all rows beside the sums. Where this bound is above ERROR, or MOST landmarks are too few, there is no result, and tiles are to do it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rows = dict[str, np.ndarray]
Kernel = Callable[[Rows, Rows], np.ndarray]

#: What may be left of the means of h and of h^2, as a share of their means over rows paired with themselves.
ERROR = 1e-8
#: Rows of the pool that are drawn, about, and that are farthest out; landmarks of one kernel at most.
POOL, FAR, MOST = 6144, 4096, 7168
#: Pivots that are tried at once, rows whose kernels to the landmarks are made at once, and columns of features that are made at once.
AT_ONCE, STRIP, COLUMNS = 32, 64, 256
#: Blocks of a task: at least, so that landmarks are decomposed for enough rows, and at most.
FEW, MANY = 8, 256


def part(rows: Rows, at) -> Rows:
    return {c: v[at] for c, v in rows.items()}


def length(rows: Rows) -> int:
    return len(next(iter(rows.values())))


def diagonal(kernel: Kernel, rows: Rows) -> np.ndarray:
    """The kernel of each row with itself."""
    strips = (part(rows, slice(k, k + 16)) for k in range(0, length(rows), 16))
    return np.concatenate([np.diagonal(kernel(x, x)) for x in strips])


def pivots(kernel: Kernel, pool: Rows, error: float = ERROR / 8) -> list[int] | None:
    """The places of landmarks in the pool, by falling use, that leave `error` of the kernel's diagonal on average; None where MOST do not."""
    rest = diagonal(kernel, pool)
    goal, picked, done = error * rest.mean(), [], np.empty((MOST, len(rest)))
    # Landmarks leave nothing of themselves, so the others count.
    while not rest.sum() <= goal * max(1, len(rest) - len(picked)):
        top = np.argsort(-rest)[:AT_ONCE]
        if len(picked) + len(top) > MOST or not np.isfinite(rest).all():
            return None
        left = kernel(part(pool, top), pool) - done[: len(picked), top].T @ done[: len(picked)]
        inner, least, best = left[:, top], rest[top[0]] / 4, []
        while len(best) < len(top) and (own := np.diagonal(inner)).max() > least:
            best.append(int(own.argmax()))
            column = inner[:, best[-1]] / np.sqrt(own.max())
            inner = inner - np.outer(column, column)
        if not best:  # as far as double precision goes
            return None
        new = lower_inverse(np.linalg.cholesky(left[best][:, top[best]])) @ left[best]
        done[len(picked) : len(picked) + len(best)] = new
        picked += top[best].tolist()
        rest = np.maximum(rest - (new * new).sum(0), 0)
        rest[picked] = 0
    return picked


def lower_inverse(m: np.ndarray) -> np.ndarray:
    """The inverse of a lower triangular matrix."""
    n = len(m)
    if n <= 64:
        return np.tril(np.linalg.inv(m)) if n else m
    half, out = n // 2, np.zeros_like(m)
    a, b = lower_inverse(m[:half, :half]), lower_inverse(m[half:, half:])
    out[:half, :half], out[half:, half:], out[half:, :half] = a, b, -(b @ m[half:, :half]) @ a
    return out


class Features:
    """The features of a kernel by its landmarks."""

    def __init__(self, kernel: Kernel, landmarks: Rows):
        self.kernel, self.landmarks, self.size = kernel, landmarks, length(landmarks)
        #: L^-1 in strips of COLUMNS rows, each as far as its last row goes; made strip by strip, so that no other matrix is as large.
        self.inverse: list[np.ndarray] = []
        for k in range(0, self.size, COLUMNS):
            met = kernel(part(landmarks, slice(k, k + COLUMNS)), part(landmarks, slice(0, k + COLUMNS)))
            known = self.known(met)
            own = lower_inverse(np.linalg.cholesky(met[:, k:] - known @ known.T))
            left = np.zeros((len(met), k))
            for strip in self.inverse:
                end = strip.shape[1]
                left[:, :end] += known[:, end - len(strip) : end] @ strip
            self.inverse.append(np.concatenate([-own @ left, own], axis=1))

    def known(self, met: np.ndarray) -> np.ndarray:
        """The features of the strips so far, from the kernels of rows to landmarks."""
        return np.concatenate([np.empty((len(met), 0)), *(met[:, : m.shape[1]] @ m.T for m in self.inverse)], axis=1)

    def of(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows' features, the kernel of each row with itself, and what the features leave of that."""
        out = self.known(np.concatenate([self.kernel(part(rows, slice(k, k + STRIP)), self.landmarks) for k in range(0, length(rows), STRIP)]))
        own = diagonal(self.kernel, rows)
        return out, own, np.abs(own - (out * out).sum(1))


def powers(kernel: Kernel) -> tuple[Kernel, Kernel]:
    """A kernel and its square."""
    return kernel, lambda a, b: np.square(kernel(a, b))


def pool_rows(blocks: DataFrame, count: int, unpack: Callable[[object], Rows], factors: tuple[Kernel, Kernel], prepare: Callable[[Rows], Rows]) -> Rows:
    """The rows that landmarks are picked from."""

    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in (row for f in frames for row in f.itertuples()):
            x = unpack(row)
            x |= prepare(x)
            yield pd.DataFrame({"i": row.ids, "own": np.prod([diagonal(kernel, x) for kernel in factors], axis=0)})

    far = blocks.mapInPandas(own, "i long, own double").orderBy(F.desc("own"), "i").limit(FAR).select("i")
    drawn = blocks.select(F.explode("ids").alias("i")).filter(F.pmod(F.xxhash64("i"), F.lit(count)) < POOL)
    wanted = np.array([r.i for r in far.union(drawn).distinct().collect()])

    def taken(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in (row for f in frames for row in f.itertuples()):
            at = np.isin(row.ids, wanted)
            if at.any():
                data = np.frombuffer(row.data, "<f8").reshape(len(at), -1)[at].tobytes()
                yield pd.DataFrame({"block": [row.block], "ids": [row.ids[at]], "sizes": [row.sizes], "data": [data]})

    found = sorted(blocks.mapInPandas(taken, "block long, ids array<long>, sizes array<int>, data binary").collect(), key=lambda r: r.block)
    parts = [unpack(r) for r in found]
    return {c: np.concatenate([x[c] for x in parts]) for c in parts[0]}


def complete(blocks: DataFrame, count: int, unpack: Callable[[object], Rows], factors: tuple[Kernel, Kernel], prepare: Callable[[Rows], Rows]) -> DataFrame | None:
    """One row (m, val, mean_h2) of h = the product of the factors, or None where the bound does not hold.

    blocks: all `count` rows, as unpack takes them (block, ids, sizes, data); prepare: as in Statistic.
    """
    spark = blocks.sparkSession
    # By power: the first factor's kernel, the second's.
    kernels = [kernel for two in zip(*map(powers, factors), strict=True) for kernel in two]
    pool = pool_rows(blocks, count, unpack, factors, prepare)

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k in (int(k) for f in frames for k in f["id"]):
            yield pd.DataFrame({"id": [k], "picked": [pivots(kernels[k], pool | prepare(pool))]})

    found = {r.id: r.picked for r in spark.range(0, len(kernels), 1, len(kernels)).mapInPandas(pick, "id long, picked array<int>").collect()}
    if not all(found.values()):
        return None
    landmarks = [part(pool, found[k]) for k in range(len(kernels))]

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spaces = [Features(kernel, x | prepare(x)) for kernel, x in zip(kernels, landmarks, strict=True)]
        total = [np.zeros((e.size, r.size)) for e, r in (spaces[:2], spaces[2:])]
        known = np.zeros((2, 5))
        for row in (row for f in frames for row in f.itertuples()):
            x = unpack(row)
            x |= prepare(x)
            for power in range(2):
                (e, e_own, e_rest), (r, r_own, r_rest) = (s.of(x) for s in spaces[2 * power : 2 * power + 2])
                for k in range(0, e.shape[1], COLUMNS):
                    total[power][k : k + COLUMNS] += e[:, k : k + COLUMNS].T @ r
                e_sq, r_sq = (e * e).sum(1), (r * r).sum(1)
                known[power] += len(e), e_sq @ r_sq, e_own @ r_own, np.sqrt(e_rest * r_own).sum(), np.sqrt(e_sq * r_rest).sum()
        for power in range(2):
            yield pd.DataFrame({"power": [power], "strip": [-1], "data": [known[power].tobytes()]})
            for k in range(0, len(total[power]), AT_ONCE):
                yield pd.DataFrame({"power": [power], "strip": [k], "data": [total[power][k : k + AT_ONCE].tobytes()]})

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        whole, first = sum(np.frombuffer(d, "<f8") for d in frame["data"]), frame["strip"].iloc[0] < 0
        return pd.DataFrame({"power": frame["power"].iloc[:1], "known": [whole if first else None], "squares": [0.0 if first else float(whole @ whole)]})

    number = blocks.count()
    # A task's result does not grow with its rows, so there are as few tasks as keep the machines busy.
    tasks = max(1, min(number // FEW, spark.sparkContext.defaultParallelism), number // MANY)
    dealt = blocks.withColumn("task", F.pmod("block", F.lit(tasks)).cast("int")).repartitionById(tasks, F.col("task"))
    sums = dealt.mapInPandas(add, "power int, strip int, data binary")
    joined = sums.groupBy("power", "strip").applyInPandas(join, "power int, known array<double>, squares double")
    out = joined.groupBy("power").agg(F.max("known").alias("known"), F.sum("squares").alias("squares")).orderBy("power").collect()
    pairs, means = count * (count - 1) // 2, []
    for power in out:
        n, own, scale, *left = (np.nan if v is None else v for v in power.known)  # pandas has no NaN in lists
        if n != count or not sum(v * v for v in left) <= ERROR * scale * count:
            return None
        means.append((power.squares - own) / 2 / pairs)
    return spark.createDataFrame([(pairs, *map(float, means))], "m long, val double, mean_h2 double")
