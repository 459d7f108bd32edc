"""Markov chains of models as a stored table that is warmed up once, goes on from where it stopped, and is shared by all pairs of a test.

A row of the table holds the chains of one input row: their positions, log step sizes, accepted moves and kept particles, and the number of
steps done. Every version is a Parquet folder `step=N` of the table's folder, and counts once Spark has committed it (its _SUCCESS
mark): a run that is killed leaves the last committed version, and the next run goes on from there. Draws are hashes of (seed, row, chain, step,
place): a chain has no generator state but its step, so stopping, resuming, other partitions or lost tasks change nothing.

Table: (i, model columns, step, position, log_step, accepted, points). A new version reads the last one and nothing else; no shuffle.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.randomness import counter_normals, counter_uniforms, mixed
from ..session import new_folder, shared_folder

Values = dict[str, np.ndarray]


@dataclass(frozen=True)
class Density:
    """A model that is known up to a constant. log_density(x, values) and gradient(x, values) take points (n, d) and the rows' model
    columns, stacked (n, ...), and return (n,) and (n, d); dimension(values of one row) is d. name stands for the functions in a table's key.
    """

    name: str
    needs: tuple[str, ...]
    dimension: Callable[[Values], int]
    log_density: Callable[[np.ndarray, Values], np.ndarray]
    gradient: Callable[[np.ndarray, Values], np.ndarray]


def gaussian_density() -> Density:
    """The Gaussian models (mu, s) of the rows."""
    variance = lambda v: (v["s"] ** 2)[:, None]
    return Density("gaussian", ("mu", "s"), lambda v: len(v["mu"]), lambda x, v: -((x - v["mu"]) ** 2 / (2 * variance(v))).sum(1), lambda x, v: (v["mu"] - x) / variance(v))


def mixture_density() -> Density:
    """Equal mixtures of N(c, s^2 I) over the rows' centres, an array of points."""

    def logs(x: np.ndarray, v: Values) -> np.ndarray:
        return -((x[:, None] - v["centres"]) ** 2).sum(2) / (2 * v["s"][:, None] ** 2)

    def log_density(x: np.ndarray, v: Values) -> np.ndarray:
        terms = logs(x, v)
        top = terms.max(1)
        return top + np.log(np.exp(terms - top[:, None]).mean(1))

    def gradient(x: np.ndarray, v: Values) -> np.ndarray:
        terms = logs(x, v)
        w = np.exp(terms - terms.max(1)[:, None])
        return ((w / w.sum(1)[:, None])[:, :, None] * v["centres"]).sum(1) / v["s"][:, None] ** 2 - x / v["s"][:, None] ** 2

    return Density("mixture", ("centres", "s"), lambda v: len(v["centres"][0]), log_density, gradient)


@dataclass(frozen=True)
class ChainConfig:
    """particles: points that a test gets of each row's model. They come from min(particles, chains) chains, started from standard normals: warm_up steps
    without keeping, in which step sizes adapt to the target rate of acceptance, then one kept point every `thin` steps (the first right after
    the warm-up). adjusted: MALA, else ULA.
    """

    particles: int = 10
    chains: int = 100
    warm_up: int = 10
    step: float = 0.1
    adapt: bool = True
    target: float = 0.5
    thin: int = 1
    adjusted: bool = True
    seed: str = "0"

    @property
    def count(self) -> int:
        return min(self.particles, self.chains)

    @property
    def steps(self) -> int:
        """Steps after which every row has its particles."""
        return self.warm_up + (-(-self.particles // self.count) - 1) * self.thin


def keys_of(i: np.ndarray, config: ChainConfig) -> np.ndarray:
    """A 64-bit key for each row and chain, rows first."""
    seed = np.frombuffer(hashlib.md5(config.seed.encode()).digest()[:8], "<u8")[0]
    rows = mixed(np.asarray(i, np.int64).astype(np.uint64) ^ seed)
    with np.errstate(over="ignore"):
        return mixed(np.repeat(rows, config.count) + np.tile(np.arange(1, config.count + 1, dtype=np.uint64), len(rows)))


def moved(x: np.ndarray, log_step: np.ndarray, accepted: np.ndarray, keys: np.ndarray, step: int, values: Values, density: Density, config: ChainConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One step of all chains. A move whose acceptance is no number is refused; without adjustment all moves are made."""
    eps = np.exp(log_step)[:, None]
    forward = x + eps * density.gradient(x, values)
    y = forward + np.sqrt(2 * eps) * counter_normals(keys, step, x.shape[1])
    if not config.adjusted:
        return y, log_step, accepted + 1
    back = y + eps * density.gradient(y, values)
    ratio = density.log_density(y, values) - density.log_density(x, values) + (((y - forward) ** 2).sum(1) - ((x - back) ** 2).sum(1)) / (4 * eps[:, 0])
    take = np.log(counter_uniforms(keys, step, 2 * x.shape[1] + 1)[:, -1]) < ratio
    if config.adapt and step < config.warm_up:
        rate = np.exp(np.minimum(np.nan_to_num(ratio, nan=-np.inf), 0.0))
        log_step = log_step + (rate - config.target) / np.sqrt(step + 1.0)
    return np.where(take[:, None], y, x), log_step, accepted + take


def _advance(frames: Iterator[pd.DataFrame], to: int, density: Density, config: ChainConfig) -> Iterator[pd.DataFrame]:
    c = config.count
    for frame in frames:
        out = frame.copy()
        models = [{n: np.array(v.tolist() if isinstance(v, np.ndarray) else v, float) for n, v in zip(density.needs, row, strict=True)} for row in frame[list(density.needs)].itertuples(index=False)]
        shapes = [tuple(v.shape for v in m.values()) for m in models]
        positions, logs, counts, points = ([None] * len(frame) for _ in range(4))
        for shape in dict.fromkeys(shapes):  # rows of one shape move together
            rows = [k for k, s in enumerate(shapes) if s == shape]
            values = {n: np.repeat(np.stack([models[k][n] for k in rows]), c, axis=0) for n in density.needs}
            d = density.dimension(models[rows[0]])
            keys = keys_of(frame["i"].to_numpy()[rows], config)
            done = int(frame["step"].iloc[rows[0]])
            if done == 0:
                # The start has a step number of its own, which no move has.
                x, log_step, accepted = counter_normals(keys, (1 << 40), d), np.full(len(keys), np.log(config.step)), np.zeros(len(keys), np.int64)
                kept = [[] for _ in rows]
            else:
                x = np.array([p for k in rows for p in frame["position"].iloc[k]], float).reshape(len(keys), d)
                log_step = np.concatenate([frame["log_step"].iloc[k] for k in rows])
                accepted = np.concatenate([frame["accepted"].iloc[k] for k in rows])
                kept = [list(frame["points"].iloc[k]) for k in rows]
            for step in range(done, to + 1):
                if step >= config.warm_up and (step - config.warm_up) % config.thin == 0 and (step > done or step == 0):
                    for k, new in enumerate(x.reshape(len(rows), c, d)):
                        kept[k] += list(new)[: max(0, config.particles - len(kept[k]))]
                if step < to:
                    x, log_step, accepted = moved(x, log_step, accepted, keys, step, values, density, config)
            for k, row in enumerate(rows):
                at = slice(k * c, k * c + c)
                positions[row], logs[row], counts[row], points[row] = x[at].tolist(), log_step[at].tolist(), accepted[at].tolist(), [list(map(float, p)) for p in kept[k]]
        out["step"] = to
        out["position"], out["log_step"], out["accepted"], out["points"] = positions, logs, counts, points
        yield out


class ChainTable:
    """The chains of rows(i, model columns) under a density, in a folder of the shared file system.

    The folder's name ends in a hash of the density's name and the settings, so other settings never go on from these chains. Whoever names a folder
    answers for its rows being the same in every run; without one, a new folder is taken.
    """

    def __init__(self, rows: DataFrame, density: Density, config: ChainConfig = ChainConfig(), folder: str | None = None):
        self.spark, self.density, self.config = rows.sparkSession, density, config
        shared_folder(self.spark)
        key = hashlib.sha256(json.dumps([density.name, density.needs, asdict(config)]).encode()).hexdigest()[:16]
        self.folder = f"{folder or new_folder(self.spark, 'chains')}/{key}"
        self.rows = rows.select(F.col("i").cast("long").alias("i"), *density.needs)

    def committed(self) -> list[int]:
        """Steps of the versions that are whole, ascending."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        names = [s.getPath() for s in files.listStatus(path)]
        whole = [p for p in names if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("step=")) for p in whole)

    def version(self, step: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/step={step}").withColumn("step", F.lit(step).cast("long"))

    def advanced(self, to: int | None = None, every: int | None = None) -> DataFrame:
        """The table at step `to` (all particles, by default), from the last committed version before it; with every, one more version each so many steps."""
        to = self.config.steps if to is None else to
        if not self.committed():
            empty = {"step": "0L", "position": "cast(array() as array<array<double>>)", "log_step": "cast(array() as array<double>)", "accepted": "cast(array() as array<long>)", "points": "cast(array() as array<array<double>>)"}
            self._write(self.rows.select("*", *(F.expr(v).alias(k) for k, v in empty.items())), 0, moved_=False)
        while True:
            last = max(s for s in self.committed() if s <= to)
            # At step 0 nothing has been drawn: it holds the input, so that a table is of one reading of it.
            if last == to and to > 0:
                return self.version(to)
            if to == 0:
                return self.version(0)
            self._write(self.version(last), min(to, last + every) if every else to)

    def _write(self, table: DataFrame, step: int, moved_: bool = True) -> None:
        density, config = self.density, self.config
        new = table.mapInPandas(lambda frames: _advance(frames, step, density, config), table.schema) if moved_ else table
        new.drop("step").write.mode("overwrite").parquet(f"{self.folder}/step={step}")

    def particles(self) -> DataFrame:
        """(i, points): the rows' particles."""
        return self.advanced().select("i", "points")

    def chains(self, step: int | None = None) -> DataFrame:
        """(i, chain, step, position, step_size, rate): one row per chain."""
        each = F.arrays_zip("position", "log_step", "accepted")
        wide = self.advanced(step).select("i", "step", F.posexplode(each).alias("chain", "c"))
        return wide.select("i", "chain", "step", F.col("c.position").alias("position"), F.exp("c.log_step").alias("step_size"), (F.col("c.accepted") / F.col("step")).alias("rate"))
