"""Particles of models: seeded samplers and Langevin chains in Arrow tasks, and the interface of external models.

Every row's draws come from a generator seeded by (seed, id), so they do not depend on partitions, order or lost tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINTS = "i long, points array<array<double>>"


def generator(seed: str, i: int) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}:{i}".encode()).digest()[:8], "little"))


def _rows(df: DataFrame, columns: list[str], make: Callable[[np.random.Generator, tuple], np.ndarray], seed: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [make(generator(seed, i), values).tolist() for i, *values in f[["i", *columns]].itertuples(index=False)]
            yield pd.DataFrame({"i": f["i"], "points": out})

    return df.select("i", *columns).mapInPandas(run, POINTS)


def gaussian_particles(df: DataFrame, m: int, seed: str) -> DataFrame:
    """(i, points): m draws from the Gaussian model (mu, s) of each row."""
    return _rows(df, ["mu", "s"], lambda rng, v: np.asarray(v[0]) + v[1] * rng.normal(size=(m, len(v[0]))), seed)


def base_samples(n: int, dimension: int, seed: str) -> list[list[float]]:
    """n standard normal points for all rows to share, as a base measure. n is a parameter, so they travel in the plan."""
    return generator(seed, 0).normal(size=(n, dimension)).tolist()


def langevin_particles(df: DataFrame, columns: list[str], log_density: Callable[[np.ndarray, tuple], float], gradient: Callable[[np.ndarray, tuple], np.ndarray], dimension: int, m: int, seed: str, step: float = 0.1, warm_up: int = 10, adjusted: bool = True) -> DataFrame:
    """(i, points): m Langevin chains per row, run for warm_up steps from standard normal starts; MALA, or ULA if not adjusted.

    log_density(x, values) and gradient(x, values) are those of the row's model, values being its columns.
    """

    def chains(rng: np.random.Generator, values: tuple) -> np.ndarray:
        out = []
        for _ in range(m):
            x = rng.normal(size=dimension)
            for _ in range(warm_up):
                g = gradient(x, values)
                y = x + step * g + np.sqrt(2 * step) * rng.normal(size=dimension)
                if adjusted:
                    back = ((x - y - step * gradient(y, values)) ** 2).sum()
                    there = ((y - x - step * g) ** 2).sum()
                    accept = log_density(y, values) - log_density(x, values) + (there - back) / (4 * step)
                    if np.log(rng.random()) >= accept:
                        continue
                x = y
            out.append(x)
        return np.array(out)

    return _rows(df, columns, chains, seed)


def autoregressive_particles(df: DataFrame, columns: list[str], next_law: Callable[[list[int], tuple], np.ndarray], longest: int, stop: int, m: int, seed: str) -> DataFrame:
    """(i, sequences): m token sequences per row; next_law(prefix, values) gives the next token's probabilities, stop ends a sequence."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, *values in f[["i", *columns]].itertuples(index=False):
                rng, drawn = generator(seed, i), []
                for _ in range(m):
                    tokens: list[int] = []
                    while len(tokens) < longest:
                        p = np.cumsum(next_law(tokens, values))
                        t = int(np.searchsorted(p, rng.random() * p[-1], "right"))
                        if t == stop:
                            break
                        tokens.append(t)
                    drawn.append(tokens)
                out.append(drawn)
            yield pd.DataFrame({"i": f["i"], "sequences": out})

    return df.select("i", *columns).mapInPandas(run, "i long, sequences array<array<int>>")


def external(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """An external model (encoder, scorer, sampler): load() runs once per task and returns a function over Arrow batches.

    A batch on which the model fails is scored row by row. A row that fails again comes back with its columns of the same name
    and nulls in the others; where the schema has a string column `error`, it holds the failure's text.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            try:
                yield model(f)
            except Exception:
                for k in range(len(f)):
                    try:
                        yield model(f.iloc[k : k + 1])
                    except Exception as e:
                        row = {c: f[c].iloc[k] if c in f else None for c in columns}
                        yield pd.DataFrame([row | ({"error": repr(e)} if "error" in columns else {})], columns=columns)

    return df.mapInPandas(run, schema)


def as_rows(points: DataFrame) -> DataFrame:
    """(i, n, v, w): one row per particle, with equal weights."""
    return points.select("i", F.posexplode("points").alias("n", "v"), (1 / F.size("points")).alias("w"))
