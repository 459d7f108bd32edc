"""Randomness from hashes: the same draws in every engine, on every partitioning, and after a lost task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed, *parts) -> Column:
    """md5 of the seed and the parts, colon-joined, as hex."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)).cast("binary"))


def sign(seed, *parts) -> Column:
    """A Rademacher draw: 1 or -1."""
    return F.when(F.substring(digest(seed, *parts), 1, 1) < "8", 1).otherwise(-1)


def index(seed, n, *parts) -> Column:
    """A draw from 0 to n - 1 (eight hex digits, modulo n)."""
    return F.pmod(F.conv(F.substring(digest(seed, *parts), 1, 8), 16, 10).cast("long"), n)


def uniform(seed, *parts) -> Column:
    """A draw from [0, 1)."""
    return F.conv(F.substring(digest(seed, *parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


# Counter-based draws inside tasks: a draw depends on its key, its step and its place only, so work can stop after any step and go on.

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def counter_uniforms(keys: np.ndarray, step: int, width: int) -> np.ndarray:
    """(keys, width) draws from (0, 1) for a step."""
    with np.errstate(over="ignore"):
        base = mixed(keys + np.uint64(step + 1) * _GOLDEN)[:, None]
        h = mixed(mixed(base + np.arange(1, width + 1, dtype=np.uint64) * _GOLDEN))
    return ((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def counter_normals(keys: np.ndarray, step: int, width: int) -> np.ndarray:
    """(keys, width) standard normal draws for a step, two uniforms each."""
    u = counter_uniforms(keys, step, 2 * width)
    return np.sqrt(-2 * np.log(u[:, :width])) * np.cos(2 * np.pi * u[:, width:])
