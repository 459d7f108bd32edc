"""Integer vectors of embeddings: rows without sound vectors left out, components floor(factor * x), packed to few bytes.

A packed vector is its width in bytes (1, 2, 4 or 8), then its components without the zeros at its end: equal vectors have equal bytes, and
a shorter one equals itself filled up with zeros. Components that no 64-bit integer holds stop the job with a message; nothing is clipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map

#: Components of one block in memory.
CELLS = 1 << 22


def sound(rows: DataFrame, carried: dict[str, F.Column], vector: str = "embedding") -> DataFrame:
    """The carried columns and x (array of doubles) of the rows whose vector is not null and holds no null, NaN or infinity."""
    x = F.col("x")
    out = rows.select(*(c.alias(k) for k, c in carried.items()), rows[f"`{vector}`"].cast("array<double>").alias("x"))
    return out.filter(x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))


def integers(col: pa.Array, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """floor(factor * x) of all components in one array, and the bounds of each vector."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(float)
    with np.errstate(over="ignore"):
        x = np.floor(factor * flat)
    if len(x) and not (float(x.min()) >= -(2.0**63) and float(x.max()) < 2.0**63):
        raise ArithmeticError("a vector holds a component that does not fit 64 bits after scaling")
    size = col.value_lengths().to_numpy(zero_copy_only=False)
    return x.astype(np.int64), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def pack(x: np.ndarray) -> bytes:
    solid = np.flatnonzero(x)
    x = x[: solid[-1] + 1 if len(solid) else 0]
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).astype(np.dtype(kind).newbyteorder("<")).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1)


def blocks(col, dims: int, cells: int = CELLS) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row + 1, 64-bit matrix) of runs of packed vectors, filled up with zeros to dims."""
    step = max(1, cells // max(1, dims))
    for a in range(0, len(col), step):
        part = col[a : a + step]
        out = np.zeros((len(part), dims), np.int64)
        for k, raw in enumerate(part):
            v = unpack(raw)
            out[k, : len(v)] = v
        yield a, a + len(part), out


def packed(rows: DataFrame, factor: float) -> DataFrame:
    """The columns of `sound` with v, the packed vector, in place of x."""
    schema = T.StructType([f for f in rows.schema.fields if f.name != "x"] + [T.StructField("v", T.BinaryType())])
    at = rows.columns.index("x")

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            x, ends = integers(batch.column(at), factor)
            v = pa.array([pack(x[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != at), v], schema.names)

        return each

    return arrow_map(rows, make, schema)
