"""Batches for external models: rows are put together by length under a budget of tokens, whatever batches Arrow brings.

Rows of a task pass through a buffer of bounded size, are ordered by length there, and leave as batches whose cells do not exceed the budget. Three
forms of a batch: `sequential` (rows one by one), `padded` (a rectangle, with a mask) and `ragged` (all tokens in one array, with
offsets). Results come back in the rows' own order of the buffer, with their ids; a longer row than the budget is a batch of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MODES = ("sequential", "padded", "ragged")


@dataclass(frozen=True)
class Batch:
    """tokens: (rows, longest) if padded, else all rows' tokens in one array; offsets: where each row begins in it, and the end."""

    mode: str
    tokens: np.ndarray
    lengths: np.ndarray
    offsets: np.ndarray

    @property
    def mask(self) -> np.ndarray:
        """(rows, longest): whether a cell of a padded batch holds a token."""
        return np.arange(self.tokens.shape[1]) < self.lengths[:, None]


def groups(lengths: np.ndarray, budget: int, mode: str) -> Iterator[np.ndarray]:
    """Places of rows, shortest first, in batches of at most `budget` cells: those of the rectangle if padded, else those of the rows."""
    order = np.argsort(lengths, kind="stable")
    if mode == "sequential":
        yield from (order[k : k + 1] for k in range(len(order)))
        return
    start, held = 0, 0
    for k, row in enumerate(order):
        n = max(1, int(lengths[row]))
        cells = n * (k - start + 1) if mode == "padded" else held + n
        if k > start and cells > budget:
            yield order[start:k]
            start, held = k, 0
        held += n
    if len(order):
        yield order[start:]


def batch_of(rows: list[np.ndarray], mode: str, pad) -> Batch:
    lengths = np.array([len(r) for r in rows])
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.concatenate(rows) if len(rows) else np.zeros(0)
    if mode != "padded":
        return Batch(mode, flat, lengths, offsets)
    whole = np.full((len(rows), max(1, int(lengths.max(initial=0)))), pad, flat.dtype if len(flat) else float)
    whole[np.arange(whole.shape[1]) < lengths[:, None]] = flat
    return Batch(mode, whole, lengths, offsets)


def modelled(df: DataFrame, id_column: str, tokens: str, load: Callable[[], Callable[[Batch], list]], result: str, mode: str = "padded", budget: int = 1 << 14, buffer: int = 1 << 20, pad=0) -> DataFrame:
    """(id, result): what a model returns for each row's tokens (an array column). result is a DDL type.

    load() runs once per task and returns a function from a Batch to one result per row. budget: cells of a batch; buffer: tokens that a task holds to
    order them. A null row has a null result and does not reach the model.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    kind = df.schema[id_column].dataType.simpleString()

    def flush(model, held: list[tuple]) -> pd.DataFrame:
        out: list = [None] * len(held)
        known = [k for k, (_, t) in enumerate(held) if t is not None]
        arrays = [np.asarray(held[k][1]) for k in known]
        for at in groups(np.array([len(a) for a in arrays], int), budget, mode):
            found = list(model(batch_of([arrays[k] for k in at], mode, pad)))
            if len(found) != len(at):
                raise ValueError(f"the model returned {len(found)} results for {len(at)} rows")
            for k, v in zip(at, found, strict=True):
                out[known[k]] = v
        return pd.DataFrame({"id": [i for i, _ in held], "result": out})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, held, size = load(), [], 0
        for f in frames:
            for i, t in zip(f[id_column], f[tokens], strict=True):
                held.append((i, t))
                size += 1 if t is None else len(t) + 1
                if size >= buffer:
                    yield flush(model, held)
                    held, size = [], 0
        if held:
            yield flush(model, held)

    return df.select(id_column, tokens).mapInPandas(run, f"id {kind}, result {result}")


def padded_cells(lengths: list[int], budget: int, buffer: int = 1 << 20, by_length: bool = True) -> int:
    """Cells of all padded batches of rows of these lengths, which is what a model's time follows; by_length=False: in the rows' own order."""
    total, start = 0, 0
    while start < len(lengths):
        end, size = start, 0
        while end < len(lengths) and (end == start or size < buffer):
            size += lengths[end] + 1
            end += 1
        part = np.array(lengths[start:end])
        if by_length:
            total += sum(len(g) * max(1, int(part[g].max())) for g in groups(part, budget, "padded"))
        else:
            row = 0
            while row < len(part):
                stop, top = row, 1
                while stop < len(part) and (stop == row or max(top, int(part[stop])) * (stop - row + 1) <= budget):
                    top = max(top, int(part[stop]))
                    stop += 1
                total += top * (stop - row)
                row = stop
        start = end
    return total
