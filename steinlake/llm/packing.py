"""Best-fit packing: documents as token pieces in as few sequences of a fixed capacity as can be.

Bounded-space online best-fit: a task keeps at most OPEN bins open. Their free space is the key of a bitset, so the bin with
the least room that still holds a piece is one shift and one lowest-bit away; a piece that fits nowhere opens a bin, and when
OPEN bins are open already the fullest one closes first. That happens where over OPEN of a task's pieces leave a gap that no
later piece has filled yet, as with many pieces of more than half the capacity. Pieces are dealt out by a hash of document, piece and
place in the table, about SHARE to a task, so that neither null ids nor repeated rows meet in one; they reach the task
longest first, which leaves one or two bins per task that are not full.

Cases: a null text is an empty one; an empty text is the end id alone; repeated rows are packed as rows of their own; a null
doc_id is kept. Only doc_id and text are read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, fields, prepared, stored
from .tokens import vocabulary_path, word_bpe

CAPACITY, OPEN, SHARE = 2048, 1 << 16, 100_000


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, cut only where it is longer than capacity."""
    prepared(docs.sparkSession)
    path = vocabulary or vocabulary_path()
    end = int(end_id).to_bytes(4, "little")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *fields("piece int, start long, length long, ids_crc32 long"), *(fields("ids binary") if with_ids else [])])

    def make():
        encoder = word_bpe(path)

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, raw in enumerate(encoder.encode(batch.column(1).to_pylist())):
                raw += end
                for k in range(0, len(raw), 4 * capacity):
                    part = raw[k : k + 4 * capacity]
                    rows.append(row)
                    piece.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            cols = [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.binary())] if with_ids else []), schema.names)

        return each

    return arrow_map(docs.select("doc_id", "text"), make, schema)


class OpenBins:
    """At most `most` open bins of one capacity."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = self.opened = self.now = 0

    def _take(self, room: int) -> int:
        stack = self.free[room]
        found = stack.pop()
        if not stack:
            self.mask ^= 1 << room
        self.now -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to capacity tokens."""
        fits = self.mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = self._take(room)
        else:
            if self.now >= self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)
            room, at = self.capacity, self.opened
            self.opened += 1
        left = room - size
        if left:
            self.free[left].append(at)
            self.mask |= 1 << left
            self.now += 1
        return at, self.capacity - room


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN, share: int = SHARE) -> DataFrame:
    """The pieces with sequence_id and offset. pieces: a stored table of doc_id, piece, length (1 to capacity) and any other columns."""
    tasks = max(1, -(-pieces.count() // share))
    schema = T.StructType([*pieces.schema.fields, *fields("sequence_id long, offset long")])
    at = pieces.columns.index("length")

    def make():
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            placed = [bins.place(n) for n in batch.column(at).to_pylist()]
            ids, offsets = zip(*placed, strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base + x for x in ids], pa.int64()), pa.array(offsets, pa.int64())], schema.names)

        return each

    dealt = pieces.repartition(tasks, F.xxhash64("doc_id", "piece", F.monotonically_increasing_id())).sortWithinPartitions(F.desc("length"), "doc_id", "piece")
    return arrow_map(dealt, make, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, vocabulary: str | None = None) -> DataFrame:
    """Every piece of every document with its place; the pieces are stored once, so texts are tokenised once."""
    return best_fit(stored(token_pieces(docs, capacity, vocabulary=vocabulary, with_ids=with_ids), "pieces"), capacity)
