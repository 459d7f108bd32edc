"""Training order as binary token shards: a keyed Feistel permutation gives every sequence its global slot.

A sequence is a piece of at most STRIDE tokens of one document. The documents of each task are numbered by an upper bound of
their pieces (a text has no more tokens than bytes), so numbers are known before anything is tokenised. A Feistel network
permutes the numbers' range, walking the cycle where it leaves the range. Ranges of the permuted numbers are shards: the rows
of a shard meet sorted in one task, which writes them as fixed-stride records of unsigned 16-bit ids, padded with PAD. A
sequence's slot is its rank in the permuted order: the sequences of the shards before it, and its place in its own. A reader
goes on from any slot by one look at the shard table and one multiplication.

Only shards named in the table, which Spark commits, are read, so a repeated task does no harm. The numbering pass and the
writing pass must see the same rows in the same tasks, as two scans of the same files do; every writing task checks that, and
a frame that is not a plain scan should be stored first.

Cases: a null or empty text is the end id alone; repeated rows are sequences of their own; null ids are kept; an empty table
writes no shard; a vocabulary whose ids do not fit 16 bits is an error. Only doc_id and text are read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, fields, new_path, prepared, stored
from .files import open_folder, write_new
from .textkernel import U, mix
from .tokens import vocabulary_path, word_bpe

STRIDE, PAD, END_ID, KEY, ROUNDS = 512, 0xFFFF, 0, 20240501, 4
#: Numbers of one shard, about; a half to a third of them are sequences.
SHARD = 1 << 17
#: Shards whose sequences are summed up in one task.
RUN = 4096
#: Tasks that write shards, at most: beyond as many shards, a task writes several in a row.
WRITERS = 65_536


def feistel(numbers: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """A permutation of 0 .. size - 1, chosen by the key."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low = U((1 << half) - 1)
    with np.errstate(over="ignore"):
        keys = mix(np.arange(1, ROUNDS + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(key))
    out = numbers.astype(U)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> U(half), out[walking] & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        out[walking] = left << U(half) | right
        walking = walking[out[walking] >= U(size)]
    return out.astype(np.int64)


def _bound(text: F.Column, stride: int) -> F.Column:
    """At least the number of a text's pieces: bytes and the end id, over the stride, rounded up."""
    return F.floor((F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(stride)) / F.lit(stride)).cast("long")


def write_training_order(docs: DataFrame, folder: str, stride: int = STRIDE, key: int = KEY, shard: int = SHARD, vocabulary: str | None = None) -> DataFrame:
    """Writes the shards; (doc_id, piece, length, ids_crc32, shard, file, at) of every sequence, at being its record in the file."""
    spark = prepared(docs.sparkSession)
    path = vocabulary or vocabulary_path()
    rows = docs.select("doc_id", "text")
    # A row per task of the scan.
    bounds = rows.select(F.spark_partition_id().alias("task"), _bound(F.col("text"), stride).alias("n")).groupBy("task").agg(F.sum("n").alias("n")).orderBy("task").collect()
    size = sum(r["n"] for r in bounds)
    base, at = {}, 0
    for r in bounds:
        base[r["task"]] = (at, r["n"])
        at += r["n"]
    shards = max(1, -(-size // shard))
    width = max(1, -(-size // shards))
    told = spark.sparkContext.broadcast(base)
    cut = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *fields("piece int, order long, shard int, ids binary")])

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_bpe(path), int(END_ID).to_bytes(2, "little")
        if encoder.slow.get_vocab_size() > PAD:
            raise ValueError(f"ids of {PAD} and more do not fit the shards' unsigned 16-bit records")
        start, expected = told.value.get(TaskContext.get().partitionId(), (0, 0))
        done = 0
        for batch in batches:
            row, piece, number, ids = [], [], [], []
            texts = batch.column(1).to_pylist()
            for k, (text, raw) in enumerate(zip(texts, encoder.encode(texts), strict=True)):
                short = np.frombuffer(raw, "<u4").astype("<u2").tobytes() + end
                for n in range(0, len(short), 2 * stride):
                    row.append(k)
                    piece.append(n // (2 * stride))
                    number.append(start + done + piece[-1])
                    ids.append(short[n : n + 2 * stride])
                done += (len((text or "").encode()) + stride) // stride
            if done > expected:
                raise ValueError("the rows of this task changed since they were numbered; store the documents first")
            order = feistel(np.array(number, np.int64), size, key)
            where = (order // width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(order), pa.array(where), pa.array(ids, pa.binary())], cut.names)
        if done != expected:
            raise ValueError("the rows of this task changed since they were numbered; store the documents first")

    written = T.StructType([cut["doc_id"], *fields("piece int, length int, ids_crc32 long, shard int, file string, at long")])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        now, out, name, place = None, None, "", 0
        for batch in batches:
            files, places, lengths, sums = [], [], [], []
            for shard_no, raw in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if shard_no != now:
                    if out is not None:
                        out.close()
                    now, place, name = shard_no, 0, f"shard-{shard_no:06d}-{uuid.uuid4().hex}.u16"
                    out = write_new(store, f"{root}/{name}")
                out.write(raw + int(PAD).to_bytes(2, "little") * (stride - len(raw) // 2))
                files.append(name)
                places.append(place)
                lengths.append(len(raw) // 2)
                sums.append(zlib.crc32(raw))
                place += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.int32()), pa.array(sums, pa.int64()), batch.column(3), pa.array(files), pa.array(places, pa.int64())], written.names)
        if out is not None:
            out.close()

    # As many shards to each task as to any other, and in a row: a hash of the shard's number would give some tasks several and others none.
    writers = min(shards, WRITERS)
    writer = F.floor(F.col("shard").cast("long") * F.lit(writers) / F.lit(shards)).cast("int")
    dealt = rows.mapInArrow(tokenise, cut).repartitionById(writers, writer).sortWithinPartitions("shard", "order")
    return stored(dealt.mapInArrow(write, written), "order")


def shard_table(sequences: DataFrame) -> DataFrame:
    """(shard, file, n, first_slot): one row per shard. Sums within runs of RUN shards, then over the runs, so no task numbers all shards."""
    counts = sequences.groupBy("shard", "file").agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.floor(F.col("shard") / RUN))
    runs = counts.groupBy("run").agg(F.sum("n").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    before = F.sum("n").over(Window.partitionBy("run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    within = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    return within.join(runs, "run").select("shard", "file", "n", (F.coalesce("base", F.lit(0)) + F.col("before")).alias("first_slot"))


def with_slot(sequences: DataFrame) -> DataFrame:
    """Every sequence with its slot, from 0 without gaps. The shard table is broadcast only where Spark finds it small enough."""
    return sequences.join(shard_table(sequences), ["shard", "file"]).select("doc_id", "piece", "length", "ids_crc32", "shard", "file", "at", (F.col("first_slot") + F.col("at")).alias("slot"))


def read_from(table: list, folder: str, slot: int, count: int, stride: int = STRIDE) -> Iterator[np.ndarray]:
    """Up to count sequences from a slot on, without padding: sequential reads of the shards (rows of shard_table, collected)."""
    store, root = open_folder(folder)
    for row in sorted(table, key=lambda r: r["first_slot"]):
        skip = max(0, slot - row["first_slot"])
        if skip >= row["n"] or count <= 0:
            continue
        with store.open_input_file(f"{root}/{row['file']}") as f:
            f.seek(skip * 2 * stride)
            for _ in range(min(count, row["n"] - skip)):
                ids = np.frombuffer(f.read(2 * stride), "<u2")
                count -= 1
                slot += 1
                yield ids[ids != PAD]


def training_order(docs: DataFrame) -> DataFrame:
    """Shards in a new folder of the shared one, and every sequence's slot."""
    return with_slot(write_training_order(docs, new_path(prepared(docs.sparkSession), "shards")))
