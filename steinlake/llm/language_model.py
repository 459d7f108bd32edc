"""Stupid-backoff scores of whole documents from n-gram counts of the whole corpus.

The score of a word is c(history word) / c(history) for the longest history of at most ORDER - 1 words whose n-gram is in the
count tables, times ALPHA for every word of history given up; a single word scores c(word) / N. Tables of two and more words
hold n-grams seen at least LEAST times. A document's score is the sum of the logarithms over its words.

Counting and scoring is one relational plan. A block is BLOCK bytes of consecutive rows of one scan task, so equal rows, however
many, are spread over blocks like any others.

1. Each block is exploded to its n-grams, which are pre-aggregated. An exchanged row is one hash range of one block: the hashes
   of its distinct n-grams, sorted, with their counts.
2. The count tables are partitioned by hash range. A range adds up what all blocks send to it.
3. The counts are joined back on (block, range) to the n-grams of the block's words, and summed per document.

A block makes at most RANGES rows, so rows grow with the text and not with its square. Where RANGES ranges would hold more than SHARE n-grams each (from
about 55 GB of text on), a range is cut finer, but blocks do not meet the finer ranges themselves: the blocks are dealt out to PARTS parts, a part's
rows of one range are merged and sent on by finer range, and the counts come back the same way. That is at most PARTS rows for a finer
range, whose number grows with the text, so all rows grow with the text; the price is that the blocks' rows are stored once and exchanged twice. About six bytes cross the network
for a distinct n-gram of a block, and one byte back; a frequent n-gram is one entry per block however often it occurs there.
Hashes have BITS bits; two n-grams with equal hashes would be counted together. At 64 bits an n-gram meets one of 6.6e9 others
(30 GB, upper bound) with probability 4e-10.

Both scans must give a task the same rows, as two scans of the same files do; scoring checks that, and a frame that is not a plain
scan should be stored first.

Cases: words are runs without blanks, lower-cased in A-Z; a null or wordless text has no words and score 0; repeated rows are
counted and scored each; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, prepared, stored
from .textkernel import LOWER, VISIBLE, U, chunks, mix, word_bounds, word_hashes

ORDER, ALPHA, LEAST, BLOCK, BITS = 3, 0.4, 2, 12 << 20, 64
#: Bytes of the gap between a block's hashes, of which some millions spread over 64 bits.
GAP = 6
#: Hash ranges of a block, and n-grams of all blocks that one range adds up at most, about; more make finer ranges.
RANGES, SHARE = 4096, 4_000_000
#: Parts of the blocks whose n-grams are merged before they meet finer ranges.
PARTS = 1024


def pack(values: np.ndarray, wide: int) -> bytes:
    """Small numbers as `wide` planes of bytes, highest first (the high ones are alike and compress); larger numbers are listed behind."""
    top = (1 << (8 * wide)) - 1
    large = np.flatnonzero(values >= top)
    planes = np.minimum(values, top).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - wide :].T
    return np.array([len(values), len(large)], "<u8").tobytes() + planes.tobytes() + large.astype("<u4").tobytes() + values[large].astype("<u8").tobytes()


def unpack(raw: bytes, wide: int, at: int = 0) -> tuple[np.ndarray, int]:
    """The numbers of pack(), and where they end."""
    n, large = np.frombuffer(raw, "<u8", 2, at).tolist()
    at += 16
    out = np.zeros(n, np.uint64)
    for plane in np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n):
        out = out << U(8) | plane
    at += n * wide
    where = np.frombuffer(raw, "<u4", large, at)
    at += 4 * large
    out[where] = np.frombuffer(raw, "<u8", large, at)
    return out, at + 8 * large


def squeezed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def opened(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """(number, ids, bytes, bounds) of runs of about that many bytes of a task's rows (doc_id, text)."""
    task, number = TaskContext.get().partitionId() << 32, 0
    ids, raws, lengths, held = [], [], [], 0

    def block() -> tuple[int, pa.Array, np.ndarray, np.ndarray]:
        offs = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        return task + number, pa.concat_arrays(ids), np.concatenate(raws), offs

    for batch in batches:
        for a, b, raw, offs in chunks(batch.column(1), size):
            if held and held + len(raw) > size:
                yield block()
                number += 1
                ids, raws, lengths, held = [], [], [], 0
            ids.append(batch.column(0).slice(a, b - a))
            raws.append(raw)
            lengths.append(np.diff(offs))
            held += len(raw)
    if ids:
        yield block()


def grams(raw: np.ndarray, offs: np.ndarray, order: int, bits: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each n, the hash of the n words that end at each word (no key where place < n - 1: the text has fewer); each word's place; first words."""
    low = LOWER[raw]
    starts, ends, first = word_bounds(low, offs, VISIBLE)
    words = word_hashes(low, starts, ends)
    del low, starts, ends
    place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    found, h = [], np.zeros(len(words), U)
    for n in range(order):
        back = np.zeros(len(words), U)
        back[n:] = words[: len(words) - n]
        h = mix(h * U(3) + back + U(n + 1))
        found.append(h >> U(64 - bits))
    return found, place, first


def distinct(found: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of all orders, sorted, with their counts. `found` is emptied; sorting in place needs the least memory."""
    keys = np.empty(sum(int((place >= n).sum()) for n in range(len(found))), U)
    at = 0
    for n in range(len(found)):
        some = found[n][place >= n]
        found[n] = None
        keys[at : at + len(some)] = some
        at += len(some)
    keys.sort()
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return keys[first], np.diff(first, append=len(keys))


def _range_bits(entries: int) -> tuple[int, int]:
    """Bits of a hash that name its range, and those behind them that name a finer one, for that many n-grams in all blocks."""
    coarse = RANGES.bit_length() - 1
    return coarse, max(0, (max(1, entries // SHARE) - 1).bit_length() - coarse)


def gram_data(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return squeezed(pack(np.diff(keys, prepend=U(0)), GAP) + pack(counts.astype(U), 1))


def opened_grams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes and counts of gram_data."""
    raw = opened(data)
    gaps, at = unpack(raw, GAP)
    return np.cumsum(gaps, dtype=np.uint64), unpack(raw, 1, at)[0].astype(np.int64)


def cut_by(names: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The different names of sorted hashes, and the gram_data of each."""
    found, cut = np.unique(names, return_index=True)
    cut = [*cut.tolist(), len(keys)]
    return found, [gram_data(keys[a:b], counts[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def gram_rows(docs: DataFrame, order: int, block: int, bits: int, ranges: int) -> DataFrame:
    """(block, range, data): the distinct n-grams of each block with their counts, a row for each hash range (of 1 << ranges) that has any."""
    schema = fields("block long, range int, data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, raw, offs in blocks(batches, block):
            found, place, _ = grams(raw, offs, order, bits)
            keys, counts = distinct(found, place)
            del found, place
            names, data = cut_by(keys >> U(bits - ranges), keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), number)), pa.array(names.astype(np.int32)), pa.array(data, pa.binary())], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def added_up(frame: pd.DataFrame) -> pd.DataFrame:
    """The frame with, in place of each row's own counts, those of all its rows, in the same order."""
    keys, counts = zip(*map(opened_grams, frame["data"]), strict=True)
    _, of = np.unique(np.concatenate(keys), return_inverse=True)
    # Counts are exact in doubles up to 2**53.
    total = np.bincount(of, np.concatenate(counts).astype(float), minlength=1)
    ends = np.cumsum([len(k) for k in keys])
    return frame.assign(data=[squeezed(pack(total[of[e - len(k) : e]].astype(U), 1)) for k, e in zip(keys, ends, strict=True)])


def count_tables(rows: DataFrame) -> DataFrame:
    """(block, range, data) of gram_rows with the counts of the whole corpus in the place of the block's own, in the same order."""
    return rows.groupBy("range").applyInPandas(added_up, rows.schema)


def merged_rows(rows: DataFrame, bits: int, ranges: int, finer: int) -> DataFrame:
    """(range, part, fine, data): the distinct n-grams of each part of the blocks with their counts, a row for each finer range. rows: gram_rows with `part`."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        keys, counts = zip(*map(opened_grams, frame["data"]), strict=True)
        keys, of = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(of, np.concatenate(counts).astype(float))
        names, data = cut_by(keys >> U(bits - ranges - finer) & U((1 << finer) - 1), keys, total)
        return pd.DataFrame({"range": frame["range"].iloc[0], "part": frame["part"].iloc[0], "fine": names.astype(np.int32), "data": data})

    return rows.groupBy("range", "part").applyInPandas(merge, fields("range int, part int, fine int, data binary"))


def finer_count_tables(rows: DataFrame, bits: int, ranges: int, finer: int) -> DataFrame:
    """What count_tables gives, by way of parts and of 1 << finer finer ranges in each range. rows, gram_rows, are read twice, so they should be stored."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(PARTS)).cast("int"))
    merged = merged_rows(rows, bits, ranges, finer)
    totals = merged.groupBy("range", "fine").applyInPandas(added_up, merged.schema)

    def give_back(mine: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        keys = [opened_grams(x)[0] for x in mine["data"]]
        total = np.concatenate([unpack(opened(x), 1)[0] for x in told.sort_values("fine")["data"]])
        whole = np.unique(np.concatenate(keys))
        return pd.DataFrame({"block": mine["block"], "range": mine["range"], "data": [squeezed(pack(total[np.searchsorted(whole, k)], 1)) for k in keys]})

    return rows.groupBy("range", "part").cogroup(totals.groupBy("range", "part")).applyInPandas(give_back, fields("block long, range int, data binary"))


def _texts(docs: DataFrame, block: int) -> DataFrame:
    """(block, ids, sizes, data): the texts of each block as compressed bytes, one row a block."""
    schema = T.StructType([*fields("block long"), T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType)), T.StructField("sizes", T.ArrayType(T.IntegerType())), *fields("data binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, raw, offs in blocks(batches, block):
            lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x) for x in (ids, pa.array(np.diff(offs), pa.int32()))]
            packed = zstandard.ZstdCompressor(level=3).compress(raw.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, pa.array([packed], pa.binary())], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def backoff_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, least: int = LEAST, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """(doc_id, n_words, n_seen, log_score): words, words whose n-gram of full order was in the tables, and the sum of logarithms."""
    prepared(docs.sparkSession)
    size = docs.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))).first()[0] or 0
    ranges, finer = _range_bits(int(size) * order // 10)
    ranges, finer = min(bits, ranges), max(0, min(bits - ranges, finer))
    rows = gram_rows(docs, order, block, bits, ranges)
    tables = finer_count_tables(stored(rows, "grams"), bits, ranges, finer) if finer else count_tables(rows)

    def score(frame: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        text = frame.iloc[0]
        raw = np.frombuffer(opened(text["data"]), np.uint8)
        found, place, first = grams(raw, np.concatenate([[0], np.cumsum(text["sizes"], dtype=np.int64)]), order, bits)
        keys, _ = distinct(list(found), place)
        totals = np.concatenate([np.zeros(0, U), *(unpack(opened(x), 1)[0] for x in counted.sort_values("range")["data"])]).astype(float)
        if len(totals) != len(keys):
            raise ValueError("the rows of a block changed between counting and scoring; store the documents first")
        counts = [np.zeros(len(place)) for _ in found]
        for n, f in enumerate(found):
            counts[n][place >= n] = totals[np.searchsorted(keys, f[place >= n])]
        logs = np.log(np.maximum(counts[0], 1))
        alone = np.ones(len(place), bool)
        for n in range(1, order):
            history = np.concatenate([[0.0], counts[n - 1][:-1]]) if len(place) else counts[n - 1]
            seen = (place >= n) & (counts[n] >= least)
            penalty = np.where(place >= n, np.log(alpha), 0.0)
            logs = np.where(seen, np.log(np.maximum(counts[n], 1)) - np.log(np.maximum(history, 1)), logs + penalty)
            alone &= ~seen
        full = (place >= order - 1) & (counts[order - 1] >= least)
        some = np.diff(first) > 0
        log, single, seen = (np.add.reduceat(np.append(x, 0.0), first[:-1]) * some for x in (logs, alone, full))
        return pd.DataFrame({"doc_id": pd.Series(list(text["ids"]), dtype=object), "n_words": np.diff(first), "n_seen": seen.astype(np.int64), "n_alone": single.astype(np.int64), "log_score": log})

    schema = T.StructType([docs.schema["doc_id"], *fields("n_words long, n_seen long, n_alone long, log_score double")])
    scored = stored(_texts(docs, block).groupBy("block").cogroup(tables.groupBy("block")).applyInPandas(score, schema), "scores")
    words = scored.agg(F.sum("n_words")).first()[0] or 1
    return scored.select("doc_id", "n_words", "n_seen", (F.col("log_score") - F.col("n_alone") * F.lit(float(np.log(max(words, 1))))).alias("log_score"))
