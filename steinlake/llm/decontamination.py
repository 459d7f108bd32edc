"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A pattern is a window of WINDOW consecutive words of a benchmark item (an item of fewer words is one pattern). The symbols
of the search are words, not characters. For every pattern length there is one set of Wu-Manber tables: a shift table over
blocks of words says how far the search may jump because no pattern holds the block nearer to its end; where the shift is 0,
the bucket of the suffix block names the patterns to test, and a direct comparison of all words confirms an occurrence.

Cases: a null or wordless text has no words and no hits; a wordless item has no pattern; copies of a window belong to all
their items; rows with equal doc_id stay separate rows; rows of null item_id are one item, which n_items counts and
items_sha256 leaves out, whatever other items are called. An empty benchmark hits nothing. Only doc_id and text of the documents are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, fields, prepared, stored

WINDOW = 13
#: Bytes of the tables of one pass in a Python worker. A larger benchmark is searched in that many passes, each over its own share.
PASS_BYTES = 128 << 20
#: Bytes of one pattern's tables beside its words (tuples, shift entries, bucket entries); 1,240 in all were measured at 13 words.
PATTERN_BYTES = 1200
#: Bytes of the rule's words, A-Z lower-cased; every other byte becomes a blank.
_KEEP = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEEP else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased, as UTF-8."""
    return [] if text is None else text.encode().translate(_TABLE).split()


class WuManber:
    """Tables for patterns of one length, each a tuple of words with a list of item numbers."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length = length
        self.block = 1 if length < 3 else 2 if length < 6 else 3
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
        for p, items in patterns.items():
            for end in range(self.block, length + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.buckets.setdefault(hash(p[-self.block :]), {})[p] = items

    def search(self, words: list[bytes], found: dict[str, None], hit: list[tuple[int, int]]) -> None:
        """Adds the items and the word ranges of all occurrences."""
        n, m, b, far, shift = len(words), self.length, self.block, self.far, self.shift.get
        pos = m
        while pos <= n:
            block = tuple(words[pos - b : pos])
            jump = shift(block, far)
            if jump:
                pos += jump
                continue
            items = self.buckets.get(hash(block), {}).get(tuple(words[pos - m : pos]))
            if items is not None:
                hit.append((pos - m, pos))
                found.update(dict.fromkeys(items))
            pos += 1


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(length, pattern, item_ids): each distinct window once, as blank-joined words, with the items that have it ("=" and the id; "" for a null one)."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = set()
            for item, text in zip(*batch.to_pydict().values(), strict=True):
                w = words_of(text)
                k = min(size, len(w))
                rows.update((k, b" ".join(w[i : i + k]), item) for i in range(len(w) - k + 1 if k else 0))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.string())], ["length", "pattern", "item"])

        return each

    named = F.concat(F.lit("="), F.col("item_id").cast("string"))
    items = benchmark.select(F.coalesce(named, F.lit("")).alias("item"), F.col("text").alias("text"))
    return arrow_map(items, make, "length int, pattern binary, item string").groupBy("length", "pattern").agg(F.collect_set("item").alias("item_ids"))


def _pass(state: DataFrame, patterns: list, last: bool, kept: int) -> DataFrame:
    """One pass with a bounded share of the patterns. The state: the kept columns, text, and the hits of earlier passes."""
    by_length: dict[int, dict] = {}
    for length, pattern, items in patterns:
        by_length.setdefault(length, {})[tuple(bytes(pattern).split(b" "))] = list(items)
    shared = state.sparkSession.sparkContext.broadcast(sorted(by_length.items()))
    schema = T.StructType(state.schema.fields[:kept] + RESULT.fields) if last else state.schema

    def make():
        tables = [WuManber(k, v) for k, v in shared.value]

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            carried, (texts, ranges, items) = batch.columns[:kept], batch.columns[kept:]
            out: list[tuple] = []
            for text, old, had in zip(texts, ranges, items, strict=True):
                words = words_of(text.as_py())
                hit = [tuple(x) for x in np.frombuffer(old.as_py(), "<i8").reshape(-1, 2).tolist()] if old.is_valid else []
                found = dict.fromkeys(had.as_py() or ())
                for t in tables:
                    t.search(words, found, hit)
                if not last:
                    out.append((np.array(hit, "<i8").tobytes(), list(found)))
                    continue
                mark = np.zeros(len(words) + 1, np.int64)
                for a, b in hit:
                    mark[a] += 1
                    mark[b] -= 1
                n, n_hit = len(words), int(np.count_nonzero(np.cumsum(mark[:-1]))) if hit else 0
                out.append((n, n_hit, len(found), hashlib.sha256(",".join(sorted(x[1:] for x in found if x)).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()) if last else (pa.binary(), pa.list_(pa.string()))
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*carried, *([] if last else [texts]), *cols], schema.names)

        return each

    return arrow_map(state, make, schema)


#: The result's columns, after the kept ones.
RESULT = fields("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row per document: the columns of keep, then n_words, n_hit, n_items, items_sha256, contaminated.

    The patterns are counted first. Those of one pass are broadcast, with tables of at most about pass_bytes (patterns are dealt
    out by hash); a benchmark beyond that takes more passes, with the hits so far written to the shared folder between them.
    """
    prepared(docs.sparkSession)
    found = stored(windows(benchmark, window), "windows")
    size = found.agg(F.sum(F.length("pattern") + PATTERN_BYTES + 80 * F.size("item_ids"))).first()[0] or 0
    passes = max(1, -(-int(size) // pass_bytes))
    state = docs.select(*(docs[f"`{c}`"].alias(f"kept{i}") for i, c in enumerate(keep)), docs["text"].alias("text"), F.lit(None).cast("binary").alias("ranges"), F.lit(None).cast("array<string>").alias("items"))
    for k in range(passes):
        mine = found.filter(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == k).collect()
        state = _pass(state, mine, k == passes - 1, len(keep))
        if k < passes - 1:
            state = stored(state, "hits")
    return state.toDF(*keep, *RESULT.names)


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, all columns kept: one pass over the documents, no join."""
    kept = tuple(c for c in docs.columns)
    told = decontaminate(docs, benchmark, kept).toDF(*(f"kept{k}" for k in range(len(kept))), *RESULT.names)
    return told.filter("not contaminated").drop(*RESULT.names).toDF(*kept)
