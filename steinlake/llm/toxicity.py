"""Toxicity by class-conditional Kneser-Ney models of the bytes within words.

Two models, of toxic and of ordinary text, give the next byte of a word from the five before it (a word is a run of letters,
with a mark before and after). Each discounts its own counts and backs off, from SHARED bytes on to Kneser-Ney continuation
counts of both classes together, so an expression that is rare in both says little. A text's evidence is the difference of its two log-likelihoods
divided by its length, over the whole text and over the part by which single words exceed CLEAR nats; a logistic curve, fitted on labelled documents that the counts have not seen, turns it into a score.

Fitting uses at most about FIT documents and FIT_BYTES of text of each label, chosen by a hash of the id among labelled ids outside
the held-out fifth with texts of at most LONGEST bytes (those bounds are parameters), so the counts that reach the driver are
bounded too; their lang, source and id are no inputs. Scoring reads whole texts.

Cases: a null, empty or letterless text gets the share of toxic rows as its score (at most 0.49); without labels of both
kinds every score is 0; repeated rows are scored alike; labels that are null or not 0/1 are not learnt from; a doc_id with
several labels counts once for each. Only doc_id and text, and doc_id and toxic of the labels, are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, fields, held_out, prepared, stored
from .textkernel import LETTER, LOWER, U, chunks, word_bounds, word_hashes

ORDER, SHARED, DISCOUNT, CLEAR, FIT = 6, 4, 0.75, 3.0, 8_000
FIT_BYTES, LONGEST = 64 << 20, 1 << 20
_MARK = 1


def distinct_words(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of one word of each kind, kind of every word)."""
    _, first, kind = np.unique(word_hashes(low, starts, ends), return_index=True, return_inverse=True)
    return first, kind


def word_grams(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each word and its end mark: that byte in the lowest 8 bits, those before it above. And the words' bounds."""
    size = ends - starts + 1
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    within = np.arange(at[-1]) - np.repeat(at[:-1], size)
    where = np.repeat(starts, size) + within
    last = np.repeat(size, size) - 1
    key = np.zeros(at[-1], U)
    for back in range(order):
        pos = within - back
        byte = np.where((pos >= 0) & (pos < last), low[np.clip(where - back, 0, max(len(low) - 1, 0))] if len(low) else 0, _MARK)
        key |= byte.astype(U) << U(8 * back)
    return key, at


class KneserNeyPair:
    """The two models: for every order above SHARED the log-likelihood ratio of each gram, and of the rest of each context.

    A class discounts its counts (at the highest order; continuation types below) and backs off to its own next lower order;
    at SHARED bytes both back off to the same continuation counts, pooled over the classes.
    """

    def __init__(self, keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, order: int = ORDER, d: float = DISCOUNT):
        """keys: distinct grams of the highest order, sorted; their counts in each class."""
        low = lambda m: U((1 << (8 * m)) - 1)
        # Grams of each order, with counts or types by class, from the highest down.
        levels = {order: (keys, toxic, ordinary)}
        for m in range(order - 1, 0, -1):
            above, t, o = levels[m + 1]
            grams, at = np.unique(above & low(m), return_inverse=True)
            levels[m] = (grams, np.bincount(at, t > 0).astype(float), np.bincount(at, o > 0).astype(float))

        def interpolated(grams, counts, base):
            """Probabilities, and what a context leaves to the order below (1 where it was not seen)."""
            heads, of = np.unique(grams >> U(8), return_inverse=True)
            total = np.bincount(of, counts)
            rest = np.where(total > 0, d * np.bincount(of, counts > 0) / np.maximum(total, 1), 1.0)
            return np.maximum(counts - d, 0) / np.maximum(total, 1)[of] + rest[of] * base, heads, rest

        below, p = None, None
        for m in range(1, SHARED + 1):
            grams, t, o = levels[m]
            base = np.full(len(grams), 1 / 256) if below is None else p[np.searchsorted(below, grams & low(m - 1))]
            p, _, _ = interpolated(grams, t + o, base)
            below = grams
        both = [p, p]
        self.levels = []
        for m in range(SHARED + 1, order + 1):
            grams, *counts = levels[m]
            at = np.searchsorted(below, grams & low(m - 1))
            found = [interpolated(grams, c, q[at]) for c, q in zip(counts, both, strict=True)]
            both, below = [f[0] for f in found], grams
            self.levels.append((m, grams, np.log(both[0]) - np.log(both[1]), found[0][1], np.log(found[0][2]) - np.log(found[1][2])))

    def ratios(self, grams: np.ndarray) -> np.ndarray:
        """The log-likelihood ratio of the last byte of each gram."""
        out = np.zeros(len(grams))
        left = np.arange(len(grams))
        for m, keys, ratio, heads, rest in reversed(self.levels):
            own = grams[left] & U((1 << (8 * m)) - 1)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            seen = keys[at] == own
            out[left[seen]] += ratio[at[seen]]
            left, context = left[~seen], own[~seen] >> U(8)
            if not len(left):
                break
            at = np.minimum(np.searchsorted(heads, context), len(heads) - 1)
            out[left] += np.where(heads[at] == context, rest[at], 0.0)
        return out

    def evidence(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """For each text: difference of log-likelihoods, bytes and end marks, sum of single words' excess over CLEAR, words."""
        low = LOWER[raw]
        starts, ends, first = word_bounds(low, offs, LETTER)
        if not len(starts):
            return np.zeros((len(offs) - 1, 4))
        one, kind = distinct_words(low, starts, ends)
        grams, at = word_grams(low, starts[one], ends[one])
        word = np.add.reduceat(self.ratios(grams), at[:-1])
        per_word = np.column_stack([word, np.diff(at), np.maximum(word - CLEAR, 0), np.ones(len(word))])[kind]
        return np.add.reduceat(np.concatenate([per_word, np.zeros((1, 4))]), first[:-1]) * (np.diff(first) > 0)[:, None]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the first is the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def features(evidence: np.ndarray) -> np.ndarray:
    """What the curve sees of a text: both differences, length-normalised and in units of their chance spread."""
    n, words = np.maximum(evidence[:, 1], 1), np.maximum(evidence[:, 3], 1)
    return np.column_stack([evidence[:, 0] / n, evidence[:, 0] / np.sqrt(n), evidence[:, 2] / words, evidence[:, 2] / np.sqrt(words)])


def _count(rows: DataFrame) -> DataFrame:
    """(toxic, check, gram, n) of rows(toxic, check, text)."""
    schema = fields("toxic int, check boolean, gram long, n long")

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            label = batch.column(0).to_numpy(zero_copy_only=False) * 2 + batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, raw, offs in chunks(batch.column(2)):
                low = LOWER[raw]
                starts, ends, first = word_bounds(low, offs, LETTER)
                of = np.repeat(label[a:b], np.diff(first))
                for k in range(4):
                    grams, _ = word_grams(low, starts[of == k], ends[of == k])
                    key, n = np.unique(grams, return_counts=True)
                    if len(key):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k // 2, np.int32)), pa.array(np.full(len(key), k % 2 == 1)), pa.array(key.view(np.int64)), pa.array(n)], schema.names)

        return each

    return arrow_map(rows, make, schema).groupBy("toxic", "check", "gram").agg(F.sum("n").alias("n"))


def _evidence(rows: DataFrame, shared) -> DataFrame:
    """rows(kept..., text) with the evidence in the place of text."""
    kept = len(rows.columns) - 1
    schema = T.StructType([*rows.schema.fields[:kept], *fields("difference double, length double, clear double, words double")])

    def make():
        model = shared.value

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for a, b, raw, offs in chunks(batch.column(kept)):
                found = model.evidence(raw, offs).T if model is not None else np.zeros((4, b - a))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:kept]), *(pa.array(x) for x in found)], schema.names)

        return each

    return arrow_map(rows, make, schema)


def _model(table) -> KneserNeyPair | None:
    """The model of a frame of counts; None without counts."""
    if not len(table):
        return None
    grams = table["gram"].to_numpy().view(U)
    keys, at = np.unique(grams, return_inverse=True)
    toxic = table["toxic"].to_numpy() == 1
    n = table["n"].to_numpy().astype(float)
    return KneserNeyPair(keys, np.bincount(at, n * toxic, len(keys)), np.bincount(at, n * ~toxic, len(keys)))


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT, most_bytes: int = FIT_BYTES):
    """(model, weights, share of toxic rows) from at most about `most` documents, and most_bytes of text, of each label."""
    spark = prepared(docs.sparkSession)
    marked = labels.select(labels["doc_id"].alias("_id"), labels["toxic"].cast("int").alias("toxic")).filter("toxic in (0, 1)").filter(~held_out(F.col("_id"))).distinct()
    n = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None, np.zeros(5), 0.0
    hashed = F.pmod(F.xxhash64("_id"), F.lit(1 << 20))
    rate = {k: min(1.0, most / n[k]) for k in n}
    chosen = marked.filter(F.when(F.col("toxic") == 1, hashed < rate[1] * (1 << 20)).otherwise(hashed < rate[0] * (1 << 20)))
    chosen = chosen.withColumn("check", F.pmod(F.crc32(F.concat(F.lit("check"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary")), F.lit(4)) == 0)
    # The chosen ids are at most about 2 * most rows.
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    rows = stored(docs.select("doc_id", "text").filter(size <= LONGEST).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_id", "toxic", "check", "text"), "labelled")
    # Two rows at most.
    excess = {r["toxic"]: min(1.0, most_bytes / max(1, r["n"])) for r in rows.groupBy("toxic").agg(F.sum(size).alias("n")).collect()}
    if min(excess.values(), default=1.0) < 1:
        again = F.pmod(F.xxhash64("_id", F.lit("bytes")), F.lit(1 << 20))
        rows = rows.filter(again < F.when(F.col("toxic") == 1, excess.get(1, 1.0)).otherwise(excess.get(0, 1.0)) * (1 << 20))
    table = _count(rows.select("toxic", "check", "text")).toPandas()
    if not len(table):
        return None, np.zeros(5), 0.0
    curve_model = spark.sparkContext.broadcast(_model(table[~table["check"]]))
    shared = spark.sparkContext.broadcast(_model(table))  # the curve is fitted on unseen documents; then all of them are counted
    seen = _evidence(rows.filter("check").select("toxic", "text"), curve_model).filter("length > 0").toPandas()
    share = n[1] / (n[0] + n[1])
    if seen["toxic"].nunique() < 2:
        return shared, np.array([math.log(share / (1 - share)), 100.0, 0.0, 0.0, 0.0]), share
    x = features(seen[["difference", "length", "clear", "words"]].to_numpy())
    scale = x.std(axis=0) + 1e-12
    w = logistic(x / scale, seen["toxic"].to_numpy().astype(float))
    w[1:] /= scale
    w[0] -= math.log(rate[1] / rate[0])  # the labels were drawn at different rates
    return shared, w, share


def score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), most: int = FIT) -> DataFrame:
    """The columns of keep, then score and predicted, for every document."""
    shared, w, share = fit(docs, labels, most)
    rows = docs.select(*(docs[f"`{c}`"].alias(f"kept{k}") for k, c in enumerate(keep)), docs["text"].alias("text"))
    schema = T.StructType([*rows.schema.fields[: len(keep)], *fields("score double, predicted int")])
    if shared is None:
        return rows.drop("text").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).toDF(*keep, "score", "predicted")

    def make():
        model, kept = shared.value, len(keep)

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for a, b, raw, offs in chunks(batch.column(kept)):
                found = model.evidence(raw, offs)
                p = 1 / (1 + np.exp(-np.clip(w[0] + features(found) @ w[1:], -700, 700)))
                p = np.where(found[:, 3] > 0, p, min(share, 0.49))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:kept]), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], schema.names)

        return each

    return arrow_map(rows, make, schema).toDF(*keep, "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted toxic, all columns kept: one pass, no join."""
    kept = tuple(docs.columns)
    told = score(docs, labels, kept).toDF(*(f"kept{k}" for k in range(len(kept))), "score", "predicted")
    return told.filter("predicted = 0").drop("score", "predicted").toDF(*kept)
