"""Language identification: script ranges narrow the candidates, and Viterbi over words labels spans of mixed texts.

A word is a run of letters (of any script, with the marks on them), lower-cased. Only languages that use the script of its first
letter are candidates and are scored: a word's score in a language is the log-probability of its byte n-grams (2 to 4, with a
mark at both ends) under that language's smoothed counts.
The best path over a text's words pays SWITCH for each change of language; its runs are the spans. The text's language is the
one whose spans hold the most bytes of words, and the score is their share.

Fitting uses at most about FIT documents and FIT_BYTES of text, in equal shares for each language (so a rare one is not lost beside
a hot one), chosen by a hash of the id among those with a language outside the held-out fifth and at most LONGEST bytes.
Predictions read text alone.

Cases: a null text, or one without a letter, is `und` with score 0 and no spans; so is every text when no row has a language;
ties go to the language that sorts first; repeated rows are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, fields, held_out, prepared
from .textkernel import chunks, letter_words
from .toxicity import distinct_words

FIT, BITS, SIZES, SMOOTH, SWITCH, TEMPER = 20_000, 18, (2, 3, 4), 0.1, 8.0, 0.5
FIT_BYTES, LONGEST = 128 << 20, 1 << 20
#: A candidate's score is above that of every other language by this at least.
BARRED = 60.0
#: The pipeline's stage keeps texts whose main language holds at least this share of the words' bytes.
MAIN = 0.4
UNKNOWN = "und"
#: First and last code points of Unicode's ranges for scripts; the first row is the rest.
SCRIPTS = [
    ("other", 0, 0),
    ("latin", 0x41, 0x24F),
    ("greek", 0x370, 0x3FF),
    ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x6FF),
    ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF),
    ("tamil", 0xB80, 0xBFF),
    ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF),
    ("latin additional", 0x1E00, 0x1EFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
    ("syriac and thaana", 0x700, 0x7BF),
    ("gurmukhi", 0xA00, 0xA7F),
    ("gujarati", 0xA80, 0xAFF),
    ("oriya", 0xB00, 0xB7F),
    ("telugu", 0xC00, 0xC7F),
    ("kannada", 0xC80, 0xCFF),
    ("malayalam", 0xD00, 0xD7F),
    ("sinhala", 0xD80, 0xDFF),
    ("lao", 0xE80, 0xEFF),
    ("tibetan", 0xF00, 0xFFF),
    ("burmese", 0x1000, 0x109F),
    ("hangul jamo", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x139F),
    ("cherokee", 0x13A0, 0x13FF),
    ("khmer", 0x1780, 0x17FF),
    ("mongolian", 0x1800, 0x18AF),
    ("cyrillic extended c", 0x1C80, 0x1C8F),
    ("greek extended", 0x1F00, 0x1FFF),
    ("cyrillic extended a", 0x2DE0, 0x2DFF),
    ("bopomofo", 0x3100, 0x312F),
    ("hangul compatibility", 0x3130, 0x318F),
    ("kana extended", 0x31F0, 0x31FF),
    ("han extension a", 0x3400, 0x4DBF),
    ("cyrillic extended b", 0xA640, 0xA69F),
    ("latin extended d", 0xA720, 0xA7FF),
    ("han compatibility", 0xF900, 0xFAFF),
    ("arabic forms a", 0xFB50, 0xFDFF),
    ("arabic forms b", 0xFE70, 0xFEFF),
    ("kana halfwidth", 0xFF65, 0xFF9F),
    ("han extensions b to h", 0x20000, 0x323AF),
]
#: A language uses a script if at least this share of its words starts in it.
USES = 0.002


def scripts_of(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The script of the first letter of each word."""
    padded = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int64)
    b = [padded[starts + k] for k in range(4)]
    tail = [x & 0x3F for x in b]
    code = np.select([b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0], [b[0], (b[0] & 0x1F) << 6 | tail[1], (b[0] & 0xF) << 12 | tail[1] << 6 | tail[2]], (b[0] & 7) << 18 | tail[1] << 12 | tail[2] << 6 | tail[3])
    order = sorted(range(1, len(SCRIPTS)), key=lambda k: SCRIPTS[k][1])
    at = np.searchsorted([SCRIPTS[k][1] for k in order], code, "right") - 1
    inside = (at >= 0) & (code <= np.array([SCRIPTS[k][2] for k in order])[at])
    return np.where(inside, np.array(order)[at], 0)


def word_features(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n-gram size, the feature at every place of every marked word (1 << BITS where the word ends before), and the words' bounds."""
    size = ends - starts + 2
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    within = np.arange(at[-1]) - np.repeat(at[:-1], size)
    left = np.repeat(size, size) - within
    where = np.repeat(starts, size) + within - 1
    byte = np.where((within > 0) & (left > 1), low[np.clip(where, 0, len(low) - 1)], 1).astype(np.uint64)
    byte = np.concatenate([byte, np.zeros(max(SIZES), np.uint64)])
    found, key = [], np.zeros(at[-1], np.uint64)
    for n in range(1, max(SIZES) + 1):
        key = key << np.uint64(8) | byte[n - 1 : n - 1 + at[-1]]
        if n in SIZES:
            hashed = (key + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
            found.append(np.where(left >= n, hashed, 1 << BITS).astype(np.int64))
    return found, at


class LanguageModel:
    """Log-probabilities of n-grams and the scripts of each language."""

    def __init__(self, names: list[str], counts: np.ndarray, scripts: np.ndarray):
        """names in order; counts: n-gram by language; scripts: words by script and language."""
        self.names = names
        logs = np.log(counts + SMOOTH) - np.log(counts.sum(axis=0) + SMOOTH * len(counts))
        logs -= logs.mean(axis=1, keepdims=True)  # what all languages share decides nothing
        self.logs = np.concatenate([logs, np.zeros((1, len(names)))]).astype(np.float32)
        uses = scripts >= USES * np.maximum(scripts.sum(axis=0), 1)
        uses[~uses.any(axis=1)] = True
        self.uses, self.narrow = uses, {}

    def candidates(self, script: int) -> tuple[np.ndarray, np.ndarray]:
        """The languages that use a script, and their columns of the log-probabilities."""
        which = np.flatnonzero(self.uses[script])
        key = tuple(which.tolist())
        if key not in self.narrow:
            self.narrow[key] = self.logs if len(key) == len(self.names) else np.ascontiguousarray(self.logs[:, which])
        return which, self.narrow[key]

    def word_scores(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The scores of each word in each language; only the candidates of its script are scored, the others lie BARRED below."""
        one, kind = distinct_words(low, starts, ends)
        script = scripts_of(low, starts[one])
        total = np.zeros((len(one), len(self.names)), np.float32)
        for s in np.unique(script).tolist():
            mine = np.flatnonzero(script == s)
            which, logs = self.candidates(s)
            found, at = word_features(low, starts[one[mine]], ends[one[mine]])
            score = TEMPER * sum(np.add.reduceat(logs[f], at[:-1]) for f in found)
            total[mine] = score.min(axis=1, keepdims=True) - BARRED
            total[mine[:, None], which] = score
        return total[kind]

    def paths(self, score: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best language of each word; all texts of the batch step through their words together."""
        count = np.diff(first)
        order = np.argsort(-count, kind="stable")
        begin = first[:-1][order]
        steps = int(count.max(initial=0))
        active = len(count) - np.searchsorted(np.sort(count), np.arange(1, steps + 1))
        small = np.uint8 if score.shape[1] <= 256 else np.uint16
        label = np.arange(score.shape[1], dtype=small)
        back = np.empty(score.shape, small)
        best = np.zeros((len(count), score.shape[1]), np.float32)
        for t in range(steps):
            n = active[t]
            at = begin[:n] + t
            now = best[:n]
            top = now.argmax(axis=1)
            jump = now[np.arange(n), top] - SWITCH
            stay = now >= jump[:, None]
            back[at] = np.where(stay, label, top[:, None].astype(small))
            best[:n] = np.where(stay, now, jump[:, None]) + score[at]
        out = np.empty(len(score), small)
        state = best.argmax(axis=1).astype(small)
        for t in range(steps - 1, -1, -1):
            n = active[t]
            at = begin[:n] + t
            out[at] = state[:n]
            state[:n] = back[at, state[:n]]
        return out


def fit(docs: DataFrame, most: int = FIT, most_bytes: int = FIT_BYTES) -> LanguageModel | None:
    """The model of at most about `most` documents, and most_bytes, with a language outside the held-out fifth; None if there is none."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    known = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & (size <= LONGEST) & ~held_out(F.col("doc_id")))
    # A row per language.
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).collect()
    if not sizes:
        return None
    rates = [(r["lang"], min(1.0, most / len(sizes) / r["n"], most_bytes / len(sizes) / max(1, r["bytes"]))) for r in sizes]
    drawn = known.join(F.broadcast(docs.sparkSession.createDataFrame(rates, "lang string, rate double")), "lang")
    chosen = drawn.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("rate") * (1 << 20))
    schema = fields("lang string, feature long, n long")

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            langs = np.array(batch.column(0).to_pylist(), object)
            for a, b, raw, offs in chunks(batch.column(1)):
                low, starts, ends, first, _ = letter_words(raw, offs)
                of = np.repeat(langs[a:b], np.diff(first))
                for lang in set(langs[a:b]):
                    s, e = starts[of == lang], ends[of == lang]
                    if not len(s):
                        continue
                    found, _ = word_features(low, s, e)
                    script = (1 << BITS) + 1 + scripts_of(low, s)
                    counts = np.bincount(np.concatenate([*found, script]), minlength=(1 << BITS) + 1)
                    counts[1 << BITS] = 0
                    some = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(counts[some])], schema.names)

        return each

    # At most languages * (n-grams + scripts) rows, whatever the input's size.
    found = arrow_map(chosen.select("lang", "text"), make, schema).groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    if not len(found):
        return None
    names = sorted(found["lang"].unique())
    counts = np.zeros(((1 << BITS) + 1 + len(SCRIPTS), len(names)))
    counts[found["feature"], np.searchsorted(names, found["lang"])] = found["n"]
    return LanguageModel(names, counts[: 1 << BITS], counts[(1 << BITS) + 1 :])


def identify(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), most: int = FIT, model: LanguageModel | None = None, with_spans: bool = False) -> DataFrame:
    """The columns of keep, then lang_pred and score, and with_spans an array of (start, end, lang) with places in the text's UTF-8."""
    spark = prepared(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model or fit(docs, most))
    rows = docs.select(*(docs[f"`{c}`"].alias(f"kept{k}") for k, c in enumerate(keep)), docs["text"].alias("text"))
    kept = len(keep)
    schema = T.StructType([*rows.schema.fields[:kept], *fields("lang_pred string, score double")])
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
    if with_spans:
        schema = schema.add("spans", T.ArrayType(fields("start long, end long, lang string")))

    def make():
        model = shared.value

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for a, b, raw, offs in chunks(batch.column(kept), max(1 << 18, (6 << 20) * 4 // max(4, len(model.names) if model else 4))):
                n = b - a
                lang, share, spans = np.full(n, UNKNOWN, object), np.zeros(n), [[] for _ in range(n)]
                low, starts, ends, first, some = letter_words(raw, offs)
                if model is not None and len(starts):
                    path = model.paths(model.word_scores(low, starts, ends), first)
                    doc = np.repeat(np.arange(n), np.diff(first))
                    weight = np.zeros((n, len(model.names)))
                    np.add.at(weight, (doc, path), ends - starts)
                    top = weight.argmax(axis=1)
                    lang[some] = np.array(model.names, object)[top[some]]
                    share[some] = weight[np.arange(n), top][some] / np.maximum(weight.sum(axis=1)[some], 1)
                    if with_spans:
                        cut = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])]))
                        for s, e in zip(cut, [*cut[1:], len(path)], strict=True):
                            if some[doc[s]]:
                                spans[doc[s]].append({"start": starts[s] - offs[doc[s]], "end": ends[e - 1] - offs[doc[s]], "lang": model.names[path[s]]})
                out = [pa.array(lang.tolist(), pa.string()), pa.array(share)] + ([pa.array(spans, pa.list_(span))] if with_spans else [])
                yield pa.RecordBatch.from_arrays([*(c.slice(a, n) for c in batch.columns[:kept]), *out], schema.names)

        return each

    return arrow_map(rows, make, schema).toDF(*keep, *schema.names[kept:])


def with_language(docs: DataFrame) -> DataFrame:
    """The documents with a main language, all columns kept: not `und`, and MAIN of the words or more in one language.

    Where no row has a language to learn, a text with a letter is kept.
    """
    kept = tuple(docs.columns)
    model = fit(docs)
    if model is None:
        return docs.filter(docs["text"].rlike(r"\p{L}"))
    told = identify(docs, kept, model=model).toDF(*(f"kept{k}" for k in range(len(kept))), "lang_pred", "score")
    return told.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MAIN)).drop("lang_pred", "score").toDF(*kept)
