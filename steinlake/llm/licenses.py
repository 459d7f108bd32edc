"""License scans: notices by Aho-Corasick over words, tagged license expressions by a shunting-yard parser.

A text is lower-cased (A-Z) and cut to words; one automaton (pyahocorasick) over the words, joined by blanks, finds all notice phrases and
identifier tags in one pass. A phrase stands where its words stand consecutively. A tag counts where a colon or an equals sign
follows it in the raw text; what follows to the end of that line is read as a license expression.

The parser takes identifiers, brackets and the operators WITH, AND, OR (binding in this order, in any case) as far as they form an expression: it
stops at the first token that cannot follow, and goes back to the last place where all brackets were closed. Every identifier gives a label; the
expression's level is evaluated over restrictions from 0.1 (public domain) to 1 (no commercial use, no changes, or terms unknown here): all terms
of an AND bind (largest), of an OR one may be chosen (least), and an exception by WITH leaves a library's restriction at most.
The score of a text is the largest level of its notices and expressions, as all of them hold; 0 without any. A phrase inside an
expression keeps its label and place, but its level is the expression's.

Labels of identifiers are lower-cased, without a version's ".0", without "-only", "-or-later" or "+", and without the version for Creative
Commons; so "Apache-2.0" and the phrase "Apache License, Version 2" give one label.

Cases: a null or empty text has no words, no places and score 0; repeated and overlapping places count each; very long texts are read whole, in one
pass, and a hit's place in the text is found by bisection. Each input row gives one row, in no order. Only the columns of keep and
text are read, so others may have any name. Work is per row: no exchange of data, nothing grows with the table.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_map, fields, prepared
from .decontamination import _TABLE as AS_WORDS

#: Fixed values of the contract: phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notice phrases beyond those, and their labels.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license 2 0": "apache-2",
    "apache software license": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc",
    "boost software license": "bsl",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0 1 0": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
#: Tags whose value is a license expression.
TAGS = ("spdx license identifier", "license expression")
#: Restriction by the beginning of a label, first match; what is not named here is unknown and counts 1.
LEVELS = (
    (("public-domain", "cc0", "unlicense", "0bsd"), 0.1),
    (("mit", "apache", "bsd", "isc", "bsl", "zlib", "ncsa", "python", "psf", "postgresql"), 0.25),
    (("lgpl", "mpl", "epl", "cddl", "cecill-c", "cc-by-sa"), 0.5),
    (("gpl", "eupl"), 0.75),
    (("agpl",), 0.85),
)
LIBRARY = 0.5
BINDING = {"with": 3, "and": 2, "or": 1}
RESULT = T.StructType(
    fields("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double").fields
    + [
        T.StructField("places", T.ArrayType(T.StructType(fields("word long, label string").fields))),
        T.StructField("expressions", T.ArrayType(T.StructType(fields("word long, postfix string, level double").fields))),
    ]
)
_TOKEN = re.compile(rb"[ \t\"']*([()]|[a-z0-9][a-z0-9.+:_-]*)")
_MARK = re.compile(rb"[ \t\"']*[:=]")


def label_of(identifier: str) -> str:
    """The label of an identifier as written in an expression."""
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    name = re.sub(r"-\d+(\.\d+)*$", "", name) if re.match(r"cc0|cc-by", name) else name
    return re.sub(r"\.0$", "", name)


def level_of(label: str) -> float:
    """How much a license restricts use, 0.1 to 1."""
    if {"nc", "nd"} & set(label.split("-")):
        return 1.0
    if label == "cc-by":
        return 0.25
    return next((level for begins, level in LEVELS if label.startswith(begins)), 1.0)


def postfix(tokens: list[str]) -> tuple[list[str], int]:
    """Shunting-yard: the longest beginning of the tokens that is an expression, in postfix order, and its number of tokens."""
    done: list[str] = []
    waiting: list[str] = []
    whole: list[str] = []
    operand, depth, used = True, 0, 0
    for k, t in enumerate(tokens):
        if t == "(":
            if not operand:
                break
            waiting.append(t)
            depth += 1
            continue
        if t == ")":
            if operand or not depth:
                break
            while waiting[-1] != "(":
                done.append(waiting.pop())
            waiting.pop()
            depth -= 1
        elif t in BINDING:
            if operand:
                break
            while waiting and waiting[-1] != "(" and BINDING[waiting[-1]] >= BINDING[t]:
                done.append(waiting.pop())
            waiting.append(t)
            operand = True
            continue
        else:
            if not operand:
                break
            done.append(t)
            operand = False
        if not depth:
            whole, used = done + waiting[::-1], k + 1
    return whole, used


def evaluated(expression: list[str]) -> tuple[float, list[str]]:
    """(level, labels) of a postfix expression."""
    stack: list[float] = []
    labels: list[str] = []
    for t in expression:
        if t in BINDING:
            right, left = stack.pop(), stack.pop()
            stack.append(max(left, right) if t == "and" else min(left, right) if t == "or" else min(left, LIBRARY))
        else:
            labels.append(label_of(t))
            stack.append(level_of(labels[-1]))
    return stack[-1], labels


def tokens_after(line: bytes) -> tuple[list[str], list[int]]:
    """The tokens of a tag's value and where each ends; a full stop, comma or anything else that is no token ends them."""
    out, stops, at = [], [], 0
    while m := _TOKEN.match(line, at):
        raw = m[1]
        word = raw.rstrip(b".:-_")
        out.append(word.decode())
        at = m.end()
        stops.append(at)
        if word != raw:
            break
    return out, stops


def automaton():
    """Aho-Corasick over blank-joined words: a phrase's value is (words' blanks and letters, kind, label); base phrases have kind 0, notices 1, tags 2."""
    import ahocorasick

    found: dict[str, list[tuple[int, str]]] = {}
    for kind, phrases in enumerate((BASE, NOTICES, dict.fromkeys(TAGS, ""))):
        for phrase, label in phrases.items():
            found.setdefault(phrase, []).append((kind, label))
    tree = ahocorasick.Automaton()
    for phrase, what in found.items():
        tree.add_word(f" {phrase} ", (len(phrase) + 2, len(phrase.split()), what))
    tree.make_automaton()
    return tree


def scan_text(tree, raw: bytes) -> tuple:
    """One text's row of RESULT."""
    plain = raw.translate(AS_WORDS)
    words = plain.split()
    joined = b" " + b" ".join(words) + b" "
    hits = [(end - size + 1, n, what) for end, (size, n, what) in tree.iter(joined.decode("latin-1"))] if words else []
    base: list[tuple[int, str]] = []
    places: list[tuple[int, str]] = []
    expressions: list[tuple[int, str, float]] = []
    labels: set[str] = set()
    spans: list[tuple[int, int]] = []
    if hits:
        blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        ends = None
        for start, n, what in hits:
            word = int(np.searchsorted(blanks, start))
            for kind, label in what:
                if kind < 2:
                    places.append((word, label))
                    labels.add(label)
                    if kind == 0:
                        base.append((word, label))
                    continue
                if ends is None:  # where words end in the raw text, which has the same length
                    solid = np.frombuffer(plain + b" ", np.uint8) != 32
                    ends = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
                mark = _MARK.match(raw, int(ends[word + n - 1]))
                if not mark:
                    continue
                stop = raw.find(b"\n", mark.end())
                line = raw[mark.end() : stop if stop >= 0 else len(raw)].lower()
                tokens, stops = tokens_after(line)
                expression, used = postfix(tokens)
                if expression:
                    level, named = evaluated(expression)
                    expressions.append((word, " ".join(expression), level))
                    labels.update(named)
                    spans.append((word, int(np.searchsorted(ends, mark.end() + stops[used - 1], "right"))))
    # What stands inside an expression counts by the expression's level only. Spans ascend, as tags are found in order.
    within = [bisect(spans, (w, len(words))) - 1 for w, _ in places]
    free = [label for (w, label), k in zip(places, within, strict=True) if k < 0 or w >= spans[k][1]]
    score = max([0.0, *(level_of(label) for label in set(free)), *(level for _, _, level in expressions)])
    starts = [word for word, _ in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({label for _, label in base})), ",".join(sorted(labels)), score,
        [{"word": w, "label": x} for w, x in sorted(places)], [{"word": w, "postfix": x, "level": v} for w, x, v in sorted(expressions)],
    )


def scan_licenses(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the columns of keep, then those of RESULT.

    n_words; n_base, first_word, last_word, base_labels: the places of BASE and their labels; labels: all labels; score: the largest
    restriction; places: (word, label) of every phrase; expressions: (word of the tag, postfix form, level).
    """
    prepared(docs.sparkSession)
    state = docs.select(*(docs[f"`{c}`"].alias(f"kept{i}") for i, c in enumerate(keep)), docs[f"`{text}`"].cast("string").alias("text"))
    schema = T.StructType(state.schema.fields[:-1] + RESULT.fields)
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]
    kinds += [pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())])), pa.list_(pa.struct([("word", pa.int64()), ("postfix", pa.string()), ("level", pa.float64())]))]

    def make():
        tree = automaton()

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = [scan_text(tree, x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(len(keep))]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], schema.names)

        return each

    return arrow_map(state, make, schema).toDF(*keep, *RESULT.names)
