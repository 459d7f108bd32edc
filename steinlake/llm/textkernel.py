"""Vectorised work on the bytes of a batch of texts: word bounds, word hashes, shingles.

Everything here is a helper for code inside tasks; Spark deals out the batches.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
SPAN = 1 << 17

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes of the contamination rule: digits, a-z after lower-casing, and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Word bytes of the shingle rule: all but the blank and 09-0D.
VISIBLE = np.ones(256, bool)
VISIBLE[[32, 9, 10, 11, 12, 13]] = False
#: Letters only, digits and marks left out: for the language and toxicity models.
LETTER = ALNUM.copy()
LETTER[48:58] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        step = _BASE if kind == "up" else _INVERSE
        have = np.full(max(n, 2 * SPAN), step, U)
        have[0] = U(1)
        np.cumprod(have, out=have)
        _powers[kind] = have
    return have[:n]


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the bounds of each text; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    _, bounds, data = col.buffers()
    offs = np.frombuffer(bounds, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(col) else np.zeros(0, np.uint8)
    return raw, offs - (offs[0] if len(offs) else 0)


def chunks(col: pa.Array, size: int = 6 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, bounds) of runs of whole texts of about that many bytes."""
    raw, offs = flat(col)
    row, n = 0, len(offs) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + size, "right")) - 1)
        end = min(end, n)
        yield row, end, raw[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def word_bounds(raw: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of its first word (one more entry than texts)."""
    return runs(kind[raw], offs)


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For code points below 0x32400 (letters of later planes are not assigned): 2 for a letter, 1 for a mark, else 0; and the lower-case one where it has as many bytes."""
    kind, lower = np.zeros(0x32400, np.uint8), np.arange(0x32400)
    for c in range(128, 0x32400):
        category = unicodedata.category(chr(c))
        kind[c] = {"L": 2, "M": 1}.get(category[0], 0)
        if category[0] == "L" and len(low := chr(c).lower()) == 1 and len(low.encode()) == len(chr(c).encode()):
            lower[c] = ord(low)
    return kind, lower


def letter_words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, first words, whether each text has a letter): words are runs of letters and the marks on them, in any script."""
    low = LOWER[raw]
    letter = LETTER[raw] & (raw < 128)
    inside = letter.copy()
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        kind, lower = _characters()
        padded = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int64)
        size = np.where(padded[lead] < 0xE0, 2, np.where(padded[lead] < 0xF0, 3, 4))
        code = padded[lead] & (0xFF >> (size + 1))
        for k in range(1, 4):
            code = np.where(k < size, code << 6 | padded[lead + k] & 0x3F, code)
        code = np.minimum(code, len(kind) - 1)
        letter[lead] = kind[code] == 2
        to = lower[code]
        for k in range(4):
            some = size > k
            inside[lead[some] + k] = kind[code[some]] > 0
            fold = some & (to != code)
            low[lead[fold] + k] = to[fold] >> 6 * (size[fold] - 1 - k) & 0x3F | 0x80 if k else (0xF00 >> size[fold]) & 0xFF | to[fold] >> 6 * (size[fold] - 1)
    sums = np.concatenate([[0], np.cumsum(letter)])
    return low, *runs(inside, offs), sums[offs[1:]] > sums[offs[:-1]]


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_bounds() of a mask of the bytes that lie in words."""
    n = len(inside)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    edge = offs[(offs > 0) & (offs < n)]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[edge - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a difference of prefix sums of a polynomial, finished by mix().

    The sums are taken over stretches of about SPAN bytes, which keeps them in the processor's cache.
    """
    out = np.empty(len(starts), U)
    k = 0
    while k < len(starts):
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + SPAN, "right")))
        a, b = int(starts[k]), int(ends[stop - 1])
        sums = np.zeros(b - a + 1, U)
        np.cumsum((low[a:b].astype(U) + U(1)) * _power("up", b - a), out=sums[1:])
        s, e = starts[k:stop] - a, ends[k:stop] - a
        out[k:stop] = (sums[e] - sums[s]) * _power("down", b - a + 1)[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93)
        k = stop
    return mix(out)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `size` words within a text, and each text's first run; a shorter text with words is one run."""
    counts = np.diff(first)
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(runs, out=at[1:])
    total = int(at[-1])
    doc = np.repeat(np.arange(len(counts)), runs)
    start = first[:-1][doc] + (np.arange(total) - at[:-1][doc])
    h = np.full(total, U(0x51ED270B9F2C1A35), U)
    stop = first[1:][doc]
    padded = np.concatenate([words, np.zeros(1, U)])
    for k in range(size):
        pos = start + k
        inside = pos < stop
        h = mix(h * U(3) + np.where(inside, padded[np.where(inside, pos, len(words))], U(k + 1)))
    return h, at


def unique_in_groups(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each group, sorted, and the new bounds."""
    n = len(at) - 1
    group = np.repeat(np.arange(n), np.diff(at))
    order = np.lexsort((h, group))
    h = h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (group[1:] != group[:-1])
    new = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(group[keep], minlength=n), out=new[1:])
    return h[keep], new
