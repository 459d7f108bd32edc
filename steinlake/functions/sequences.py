"""Sequences as strings or token arrays: encoding, padding, trimming, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Alphabets in their token order.
PROTEIN = "ACDEFGHIKLMNPQRSTVWY"
PROTEIN_X = PROTEIN + "X"
DNA, RNA, STOP = "ACGT", "ACGU", "]"


def letters(s) -> Column:
    """The characters of a string, none for an empty one."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def encode(s, alphabet: str) -> Column:
    """Token numbers from 0; null for letters outside the alphabet."""
    return F.transform(letters(s), lambda c: F.nullif(F.position(c, F.lit(alphabet)), F.lit(0)) - 1)


def decode(tokens, alphabet: str) -> Column:
    """Letters of token numbers; nulls and numbers outside the alphabet (padding) are left out."""
    known = F.filter(tokens, lambda t: t.isNotNull() & (t >= 0) & (t < len(alphabet)))
    return F.array_join(F.transform(known, lambda t: F.substring(F.lit(alphabet), t + 1, F.lit(1))), "")


def one_hot(s, alphabet: str, to: int | None = None, stop: bool = False, fill: bool = False) -> Column:
    """An array of 0/1 arrays, one per letter; a letter outside the alphabet has zeros only.

    With `to`, as many as that, cut or with rows of zeros. With stop, one more column, for the letter STOP. fill sets that column in all rows of zeros.
    """
    if fill and not stop:
        raise ValueError("places can only be filled with stops where there is a column for them")
    whole = alphabet + STOP if stop else alphabet
    symbols = F.array(*map(F.lit, whole))
    row = lambda c: F.transform(symbols, lambda a: F.when(a == c, 1).otherwise(0))
    empty = F.array(*(F.lit(int(fill and k == len(alphabet))) for k in range(len(whole))))
    # A letter outside the alphabet is an empty place like those behind the end.
    out = F.transform(letters(s), lambda c: F.when(F.array_contains(symbols, c), row(c)).otherwise(empty))
    return out if to is None else padded(out, F.lit(to), empty)


def one_hot_tokens(tokens, size: int) -> Column:
    """An array of 0/1 arrays, one per token number from 0; null, NaN and numbers outside have zeros only."""
    return F.transform(tokens, lambda t: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.when(t == k, 1).otherwise(0)))


def one_hot_lengths(hot) -> Column:
    """The number of rows of a one-hot encoding that hold a letter; null where a row is null."""
    return F.aggregate(F.flatten(hot), F.lit(0), lambda n, x: n + x)


def one_hot_stops(hot) -> Column:
    """A one-hot encoding with a column and a row more: the row behind the last letter has the stop, once. Letters are taken to stand in front; null where a row is null."""
    n = one_hot_lengths(hot)
    longer = F.concat(hot, F.array(F.transform(F.get(hot, F.lit(0)), lambda _: F.lit(0))))
    return F.when(n.isNotNull() & (F.size(hot) > 0), F.transform(longer, lambda row, k: F.concat(row, F.array(F.when(k == n, 1).otherwise(0)))))


def padded(values, to: Column, fill) -> Column:
    """An array cut to a length, or with the value behind it up to there; null for null."""
    return F.when(F.size(values) >= to, F.slice(values, 1, to)).otherwise(F.concat(values, F.array_repeat(fill, to - F.size(values))))


def indices(s, alphabet: str, to: Column | None = None, stop: bool = False) -> Column:
    """Token numbers as doubles, NaN for what is no letter and behind the end; with stop, STOP is the alphabet's last letter."""
    found = F.transform(encode(s, alphabet + STOP if stop else alphabet), lambda t: F.coalesce(t.cast("double"), F.lit(float("nan"))))
    return found if to is None else padded(found, to, F.lit(float("nan")))


def bits(s, alphabet: str, to: int) -> Column:
    """Each letter as a number with one bit set, bit 0 for padding up to a length."""
    found = F.transform(encode(s, alphabet), lambda t: F.when(t.isNull(), 1).otherwise(F.pow(F.lit(2), t + 1).cast("long")).cast("long"))
    pad = F.when(F.size(found) < to, F.array_repeat(F.lit(1).cast("long"), to - F.size(found))).otherwise(F.array().cast("array<long>"))
    return F.concat(found, pad)


def with_stop(s) -> Column:
    return F.concat(s, F.lit(STOP))


def omit(s, characters: str) -> Column:
    """The string without some characters."""
    return F.translate(s, characters, "")


def gaps_to_x(s) -> Column:
    return F.replace(s, F.lit("-"), F.lit("X"))


def trim_tags(s, tag: str = "HHHHHH") -> Column:
    """The sequence without a tag that starts within 3 places of either end; every test looks at the original string, and a
    sequence of which under 4 letters are left becomes null.
    """
    n, k = F.length(s), len(tag)
    out = F.lit(0)
    for shift in range(4):
        out = F.greatest(out, F.when(F.substring(s, shift + 1, k) == tag, shift + k).otherwise(0))
    end = F.lit(0)
    for shift in range(4):
        end = F.greatest(end, F.when(F.substring(s, n - shift - k + 1, F.lit(k)) == tag, shift + k).otherwise(0))
    left = n - out - end
    return F.when(left >= 4, F.substring(s, out + 1, left))


def chain_letter(number) -> Column:
    """A chain's letter from its number from 0, and back with chain_number."""
    return F.substring(F.lit(CHAINS), number + 1, F.lit(1))


def chain_number(letter) -> Column:
    return F.position(letter, F.lit(CHAINS)) - 1


#: Fixed value: chain letters in order.
CHAINS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def operations(expression) -> Column:
    """Numbers of an operation expression such as (1-3,5)."""
    parts = F.split(F.regexp_replace(expression, r"[()\s]", ""), ",")
    bounds = F.transform(parts, lambda p: F.split(p, "-"))
    return F.flatten(F.transform(bounds, lambda b: F.sequence(F.get(b, 0).cast("int"), F.element_at(b, -1).cast("int"))))
