"""Closed forms of the conditional discrepancy for the three-symbol sequence model, to check estimates against.

The model emits A or B with probability p each and stops with 1 - 2p; the perturbed model gives the first token p + delta and
p - delta. Sequences are compared by exp(-lam * Hamming), the shorter padded with stops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tail(p: Column, q: Column, w: Column) -> Column:
    """E exp(-lam * Hamming) of two independent continuations of the unperturbed models.

    Either both stop now; or one stops and every later token of the other costs w; or both go on, equal with weight 1 and
    different with weight w. One-sided continuations end with a factor (1 - 2p) / (1 - 2pw).
    """
    sp, sq = 1 - 2 * p, 1 - 2 * q
    alone_p, alone_q = sp / (1 - 2 * p * w), sq / (1 - 2 * q * w)
    return (sp * sq + w * (2 * p * alone_p * sq + 2 * q * alone_q * sp)) / (1 - 2 * p * q * (1 + w))


def two_conditions(p: Column, q: Column, delta: Column, w: Column) -> Column:
    """The first tokens differ between model and truth by +-delta: the difference kernel over A and B is 2 (1 - w) times the tail."""
    return 2 * delta * delta * (1 - w) * tail(p, q, w)


def discrepancy(p: Column, delta: Column, lam: float) -> Column:
    """One condition, in the published form: 2 d^2 (1-w) (1-2p)^2 / (1 - 2p^2(1+w)) * (4 p w / (1 - 2 p w) + 1)."""
    w = F.exp(F.lit(-lam))
    return 2 * delta * delta * (1 - w) * F.pow(1 - 2 * p, 2) / (1 - 2 * p * p * (1 + w)) * (4 * p * w / (1 - 2 * p * w) + 1)


def discrepancy_pair(p: Column, q: Column, delta: Column, lam: float) -> Column:
    """Two conditions with parameters p and q."""
    return two_conditions(p, q, delta, F.exp(F.lit(-lam)))


def sequence_models_mmd2(p: Column, q: Column, delta: Column, lam: float) -> Column:
    """Squared discrepancy of two perturbed sequence models, under the kernel of sequences.

    With both first tokens perturbed, equal letters gain 2 delta^2 and different ones lose as much: the tail times 1 + 2 delta^2 (1 - w).
    """
    w = F.exp(F.lit(-lam))
    return (1 + 2 * delta * delta * (1 - w)) * (tail(p, p, w) + tail(q, q, w) - 2 * tail(p, q, w))


def composite(grid: DataFrame, delta: Column, lam: float, kernel: Callable[[Column, Column], Column]) -> DataFrame:
    """(discrepancy): the discrepancy over all pairs of conditions, of grid(p, n): a condition's parameter and its count.

    kernel(p, q) is a kernel on conditions, or on the models themselves (calibration). The grid is a bounded list of parameters.
    """
    cells = grid.agg(F.collect_list(F.struct("p", "n")).alias("g")).select("g", F.explode("g").alias("a")).select("a", F.explode("g").alias("b"))
    p, q, w = F.col("a.p"), F.col("b.p"), F.col("a.n") * F.col("b.n")
    return cells.agg((F.sum(w * kernel(p, q) * discrepancy_pair(p, q, delta, lam)) / F.sum(w)).alias("discrepancy"))
