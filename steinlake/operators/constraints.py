"""Constraint tables of designs (name, chain, pos, ...) and the filter of sampled letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bound, total

#: Fixed value: the order of amino-acid letters, X last.
ALPHABET = "ACDEFGHIKLMNPQRSTVWYX"


def assign_chains(chains: DataFrame, designed: list[str]) -> DataFrame:
    """(name, designed, fixed): the chains to design and the rest, sorted. chains: (name, chain)."""
    one = chains.groupBy("name").agg(F.array_sort(F.collect_set("chain")).alias("all"))
    want = F.array(*map(F.lit, designed)) if designed else F.col("all")
    return one.select("name", F.array_intersect("all", want).alias("designed"), F.array_except("all", want).alias("fixed"))


def fixed_positions(lengths: DataFrame, listed: DataFrame, complement: bool = False) -> DataFrame:
    """(name, chain, positions): listed 1-based positions, or all others. lengths: (name, chain, length); listed: (name, chain, pos)."""
    given = listed.groupBy("name", "chain").agg(F.array_sort(F.collect_set(F.col("pos").cast("int"))).alias("given"))
    out = lengths.join(given, ["name", "chain"], "left").withColumn("given", F.coalesce("given", F.array().cast("array<int>")))
    whole = F.sequence(F.lit(1), F.col("length").cast("int"))
    return out.select("name", "chain", (F.array_except(whole, "given") if complement else F.array_intersect(whole, "given")).alias("positions"))


def tied_homomer(lengths: DataFrame) -> DataFrame:
    """(name, pos, chains): in structures of equal chains, each position tied over all chains."""
    equal = lengths.groupBy("name").agg(F.min("length").alias("a"), F.max("length").alias("b"), F.array_sort(F.collect_set("chain")).alias("chains"))
    return equal.filter("a = b").select("name", F.explode(F.sequence(F.lit(1), F.col("a").cast("int"))).alias("pos"), "chains")


def tied_explicit(chains: list[str], positions: list[list[int]], betas: list[float] | None = None):
    """Rows (group, chain, pos, beta) that tie the k-th positions of the chains."""
    n = {len(p) for p in positions}
    if len(n) != 1 or len(chains) != len(positions):
        raise ValueError("tied chains need lists of one length")
    beta = betas or [1.0] * len(chains)
    return [(k, c, p[k], b) for k in range(n.pop()) for c, p, b in zip(chains, positions, beta, strict=True)]


def softmax(df: DataFrame, group: list[str], value: Column, temperature: float = 1.0, name: str = "p") -> DataFrame:
    """df with the softmax of value / temperature over each group (a position's letters)."""
    w = Window.partitionBy(*group)
    top = df.withColumn("_z", value / temperature).withColumn("_m", F.max("_z").over(w)).withColumn("_e", F.exp(F.col("_z") - F.col("_m")))
    return top.withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_z", "_m", "_e")


def sampling_filter(df: DataFrame, group: list[str], logit: Column, temperature: float, omitted: Column, bias: Column, bias_by_residue: Column, pssm: Column, pssm_coef: Column, pssm_multi: float, log_odds: Column | None = None, threshold: float = 0.0) -> DataFrame:
    """df with p, the probability with which a letter is sampled: softmax of (logit / t - omitted * 1e8 + bias / t + residue bias / t),
    mixed with the profile, then masked by the profile's log-odds, and normalised again.
    """
    z = logit - F.when(omitted, 1e8).otherwise(0.0) * temperature + bias + bias_by_residue
    out = softmax(df, group, z, temperature, "_p")
    share = pssm_multi * pssm_coef
    mixed = (1 - share) * F.col("_p") + share * pssm
    if log_odds is not None:
        mixed = mixed * F.when(log_odds > threshold, 1.0).otherwise(0.001)
    out = out.withColumn("_q", mixed)
    return out.withColumn("p", F.col("_q") / F.sum("_q").over(Window.partitionBy(*group))).drop("_p", "_q")


def omit_mask(residues: DataFrame, rules: DataFrame) -> DataFrame:
    """residues with omitted: whether a rule (name, chain, pos, letters) names the letter aa of the row."""
    hits = rules.select("name", "chain", "pos", F.explode(F.split("letters", "")).alias("aa")).distinct().withColumn("omitted", F.lit(True))
    out = residues.join(hits, ["name", "chain", "pos", "aa"], "left")
    return out.withColumn("omitted", F.coalesce("omitted", F.lit(False)))


def one_row_json(df: DataFrame, name: str, chain: str, value: str) -> DataFrame:
    """(name, json): {name: {chain: value}} as one JSON object per structure; a structure has few chains."""
    inner = df.groupBy(name).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(chain), F.col(value))))).alias("m"))
    return inner.select(name, F.to_json(F.create_map(F.col(name), F.col("m"))).alias("json"))


def profile_softmax(values: Column, letters: int = 20) -> Column:
    """Probabilities of a profile's values, and 0 for the unknown letter behind them."""
    powers = lambda v: bound(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    shares = lambda e: bound(total(e), lambda s: F.transform(e, lambda x: x / s))
    return F.concat(bound(bound(F.slice(values, 1, letters), powers), shares), F.array(F.lit(0.0)))


def bias_vector(bias: dict[str, float], alphabet: str = ALPHABET) -> Column:
    """A letter's bias at its place of the alphabet, 0 for letters that have none."""
    return F.array(*(F.lit(float(bias.get(a, 0.0))) for a in alphabet))


def with_residue_bias(residues: DataFrame, rules: DataFrame, alphabet: str = ALPHABET) -> DataFrame:
    """residues(name, chain, pos, ...) with bias: an array over the alphabet from rules(name, chain, pos, aa, bias); biases of one letter add up."""
    keys = ["name", "chain", "pos"]
    one = rules.groupBy(*keys, "aa").agg(F.sum("bias").alias("b")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("aa", "b"))).alias("_m"))
    values = F.array(*(F.coalesce(F.try_element_at(F.col("_m"), F.lit(a)), F.lit(0.0)) for a in alphabet))
    return residues.join(one, keys, "left").withColumn("bias", values).drop("_m")


def tied_logits(df: DataFrame, group: list[str], letter: str, logit: str, beta: str) -> DataFrame:
    """(group, letter, logit): for positions tied to one another, the mean of their logits weighted by beta."""
    return df.groupBy(*group, letter).agg((F.sum(F.col(logit) * F.col(beta)) / F.count(F.lit(1))).alias(logit))
