"""Residue tables for models: everything that a model's input holds of a structure, one row per residue, from one exchange by structure.

Residues and all constraint tables are put under one another, dealt out by name once, and merged by (name, chain, pos); chains become rows with arrays of
residues, are put in order and numbered, and opened again. No constraint adds a join or an exchange. The forms that models take (`form`) are projections.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.randomness import digest
from .constraints import ALPHABET

BACKBONE = ("n", "ca", "c", "o")
FORMS = ("tied", "graph", "file")


def _letters_of(texts: Column, alphabet: str) -> Column:
    """For each letter of an alphabet whether any of an array of texts holds it."""
    return F.array(*(F.exists(texts, _holds(a)) for a in alphabet))


def _holds(letter: str):
    return lambda t: F.contains(t, F.lit(letter))


def _bias_of(rules: Column, alphabet: str) -> Column:
    """An array over an alphabet: the sums of rules (aa, bias) by letter."""
    sum_of = lambda a: F.aggregate(F.filter(rules, _is(a)), F.lit(0.0), lambda s, r: s + r["bias"])
    return F.array(*(sum_of(a) for a in alphabet))


def _is(letter: str):
    return lambda r: r["aa"] == letter


def _first(c: str) -> Column:
    return F.first(c, ignorenulls=True).alias(c)


def _numbered(chains: DataFrame, order: list[Column], residues: str = "residues") -> DataFrame:
    """chains(name, chain, residues, ...) opened to residues with chain_no (from 1), place (from 0), residue_index, phi, psi and omega."""
    w = Window.partitionBy("name").orderBy(*order)
    before = F.coalesce(F.sum(F.size(residues)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = chains.withColumns({"chain_no": F.row_number().over(w), "_start": before, "_n": F.size(residues)})
    rest = [c for c in numbered.columns if c not in (residues, "_start", "_n")]
    opened = numbered.select(*rest, "_start", "_n", F.posexplode(residues).alias("_k", "r")).select(*rest, "_start", "_n", "_k", "r.*")
    place = (F.col("_start") + F.col("_k")).cast("int")
    # Residues are consecutive inside a chain; a new chain jumps by a hundred.
    after = F.col("_k") + 1 < F.col("_n")
    index = 100 * (F.col("chain_no") - 1) + F.col("place")
    return opened.withColumn("place", place).withColumns({"residue_index": index, "phi": F.col("_k") > 0, "psi": after, "omega": after}).drop("_start", "_n", "_k")


def _observed(r: Column, atoms: tuple[str, ...]) -> Column:
    """Whether every coordinate of a residue is a finite number."""
    finite = lambda p: F.coalesce(F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    return reduce(lambda a, b: a & b, (finite(r[a]) for a in atoms))


def design_table(
    residues: DataFrame, designed: DataFrame | None = None, fixed: DataFrame | None = None, omitted: DataFrame | None = None, profiles: DataFrame | None = None, bias: DataFrame | None = None,
    ties: DataFrame | None = None, atoms: tuple[str, ...] = BACKBONE, alphabet: str = ALPHABET, dealt: bool = False,
) -> DataFrame:
    """One row per residue of residues(name, chain, pos, aa, atoms): the input of a design.

    designed(name, chain): chains to design, all where it is None. fixed, omitted (letters), profiles (coef, bias, log_odds), bias (aa, bias) and ties (tie,
    beta, member) are tables over (name, chain, pos); what names no residue is ignored. Adds: letter (number in the alphabet), observed, designed, free (designed and
    not fixed), omit (booleans over the alphabet), profile_weight, profile, log_odds, bias, tie, beta, member, and the columns of _numbered. Designed chains
    come first, each sort in order of name. Without a rule: weight 0, profile zeros, log-odds 1e4, bias zeros, beta 1.
    dealt: all tables were dealt out by name (repartition) while they were narrow, and their rows, wide by now, are not exchanged again.
    """
    keys = ["name", "chain", "pos"]
    kinds = {k: residues.schema[k].dataType for k in keys}
    at = lambda df, pos=True: [F.col(k).cast(kinds[k]).alias(k) for k in keys[: 3 if pos else 2]]
    parts = [residues.select(*at(residues), "aa", *(F.col(a).cast("array<double>").alias(a) for a in atoms), F.lit(True).alias("_here"))]
    if designed is not None:
        parts.append(designed.select(*at(designed, False), F.lit(True).alias("_chosen")))
    if fixed is not None:
        parts.append(fixed.select(*at(fixed), F.lit(True).alias("_fixed")))
    if omitted is not None:
        parts.append(omitted.select(*at(omitted), F.col("letters").alias("_letters")))
    if profiles is not None:
        parts.append(profiles.select(*at(profiles), F.struct(F.col("coef").cast("double").alias("coef"), F.col("bias").cast("array<double>").alias("bias"), F.col("log_odds").cast("array<double>").alias("log_odds")).alias("_profile")))
    if bias is not None:
        parts.append(bias.select(*at(bias), F.struct("aa", F.col("bias").cast("double").alias("bias")).alias("_rule")))
    if ties is not None:
        parts.append(ties.select(*at(ties), F.struct(F.col("tie").cast("string").alias("tie"), F.col("beta").cast("double").alias("beta"), F.col("member").cast("int").alias("member")).alias("_tie")))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    absent = {"_chosen": "boolean", "_fixed": "boolean", "_letters": "string", "_profile": "struct<coef:double,bias:array<double>,log_odds:array<double>>", "_rule": "struct<aa:string,bias:double>", "_tie": "struct<tie:string,beta:double,member:int>"}
    whole = whole.select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in absent.items() if c not in whole.columns))
    whole = whole if dealt else whole.repartition("name")
    merged = whole.groupBy(*keys).agg(*(_first(c) for c in ("aa", *atoms, "_here", "_chosen", "_fixed", "_profile", "_tie")), F.collect_list("_letters").alias("_letters"), F.collect_list("_rule").alias("_rules"))
    here = F.struct("pos", "aa", *atoms, *(c for c in ("_fixed", "_profile", "_tie", "_letters", "_rules")))
    chains = merged.groupBy("name", "chain").agg(F.array_sort(F.collect_list(F.when(F.col("_here"), here)), lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)).alias("residues"), F.max("_chosen").alias("_chosen"))
    chains = chains.filter(F.size("residues") > 0).withColumn("designed", F.coalesce("_chosen", F.lit(designed is None))).drop("_chosen")
    out = _numbered(chains, [F.desc("designed"), F.col("chain")])
    zeros = lambda v: F.array(*(F.lit(v) for _ in alphabet))
    row = F.struct(*atoms)
    return out.select(
        *keys, "aa", F.nullif(F.position("aa", F.lit(alphabet)), F.lit(0)).alias("letter"), *atoms, _observed(row, atoms).alias("observed"), "designed", (F.col("designed") & F.col("_fixed").isNull()).alias("free"),
        _letters_of(F.col("_letters"), alphabet).alias("omit"), F.coalesce("_profile.coef", F.lit(0.0)).alias("profile_weight"), F.coalesce("_profile.bias", zeros(0.0)).alias("profile"), F.coalesce("_profile.log_odds", zeros(1e4)).alias("log_odds"),
        _bias_of(F.col("_rules"), alphabet).alias("bias"), F.col("_tie.tie").alias("tie"), F.coalesce("_tie.beta", F.lit(1.0)).alias("beta"), F.col("_tie.member").alias("member"), "chain_no", "place", "residue_index", "phi", "psi", "omega",
    ).withColumn("letter", F.col("letter") - 1)


def training_table(residues: DataFrame, picked: DataFrame, homologous: DataFrame | None = None, seed: str = "0", atoms: tuple[str, ...] = BACKBONE, alphabet: str = ALPHABET) -> DataFrame:
    """One row per residue of residues(name, chain, pos, aa, atoms): the input of training, name being a sampled assembly.

    picked(name, chain): chains to predict; with homologous(name, chain, others) the chains like those too, and always those of equal sequence.
    Chains come in a random order (hashes of seed, name and chain). Adds letter, observed, masked and the columns of _numbered; two residues are
    of different chains, as an interface loss asks, where chain_no differs.
    """
    keys = ["name", "chain"]
    kinds = {k: residues.schema[k].dataType for k in keys}
    wanted = picked.select(*keys).distinct()
    if homologous is not None:
        like = homologous.join(wanted, keys, "left_semi").select("name", F.explode("others").alias("chain"))
        wanted = wanted.unionByName(like)
    parts = residues.select(*keys, "pos", "aa", *(F.col(a).cast("array<double>").alias(a) for a in atoms), F.lit(True).alias("_here"))
    whole = parts.unionByName(wanted.select(*(F.col(k).cast(kinds[k]).alias(k) for k in keys), F.lit(True).alias("_picked")), allowMissingColumns=True).repartition("name")
    row = F.struct("pos", "aa", *atoms)
    chains = whole.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("_here"), row)), lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)).alias("residues"), F.coalesce(F.max("_picked"), F.lit(False)).alias("_picked"))
    chains = chains.filter(F.size("residues") > 0).withColumn("_seq", F.array_join(F.transform("residues", lambda r: r["aa"]), ""))
    chains = chains.withColumn("masked", F.max("_picked").over(Window.partitionBy("name", "_seq"))).drop("_picked", "_seq")
    out = _numbered(chains, [digest(seed, F.col("name"), F.col("chain")), F.col("chain")])
    letter = F.nullif(F.position("aa", F.lit(alphabet)), F.lit(0)) - 1
    return out.select(*keys, "pos", "aa", letter.alias("letter"), *atoms, _observed(F.struct(*atoms), atoms).alias("observed"), "masked", "chain_no", "place", "residue_index", "phi", "psi", "omega")


def form(table: DataFrame, kind: str, atoms: tuple[str, ...] = BACKBONE) -> DataFrame:
    """A residue table as a model takes it. tied: rows in order, coordinates that were not observed as zeros; graph: nodes (name, node, xyz of the C-alpha, letter, chain_no,
    residue_index, mask), for edges to be found; file: one row per structure, with arrays over its places.
    """
    if kind not in FORMS:
        raise ValueError(f"form is one of {FORMS}")
    if kind == "graph":
        return table.select("name", F.col("place").alias("node"), F.col("ca").alias("xyz"), "letter", "chain_no", "residue_index", F.col("observed").alias("mask"))
    zero = F.array(*(F.lit(0.0) for _ in range(3)))
    filled = table.withColumns({a: F.when(F.col("observed"), F.col(a)).otherwise(zero) for a in atoms})
    if kind == "tied":
        return filled
    kept = ["place", *(c for c in filled.columns if c not in ("name", "place"))]
    one = filled.groupBy("name").agg(F.array_sort(F.collect_list(F.struct(*kept)), lambda a, b: F.when(a["place"] < b["place"], -1).otherwise(1)).alias("r"))
    return one.select("name", F.size("r").alias("length"), *(F.transform("r", _field(c)).alias(c) for c in kept))


def _field(name: str):
    return lambda r: r[name]
