"""Sampling of letters along a decoding order, with tied positions as one step: a fold over each structure's steps.

The order is that of (designed + 1e-4) * |noise|; a tie takes its first member's place and is decided at once. A step's logits are the mean of its members'
logits weighted by beta, given the letters sampled so far; then come omission, biases, the profile and its log-odds, the letters omitted
at the position, and one draw by a hash. The fields after the logits are those of the tie's last member. Positions that are not designed keep their native
letter, and a tie with a missing member takes that member's.

The fold runs in the JVM over an array of steps: a structure is one row, which is what makes its steps sequential; structures are independent. One exchange by
name serves order, ties and fold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import total
from ..functions.randomness import uniform

#: Columns of a residue after (name, chain, pos), and what stands for one that is absent. Arrays are over the letters.
OPTIONAL = {
    "noise": ("double", None), "designed": ("boolean", True), "mask": ("boolean", True), "native": ("int", 0), "bias": ("array<double>", None), "omit": ("array<boolean>", None),
    "profile": ("array<double>", None), "profile_weight": ("double", 0.0), "allowed": ("array<boolean>", None), "beta": ("double", 1.0), "member": ("int", 0),
}


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _normalised(p: Column) -> Column:
    return bound(p, lambda q: F.transform(q, lambda x: x / total(q)))


def _added(a: Column, b: Column) -> Column:
    return F.when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x + y))


def softmax(z: Column) -> Column:
    return bound(z, lambda q: _normalised(F.transform(q, lambda x: F.exp(x - F.array_max(q)))))


def letter_law(logits: Column, at: Column, temperature: float, omitted: list[int], bias: list[float] | None, profile_share: float) -> Column:
    """Probabilities of the letters at a position with these (already weighted) logits; `at` has the fields of OPTIONAL."""
    z = F.transform(logits, lambda x: x / temperature)
    if omitted:
        z = F.transform(z, lambda x, k: x - F.when(k.isin(omitted), 1e8).otherwise(0.0))
    if bias:
        z = _added(z, F.array(*(F.lit(b / temperature) for b in bias)))
    p = softmax(F.when(at["bias"].isNull(), z).otherwise(F.zip_with(z, at["bias"], lambda x, b: x + b / temperature)))
    if profile_share:
        share = profile_share * at["profile_weight"]
        p = bound(p, lambda q: F.when(at["profile"].isNull(), q).otherwise(F.zip_with(q, at["profile"], lambda x, y: (1 - share) * x + share * y)))
    p = bound(p, lambda q: F.when(at["allowed"].isNull(), q).otherwise(_normalised(F.zip_with(q, at["allowed"], lambda x, ok: F.when(ok, x * 1.001).otherwise(x * 0.001)))))
    return bound(p, lambda q: F.when(at["omit"].isNull(), q).otherwise(_normalised(F.zip_with(q, at["omit"], lambda x, no: F.when(no, 0.0).otherwise(x)))))


def drawn(p: Column, u: Column) -> Column:
    """The first letter at which the running sum of p passes u times its sum."""
    def go(q: Column) -> Column:
        goal = u * total(q)
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("k"))
        passed = F.aggregate(F.slice(q, 1, F.size(q) - 1), start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["k"] + F.when(a["sum"] + x <= goal, 1).otherwise(0)).alias("k")))
        return passed["k"].cast("int")

    return bound(p, go)


def sampled(
    residues: DataFrame, ties: DataFrame | None = None, seed: str = "0", temperature: float = 1.0, omitted: list[int] | None = None, bias: list[float] | None = None, profile_share: float = 0.0,
    context: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """(name, chain, pos, step, letter, p): the sampled letters and their probabilities; p is null where a missing member decided.

    residues: (name, chain, pos, logits) and any of OPTIONAL, noise among them (else a hash of seed and place). ties: (name, tie, chain, pos,
    beta, member), member being the order inside a tie. context(state, member) gives logits to add for a member, from the state:
    last (the letter of the step before, or null) and done (array of chain, pos, letter in order).
    """
    keys = ["name", "chain", "pos"]
    r = residues
    if ties is not None:
        r = r.join(ties.select(*keys, "tie", F.col("beta").cast("double").alias("beta"), F.col("member").cast("int").alias("member")), keys, "left")
    else:
        r = r.withColumn("tie", F.lit(None).cast("string"))
    for c, (kind, default) in OPTIONAL.items():
        r = r.withColumn(c, F.coalesce(F.col(c).cast(kind), F.lit(default).cast(kind)) if c in r.columns else F.lit(default).cast(kind))
    noise = F.coalesce("noise", uniform(seed, F.lit("order"), *(F.col(k) for k in keys)))
    designed = F.col("designed") & F.col("mask")
    r = r.withColumn("designed", designed).withColumn("place", (F.col("designed").cast("double") + 1e-4) * F.abs(noise))
    fields = ["member", "chain", "pos", "logits", *(c for c in OPTIONAL if c not in ("noise", "member"))]
    alone = F.when(F.col("tie").isNull(), F.struct("chain", "pos"))
    first = F.min(F.struct("place", "chain", "pos"))
    steps = r.repartition("name").groupBy("name", "tie", alone.alias("alone")).agg(first.alias("first"), F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: _order(a, b)).alias("members"))
    steps = steps.withColumn("u", uniform(seed, F.lit("draw"), F.col("name"), F.col("first.chain"), F.col("first.pos")))
    whole = steps.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("first", "members", "u")), lambda a, b: F.when(a["first"] < b["first"], -1).when(a["first"] > b["first"], 1).otherwise(0)).alias("steps"))

    chain_type, pos_type = (r.schema[c].dataType.simpleString() for c in ("chain", "pos"))
    start = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("step"), F.array().cast(f"array<struct<chain:{chain_type},pos:{pos_type},letter:int,p:double,step:int>>").alias("done"))

    def one(state: Column, s: Column) -> Column:
        members = s["members"]
        n = F.size(members)
        with_context = lambda m: m["logits"] if context is None else F.zip_with(m["logits"], context(state, m), lambda x, y: x + y)
        zero = F.transform(F.get(members, F.lit(0))["logits"], lambda x: F.lit(0.0))
        logits = F.aggregate(members, zero, lambda a, m: F.zip_with(a, with_context(m), lambda x, y: x + m["beta"] * y / n))
        at = F.element_at(members, -1)
        missing = F.get(F.filter(members, lambda m: ~m["mask"]), F.lit(0))
        law = letter_law(logits, at, temperature, omitted or [], bias, profile_share)

        def decided(p: Column) -> Column:
            letter = F.when(missing.isNotNull(), missing["native"]).when(at["designed"], drawn(p, s["u"])).otherwise(at["native"])
            return bound(letter, lambda k: F.struct(k.alias("letter"), F.when(missing.isNull(), F.get(p, k)).alias("p")))

        new = lambda q: F.transform(members, lambda m: F.struct(m["chain"].alias("chain"), m["pos"].alias("pos"), q["letter"].alias("letter"), q["p"].alias("p"), state["step"].alias("step")))
        return bound(bound(law, decided), lambda q: F.struct(q["letter"].alias("last"), (state["step"] + 1).alias("step"), F.concat(state["done"], new(q)).alias("done")))

    done = whole.select("name", F.explode(F.aggregate("steps", start, one)["done"]).alias("d"))
    return done.select("name", "d.chain", "d.pos", "d.step", "d.letter", "d.p")


def _order(a: Column, b: Column) -> Column:
    """Members by their number, then by place."""
    less, more = F.lit(-1), F.lit(1)
    out = F.lit(0)
    for c in ("pos", "chain", "member"):
        out = F.when(a[c] < b[c], less).when(a[c] > b[c], more).otherwise(out)
    return out
