"""Structure records: one JSON object a line, with coordinates under keys that name their chain.

A record holds name, num_of_chains, seq, and for each chain X a `seq_chain_X` and a `coords_chain_X` with one list of points per atom, `N_chain_X` and
so on; an absent point is null or NaN. Keys vary from record to record, so a record is a VARIANT: it is opened to residues, and
built from them, without a schema of its own and without an exchange beyond the one that gathers a structure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BACKBONE = ("N", "CA", "C", "O")
POINTS = "map<string,array<array<double>>>"
#: NaN as a JSON value, which JSON does not know; it stands where a value can, after a bracket, comma, colon or blank.
_NAN = r"(?<=[\[,: ])-?(?:NaN|Infinity)(?=[\],} ])"


def records(residues: DataFrame, atoms: tuple[str, ...] = BACKBONE) -> DataFrame:
    """(name, record): one VARIANT per structure of residues(name, chain, pos, aa, a column of coordinates for each atom, lower-case)."""
    points = [a.lower() for a in atoms]
    at = F.array_sort(F.collect_list(F.struct("pos", "aa", *points)))
    chains = residues.groupBy("name", "chain").agg(at.alias("r"))
    absent = F.lit(None).cast("array<double>")

    def coordinates(chain: Column, r: Column) -> Column:
        points_of = lambda p: F.transform(r, lambda x: F.when(F.exists(x[p], lambda v: v.isNull() | F.isnan(v)), absent).otherwise(x[p]))
        return F.map_from_arrays(F.array(*(F.concat(F.lit(f"{a}_chain_"), chain) for a in atoms)), F.array(*map(points_of, points)))

    seq = F.array_join(F.transform("r", lambda x: x["aa"]), "")
    one = chains.select("name", "chain", seq.alias("seq"), F.to_variant_object(coordinates(F.col("chain"), F.col("r"))).alias("coords"))
    entries = lambda c: F.array(F.struct(F.concat(F.lit("seq_chain_"), c["chain"]).alias("k"), c["seq"].cast("variant").alias("v")), F.struct(F.concat(F.lit("coords_chain_"), c["chain"]).alias("k"), c["coords"].alias("v")))
    # Variants cannot be compared, so chains are put in order by their names, from a map.
    whole = one.groupBy("name").agg(F.array_sort(F.collect_list("chain")).alias("order"), F.map_from_entries(F.collect_list(F.struct("chain", F.struct("chain", "seq", "coords")))).alias("by"))
    ordered = F.transform("order", lambda c: F.element_at("by", c))
    head = F.array(
        F.struct(F.lit("name").alias("k"), F.col("name").cast("string").cast("variant").alias("v")),
        F.struct(F.lit("num_of_chains").alias("k"), F.size("order").cast("variant").alias("v")),
        F.struct(F.lit("seq").alias("k"), F.array_join(F.transform(ordered, lambda c: c["seq"]), "").cast("variant").alias("v")),
    )
    return whole.select("name", F.to_variant_object(F.map_from_entries(F.concat(F.flatten(F.transform(ordered, entries)), head))).alias("record"))


def write_records(built: DataFrame, path: str) -> None:
    """One line per record."""
    built.select(F.to_json("record").alias("value")).write.text(path)


def read_records(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(name, seq, num_of_chains, record, error) of a file or folder of records. A line that is no JSON object has its text as error, and nulls.

    With limit, at most so many records, as a scan that stops early.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.try_parse_json(F.regexp_replace("value", _NAN, "null")).alias("record"))
    get = lambda k, kind: F.try_variant_get("record", f"$.{k}", kind)
    # An object has a name for each value; arrays and plain values are no records.
    sound = F.schema_of_variant("record").startswith("OBJECT")
    out = parsed.select(get("name", "string").alias("name"), get("seq", "string").alias("seq"), get("num_of_chains", "int").alias("num_of_chains"), F.when(sound, F.col("record")).alias("record"), F.when(~F.coalesce(sound, F.lit(False)), F.col("value")).alias("error"))
    return out if limit is None else out.limit(limit)


def record_chains(read: DataFrame) -> DataFrame:
    """(name, chain, seq, coords): a row for each chain of records(name, record); coords maps N_chain_X and the like to points."""
    fields = read.filter("record is not null").select("name", F.variant_get("record", "$", "map<string,variant>").alias("m"))
    begins = "seq_chain_"
    names = F.transform(F.filter(F.map_keys("m"), lambda k: k.startswith(begins)), lambda k: F.substring(k, len(begins) + 1, 1 << 20))
    each = fields.select("name", "m", F.explode(names).alias("chain"))
    # A record's keys are looked up by names that are made from its own.
    seq, coords = (F.element_at("m", F.concat(F.lit(p), "chain")) for p in (begins, "coords_chain_"))
    return each.select("name", "chain", F.variant_get(seq, "$", "string").alias("seq"), F.variant_get(coords, "$", POINTS).alias("coords"))


def record_residues(read: DataFrame, atoms: tuple[str, ...] = BACKBONE) -> DataFrame:
    """(name, chain, pos, aa, one column of coordinates per atom) of records(name, record); an atom that a chain does not list is null."""
    chains = record_chains(read)
    lists = {a.lower(): F.try_element_at("coords", F.concat(F.lit(f"{a}_chain_"), "chain")) for a in atoms}
    wide = chains.select("name", "chain", F.split("seq", "").alias("letters"), *(v.alias(f"_{k}") for k, v in lists.items()))
    rows = wide.select("name", "chain", F.posexplode(F.filter("letters", lambda x: x != "")).alias("k", "aa"), *(f"_{k}" for k in lists))
    return rows.select("name", "chain", (F.col("k") + 1).alias("pos"), "aa", *(F.get(f"_{k}", F.col("k")).alias(k) for k in lists))


def record_atoms(read: DataFrame) -> DataFrame:
    """(name, chain, atom, pos, xyz): every point of records(name, record), whatever atoms they list."""
    each = record_chains(read).select("name", "chain", F.explode("coords").alias("key", "points"))
    atom = F.regexp_replace("key", r"_chain_.*$", "")
    return each.select("name", "chain", atom.alias("atom"), F.posexplode("points").alias("k", "xyz")).select("name", "chain", "atom", (F.col("k") + 1).alias("pos"), "xyz")
