"""Structure files as tables: fixed-width PDB text, JSON-lines records, and their residues.

A structure file is small and read whole, so its lines keep their order; many files are many rows of one scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dataset import alphabet_report

#: Three-letter and one-letter names of the residues.
RESIDUES = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
BACKBONE = ("N", "CA", "C", "O")


def read_lines(spark: SparkSession, path: str, glob: str = "*", most_lines: int | None = None) -> DataFrame:
    """(name, line_no, line) of text files; with most_lines, longer files are left out."""
    whole = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("name"), F.split("value", r"\r?\n").alias("lines"))
    if most_lines is not None:
        whole = whole.filter(F.size("lines") <= most_lines + 1)
    return whole.select("name", F.posexplode("lines").alias("line_no", "line"))


def pdb_atoms(lines: DataFrame) -> DataFrame:
    """(name, line_no, atom, resname, chain, resnum, icode, x, y, z) of the ATOM records; selenomethionine counts as methionine."""
    line = F.when(F.col("line").rlike("^HETATM.{11}MSE"), F.replace(F.replace("line", F.lit("HETATM"), F.lit("ATOM  ")), F.lit("MSE"), F.lit("MET"))).otherwise(F.col("line"))
    part = lambda a, n: F.trim(F.substring("line", a, n))
    number = part(23, 5)
    return (
        lines.withColumn("line", line)
        .filter(F.col("line").startswith("ATOM"))
        .select(
            "name", "line_no", part(13, 4).alias("atom"), F.substring("line", 18, 3).alias("resname"), F.substring("line", 22, 1).alias("chain"),
            F.regexp_extract(number, r"^(-?\d+)", 1).cast("int").alias("resnum"), F.regexp_extract(number, r"([A-Za-z]?)$", 1).alias("icode"),
            *(part(a, 8).cast("double").alias(c) for a, c in ((31, "x"), (39, "y"), (47, "z"))),
        )
    )


def residues(atoms: DataFrame, backbone: tuple[str, ...] = BACKBONE) -> DataFrame:
    """(name, chain, pos, resnum, icode, aa, one column of coordinates per backbone atom): one row per residue, gaps as X.

    The first line of an atom and of a residue wins; insertion codes follow the residue's number in order; numbers missing
    between the first and the last residue of a chain become unknown residues. A missing atom is null.
    """
    keys = ["name", "chain", "resnum", "icode"]
    # One aggregation, so files are read and parsed once; atoms of other names have a null order and do not count.
    is_a = lambda a, v: F.when(F.col("atom") == a, v)
    points = [F.min_by(is_a(a, F.array("x", "y", "z")), is_a(a, F.col("line_no"))).alias(a.lower()) for a in backbone]
    got = atoms.filter("resnum is not null").groupBy(*keys).agg(*points, F.min_by("resname", "line_no").alias("resname"))
    to_letter = F.create_map(*(F.lit(x) for kv in RESIDUES.items() for x in kv))
    letter = F.replace(F.coalesce(F.try_element_at(to_letter, F.col("resname")), F.lit("-")), F.lit("-"), F.lit("X"))
    w = Window.partitionBy("name", "chain").orderBy("resnum", "icode")  # a chain is a bounded group
    # A residue brings the missing ones up to the next; its place is behind those that the ones before it brought.
    missing = F.greatest(F.coalesce(F.lead("resnum").over(w), F.col("resnum") + 1) - F.col("resnum") - 1, F.lit(0))
    wide = got.withColumn("aa", letter).withColumn("_m", missing).withColumn("_s", F.sum(F.col("_m") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m") - 1)
    own = [a.lower() for a in backbone]
    out = wide.select("name", "chain", "resnum", "icode", "aa", *own, "_s", F.explode(F.sequence(F.lit(0), F.col("_m"))).alias("_k"))
    here = F.col("_k") == 0
    return out.select(
        "name", "chain", (F.col("_s") + F.col("_k") + 1).cast("int").alias("pos"), (F.col("resnum") + F.col("_k")).alias("resnum"), F.when(here, F.col("icode")).otherwise("").alias("icode"),
        F.when(here, F.col("aa")).otherwise("X").alias("aa"), *(F.when(here, F.col(a)).alias(a) for a in own),
    )


def structures(res: DataFrame) -> DataFrame:
    """(name, num_of_chains, seq, chains): one row per structure with its chains in order."""
    sorted_chain = F.array_sort(F.collect_list(F.struct("pos", "aa")))
    chains = res.groupBy("name", "chain").agg(F.array_join(F.transform(sorted_chain, lambda s: s["aa"]), "").alias("seq"))
    one = chains.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("chain", "seq"))).alias("chains"))
    return one.select("name", F.size("chains").alias("num_of_chains"), F.array_join(F.transform("chains", lambda c: c["seq"]), "").alias("seq"), "chains")


def chain_segments(res: DataFrame, designed: DataFrame | None = None, separator: str = "/") -> DataFrame:
    """(name, seq, chains): each structure's chains in their order, a separator between their sequences, and their names. designed(name, chain): these chains only.

    A structure without such a chain has no row.
    """
    chosen = res if designed is None else res.join(designed.select("name", "chain").distinct(), ["name", "chain"], "left_semi")
    one = structures(chosen)
    return one.select("name", F.array_join(F.transform("chains", lambda c: c["seq"]), separator).alias("seq"), F.transform("chains", lambda c: c["chain"]).alias("chains"))


def read_pdb(spark: SparkSession, path: str, most_lines: int | None = None) -> DataFrame:
    """Residues of all *.pdb files under a path."""
    return residues(pdb_atoms(read_lines(spark, path, "*.pdb", most_lines)))


def read_structure_lines(spark: SparkSession, path: str, alphabet: str = "ACDEFGHIKLMNPQRSTVWYX-", longest: int = 100) -> DataFrame:
    """(name, seq, num_of_chains, coords JSON) of JSON-lines structures within an alphabet and a length.

    Chain keys vary from record to record, so a record's coordinates stay a JSON object, read with from_json where needed.
    """
    schema = T.StructType().add("name", T.StringType()).add("seq", T.StringType()).add("num_of_chains", T.IntegerType())
    rows = spark.read.text(path).select(F.from_json("value", schema).alias("r"), F.col("value").alias("json"))
    kept = rows.select("r.*", "json").filter(F.col("seq").rlike(f"^[{alphabet}]*$") & (F.length("seq") <= longest))
    return kept


def structure_discards(spark: SparkSession, path: str, alphabet: str = "ACDEFGHIKLMNPQRSTVWYX-", longest: int = 100) -> DataFrame:
    """(reason, n) of JSON-lines structures: kept, or discarded for their letters or their length."""
    rows = spark.read.text(path).select(F.get_json_object("value", "$.seq").alias("seq"))
    return alphabet_report(rows, "seq", alphabet, longest)


def listed(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(name) of the files under a path that match, without their suffix; their contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return found.select(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("name"))
