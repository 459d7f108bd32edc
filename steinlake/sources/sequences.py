"""Sequence and table files: FASTA, profiles, reference tables, encodings, dictionaries, id lists, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import bound

REFERENCE = T.StructType([T.StructField(n, T.StringType()) for n in ("pdb", "chain")] + [T.StructField(f"{n} Number", T.IntegerType()) for n in ("Class", "Architecture", "Topology", "Superfamily")] + [T.StructField("L", T.IntegerType())])
CHAIN_LIST = T.StructType().add("CHAINID", T.StringType()).add("DEPOSITION", T.DateType()).add("RESOLUTION", T.DoubleType()).add("HASH", T.StringType()).add("CLUSTER", T.IntegerType()).add("SEQUENCE", T.StringType())


def fasta_records(text: Column, omit: str = "") -> Column:
    """An array of (header, sequence) structs from the text of a FASTA file."""
    records = F.filter(F.split(F.concat(F.lit("\n"), text), "\n>"), lambda r: r != "")
    lines = F.transform(F.slice(records, 1, F.size(records)), lambda r: F.split(r, r"\r?\n"))
    sequence = lambda x: F.array_join(F.transform(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), lambda s: F.rtrim(s)), "")
    out = F.transform(lines, lambda x: F.struct(F.rtrim(F.get(x, 0)).alias("header"), (F.translate(sequence(x), omit, "") if omit else sequence(x)).alias("sequence")))
    return F.filter(out, lambda r: r["header"] != "")


def read_fasta(spark: SparkSession, path: str, limit: int | None = None, omit: str = "") -> DataFrame:
    """(file, number, header, sequence) of FASTA files, at most `limit` records of each."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(fasta_records(F.col("value"), omit)).alias("number", "r"))
    out = whole.select("file", "number", "r.header", "r.sequence")
    return out if limit is None else out.filter(F.col("number") < limit)


def header_field(header: Column, name: str) -> Column:
    """A field of a design header, such as score=2.25."""
    return F.nullif(F.regexp_extract(header, rf"(?:^|, ){name}=(\[[^\]]*\]|[^,]*)", 1), F.lit(""))


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REFERENCE).csv(path, header=True)


def read_chain_list(spark: SparkSession, path: str, resolution: float, before: str) -> DataFrame:
    """Chains up to a resolution and a date."""
    return spark.read.schema(CHAIN_LIST).csv(path, header=True).filter((F.col("RESOLUTION") <= resolution) & (F.col("DEPOSITION") <= F.to_date(F.lit(before)))).select("CHAINID", "HASH", "CLUSTER")


def read_encodings(spark: SparkSession, path: str, width: int, header: bool = True) -> DataFrame:
    """(id, v): an index column, then `width` numbers; a row with a NaN is a null vector."""
    schema = T.StructType([T.StructField("id", T.StringType()), *(T.StructField(f"v{k}", T.DoubleType()) for k in range(width))])
    v = F.array(*(F.col(f"v{k}") for k in range(width)))
    return spark.read.schema(schema).csv(path, header=header).select("id", F.when(~F.exists(v, lambda x: x.isNull() | F.isnan(x)), v).alias("v"))


def read_dictionary(spark: SparkSession, path: str, value: T.DataType) -> DataFrame:
    """(name, value) of one-object-per-line dictionaries; of several lines the last one counts."""
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("lines"))
    last = lines.select(F.from_json(F.element_at("lines", -1), T.MapType(T.StringType(), value)).alias("m"))
    return last.select(F.explode("m").alias("name", "value"))


def folded_dictionary(spark: SparkSession, path: str, value: T.DataType) -> DataFrame:
    """(name, value) of dictionaries whose lines add up: each line is a JSON object, and of a name that several lines have the last one counts.

    The fold runs over the lines of one file; a name that several files have comes once for each.
    """
    kind = T.MapType(T.StringType(), value)
    # An empty line, or one that is no object, is null.
    maps = F.filter(F.transform(F.split("value", "\n"), lambda x: F.from_json(x, kind)), lambda m: m.isNotNull())
    later = lambda old, new: F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
    # Opened where it is made: of a column, Spark would ask first whether it is empty, and so parse the files twice.
    return spark.read.text(path, wholetext=True).select(F.explode(F.aggregate(maps, F.create_map().cast(kind), later)).alias("name", "value"))


#: A structure's profiles by chain: how far to trust each position, probabilities and log-odds over the letters.
PROFILE = T.MapType(T.StringType(), T.StructType([T.StructField("pssm_coef", T.ArrayType(T.DoubleType())), *(T.StructField(n, T.ArrayType(T.ArrayType(T.DoubleType()))) for n in ("pssm_bias", "pssm_log_odds"))]))


def profile_lines(profiles: DataFrame, coefs: tuple[str, ...] = ("coef",)) -> DataFrame:
    """(name, text): the profile dictionary of each structure as one line, from (name, chain, pos, coef, bias, log_odds).

    coefs: columns of coefficients; the text has a line for each, in order, with an empty line between them.
    """
    at = F.array_sort(F.collect_list(F.struct("pos", *coefs, "bias", "log_odds")))
    chains = profiles.groupBy("name", "chain").agg(at.alias("r"))
    one = chains.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("chain", "r")), _by_first).alias("c"))
    parts = lambda r, coef: F.struct(*(F.transform(r, _field(c)).alias(n) for c, n in ((coef, "pssm_coef"), ("bias", "pssm_bias"), ("log_odds", "pssm_log_odds"))))
    of = lambda coef: F.map_from_entries(F.transform("c", lambda x: F.struct(x["chain"], parts(x["r"], coef))))
    return one.select("name", F.concat_ws("\n\n", *(F.to_json(F.create_map(F.col("name"), of(c))) for c in coefs)).alias("text"))


def _field(name: str):
    return lambda x: x[name]


def _by_first(a: Column, b: Column) -> Column:
    return F.when(a["chain"] < b["chain"], -1).when(a["chain"] > b["chain"], 1).otherwise(0)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(name, chain, pos, coef, bias, log_odds) of profile dictionaries."""
    each = folded_dictionary(spark, path, PROFILE).select("name", F.explode("value").alias("chain", "p"))
    rows = each.select("name", "chain", F.posexplode(F.arrays_zip("p.pssm_coef", "p.pssm_bias", "p.pssm_log_odds")).alias("k", "z"))
    return rows.select("name", "chain", (F.col("k") + 1).alias("pos"), F.col("z.pssm_coef").alias("coef"), F.col("z.pssm_bias").alias("bias"), F.col("z.pssm_log_odds").alias("log_odds"))


#: Fixed value: the order of the letters in the columns of text profiles.
PROFILE_LETTERS = "ARNDCQEGHILKMFPSTWYV"


def permuted(values: Column, alphabet: str, given: str = PROFILE_LETTERS) -> Column:
    """Values that come in the order of `given`, in the order of an alphabet; 0 for a letter that has none."""
    return bound(values, lambda v: F.array(*(F.get(v, F.lit(given.index(a))) if a in given else F.lit(0.0) for a in alphabet)))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").cast("long").alias("id")).filter("id is not null")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a JSON document with a list of queries."""
    levels = T.StructType([T.StructField(f"{n} Number", T.IntegerType()) for n in ("Class", "Architecture", "Topology", "Superfamily")])
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", T.StructType().add("queries", T.ArrayType(levels)))["queries"]).alias("q")).select("q.*")


def read_profile(spark: SparkSession, path: str, skip: int = 2, drop: int = 4, letters: int = 20) -> DataFrame:
    """(file, pos, values): a text profile: some head rows, some columns in front, then one number per letter."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("row", "line"))
    numbers = F.transform(F.filter(F.split(F.substring("line", drop + 1, 1 << 20), r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    return whole.filter((F.col("row") >= skip) & (F.trim("line") != "")).select("file", (F.col("row") - skip + 1).alias("pos"), F.slice(numbers, 1, letters).alias("values"))


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, step, time, train, valid, train_acc, valid_acc) of a training log."""
    field = lambda n: F.regexp_extract("value", rf"(?:^|[ ,]){n}: ([-0-9.]+)", 1)
    out = spark.read.text(path).filter(F.col("value").startswith("epoch"))
    return out.select(field("epoch").cast("int").alias("epoch"), field("step").cast("int").alias("step"), *(field(n).cast("double").alias(n) for n in ("time", "train", "valid", "train_acc", "valid_acc")))
