"""Writers: result logs, FASTA with score headers, JSON lines, single-object dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole files that a Python worker gets at once.
BATCH, FILES = "spark.sql.execution.arrow.maxRecordsPerBatch", 64


def append_results(results: DataFrame, path: str, kind: str = "parquet") -> None:
    """Appends a result log; draws of the null distribution stay in Parquet and are left out of CSV."""
    if kind == "csv":
        results.drop("h0").write.mode("append").csv(path, header=True)
    else:
        results.write.mode("append").parquet(path)


def result_name(checkpoint: Column | str, suffix: str = ".csv") -> Column:
    """The name of the file with a checkpoint's results: its path without dots and slashes in front, the other slashes as "_", and the suffix in place of its own."""
    inner = F.replace(F.regexp_replace(checkpoint, r"^[/.]+", ""), F.lit("/"), F.lit("_"))
    return F.concat(F.regexp_replace(inner, r"(?<=.)\.[^.]+$", ""), F.lit(suffix))


def design_header(row: dict[str, Column]) -> Column:
    """name=value fields, comma-separated; numbers with four decimals."""
    parts = [F.concat(F.lit(f"{k}="), F.format_string("%.4f", v) if k in ("score", "global_score", "seq_recovery") else v.cast("string")) for k, v in row.items()]
    return F.concat_ws(", ", *parts)


def fasta_text(header: Column, sequence: Column) -> Column:
    return F.concat(F.lit(">"), header, F.lit("\n"), sequence)


def write_fasta(records: DataFrame, path: str, header: str = "header", sequence: str = "sequence") -> None:
    records.select(fasta_text(F.col(header), F.col(sequence)).alias("value")).write.text(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def joined_lines(rows: DataFrame, name: str, order: list[str], line: Column) -> DataFrame:
    """(name, text): one file's lines in an explicit order. A file is one structure, a bounded group."""
    one = rows.groupBy(name).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))).alias("_lines"))
    return one.select(name, F.array_join(F.transform("_lines", lambda x: x["_line"]), "\n").alias("text"))


def write_named(files: DataFrame, folder: str, suffix: str) -> str:
    """Writes each row of files(name, text) as the file name + suffix of the folder, and returns the folder.

    A repeated task writes the same bytes under the same name again.
    """
    spark = files.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            # Texts are written from where they lie in the batch.
            for name, text in zip(b.column(0), b.column(1), strict=True):
                with store.open_output_stream(f"{root}/{name.as_py()}{suffix}") as out:
                    out.write(text.as_buffer())
                    out.write(b"\n")
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    # By rows alone, a batch of whole files has no bound in bytes that holds as there are more of them.
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(FILES))
    try:
        files.select("name", "text").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)
    return folder
