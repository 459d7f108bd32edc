"""The corpus pipeline: language, toxicity, near duplicates, contamination, packing, one after another over all documents.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents; what a stage rejects is gone for the
next. Models are fitted on the documents that reach their stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from steinlake.llm.common import prepared, stored, table
from steinlake.llm.decontamination import without_contaminated
from steinlake.llm.language import with_language
from steinlake.llm.near_duplicates import one_of_each_group
from steinlake.llm.packing import pack_documents
from steinlake.llm.toxicity import without_toxic


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents without a main language: null texts, texts without a letter, and those of which no language holds two fifths."""
    return with_language(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents predicted toxic by a model of the labelled ones."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (similarity 0.80 or more), that with the least doc_id."""
    return one_of_each_group(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents contaminated by benchmark passages."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the documents left, with its sequence and offset."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Trained stages and tokenisation are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored and read again for the next."""
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
