"""Corpus pipeline: quality, toxicity, near duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all
but the last return the columns of ``docs``, further and clashing ones included.  Defined
cases, for every stage: null ids are ids like others, repeated rows are judged alike (near
duplicates keep one), very long texts are read whole, and an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import decontaminate, jaccard, packing, quality, toxicity
from leafmill.llm.common import discard, materialize, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts; it learns from the labels of the original documents.

    Null and empty texts are scored like others; labels of documents that are not there teach
    nothing, and without any labels every score is the same.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity stays below the threshold; null and empty texts have none, and stay.

    Labels of documents that earlier stages dropped teach nothing.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of linked documents, the one of the smallest id, and every row without words.

    Null texts have no words.  In a component whose ids are all null, every different text stays.
    """
    return jaccard.keep_one(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark passage; null texts have none, and null or empty items are no passage."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences, as digests; a null text is an empty document of one token."""
    return packing.digest(packing.pack(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaked),
    ("packing", pack),
]

#: The classifiers are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of what all stages keep of ``documents``; each stage is written and read again, and goes when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
