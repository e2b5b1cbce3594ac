"""The corpus pipeline: documents are filtered, deduplicated and packed into training sequences.

Every stage works on all that its predecessor kept and is written as Parquet before the next one
reads it, so a stage that fails is run again from its predecessor's table.  All stages but the
last return the columns of documents; the last returns the pieces of packed sequences.  A
document is rejected by its text alone: rows with null or empty text have too few words for the
quality rules and go there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logweave.llm import exact_dedup, packing, quality_rules, simhash, toxicity
from logweave.llm.common import read_table
from logweave.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict toxic."""
    return toxicity.clean_documents(docs, read_table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base figures and the quality model keep."""
    return quality_rules.good_documents(docs, read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return exact_dedup.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, the document with the smallest doc_id."""
    return simhash.distinct_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_good),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("packing", pack),
]

#: SQL can express neither the trained models nor the packing; tests compare each stage with its operator.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
