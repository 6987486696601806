"""A corpus pipeline: five stages, each on all documents its predecessor kept.

Null and empty texts pass every filter that they can: they score the share of
good labels, are no copies, hold no item and no secret, and are packed with
size 0.  Long texts are handled whole.  Of near copies and repeated keys the
first key stays, see ``minhash_dedup.keep_one``; other repeated rows and rows
without a key stay.  Columns beyond those of documents stay up to the last
stage, whatever their names.  Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import compression_quality, decontamination, minhash_dedup, packing, secret_scan
from tidewatch.llm.common import materialise, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    return compression_quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return minhash_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go, cut into tokens, into bins of one context each."""
    return packing.pack_texts(docs)


STAGES = [
    ("quality_classifier", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret_scan", secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Classifier and forest are fitted models and packing is order-bound search: SQL expresses none of them.
ORACLE_SQL = None
