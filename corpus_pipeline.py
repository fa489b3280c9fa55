"""A training-corpus pipeline: each stage calls one operator of lodestone.llm on what the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet before the next one
reads it. All but the last return the columns of documents. A stage sets its session to small batches, as its result is
computed after it returns; so they stay set. Null texts, empty tables and repeated rows have the
results that the operators' own docstrings name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import mixing, neardup, packing, quality, secrets
from lodestone.llm.common import cut, set_small_batches, table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on the labelled ones, does not reject."""
    set_small_batches(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    set_small_batches(spark)
    return neardup.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in the place of each secret."""
    set_small_batches(spark)
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    set_small_batches(spark)
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    set_small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("n-gram Jaccard join", one_of_near_duplicates),
    ("secret scans", redact_secrets),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The quality classifier is trained and the mix is drawn, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{i}")
    return docs
