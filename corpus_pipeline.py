"""Corpus pipeline: from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameloom.llm import mixing, ngram_join, packing, pii, quality
from frameloom.llm.common import released, saved, table, tuned

VOCABULARY = "byte_bpe_50k.json"
# Near copies: words of an n-gram and similarity in per cent. Those of op1 are its own.
NEAR_WORDS = 5
NEAR_THRESHOLD = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; those without words go, repeated rows are judged each."""
    tuned(spark)
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id; every document without words stays, repeated rows are one."""
    tuned(spark)
    return ngram_join.representatives(docs, threshold=NEAR_THRESHOLD, size=NEAR_WORDS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts masked; null and empty texts stay as they are."""
    tuned(spark)
    return pii.masked(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is one, documents without words cost nothing."""
    tuned(spark)
    return mixing.mixed_documents(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences; a document without text is its end mark alone."""
    tuned(spark)
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("source mixing", source_mixing),
    ("best-fit packing", sequence_packing),
]

# SQL can neither run the learned stages nor tokenize; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(tuned(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
        released(spark)
    return docs
