"""Named queries of the operators with their SQL, registered by the driver entry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import ann, lm, mixing, negatives, ngram_join, packing, periodic, pii, quality, sharding, suffix_dedup, tokens, toxicity
from frameloom.llm.common import table, tuned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = lambda spark, sf_dir: run(tuned(spark), sf_dir)
    return run


@_query
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


ORACLE["op1_ngram_jaccard"] = ngram_join.COMPONENTS_SQL


@_query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality.MEASURES[:5], "base_failed", "kept", F.round("good_chance", 6).alias("good_chance"))


@_query
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


@_query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


@_query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@_query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op7_mixing"] = mixing.MIX_SQL


@_query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


@_query
def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@_query
def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.backoff_scores(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


ORACLE["op10_lm_scores"] = lm.SCORES_SQL


@_query
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


ORACLE["op11_sharding"] = sharding.SHARDS_SQL


@_query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.relabelled(table(spark, sf_dir, "embeddings"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


ORACLE["op12_hard_negatives"] = negatives.NEGATIVES_SQL


@_query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.echoed_tails(table(spark, sf_dir, "documents"))
    return periodic.run_digests(periodic.periodic_runs(docs))
