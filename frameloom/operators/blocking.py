"""Blocking of photos and partners by close hashes, over distinct hashes with counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.config import DUPLICATE_PHOTOS, TUNING, DuplicatePhotoRules, MatchTuning
from frameloom.operators.matching import HashScorer, match_nodes, node_statistics
from frameloom.session import cut_lineage


def bucket_candidates(tiers: DataFrame) -> DataFrame:
    """Buckets with at least two photos and the comparisons an all-pairs check would need."""
    n = F.col("photos")
    return (
        tiers.groupBy("aspect_tier", "megapixel_tier")
        .agg(F.count("*").alias("photos"))
        .filter(n >= 2)
        .withColumn("comparisons", (n * (n - 1) / 2).cast("long"))
    )


def hash_counts(features: DataFrame, *scope: str) -> DataFrame:
    """Distinct hashes per scope with the number of photos behind each; a photo without a hash has none."""
    # few and narrow next to the features, which are read once for all that follows
    return cut_lineage(features.filter("dhash IS NOT NULL").groupBy(*scope, "dhash").agg(F.count("*").alias("photos")))


def close_hashes(
    hashes: DataFrame,
    scope: list[str],
    rules: DuplicatePhotoRules = DUPLICATE_PHOTOS,
    tuning: MatchTuning = TUNING,
) -> DataFrame:
    """Per hash with a photo within the Hamming bound: how many photos, photo pairs and the nearest other hash.

    (scope.., dhash, photos, near_photos, photo_pairs, nearest_hamming): near_photos are those a photo of this hash can
    be paired with, copies of its own hash included; photo_pairs counts each pair at both of its hashes, pairs inside a
    hash twice at it; nearest_hamming is 0 where the hash has copies. No pair leaves the task that found it, so a million
    hashes close to each other are a million rows.
    """
    scorer = HashScorer(rules)
    name = F.concat_ws(":", *scope, F.hex("dhash"))
    place = F.concat_ws(":", *scope) if scope else F.lit("")
    nodes = cut_lineage(hashes.withColumn("node", name).withColumn("scope", place).withColumn("weight", F.col("photos")))
    found = node_statistics(nodes, match_nodes(nodes, scorer, tuning), scorer)
    joined = nodes.select("node", *scope, "dhash", "photos").join(found.drop("weight"), "node")
    return joined.select(
        *scope,
        "dhash",
        "photos",
        F.col("matches").alias("near_photos"),
        (F.col("photos") * F.col("matches")).alias("photo_pairs"),
        F.col("best_score").cast("int").alias("nearest_hamming"),
    )


def candidate_hashes(
    tiers: DataFrame, features: DataFrame, rules: DuplicatePhotoRules = DUPLICATE_PHOTOS, tuning: MatchTuning = TUNING
) -> DataFrame:
    """``close_hashes`` inside each bucket: what passes the cheap check before vectors are compared."""
    scope = ["aspect_tier", "megapixel_tier"]
    hashes = hash_counts(tiers.join(features.select("asset_id", "dhash"), "asset_id"), *scope)
    return close_hashes(hashes, scope, rules, tuning)
