"""Duplicate and similar photos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.config import (
    DUPLICATE_PHOTOS,
    SIMILAR_PHOTOS,
    TUNING,
    DuplicatePhotoRules,
    MatchTuning,
    SimilarPhotoRules,
)
from frameloom.functions import media
from frameloom.functions import vectors as V
from frameloom.operators import fingerprints as FP
from frameloom.operators import groups as G
from frameloom.operators.delta import MatchState, grouped_members, match_state, update_state
from frameloom.operators.families import match_similar
from frameloom.operators.index import photos, without_ids
from frameloom.operators.matching import (
    DuplicateScorer,
    SimilarScorer,
    collapse_copies,
    match_nodes,
    matched_components,
    node_statistics,
)
from frameloom.session import cut_lineage


def photo_tiers(assets: DataFrame, rules: DuplicatePhotoRules = DUPLICATE_PHOTOS) -> DataFrame:
    """asset_id and the two blocking tiers of every photo."""
    width, height = F.col("pixel_width"), F.col("pixel_height")
    return photos(assets).select(
        "asset_id",
        media.aspect_tier(width, height, rules.aspect_scale).alias("aspect_tier"),
        media.megapixel_tier(width, height, rules.megapixel_scale).alias("megapixel_tier"),
    )


def comparable(features: DataFrame) -> DataFrame:
    """The rows whose vector can be compared at all, as unit vectors: a photo nobody could compare matches nothing."""
    return features.filter(V.is_usable(F.col("vec"))).withColumn("vec", V.l2_normalize(F.col("vec")))


def _duplicate_features(assets: DataFrame, features: DataFrame, rules: DuplicatePhotoRules) -> DataFrame:
    """asset_id, scope, node, dhash, vec. Vectors of different length never match, so length is scope."""
    scope = F.concat_ws("x", "aspect_tier", "megapixel_tier", F.size("vec"))
    rows = photo_tiers(assets, rules).join(comparable(features).filter("dhash IS NOT NULL"), "asset_id")
    return rows.select("asset_id", scope.alias("scope"), "dhash", "vec").withColumn(
        "node", V.fingerprint_key(F.col("scope"), F.col("dhash"), F.col("vec"))
    )


def _similar_features(assets: DataFrame, features: DataFrame) -> DataFrame:
    aspect = media.photo_aspect_ratio(F.col("pixel_width"), F.col("pixel_height"))
    rows = photos(assets).select("asset_id", aspect.alias("aspect")).join(comparable(features), "asset_id")
    return rows.select(
        "asset_id", F.size("vec").cast("string").alias("scope"), "dhash", "vec", "aspect"
    ).withColumn("node", V.fingerprint_key(F.col("scope"), F.col("dhash"), F.col("aspect"), F.col("vec")))


def _members(rows: DataFrame, components: DataFrame) -> DataFrame:
    return cut_lineage(rows.select("asset_id", "node").join(components, "node"))


def duplicate_photo_members(
    assets: DataFrame,
    features: DataFrame,
    rules: DuplicatePhotoRules = DUPLICATE_PHOTOS,
    tuning: MatchTuning = TUNING,
) -> DataFrame:
    """(asset_id, node, component) of every photo in a duplicate group: enough to exclude them elsewhere."""
    scorer = DuplicateScorer(rules)
    rows = cut_lineage(_duplicate_features(assets, features, rules))  # read for the nodes and again for their assets
    nodes = collapse_copies(rows, scorer)
    found = match_nodes(nodes, scorer, tuning, connectivity_only=True)
    return _members(rows, matched_components(nodes, found, scorer))


def duplicate_photo_groups(
    assets: DataFrame,
    features: DataFrame,
    resources: DataFrame | None = None,
    rules: DuplicatePhotoRules = DUPLICATE_PHOTOS,
    tuning: MatchTuning = TUNING,
) -> DataFrame:
    """Groups of re-encoded copies: same shape and size tier, close hash, close vector, transitively."""
    members = duplicate_photo_members(assets, features, rules, tuning)
    return G.assemble_groups(members, assets, resources, G.BEST_BY_SIZE).drop("component")


def incremental_duplicate_groups(
    assets: DataFrame,
    stored: DataFrame,
    computed: DataFrame,
    resources: DataFrame | None = None,
    rules: DuplicatePhotoRules = DUPLICATE_PHOTOS,
    tuning: MatchTuning = TUNING,
) -> DataFrame:
    """Duplicate groups from the stored fingerprints that are still valid and ``computed`` features of the others.

    ``computed`` may cover more than is missing: only what ``needs_analysis`` names is taken from it.
    """
    hits = FP.cache_hits(assets, stored, "duplicate")
    missing = FP.needs_analysis(assets, stored, "duplicate").select("asset_id")
    recomputed = computed.withColumnRenamed("vec", "feature_vector").join(missing, "asset_id", "left_semi")
    features = FP.hits_and_recomputed(hits, recomputed).withColumnRenamed("feature_vector", "vec")
    return duplicate_photo_groups(assets, features, resources, rules, tuning)


def duplicate_match_state(
    assets: DataFrame, features: DataFrame, rules: DuplicatePhotoRules = DUPLICATE_PHOTOS, tuning: MatchTuning = TUNING
) -> MatchState:
    """What is stored of a library so that later changes cost little: its distinct fingerprints with their components."""
    return match_state(_duplicate_features(assets, features, rules), DuplicateScorer(rules), tuning)


def updated_match_state(
    state: MatchState,
    changed: DataFrame,
    features: DataFrame,
    deleted_ids: DataFrame,
    rules: DuplicatePhotoRules = DUPLICATE_PHOTOS,
    tuning: MatchTuning = TUNING,
) -> MatchState:
    """The state after ``changed`` assets, new or edited, with their ``features``, and after deletions: only what changed is matched."""
    gone = changed.select("asset_id").unionByName(deleted_ids.select("asset_id"))
    return update_state(state, _duplicate_features(changed, features, rules), gone, DuplicateScorer(rules), tuning)


def duplicate_groups_of(
    state: MatchState, assets: DataFrame, resources: DataFrame | None = None, rules: DuplicatePhotoRules = DUPLICATE_PHOTOS
) -> DataFrame:
    """The groups that a stored state holds, as ``duplicate_photo_groups`` gives them."""
    members = grouped_members(state, DuplicateScorer(rules))
    return G.assemble_groups(members, assets, resources, G.BEST_BY_SIZE).drop("component")


def similar_photo_groups(
    assets: DataFrame,
    features: DataFrame,
    excluded_ids: DataFrame,
    resources: DataFrame | None = None,
    rules: SimilarPhotoRules = SIMILAR_PHOTOS,
    tuning: MatchTuning = TUNING,
) -> DataFrame:
    """Groups of similar shots among the photos not excluded, with their mean verified similarity."""
    scorer = SimilarScorer(rules)
    left = without_ids(photos(assets), excluded_ids)
    rows = cut_lineage(_similar_features(left, features))
    nodes = collapse_copies(rows, scorer)
    found = cut_lineage(match_similar(nodes, scorer, tuning))
    components = cut_lineage(matched_components(nodes, found, scorer))
    averages = component_similarity(node_statistics(nodes, found, scorer), components, rules)
    members = _members(rows, components)
    groups = G.assemble_groups(members, left, resources, G.BEST_BY_PIXELS)
    return groups.join(averages, "component").drop("component")


def component_similarity(
    statistics: DataFrame, components: DataFrame, rules: SimilarPhotoRules = SIMILAR_PHOTOS
) -> DataFrame:
    """Mean over the verified pairs of each component. Every pair counts once from each side, which
    leaves the mean unchanged; the threshold stands in where nothing was verified."""
    per_copy = statistics.join(components, "node").groupBy("component")
    total = F.sum(F.col("score_sum") * F.col("weight"))
    pairs = F.sum(F.col("matches") * F.col("weight"))
    return per_copy.agg(
        F.coalesce(total / F.nullif(pairs, F.lit(0)), F.lit(rules.threshold)).alias("average_similarity")
    )


def _per_asset(rows: DataFrame, nodes: DataFrame, found: DataFrame, scorer) -> DataFrame:
    statistics = node_statistics(nodes, found, scorer).drop("weight")
    return rows.select("asset_id", "node").join(statistics, "node").drop("node")


def duplicate_matches(
    assets: DataFrame,
    features: DataFrame,
    rules: DuplicatePhotoRules = DUPLICATE_PHOTOS,
    tuning: MatchTuning = TUNING,
) -> DataFrame:
    """Per photo with a verified duplicate: how many, and the nearest and mean distance."""
    scorer = DuplicateScorer(rules)
    rows = cut_lineage(_duplicate_features(assets, features, rules))  # read for the nodes and again for their assets
    nodes = collapse_copies(rows, scorer)
    return _per_asset(rows, nodes, match_nodes(nodes, scorer, tuning), scorer).select(
        "asset_id",
        "matches",
        F.col("best_score").alias("nearest_distance"),
        (F.col("score_sum") / F.col("matches")).alias("mean_distance"),
    )


def similar_matches(
    assets: DataFrame,
    features: DataFrame,
    excluded_ids: DataFrame | None = None,
    rules: SimilarPhotoRules = SIMILAR_PHOTOS,
    tuning: MatchTuning = TUNING,
) -> DataFrame:
    """Per photo with a verified similar shot: how many, and the best and mean cosine."""
    scorer = SimilarScorer(rules)
    left = photos(assets) if excluded_ids is None else without_ids(photos(assets), excluded_ids)
    rows = cut_lineage(_similar_features(left, features))
    nodes = collapse_copies(rows, scorer)
    return _per_asset(rows, nodes, match_nodes(nodes, scorer, tuning), scorer).select(
        "asset_id",
        "matches",
        F.col("best_score").alias("best_similarity"),
        (F.col("score_sum") / F.col("matches")).alias("mean_similarity"),
    )
