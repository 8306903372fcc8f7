"""Duplicate and large videos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.config import (
    DUPLICATE_VIDEOS,
    LARGE_VIDEOS,
    TUNING,
    DuplicateVideoRules,
    LargeVideoRules,
    MatchTuning,
)
from frameloom.functions import media
from frameloom.functions import vectors as V
from frameloom.operators import groups as G
from frameloom.operators import ranking, selection
from frameloom.operators.components import connected_components
from frameloom.operators.index import videos
from frameloom.operators.matching import (
    FrameScorer,
    collapse_copies,
    match_nodes,
    matched_components,
    node_statistics,
)
from frameloom.operators.ranges import range_links
from frameloom.operators.sizes import resolve_or_estimate
from frameloom.session import cut_lineage


def video_candidates(assets: DataFrame, rules: DuplicateVideoRules = DUPLICATE_VIDEOS) -> DataFrame:
    """(asset_id, component) of the videos with a possible partner by duration and shape, transitively.

    The graph has one node per duration and aspect step, so its size depends on how varied the library is
    and not on how many videos it holds.
    """
    placed, links, own = range_links(videos(assets), rules)
    linked = connected_components(links, "a", "b").withColumnRenamed("node", "cell")
    alone = own.join(linked, "cell", "left_anti").withColumn("component", F.col("cell"))
    return placed.join(linked.unionByName(alone), "cell").select("asset_id", "component")


def _frame_rows(candidates: DataFrame, frames: DataFrame, rules: DuplicateVideoRules, align: str) -> DataFrame:
    """asset_id, scope, node, flattened frames. Videos with too few prints cannot match.

    A frame without a usable vector is no print. By position the later ones take its place; by fraction the place
    stays empty.
    """
    if align not in ("position", "fraction"):
        raise ValueError(f"align is position or fraction, not {align!r}")
    usable = F.filter("frames", V.is_usable)
    width = F.size(F.get(usable, F.lit(0)))
    even = F.forall(usable, lambda f: F.size(f) == width)
    if align == "position":
        places, present = usable, F.transform(usable, lambda f: F.lit(True))
    else:
        blank = F.array_repeat(F.lit(0.0), width)
        places = F.transform("frames", lambda f: F.when(V.is_usable(f), f.cast("array<double>")).otherwise(blank))
        present = F.transform("frames", V.is_usable)
    rows = frames.filter((F.size(usable) >= rules.min_frames) & even).select(
        "asset_id", width.alias("width"), present.alias("present"), F.size(usable).alias("n_frames"), places.alias("places")
    )
    unit = F.transform("places", lambda f: F.when(V.is_usable(f), V.l2_normalize(f)).otherwise(f.cast("array<double>")))
    return rows.join(candidates, "asset_id").select(
        "asset_id",
        F.concat_ws("#", F.col("component"), F.col("width")).alias("scope"),
        F.flatten(unit).alias("frames"),
        "n_frames",
        "present",
    ).withColumn("node", V.fingerprint_key(F.col("scope"), F.col("n_frames"), F.col("present"), F.col("frames")))


def duplicate_video_groups(
    assets: DataFrame,
    frames: DataFrame,
    resources: DataFrame | None = None,
    rules: DuplicateVideoRules = DUPLICATE_VIDEOS,
    tuning: MatchTuning = TUNING,
    align: str = "position",
) -> DataFrame:
    """Groups of videos whose keyframes agree, within the candidates of one duration-and-shape component.

    ``frames`` has a video's frames in order, null where one is missing. ``align="position"`` compares the frames that
    are there in turn, so a missing one shifts the rest; ``align="fraction"`` compares frames of one place only.
    """
    scorer = FrameScorer(rules, align)
    # read for the nodes and again for their assets
    rows = cut_lineage(_frame_rows(cut_lineage(video_candidates(assets, rules)), frames, rules, align))
    nodes = collapse_copies(rows, scorer)
    found = match_nodes(nodes, scorer, tuning, connectivity_only=True)
    components = matched_components(nodes, found, scorer)
    members = cut_lineage(rows.select("asset_id", "node").join(components, "node"))
    return G.assemble_groups(members, videos(assets), resources, G.BEST_BY_PIXELS).drop("component")


def duplicate_video_matches(
    assets: DataFrame,
    frames: DataFrame,
    rules: DuplicateVideoRules = DUPLICATE_VIDEOS,
    tuning: MatchTuning = TUNING,
    align: str = "position",
) -> DataFrame:
    """Per video with a verified duplicate: how many, and the nearest and mean frame distance."""
    scorer = FrameScorer(rules, align)
    # read for the nodes and again for their assets
    rows = cut_lineage(_frame_rows(cut_lineage(video_candidates(assets, rules)), frames, rules, align))
    nodes = collapse_copies(rows, scorer)
    statistics = node_statistics(nodes, match_nodes(nodes, scorer, tuning), scorer).drop("weight")
    return rows.select("asset_id", "node").join(statistics, "node").select(
        "asset_id",
        "matches",
        F.col("best_score").alias("nearest_distance"),
        (F.col("score_sum") / F.col("matches")).alias("mean_distance"),
    )


def large_videos(
    assets: DataFrame, resources: DataFrame | None = None, rules: LargeVideoRules = LARGE_VIDEOS
) -> DataFrame:
    """Videos ranked by resolved size with the top fraction flagged."""
    columns = ("asset_id", "duration", "creation_date", "pixel_width", "pixel_height", "file_size")
    sized = resolve_or_estimate(videos(assets).select(*columns), resources, rules)
    return ranking.mark_top(ranking.rank_by_size(sized), rules)


def marked_videos(
    assets: DataFrame, resources: DataFrame | None = None, rules: LargeVideoRules = LARGE_VIDEOS
) -> DataFrame:
    """Videos with resolved size and the top fraction flagged, without their ranks: nothing is sorted."""
    sized = resolve_or_estimate(videos(assets).select("asset_id", "duration", "file_size"), resources, rules)
    return selection.mark_top(cut_lineage(sized.select("asset_id", "file_size")), rules)


def filter_large(marked: DataFrame, mode: str, size_filter: str) -> DataFrame:
    """The top part or all videos, then the named size filter."""
    base = marked.filter("is_top") if mode == "top15" else marked
    return base.filter(media.size_matches(media.LARGE_VIDEO_SIZE_FILTERS, size_filter, F.col("file_size")))
