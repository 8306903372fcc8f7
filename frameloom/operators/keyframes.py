"""Keyframe selection and the ordered frame lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.config import DUPLICATE_VIDEOS, DuplicateVideoRules


def collect_frames(
    frame_rows: DataFrame, rules: DuplicateVideoRules = DUPLICATE_VIDEOS, keep_places: bool = False
) -> DataFrame:
    """Frame vectors of a video in order; missing frames leave no gap (the rest move up), or a null with ``keep_places``.

    One slot per sample point, so what is gathered for an asset is bounded however many rows it has.
    """
    slots = [
        F.first(F.when(F.col("frame_idx") == k, F.col("vec")), ignorenulls=True).alias(f"_f{k}")
        for k in range(rules.max_frames)
    ]
    gathered = frame_rows.groupBy("asset_id").agg(*slots)
    frames = F.array(*[f"_f{k}" for k in range(rules.max_frames)])
    return gathered.select("asset_id", (frames if keep_places else F.array_compact(frames)).alias("frames"))


def sample_keyframes(
    videos: DataFrame, frame_times: DataFrame, rules: DuplicateVideoRules = DUPLICATE_VIDEOS
) -> DataFrame:
    """Nearest frame within the tolerance of each sample point; videos with too few hits are left out.

    Which sample points a frame can serve follows from its own time and the duration, so after the
    id join there is no range join: a frame explodes to the few points in reach and the nearest wins
    in a mergeable aggregate.
    """
    long_enough = videos.filter(F.col("duration") > rules.min_duration_seconds).select("asset_id", "duration")
    points = F.array(*[F.lit(p) for p in rules.sample_fractions])
    in_reach = F.filter(
        F.transform(points, lambda p, k: F.struct(k.alias("k"), F.abs(F.col("frame_time") - p * F.col("duration")).alias("gap"))),
        lambda s: s["gap"] <= rules.frame_tolerance_seconds,
    )
    nearest = (
        frame_times.join(long_enough, "asset_id")
        .select("asset_id", "frame_no", F.explode(in_reach).alias("hit"))
        .groupBy("asset_id", F.col("hit.k").alias("sample_idx"))
        .agg(F.min(F.struct(F.col("hit.gap").alias("gap"), F.col("frame_no"))).alias("best"))
        .select("asset_id", "sample_idx", F.col("best.frame_no").alias("frame_no"), F.col("best.gap").alias("gap"))
    )
    # at most one row per sample point is left of each video, placed by the join already
    hits = F.count("*").over(Window.partitionBy("asset_id"))
    return nearest.withColumn("_hits", hits).filter(F.col("_hits") >= rules.min_sampled_frames).drop("_hits")
