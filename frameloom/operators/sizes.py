"""File sizes: per-asset lookup over the resources, resolution and estimate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.config import LARGE_VIDEOS, LargeVideoRules
from frameloom.functions import media
from frameloom.schemas import VIDEO_RESOURCE_KINDS


def resource_sizes(resources: DataFrame) -> DataFrame:
    """Largest positive video resource, else largest positive resource, else NULL, per asset."""
    size = media.known_size(F.col("file_size"))
    is_video = F.col("kind").isin(*VIDEO_RESOURCE_KINDS)
    return resources.groupBy("asset_id").agg(
        F.coalesce(F.max(F.when(is_video, size)), F.max(size)).alias("looked_up_size")
    )


def resolve_sizes(rows: DataFrame, resources: DataFrame | None) -> DataFrame:
    """Replace unknown ``file_size`` values by the looked-up size where there is one.

    Only rows that need it take part in the lookup, so the resource table is reduced to them before
    its aggregation.
    """
    if resources is None:
        return rows
    unknown = rows.filter(media.known_size(F.col("file_size")).isNull()).select("asset_id")
    sizes = resource_sizes(resources.join(unknown, "asset_id", "left_semi"))
    return rows.join(sizes, "asset_id", "left").select(
        *[
            media.resolve_size(F.col("file_size"), F.col("looked_up_size")).alias("file_size")
            if c == "file_size"
            else F.col(c)
            for c in rows.columns
        ]
    )


def resolve_or_estimate(
    videos: DataFrame, resources: DataFrame | None, rules: LargeVideoRules = LARGE_VIDEOS
) -> DataFrame:
    """Every video gets a size: own, looked up, or estimated from its duration."""
    size = F.coalesce(media.known_size(F.col("file_size")), media.estimated_size(F.col("duration"), rules))
    return resolve_sizes(videos, resources).withColumn("file_size", size)
