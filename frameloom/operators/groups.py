"""Groups of matched assets: assembly, best copy, roll-ups, removal.

A groups table has one row per member: group_id, member_rank (1 = best copy), asset_id, file_size,
pixels, total_storage and, for similar photos, average_similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.config import PLANS
from frameloom.functions import media
from frameloom.operators.index import without_ids
from frameloom.operators.ranking import rank_in_group
from frameloom.operators.sizes import resolve_sizes


def _size_or_zero() -> Column:
    return F.coalesce("file_size", F.lit(0))


# Best copy first. Photos that are duplicates keep the largest file, the others the most pixels.
BEST_BY_SIZE = "size"
BEST_BY_PIXELS = "pixels"


def best_order(best: str) -> list[Column]:
    size, pixels = _size_or_zero().desc(), F.col("pixels").desc()
    return [*((size, pixels) if best == BEST_BY_SIZE else (pixels, size)), F.col("asset_id").asc()]


def largest_group(members: DataFrame, group: str) -> int:
    return members.groupBy(group).count().agg(F.max("count")).first()[0] or 0


def rank_members(
    rows: DataFrame, group: str, order: list[Column], largest: int, max_window_rows: int = PLANS.window_rows
) -> DataFrame:
    """Adds member_rank, the id of the best member and the group's storage.

    Groups that fit a task take one window shuffle. Beyond that, ranks come from a range partitioning and
    the per-group values from a merging aggregate joined back.
    """
    if largest <= max_window_rows:
        whole = Window.partitionBy(group)
        ordered = whole.orderBy(*order)
        return (
            rows.withColumn("member_rank", F.row_number().over(ordered))
            .withColumn("best_id", F.first("asset_id").over(ordered))
            .withColumn("total_storage", F.coalesce(F.sum("file_size").over(whole), F.lit(0)))
        )
    ranked = rank_in_group(rows, group, order, max_window_rows=max_window_rows)
    per_group = ranked.groupBy(group).agg(
        F.max(F.when(F.col("member_rank") == 1, F.col("asset_id"))).alias("best_id"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_storage"),
    )
    return ranked.join(per_group, group)


def assemble_groups(
    members: DataFrame,
    assets: DataFrame,
    resources: DataFrame | None,
    best: str,
    max_window_rows: int = PLANS.window_rows,
) -> DataFrame:
    """Groups table from (asset_id, component). File sizes are looked up for group members only."""
    rows = members.join(
        assets.select("asset_id", "file_size", media.pixels(F.col("pixel_width"), F.col("pixel_height")).alias("pixels")),
        "asset_id",
    )
    rows = resolve_sizes(rows, resources)
    ranked = rank_members(rows, "component", best_order(best), largest_group(members, "component"), max_window_rows)
    return ranked.select(
        F.col("best_id").alias("group_id"),
        F.col("member_rank").cast("int").alias("member_rank"),
        "asset_id",
        "file_size",
        "pixels",
        "total_storage",
        "component",
    )


def largest_storage_first(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("total_storage"), "group_id", "member_rank")


def representatives(groups: DataFrame) -> DataFrame:
    return groups.filter(F.col("member_rank") == 1)


def deletion_candidates(groups: DataFrame) -> DataFrame:
    """Every copy but the best one."""
    return groups.filter(F.col("member_rank") > 1)


def selection(groups: DataFrame, keep_best: bool = True) -> DataFrame:
    """Ids selected for deletion: the candidates, or all members."""
    return (deletion_candidates(groups) if keep_best else groups).select("asset_id")


def member_ids(groups: DataFrame, what: str = "all_members") -> DataFrame:
    """The exclusion set built from groups: every member, or only the extra copies. No asset is in two
    groups of one analysis, so the ids are distinct as they are."""
    return selection(groups, keep_best=what == "extra_copies")


def group_storage(groups: DataFrame) -> DataFrame:
    return groups.groupBy("group_id").agg(
        F.count("*").alias("members"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_storage"),
        F.coalesce(F.max("file_size"), F.lit(0)).alias("largest_member"),
    )


def rollup(groups: DataFrame) -> DataFrame:
    """One row: groups, members, copies that can go, bytes they free. One pass without distinct."""
    extra = F.col("member_rank") > 1
    return groups.agg(
        F.count_if(F.col("member_rank") == 1).alias("group_count"),
        F.count("*").alias("member_count"),
        F.count_if(extra).alias("deletable_copies"),
        F.coalesce(F.sum(F.when(extra, F.col("file_size"))), F.lit(0)).alias("reclaimable_bytes"),
    )


def filter_by_group_size(groups: DataFrame, name: str) -> DataFrame:
    """Members of the groups whose largest member passes the named size filter."""
    keep = group_storage(groups).filter(
        media.size_matches(media.GROUP_SIZE_FILTERS, name, F.col("largest_member"))
    )
    return groups.join(keep.select("group_id"), "group_id", "left_semi")


def remove_from_groups(groups: DataFrame, ids: DataFrame, max_window_rows: int = PLANS.window_rows) -> DataFrame:
    """Drop ids, then groups with one member left. Group ids and order stay, the next member moves up."""
    left = without_ids(groups, ids).withColumnRenamed("member_rank", "_rank").drop("total_storage")
    alive = left.groupBy("group_id").agg(F.count("*").alias("_left")).filter("_left >= 2")
    left = left.join(alive.select("group_id"), "group_id", "left_semi")
    ranked = rank_members(left, "group_id", [F.col("_rank")], largest_group(groups, "group_id"), max_window_rows)
    return ranked.select(*groups.columns)
