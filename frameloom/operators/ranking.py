"""Ranks without a one-task window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.config import LARGE_VIDEOS, PLANS, LargeVideoRules
from frameloom.session import cut_lineage

_ROW_BITS = 33


def global_rank(df: DataFrame, order: list[Column], rank: str = "rank", partitions: int | None = None) -> DataFrame:
    """1-based rank over the whole table under a total order.

    Range partitioning on the full key spreads equal leading values over partitions; each row then
    adds its position to the number of rows before its partition. The order must end in a unique
    column. The sorted rows are checkpointed because range bounds come from a sample.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = cut_lineage(ranged.sortWithinPartitions(*order).withColumn("_seq", F.monotonically_increasing_id()))
    part = F.shiftright("_seq", _ROW_BITS)
    # one row per partition of the job: bounded by the number of tasks
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    position = F.col("_seq").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + F.col("_before") + 1
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(rank, position.cast("long"))
        .drop("_part", "_seq", "_before")
    )


def rank_in_group(
    df: DataFrame, group: str, order: list[Column], rank: str = "member_rank", max_window_rows: int = PLANS.window_rows
) -> DataFrame:
    """1-based rank within each group under a total order.

    The largest group is measured first. While it fits a task, a window does it in one shuffle;
    otherwise the table is ranked as a whole by (group, order) and each group's first position is
    subtracted, so no group is ever sorted by one task.
    """
    largest = df.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    if largest <= max_window_rows:
        return df.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    ranked = global_rank(df, [F.col(group), *order], "_position")
    first = ranked.groupBy(group).agg(F.min("_position").alias("_first"))
    return (
        ranked.join(first, group)
        .withColumn(rank, (F.col("_position") - F.col("_first") + 1).cast("int"))
        .drop("_position", "_first")
    )


def rank_by_size(videos: DataFrame) -> DataFrame:
    return global_rank(videos, [F.desc("file_size"), F.asc("asset_id")])


def top_count(rows: int, rules: LargeVideoRules = LARGE_VIDEOS) -> int:
    """The first 15 %, rounded up, at least one; 0 of nothing."""
    return max(1, math.ceil(rows * rules.top_fraction)) if rows else 0


def mark_top(ranked: DataFrame, rules: LargeVideoRules = LARGE_VIDEOS) -> DataFrame:
    """Flag the leading fraction of a ranked table; the row count is one scalar."""
    rows = ranked.agg(F.max("rank")).first()[0] or 0
    return ranked.withColumn("is_top", F.col("rank") <= top_count(rows, rules))


def without_and_reranked(ranked: DataFrame, ids: DataFrame, rules: LargeVideoRules = LARGE_VIDEOS) -> DataFrame:
    """Drop ids from a ranked list, close the gaps and mark the top part anew."""
    left = ranked.drop("rank", "is_top").join(ids.select("asset_id"), "asset_id", "left_anti")
    return mark_top(rank_by_size(left), rules)


def top_totals(marked: DataFrame) -> DataFrame:
    size = F.col("file_size")
    zero = F.lit(0).cast("long")
    return marked.agg(
        F.count("*").alias("videos"),
        F.count_if("is_top").alias("top_videos"),
        F.coalesce(F.sum(size), zero).alias("total_bytes"),
        F.coalesce(F.sum(F.when(F.col("is_top"), size)), zero).alias("top_bytes"),
        F.coalesce(F.sum(F.when(~F.col("is_top"), size)), zero).alias("rest_bytes"),
    )
