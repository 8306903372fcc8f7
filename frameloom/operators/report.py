"""Library overview: cleanable bytes, category states and shares, previews, input digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.config import REPORT
from frameloom.functions.signature import row_digest, signature_text
from frameloom.operators import groups as G
from frameloom.operators.index import newest_first, photos, screenshots, summary, videos
from frameloom.schemas import CATEGORIES


def is_unchanged(current: DataFrame, last: DataFrame) -> bool:
    """Whether an analysis run with digest ``last`` would read the same input again (one or two rows each)."""
    return current.exceptAll(last).isEmpty() and last.exceptAll(current).isEmpty()


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def analysis_rollups(analyses: dict[str, DataFrame | None]) -> DataFrame:
    """One roll-up row per finished analysis; missing ones are left out."""
    return _stack(
        [G.rollup(g).select(F.lit(name).alias("category"), "*") for name, g in analyses.items() if g is not None]
    )


def total_cleanable(rollups: DataFrame) -> DataFrame:
    return rollups.agg(F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).alias("cleanable_bytes"))


def _counts(index: DataFrame, analyses: dict[str, DataFrame | None], count: str) -> DataFrame:
    """(category, count) of the index categories and of the finished analyses; one pass over each input."""
    counted = summary(index).select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("category"), F.col(column).alias("count"))
                    for name, column in (("screenshots", "screenshots"), ("videos", "videos"), ("largeVideos", "videos"))
                ]
            )
        ).alias("c")
    ).select("c.*")
    done = {k: v for k, v in analyses.items() if v is not None}
    if not done:
        return counted
    return counted.unionByName(analysis_rollups(done).select("category", F.col(count).alias("count")))


def _ordinal() -> Column:
    return F.element_at(F.create_map(*[x for i, c in enumerate(CATEGORIES) for x in (F.lit(c), F.lit(i))]), F.col("category"))


def dashboard_snapshot(
    index: DataFrame,
    analyses: dict[str, DataFrame | None],
    bin_totals: DataFrame,
    running: frozenset[str] = frozenset(),
    failed: dict[str, str] | None = None,
) -> DataFrame:
    """Seven rows (ordinal, category, state, count, message) in the fixed category order.

    An analysis given as None was not run; ``running`` and ``failed`` name analyses in those states.
    """
    failed = failed or {}
    counts = _counts(index, analyses, "group_count").unionByName(
        bin_totals.select(F.lit("bin").alias("category"), F.col("active_items").alias("count"))
    )
    counted = counts.select(
        "category",
        F.when(F.col("count") > 0, F.lit("available")).otherwise(F.lit("empty")).alias("state"),
        F.when(F.col("count") > 0, F.col("count")).alias("count"),
        F.lit(None).cast("string").alias("message"),
    )
    spark = index.sparkSession
    pending = []
    for name, groups in analyses.items():
        if name in failed:
            pending.append((name, "failed", None, failed[name]))
        elif name in running:
            pending.append((name, "loading", None, None))
        elif groups is None:
            pending.append((name, "notAnalyzed", None, None))
    if pending:
        overridden = [p[0] for p in pending]
        counted = counted.filter(~F.col("category").isin(*overridden)).unionByName(
            spark.createDataFrame(pending, "category string, state string, count long, message string")
        )
    return counted.select(_ordinal().alias("ordinal"), "*").orderBy("ordinal")


def category_shares(index: DataFrame, analyses: dict[str, DataFrame | None]) -> DataFrame:
    """Members per category and their part of the bar. Categories overlap, and non-empty ones keep a
    visible minimum; the window runs over six rows."""
    counts = _counts(index, analyses, "member_count")
    total = F.greatest(F.sum("count").over(Window.partitionBy()), F.lit(1))
    share = F.greatest(F.col("count") / total, F.lit(REPORT.min_share))
    return counts.withColumn("share", F.when(F.col("count") > 0, share)).orderBy(_ordinal())


def preview_ids(index: DataFrame, analyses: dict[str, DataFrame | None], size: int = 3) -> DataFrame:
    """The first ids of every category, each an ordered limit that keeps a few rows per task."""
    ordered = {
        "screenshots": newest_first(screenshots(index)),
        "videos": newest_first(videos(index)),
        **{name: G.largest_storage_first(g) for name, g in analyses.items() if g is not None},
    }
    few = Window.partitionBy("category").orderBy("_seq")
    parts = [
        rows.limit(size)
        .select(F.lit(name).alias("category"), "asset_id", F.monotonically_increasing_id().alias("_seq"))
        .withColumn("position", F.row_number().over(few).cast("int"))
        .drop("_seq")
        for name, rows in ordered.items()
    ]
    return _stack(parts)


def input_digest(index: DataFrame, kind: str, excluded_ids: DataFrame | None = None) -> DataFrame:
    """Order-independent digest (part, rows, digest) of what an analysis reads: equal digests mean nothing to
    redo. The similar-photo analysis also reads the excluded ids, as a second row.

    Sums of row hashes merge in any order and any partitioning.
    """
    rows = photos(index) if kind == "photo" else videos(index)
    zero = F.lit(0).cast("decimal(20,0)")

    def digest(part: str, texts: DataFrame, text: Column) -> DataFrame:
        return texts.agg(
            F.lit(part).alias("part"),
            F.count("*").alias("rows"),
            F.coalesce(F.sum(row_digest(text)), zero).cast("string").alias("digest"),
        )

    records = digest("records", rows, signature_text())
    if excluded_ids is None:
        return records
    return records.unionByName(digest("excluded", excluded_ids.select("asset_id").distinct(), F.col("asset_id")))
