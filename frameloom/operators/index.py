"""The asset index: build, summarise, filter, delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions import enums


def explode_resources(library: DataFrame) -> DataFrame:
    """One child row per resource, id ``asset#index``; assets without resources keep one empty row."""
    return library.select("asset_id", F.posexplode_outer("resources").alias("idx", "resource")).select(
        "asset_id",
        "idx",
        F.when(F.col("idx").isNotNull(), F.concat_ws("#", "asset_id", F.col("idx"))).alias("resource_id"),
        F.col("resource.kind").alias("kind"),
        F.col("resource.uti").alias("uti"),
        F.col("resource.filename").alias("filename"),
        F.col("resource.file_size").alias("file_size"),
    )


def _distinct_sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull())))


def index_records(library: DataFrame, indexed_at: Column) -> DataFrame:
    """Fold the nested resources into the index columns; row-local, no shuffle."""
    resources = F.coalesce(F.col("resources"), F.array().cast(library.schema["resources"].dataType))
    folded = {
        "resource_types": _distinct_sorted(
            F.transform(resources, lambda r: enums.resource_kind(r["kind"]))
        ),
        "uniform_type_identifiers": _distinct_sorted(F.transform(resources, lambda r: r["uti"])),
        "original_filenames": _distinct_sorted(F.transform(resources, lambda r: r["filename"])),
        "file_size": F.array_max(F.transform(resources, lambda r: r["file_size"])),
        "indexed_at": indexed_at,
        "processing_state": F.lit("metadataIndexed"),
    }
    return library.withColumns(folded).drop("resources")


def photos(index: DataFrame) -> DataFrame:
    return index.filter(F.col("kind") == "photo")


def videos(index: DataFrame) -> DataFrame:
    return index.filter(F.col("kind") == "video")


def screenshots(index: DataFrame) -> DataFrame:
    return index.filter("is_screenshot")


def newest_first(index: DataFrame) -> DataFrame:
    return index.orderBy(F.desc_nulls_last("creation_date"), "asset_id")


def without_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose asset is not in ``ids``: removal from index, bin and candidate sets alike."""
    return rows.join(ids.select("asset_id"), "asset_id", "left_anti")


def with_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("asset_id"), "asset_id", "left_semi")


def existing_ids(ids: DataFrame, index: DataFrame) -> DataFrame:
    """The subset of ``ids`` still in the library."""
    return with_ids(ids.select("asset_id").distinct(), index)


def summary(index: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Five counters over the index in one pass; ``failures`` has one row per asset that failed to index."""
    counts = index.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("kind") == "photo").alias("photos"),
        F.count_if(F.col("kind") == "video").alias("videos"),
        F.count_if(F.col("is_screenshot")).alias("screenshots"),
        F.lit(0).cast("long").alias("failures"),
    )
    if failures is None:
        return counts
    zero = F.lit(0).cast("long")
    failed = failures.agg(F.count("*").alias("failures")).select(
        *[zero.alias(c) for c in counts.columns if c != "failures"], "failures"
    )
    return counts.unionByName(failed).agg(*[F.sum(c).alias(c) for c in counts.columns])


def latest_index(index: DataFrame) -> DataFrame:
    return index.agg(F.max("indexed_at").alias("latest_indexed_at"))
