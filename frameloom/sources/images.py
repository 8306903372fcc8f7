"""Scan of image folders with the built-in readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images below ``path``; files that do not decode are dropped."""
    return (
        spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(path)
    )


def read_file_facts(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and modification time; the content column is pruned, so no file is opened."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length", "modificationTime")
    )


def scan_assets(images: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """One asset row per decoded image, newest first. ``facts`` adds size and time by path."""
    origin = F.col("image.origin")
    rows = images.select(
        F.regexp_extract(origin, r"([^/]+?)(?:\.[^./]*)?$", 1).alias("asset_id"),
        F.regexp_replace(origin, r"^file:/+", "/").alias("path"),
        F.lit("photo").alias("kind"),
        F.col("image.width").alias("pixel_width"),
        F.col("image.height").alias("pixel_height"),
        F.lit(0.0).alias("duration"),
        F.lit("userLibrary").alias("source"),
    )
    if facts is None:
        return rows.orderBy("asset_id")
    by_path = facts.select(
        F.regexp_replace("path", r"^file:/+", "/").alias("path"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("creation_date"),
    )
    return rows.join(by_path, "path", "left").orderBy(F.desc_nulls_last("creation_date"), "asset_id")
