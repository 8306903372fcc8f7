"""Explicit schemas of the stored tables; nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import types as T

FINGERPRINT_SCHEMA_VERSION = 1

# The enumerations of the data model.
ASSET_KINDS = ("photo", "video", "unknown")
ASSET_SOURCES = ("userLibrary", "cloudShared", "iTunesSynced", "unknown")
RESOURCE_KINDS = (
    "photo",
    "video",
    "audio",
    "pairedVideo",
    "fullSizePhoto",
    "fullSizeVideo",
    "adjustmentData",
    "adjustmentBasePhoto",
    "adjustmentBaseVideo",
    "adjustmentBasePairedVideo",
    "alternatePhoto",
    "fullSizePairedVideo",
    "photoProxy",
    "unknown",
)
VIDEO_RESOURCE_KINDS = (
    "video",
    "fullSizeVideo",
    "pairedVideo",
    "fullSizePairedVideo",
    "adjustmentBaseVideo",
    "adjustmentBasePairedVideo",
)
PROCESSING_STATES = ("metadataIndexed", "unavailable", "failed")
BIN_KINDS = ("photo", "video", "unknown")
CATEGORIES = (
    "screenshots",
    "videos",
    "duplicatePhotos",
    "duplicateVideos",
    "similarPhotos",
    "largeVideos",
    "bin",
)

LOCATION = T.StructType(
    [T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())]
)

RESOURCE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("uti", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("file_size", T.LongType()),
    ]
)

ASSET_INDEX = T.StructType(
    [
        T.StructField("asset_id", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("creation_date", T.TimestampType()),
        T.StructField("modification_date", T.TimestampType()),
        T.StructField("pixel_width", T.IntegerType(), False),
        T.StructField("pixel_height", T.IntegerType(), False),
        T.StructField("duration", T.DoubleType(), False),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("source", T.StringType(), False),
        T.StructField("is_favorite", T.BooleanType(), False),
        T.StructField("is_hidden", T.BooleanType(), False),
        T.StructField("is_screenshot", T.BooleanType(), False),
        T.StructField("resource_types", T.ArrayType(T.StringType()), False),
        T.StructField("uniform_type_identifiers", T.ArrayType(T.StringType()), False),
        T.StructField("original_filenames", T.ArrayType(T.StringType()), False),
        T.StructField("indexed_at", T.TimestampType(), False),
        T.StructField("processing_state", T.StringType(), False),
        T.StructField("file_size", T.LongType()),
    ]
)

SIGNATURE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("modification_date", T.TimestampType()),
        T.StructField("creation_date", T.TimestampType()),
        T.StructField("pixel_width", T.IntegerType()),
        T.StructField("pixel_height", T.IntegerType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("uniform_type_identifiers", T.ArrayType(T.StringType())),
        T.StructField("original_filenames", T.ArrayType(T.StringType())),
    ]
)

PHOTO_FINGERPRINTS = T.StructType(
    [
        T.StructField("asset_id", T.StringType(), False),
        T.StructField("signature", SIGNATURE),
        T.StructField("status", T.StringType()),
        T.StructField("dhash", T.LongType()),
        T.StructField("feature_vector", T.ArrayType(T.DoubleType())),
        T.StructField("analyzed_at", T.TimestampType()),
        T.StructField("schema_version", T.IntegerType()),
    ]
)

VIDEO_FINGERPRINTS = T.StructType(
    [
        T.StructField("asset_id", T.StringType(), False),
        T.StructField("signature", SIGNATURE),
        T.StructField("status", T.StringType()),
        T.StructField("frames", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("analyzed_at", T.TimestampType()),
        T.StructField("schema_version", T.IntegerType()),
    ]
)

BIN = T.StructType(
    [
        T.StructField("asset_id", T.StringType(), False),
        T.StructField("kind", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("deleted_at", T.TimestampType()),
        T.StructField("thumbnail", T.BinaryType()),
    ]
)

CHANGES = T.StructType(
    [
        T.StructField("asset_id", T.StringType(), False),
        T.StructField("op", T.StringType()),
        T.StructField("change_ts", T.TimestampType()),
        T.StructField("sequence", T.LongType()),
    ]
)

# The layout the built-in image source decodes to.
IMAGE = T.StructType(
    [
        T.StructField("origin", T.StringType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("nChannels", T.IntegerType()),
        T.StructField("mode", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
    ]
)
