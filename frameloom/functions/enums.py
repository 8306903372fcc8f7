"""Platform codes and stored strings to the model's enumerations, each with its fallback."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom import schemas

# Public media-type codes and source bit flags of the photo library platform.
MEDIA_TYPE_IMAGE, MEDIA_TYPE_VIDEO = 1, 2
SOURCE_USER_LIBRARY, SOURCE_CLOUD_SHARED, SOURCE_ITUNES_SYNCED = 1, 2, 4


def kind_from_code(code: Column) -> Column:
    return (
        F.when(code == MEDIA_TYPE_IMAGE, F.lit("photo"))
        .when(code == MEDIA_TYPE_VIDEO, F.lit("video"))
        .otherwise(F.lit("unknown"))
    )


def source_from_flags(flags: Column) -> Column:
    """Several flags may be set: own library wins over shared, shared over synced."""

    def has(bit: int) -> Column:
        return flags.bitwiseAND(F.lit(bit)) != 0

    return (
        F.when(has(SOURCE_USER_LIBRARY), F.lit("userLibrary"))
        .when(has(SOURCE_CLOUD_SHARED), F.lit("cloudShared"))
        .when(has(SOURCE_ITUNES_SYNCED), F.lit("iTunesSynced"))
        .otherwise(F.lit("unknown"))
    )


def _decode(raw: Column, allowed: tuple[str, ...], fallback: str) -> Column:
    return F.when(raw.isin(*allowed), raw).otherwise(F.lit(fallback))


def asset_kind(raw: Column) -> Column:
    return _decode(raw, schemas.ASSET_KINDS, "unknown")


def asset_source(raw: Column) -> Column:
    return _decode(raw, schemas.ASSET_SOURCES, "unknown")


def resource_kind(raw: Column) -> Column:
    return _decode(raw, schemas.RESOURCE_KINDS, "unknown")


def processing_state(raw: Column) -> Column:
    return _decode(raw, schemas.PROCESSING_STATES, "failed")


def bin_kind(raw: Column) -> Column:
    return _decode(raw, schemas.BIN_KINDS, "unknown")
