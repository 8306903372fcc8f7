"""Change-detection signature of an asset and the order-independent digest of a record set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signature() -> Column:
    """The ten fields whose change makes stored fingerprints stale."""
    return F.struct(
        F.col("asset_id").alias("id"),
        F.col("kind"),
        F.col("modification_date"),
        F.col("creation_date"),
        F.col("pixel_width"),
        F.col("pixel_height"),
        F.col("duration"),
        F.col("file_size"),
        F.array_sort("uniform_type_identifiers").alias("uniform_type_identifiers"),
        F.array_sort("original_filenames").alias("original_filenames"),
    )


def signature_text() -> Column:
    """The same fields as one line; NULL dates and sizes read -1."""
    missing = F.lit("-1")

    def micros(name: str) -> Column:
        return F.coalesce(F.unix_micros(F.col(name).cast("timestamp")).cast("string"), missing)

    return F.concat_ws(
        "|",
        F.col("asset_id"),
        F.col("kind"),
        micros("modification_date"),
        micros("creation_date"),
        F.col("pixel_width").cast("string"),
        F.col("pixel_height").cast("string"),
        F.col("duration").cast("decimal(18,6)").cast("string"),
        F.coalesce(F.col("file_size").cast("string"), missing),
        F.concat_ws(",", F.array_sort("uniform_type_identifiers")),
        F.concat_ws(",", F.array_sort("original_filenames")),
    )


def row_digest(text: Column) -> Column:
    """32 bits of MD5 as a decimal wide enough for any row count to be summed."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("decimal(20,0)")
