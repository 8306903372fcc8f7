"""Index and fingerprint tables as Parquet below a path that the caller owns; a full replace is Spark's own overwrite."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameloom.schemas import ASSET_INDEX, FINGERPRINT_SCHEMA_VERSION


def write_table(rows: DataFrame, path: str, schema: T.StructType, *partition_by: str) -> None:
    """Replace the whole table. ``rows`` must not read from ``path``: write what comes from it elsewhere first."""
    rows.select(*schema.fieldNames()).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_index(rows: DataFrame, path: str) -> None:
    """The asset index, laid out by kind so that every analysis prunes to its partition."""
    write_table(rows, path, ASSET_INDEX, "kind")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, ASSET_INDEX)


def write_bucketed(rows: DataFrame, path: str, buckets: int = 64, name: str | None = None) -> DataFrame:
    """``rows`` stored in sorted buckets of asset_id, read again: joins of such tables on asset_id move no rows.

    Buckets are known to the catalog, so the table has a name in it; a later session reads it after ``CREATE TABLE`` with the same
    buckets and location. One number of buckets for all tables, about a gigabyte each at most.
    """
    name = name or f"stored_{uuid.uuid4().hex}"
    rows.repartition(buckets, "asset_id").write.bucketBy(buckets, "asset_id").sortBy("asset_id").option("path", path).saveAsTable(name)
    return rows.sparkSession.table(name)


def load_index(table: DataFrame) -> DataFrame:
    """Newest index first, then by asset_id; the location exists only with both coordinates."""
    located = F.when(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull(),
        F.struct("latitude", "longitude"),
    )
    return table.withColumn("location", located).drop("latitude", "longitude").orderBy(F.desc("indexed_at"), "asset_id")


def current_fingerprints(stored: DataFrame) -> DataFrame:
    """Rows of another schema version count as absent."""
    return stored.filter(F.col("schema_version") == FINGERPRINT_SCHEMA_VERSION)
