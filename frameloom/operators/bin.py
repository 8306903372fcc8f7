"""The ledger of deleted assets. ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.config import BIN, BinRules
from frameloom.functions import media
from frameloom.operators.index import without_ids


def entries_from_assets(assets: DataFrame, now: Column) -> DataFrame:
    """Ledger rows of assets about to be deleted."""
    return assets.select(
        "asset_id",
        media.bin_kind(F.col("kind")).alias("kind"),
        F.coalesce("file_size", F.lit(0)).cast("long").alias("file_size"),
        now.alias("deleted_at"),
    )


def first_per_asset(entries: DataFrame, order: list[str]) -> DataFrame:
    """Keep the first entry of each asset. An aggregate, so repeats of one asset merge before the shuffle."""
    values = [c for c in entries.columns if c != "asset_id"]
    first = F.min_by(F.struct(*values), F.struct(*order))
    return entries.groupBy("asset_id").agg(first.alias("_first")).select("asset_id", "_first.*")


def new_entries(bin_rows: DataFrame, entries: DataFrame, order: list[str]) -> DataFrame:
    """Insert-if-absent: what has to be appended. Expired rows not yet purged still block."""
    return without_ids(first_per_asset(entries, order), bin_rows)


def add(bin_rows: DataFrame, entries: DataFrame, order: list[str]) -> DataFrame:
    fresh = new_entries(bin_rows, entries, order)
    return bin_rows.unionByName(fresh, allowMissingColumns=True)


def remove(bin_rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Restore, or roll back a cancelled deletion."""
    return without_ids(bin_rows, ids)


def purge(bin_rows: DataFrame, now: Column, rules: BinRules = BIN) -> DataFrame:
    return bin_rows.filter(~media.is_expired(F.col("deleted_at"), now, rules))


def active(bin_rows: DataFrame, now: Column, rules: BinRules = BIN) -> DataFrame:
    """Rows not yet expired, newest deletion first, with the urgency flag."""
    left = media.days_remaining(F.col("deleted_at"), now, rules)
    return (
        bin_rows.withColumn("days_remaining", left)
        .filter(F.col("days_remaining") >= 1)
        .withColumn("is_urgent", F.col("days_remaining") <= rules.urgent_days)
        .orderBy(F.desc("deleted_at"), "asset_id")
    )


def totals(bin_rows: DataFrame, now: Column, rules: BinRules = BIN) -> DataFrame:
    return purge(bin_rows, now, rules).agg(
        F.count("*").alias("active_items"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("active_bytes"),
    )
