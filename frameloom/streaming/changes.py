"""Incremental index maintenance from an add / modify / delete feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from frameloom.streaming.state import CHANGE_EVENTS, NO_TIME, append_available, last_changes


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last change of each asset; a merging aggregate, so a busy asset is no hot task.

    Changes of one time are in order of ``sequence``, the number the feed gives them.
    """
    last = F.max(F.struct("change_ts", "sequence", "op"))
    return changes.groupBy("asset_id").agg(last.alias("_last")).select("asset_id", "_last.op", "_last.change_ts", "_last.sequence")


def apply_changes(index: DataFrame, changes: DataFrame) -> DataFrame:
    """The index after the feed: deletes drop rows, the others touch or create them.

    Late changes lose, deletes included: against later changes of the feed, and
    against an index row that was modified later.
    """
    last = latest_changes(changes)
    if "modification_date" in index.columns:
        known = index.select("asset_id", F.col("modification_date").alias("_stored"))
        late = F.coalesce(F.col("change_ts") < F.col("_stored"), F.lit(False))
        last = last.join(known, "asset_id", "left").filter(~late).drop("_stored")
    merged = index.join(last, "asset_id", "full_outer").filter(F.coalesce(F.col("op") != "delete", F.lit(True)))
    filled = {
        "modification_date": F.coalesce("change_ts", "modification_date"),
        "kind": F.coalesce("kind", F.lit("unknown")),
        "processing_state": F.coalesce("processing_state", F.lit("unavailable")),
    }
    present = {k: v for k, v in filled.items() if k in index.columns}
    return merged.withColumns(present).select(*index.columns)


def tombstones(changes: DataFrame) -> DataFrame:
    """The last change of every asset that is deleted by it."""
    return latest_changes(changes).filter("op = 'delete'")


def maintain_index(stream: DataFrame, index: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to ``path`` every change that is the last of its asset when it comes.

    The last change of every asset, deletions included, is in the state store, which starts with the dates of ``index``: late changes
    lose without a look at index or feed. ``apply_changes(index, read_changes(spark, path))`` is the current index.
    """
    # a change without a time is earlier than all others
    micros = F.coalesce(F.unix_micros("change_ts"), F.lit(NO_TIME))
    rows = stream.select("asset_id", "op", micros.alias("change_us"), F.coalesce("sequence", F.lit(0)).alias("sequence"))
    known = index.select("asset_id", F.unix_micros("modification_date").alias("modified_us"))
    return append_available(last_changes(rows, known), path, checkpoint)


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHANGE_EVENTS).parquet(path)
