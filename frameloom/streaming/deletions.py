"""The bin fed by a stream of deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from frameloom.config import BIN, BinRules
from frameloom.streaming.state import ENTRY_EVENTS, FirstDeletion, append_available, bin_events


def fill_bin(
    stream: DataFrame, path: str, checkpoint: str, existing: DataFrame | None = None, rules: BinRules = BIN, lateness: str = "1 day"
) -> StreamingQuery:
    """Append to ``path`` an event for every entry of the bin: when it comes in, and when it leaves by age.

    Insert-if-absent: the first deletion of an asset wins, within a micro-batch by time and ``sequence``, and across batches as its state
    says; later ones are dropped while it is in the bin. A timer of its own ends an entry when less than a whole day of its
    retention is left by the stream's time; after that the asset has no state, and a deletion is a new entry.
    Deletions without a time are dropped. ``existing``: entries that are in the bin already when the stream starts.
    """
    micros = F.unix_micros("deleted_at").alias("deleted_us")
    timed = stream.filter("deleted_at IS NOT NULL").withWatermark("deleted_at", lateness)
    sequence = F.col("sequence") if "sequence" in stream.columns else F.lit(0).cast("long")
    rows = timed.select("asset_id", "kind", "file_size", "deleted_at", micros, sequence.alias("sequence"))
    known = None
    if existing is not None:
        known = existing.filter("deleted_at IS NOT NULL").select("asset_id", "kind", "file_size", micros)
    events = bin_events(rows, FirstDeletion(rules.retention_days - 1), known)
    return append_available(events, path, checkpoint)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRY_EVENTS).parquet(path)


def bin_entries(events: DataFrame) -> DataFrame:
    """The entries that came in, as rows of the bin; those that have left are among them, ``B.active`` knows them by age."""
    return events.filter("event = 'entered'").select("asset_id", "kind", "file_size", "deleted_at")


def first_deletions(stream: DataFrame, retention: str = "30 days") -> DataFrame:
    """Stateful form with bounded state: one deletion per asset within the retention, in arrival order.
    State of an asset is dropped when the watermark passes its retention."""
    return stream.withWatermark("deleted_at", retention).dropDuplicatesWithinWatermark(["asset_id"])


def expired_entries(stream: DataFrame, rules: BinRules = BIN, lateness_days: int = 1, step: str = "1 hour") -> DataFrame:
    """(asset_id, deleted_at, leaves_at) of every entry once the stream's time says that it has left the bin by age.

    An entry leaves when less than a whole day of its retention is left. The watermark runs on that moment, so it waits
    for the retention and the lateness after a deletion; until then later deletions of the asset are dropped, and after
    that an asset has no state. Entries are told in steps of ``step``.
    """
    stay = rules.retention_days - 1
    leaving = stream.select("asset_id", "deleted_at", (F.col("deleted_at") + F.expr(f"INTERVAL {stay} DAYS")).alias("leaves_at"))
    first = leaving.withWatermark("leaves_at", f"{stay + lateness_days} days").dropDuplicatesWithinWatermark(["asset_id"])
    told = first.groupBy("asset_id", F.window("leaves_at", step)).agg(F.min("deleted_at").alias("deleted_at"), F.min("leaves_at").alias("leaves_at"))
    return told.select("asset_id", "deleted_at", "leaves_at")
