"""Keyed state of streams: what is known of an asset is in the state store, a micro-batch touches only its own assets.

The state store is RocksDB's, so state may be larger than memory; checkpoints of it lie with the query's checkpoint.

Assets have few rows each, so processors take plain rows: a pandas frame for each asset would cost more than all else. Times are microseconds
in them, and become timestamps once the rows have left.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

DAY_MS = 86_400_000
# Stands for a missing time: before all others.
NO_TIME = -(1 << 62)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which keyed state with timers needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def append_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to the files of ``path`` and stop; each row is written once, also after a failure, and the checkpoint
    makes the next run continue."""
    with rocksdb(stream.sparkSession):
        return (
            stream.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )


def _timed(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` in the layout of ``schema``, with every time from its microseconds."""
    fields = (field.split() for field in schema.split(", "))
    return rows.select(*(F.timestamp_micros(f"{name}_us").alias(name) if kind == "timestamp" else F.col(name) for name, kind in fields))


def _last_if_null(x) -> tuple:
    return x is None, 0 if x is None else x


# --- the bin --------------------------------------------------------------------------------------

ENTRY_EVENTS = "asset_id string, kind string, file_size bigint, deleted_at timestamp, event string, event_at timestamp"
_ENTRY_ROWS = "asset_id string, kind string, file_size bigint, deleted_at_us bigint, event string, event_at_us bigint"
_Entry = Row("asset_id", "kind", "file_size", "deleted_at_us", "event", "event_at_us")
_FIRST = "kind string, file_size bigint, deleted_us bigint"


class FirstDeletion(StatefulProcessor):
    """The first deletion of an asset enters the bin; later ones are dropped until it has left by age."""

    def __init__(self, stay_days: int) -> None:
        self.stay_ms = stay_days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", _FIRST)

    def _leaves_ms(self, at: int) -> int:
        return at // 1000 + self.stay_ms

    def _keep(self, row: Row) -> None:
        self.first.update((row.kind, row.file_size, row.deleted_us))
        self.handle.registerTimer(self._leaves_ms(row.deleted_us))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        # called for every entry of the asset; the earliest counts
        known = self.first.get()
        if known is not None:
            if known[2] <= initialState.deleted_us:
                return
            self.handle.deleteTimer(self._leaves_ms(known[2]))
        self._keep(initialState)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # drained before anything else: state and rows come over one connection
        row = min(rows, key=lambda r: (r.deleted_us, _last_if_null(r.sequence)))
        if not self.first.exists():
            self._keep(row)
            yield _Entry(key[0], row.kind, row.file_size, row.deleted_us, "entered", row.deleted_us)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kind, size, at = self.first.get()
        self.first.clear()
        yield _Entry(key[0], kind, size, at, "left", at + self.stay_ms * 1000)

    def close(self) -> None:
        pass


def bin_events(rows: DataFrame, processor: FirstDeletion, known: DataFrame | None) -> DataFrame:
    """ENTRY_EVENTS of a stream of (asset_id, kind, file_size, deleted_us, sequence, time of the watermark)."""
    known = None if known is None else known.groupBy("asset_id")
    events = rows.groupBy("asset_id").transformWithState(processor, _ENTRY_ROWS, "Append", "EventTime", known)
    return _timed(events, ENTRY_EVENTS)


# --- the change feed ------------------------------------------------------------------------------

CHANGE_EVENTS = "asset_id string, op string, change_ts timestamp, sequence bigint"


_CHANGE_ROWS = "asset_id string, op string, change_ts_us bigint, sequence bigint"
_Change = Row("asset_id", "op", "change_ts_us", "sequence")


class LastChange(StatefulProcessor):
    """The last change of an asset, deletions included; what is earlier than it or than the index row is late and dropped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "change_us bigint, sequence bigint")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        at, known = initialState.modified_us, self.last.get()
        if at is not None and (known is None or known[0] < at):
            # a change of the very time of the index row is not late
            self.last.update((at, -(1 << 63)))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        row = max(rows, key=lambda r: (r.change_us, r.sequence, r.op is None, r.op or ""))
        change, known = (row.change_us, row.sequence), self.last.get()
        if known is None or change > tuple(known):
            self.last.update(change)
            yield _Change(key[0], row.op, None if row.change_us == NO_TIME else row.change_us, row.sequence)

    def close(self) -> None:
        pass


def last_changes(rows: DataFrame, known: DataFrame) -> DataFrame:
    """CHANGE_EVENTS of a stream of (asset_id, op, change_us, sequence)."""
    return _timed(rows.groupBy("asset_id").transformWithState(LastChange(), _CHANGE_ROWS, "Append", "None", known.groupBy("asset_id")), CHANGE_EVENTS)


# --- fingerprints ---------------------------------------------------------------------------------

PRINT_EVENTS = "asset_id string, signature_key string, dhash bigint, feature_vector array<double>"
_Print = Row("asset_id", "signature_key", "dhash", "feature_vector")


class NewImage(StatefulProcessor):
    """The fingerprint of an image whose asset is in the index and has none of its present signature."""

    def __init__(self, featurizer) -> None:
        self.featurizer = featurizer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "signature_key string, printed_key string")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        # called for every row of the asset; the first counts
        if not self.known.exists():
            self.known.update((initialState.signature_key, initialState.printed_key))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = list(rows)
        known = self.known.get()
        if known is None or known[0] is None or known[1] == known[0]:
            return
        current = known[0]
        for row in rows:
            pixels = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels).astype(np.float64)
            found = self.featurizer(pixels)
            if found is not None:
                self.known.update((current, current))
                yield _Print(key[0], current, int(found[0]), [float(x) for x in found[1]])
                return

    def close(self) -> None:
        pass
