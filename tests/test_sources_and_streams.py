"""Versioned tables, image scan and featurizer, streams."""

import datetime
import os
import pathlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from frameloom import session
from frameloom.operators import bin as B
from frameloom.operators import fingerprints as FP
from frameloom.sources import scan
from frameloom.sources.images import read_file_facts, read_images, scan_assets
from frameloom.schemas import PHOTO_FINGERPRINTS, VIDEO_FINGERPRINTS
from frameloom.sources.store import load_index, read_index, read_table, write_bucketed, write_index, write_table
from frameloom.streaming import changes, deletions, state
from frameloom.streaming import fingerprints as stream_fp
from tests.test_decisions import INDEX, moment, now, record


def png(path, pixels):
    """Grey PNG without filters."""
    height, width = pixels.shape

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture
def pictures(tmp_path):
    folder = tmp_path / "pictures"
    folder.mkdir()
    ramp = np.tile(np.arange(36) * 7, (32, 1))
    png(folder / "ramp.png", ramp)
    png(folder / "ramp_small.png", ramp[:16, ::2])
    png(folder / "back.png", ramp[:, ::-1])
    png(folder / "flat.png", np.full((16, 16), 80))
    (folder / "broken.png").write_bytes(b"not a picture")
    return str(folder)


def test_scan_lists_decodable_pictures(spark, pictures):
    rows = scan_assets(read_images(spark, pictures), read_file_facts(spark, pictures)).collect()
    assert {r.asset_id: (r.pixel_width, r.pixel_height) for r in rows} == {
        "ramp": (36, 32), "ramp_small": (18, 16), "back": (36, 32), "flat": (16, 16),
    }
    assert all(r.file_size > 0 and r.creation_date is not None for r in rows)


def test_headers_give_the_size():
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF" + bytes(10) + b"\xff\xff\xc2" + struct.pack(">HBHH", 11, 8, 480, 640) + bytes(20)
    cases = {
        jpeg: (640, 480),
        b"GIF89a" + struct.pack("<HH", 7, 9) + bytes(20): (7, 9),
        b"BM" + bytes(16) + struct.pack("<ii", 31, -17) + bytes(9): (31, 17),
        b"\xff\xd8\xff\xda" + struct.pack(">H", 4) + bytes(30): None,
        b"\xff\xd8": None,
        b"not a picture": None,
        b"": None,
    }
    for data, size in cases.items():
        assert scan.picture_size(lambda at, n: data[at : at + n]) == size


def test_no_task_lists_a_whole_folder(pictures, monkeypatch):
    def whole(*args, **kwargs):
        raise AssertionError("a folder was listed as a whole")

    pathlib.Path(pictures, "below").mkdir()
    png(pathlib.Path(pictures, "below", "deep.png"), np.full((16, 16), 80))
    monkeypatch.setattr(scan.fs, "FileSelector", whole)
    monkeypatch.setattr(scan, "BATCH_FILES", 2)
    reader = scan._Reader({"path": pictures, "tasks": "4"})
    parts = reader.partitions()
    assert sum(p.folder == pictures for p in parts) == 3
    found = [name for p in parts for batch in reader.read(p) for name in batch.column("asset_id").to_pylist()]
    assert sorted(found) == ["back", "deep", "flat", "ramp", "ramp_small"]


def test_scan_opens_what_is_new_enough_newest_first(spark, pictures):
    deeper = f"{pictures}/more/and more"
    os.makedirs(deeper)
    for i in range(5):
        png(pathlib.Path(deeper, f"p{i}.png"), np.zeros((4 + i, 9)))
    for i, name in enumerate(["ramp.png", "ramp_small.png", "back.png", "flat.png", "more/and more/p3.png"]):
        os.utime(f"{pictures}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
    rows = scan.scan_folder(spark, pictures).collect()
    assert len(rows) == 9 and [r.asset_id for r in rows[-5:]] == ["p3", "flat", "back", "ramp_small", "ramp"]
    assert [(r.path, r.pixel_width, r.pixel_height) for r in rows if r.asset_id == "p3"] == [("/more/and more/p3.png", 9, 7)]
    assert all(r.file_size == os.path.getsize(pictures + r.path) for r in rows)
    since = datetime.datetime.fromtimestamp(1_700_000_002, datetime.timezone.utc)
    newer = scan.scan_folder(spark, f"file://{pictures}", since)
    assert {r.asset_id for r in newer.collect()} == {r.asset_id for r in rows} - {"ramp", "ramp_small"}
    # the reader was told: it would fail on a file that it need not open
    reader = scan._Reader({"path": pictures})
    list(reader.pushFilters([scan.GreaterThanOrEqual(("modified",), since)]))
    found = [name for part in reader.partitions() for batch in reader.read(part) for name in batch.column("asset_id").to_pylist()]
    assert sorted(found) == sorted({r.asset_id for r in rows} - {"ramp", "ramp_small"})
    reader.tasks = 1
    assert sorted(n for part in reader.partitions() for b in reader.read(part) for n in b.column("asset_id").to_pylist()) == sorted(found)


def test_stored_tables_are_joined_where_they_lie(spark, tmp_path):
    index = spark.createDataFrame([record(x) for x in "abcd"], INDEX)
    new = index.filter("asset_id <> 'c'").select("asset_id", F.lit(1).cast("long").alias("dhash"), F.array(F.lit(1.0)).alias("feature_vector"))
    prints = FP.fingerprint_rows(new, index, now())
    one, other = write_bucketed(index, str(tmp_path / "i"), 4), write_bucketed(prints, str(tmp_path / "p"), 4)
    missing = FP.needs_analysis(one, other, "similar")
    assert [r.asset_id for r in missing.collect()] == ["c"]
    with_hints = FP.needs_analysis(one.hint("merge"), other, "similar")
    plan = with_hints._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_default_featurizer(spark, pictures):
    rows = {r.asset_id: r for r in FP.featurize(read_images(spark, pictures)).collect()}
    assert set(rows) == {"ramp", "ramp_small", "back"}  # a flat picture has no direction
    assert rows["ramp"].dhash == rows["ramp_small"].dhash == -1 and rows["back"].dhash == 0
    assert np.dot(rows["ramp"].feature_vector, rows["ramp_small"].feature_vector) > 0.999


def test_own_featurizer_and_colour(spark, pictures):
    rows = FP.featurize(read_images(spark, pictures), lambda px: (int(px.shape[0]), np.ones(2)) if px.shape[0] == 32 else None)
    assert {(r.asset_id, r.dhash) for r in rows.collect()} == {("ramp", 32), ("back", 32)}
    red = np.zeros((8, 9, 3))
    red[:, 4:, 2] = 255
    assert FP.grid_featurizer(red)[0] == int.from_bytes(bytes([0b00010000] * 8), "big")


def test_index_is_replaced_and_read_back(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([record("a"), record("v", kind="video")], INDEX).withColumns(
        {
            "latitude": F.when(F.col("asset_id") == "a", F.lit(1.5)),
            "longitude": F.when(F.col("asset_id") == "a", F.lit(2.5)),
            "source": F.lit("userLibrary"),
            "is_favorite": F.lit(False),
            "is_hidden": F.lit(False),
            "resource_types": F.array(F.lit("photo")),
            "indexed_at": now(),
            "processing_state": F.lit("metadataIndexed"),
        }
    )
    write_index(rows, path)
    assert read_index(spark, path).count() == 2
    write_index(rows.filter("asset_id = 'a'"), path)
    loaded = load_index(read_index(spark, path)).collect()
    assert [(r.asset_id, tuple(r.location)) for r in loaded] == [("a", (1.5, 2.5))]
    plan = read_index(spark, path).filter("kind = 'photo'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan


def test_fingerprints_are_stored_and_pruned(spark, tmp_path):
    nothing = spark.createDataFrame([], VIDEO_FINGERPRINTS)
    index = spark.createDataFrame([record("v", kind="video"), record("w", kind="video")], INDEX)
    four = F.array_repeat(F.array(F.lit(1.0)), 4)
    new = FP.fingerprint_rows(index.select("asset_id", F.lit(0).cast("long").alias("dhash"), F.array(F.lit(1.0)).alias("feature_vector")), index, now())
    new = new.drop("dhash", "feature_vector").withColumn("frames", F.when(F.col("asset_id") == "v", four).otherwise(F.slice(four, 1, 3)))
    path = str(tmp_path / "v")
    write_table(FP.upsert_videos(nothing, new), path, VIDEO_FINGERPRINTS)
    stored = read_table(spark, path, VIDEO_FINGERPRINTS)
    assert [r.asset_id for r in stored.collect()] == ["v"]
    assert {r.asset_id for r in FP.needs_analysis(index, stored, "video").collect()} == {"w"}
    assert FP.prune(stored, index.filter("asset_id = 'w'")).count() == 0


def feed(spark, folder, batches, schema):
    """One file per batch, read one file at a time."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/part{i}")
    return (
        spark.readStream.schema(schema)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", 1)
        .parquet(folder)
    )


CHANGES = "asset_id string, op string, change_ts timestamp, sequence long"


def in_steps(spark, folder, batches, schema, start):
    """Runs a query over each batch of rows as it arrives, several files a batch; what a run keeps is in its checkpoint alone."""
    for rows in batches:
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(folder)
        start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(folder)).awaitTermination()


def test_change_stream_equals_batch_and_late_changes_lose(spark, tmp_path):
    batches = [
        [("a", "modify", moment("2024-01-02"), 1), ("b", "delete", moment("2024-01-05"), 2), ("new", "add", moment("2024-01-03"), 3)],
        [("b", "modify", moment("2024-01-04"), 4), ("a", "modify", moment("2024-01-01"), 5), ("c", "delete", moment("2023-12-31"), 6), ("d", "modify", None, 7)],
        [("b", "add", moment("2024-01-06"), 8), ("b", "delete", moment("2024-01-06"), 9)],
    ]
    index = spark.createDataFrame([record(x) for x in "abcd"], INDEX)
    path = str(tmp_path / "log")
    in_steps(spark, str(tmp_path / "in"), batches, CHANGES, lambda s: changes.maintain_index(s, index, path, str(tmp_path / "cp")))
    feed_rows = changes.read_changes(spark, path)
    got = {r.asset_id: r.modification_date for r in changes.apply_changes(index, feed_rows).collect()}
    everything = spark.createDataFrame([r for b in batches for r in b], CHANGES)
    want = {r.asset_id: r.modification_date for r in changes.apply_changes(index, everything).collect()}
    assert got == want == {"a": moment("2024-01-02"), "c": moment("2024-01-01"), "d": moment("2024-01-01"), "new": moment("2024-01-03")}
    # what was late when it came was not written, also behind a deletion
    assert {(r.asset_id, r.sequence) for r in feed_rows.collect()} >= {("a", 1), ("b", 2), ("new", 3), ("b", 9)}
    assert not {4, 5, 6, 7} & {r.sequence for r in feed_rows.collect()}


def test_changes_of_one_time_are_in_sequence(spark):
    schema = "asset_id string, op string, change_ts timestamp, sequence long"
    at = moment("2024-03-01")
    rows = [("a", "modify", at, 1), ("a", "delete", at, 2), ("b", "delete", at, 3), ("b", "add", at, 4)]
    index = spark.createDataFrame([record(x) for x in "ab"], INDEX)
    assert [r.asset_id for r in changes.apply_changes(index, spark.createDataFrame(rows, schema)).collect()] == ["b"]


ENTRIES = "asset_id string, kind string, file_size long, deleted_at timestamp, sequence long"


def test_bin_stream_first_deletion_wins_and_entries_leave_by_age(spark, tmp_path):
    batches = [
        [("a", "photo", 1, moment("2024-02-01"), 2), ("a", "photo", 2, moment("2024-01-31"), 1), ("n", "photo", 9, None, 3)],
        [("a", "photo", 3, moment("2024-02-05"), 4), ("b", "video", None, moment("2024-02-02"), 5), ("old", "photo", 8, moment("2024-02-03"), 6)],
        [("c", "photo", 6, moment("2024-03-02"), 7)],
        [("a", "photo", 7, moment("2024-03-10"), 8)],
    ]
    existing = spark.createDataFrame([("old", "photo", 5, moment("2024-01-20"), 0)], ENTRIES)
    path = str(tmp_path / "events")
    in_steps(spark, str(tmp_path / "in"), batches, ENTRIES, lambda s: deletions.fill_bin(s, path, str(tmp_path / "cp"), existing))
    events = deletions.read_events(spark, path)
    entered = sorted((r.asset_id, r.file_size, r.deleted_at) for r in deletions.bin_entries(events).collect())
    # the first deletion of a batch by time, the first batch of all; after a has left, a deletion is a new entry
    assert entered == [("a", 2, moment("2024-01-31")), ("a", 7, moment("2024-03-10")), ("b", None, moment("2024-02-02")), ("c", 6, moment("2024-03-02"))]
    left = {(r.asset_id, r.event_at) for r in events.filter("event = 'left'").collect()}
    # 29 days after the deletion less than a whole day is left; the watermark is a day behind
    assert {("old", moment("2024-02-18")), ("a", moment("2024-02-29"))} <= left
    assert not {a for a, _ in left} & {"c"}


def test_bin_stream_keeps_whole_sizes_and_the_earliest_known_entry(spark, tmp_path):
    large = (1 << 53) + 1  # no double
    rows = [("a", "photo", large, moment("2024-02-01"), 1), ("a", "photo", None, moment("2024-02-02"), 2), ("twice", "photo", 3, moment("2024-02-10"), 3)]
    known = [("twice", "photo", 1, moment("2024-02-05"), 0), ("twice", "photo", 2, moment("2024-01-05"), 0), ("twice", "photo", 4, moment("2024-02-07"), 0)]
    later = [("z", "photo", 5, moment("2024-02-20"), 4)]
    path = str(tmp_path / "events")
    existing = spark.createDataFrame(known, ENTRIES)
    in_steps(spark, str(tmp_path / "in"), [rows, later], ENTRIES, lambda s: deletions.fill_bin(s, path, str(tmp_path / "cp"), existing))
    events = deletions.read_events(spark, path)
    assert sorted((r.asset_id, r.file_size) for r in deletions.bin_entries(events).collect()) == [("a", large), ("z", 5)]
    # one timer of the earliest entry, 29 days after it
    left = [(r.asset_id, r.file_size, r.event_at) for r in events.filter("event = 'left'").collect()]
    assert left == [("twice", 2, moment("2024-02-03"))]


class Kept:
    """Stands for the state of one asset, and counts how often it is asked."""

    def __init__(self):
        self.value, self.asked = None, 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.get() is not None

    def get(self):
        self.asked += 1
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        self.timer = at


def _plain_rows(processor, rows, known=()):
    """What a processor gives for the plain rows of one asset, and its state: no frame is made for it."""
    kept = Kept()
    processor.init(kept)
    for row in known:
        processor.handleInitialState(("a",), row, None)
    kept.asked = 0
    found = list(processor.handleInputRows(("a",), iter(rows), None))
    assert all(isinstance(r, Row) for r in found) and kept.asked == 1
    return [tuple(r) for r in found], kept


def test_bin_takes_plain_rows():
    row = Row("kind", "file_size", "deleted_us", "sequence")
    found, kept = _plain_rows(state.FirstDeletion(29), [row("photo", 1, 5000, None), row("photo", 2, 5000, 7), row("photo", 3, 9000, 1)])
    assert found == [("a", "photo", 2, 5000, "entered", 5000)] and kept.timer == 5 + 29 * state.DAY_MS


def test_change_feed_takes_plain_rows():
    row, known = Row("op", "change_us", "sequence"), Row("modified_us")
    rows = [row("add", 7, 1), row("delete", 7, 2), row("modify", 6, 9)]
    dates = [known(3), known(None), known(8), known(5)]
    assert _plain_rows(state.LastChange(), rows, dates[:2])[0] == [("a", "delete", 7, 2)]
    # the latest of the dates counts
    assert _plain_rows(state.LastChange(), rows, dates)[0] == []
    assert _plain_rows(state.LastChange(), [row("add", state.NO_TIME, 1)])[0] == [("a", "add", None, 1)]


def test_new_images_take_plain_rows():
    row, known = Row("height", "width", "nChannels", "data"), Row("signature_key", "printed_key")
    rows = [row(1, 2, 1, bytes([0, 0])), row(1, 2, 1, bytes([3, 4]))]
    seen = lambda pixels: (int(pixels.sum()), pixels.ravel()) if pixels.any() else None
    found, kept = _plain_rows(state.NewImage(seen), rows, [known("k", None), known("other", "other")])
    assert found == [("a", "k", 7, [3.0, 4.0])] and kept.value == ("k", "k")
    assert _plain_rows(state.NewImage(seen), rows, [known("k", "k")])[0] == []


def test_stateful_first_deletions(spark, tmp_path):
    schema = "asset_id string, deleted_at timestamp"
    batches = [[("a", moment("2024-01-01")), ("b", moment("2024-01-02"))], [("a", moment("2024-01-03"))]]
    stream = deletions.first_deletions(feed(spark, str(tmp_path / "in"), batches, schema))
    query = (
        stream.writeStream.format("memory").queryName("first_deletions").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r.asset_id for r in spark.table("first_deletions").collect()) == ["a", "b"]


def test_entries_leave_the_bin_by_age(spark, tmp_path):
    schema = "asset_id string, deleted_at timestamp"
    batches = [
        [("a", moment("2024-01-01")), ("b", moment("2024-01-20"))],
        [("a", moment("2024-01-03"))],
        [("c", moment("2024-02-01"))],
        [("d", moment("2024-02-02"))],
    ]
    stream = deletions.expired_entries(feed(spark, str(tmp_path / "in"), batches, schema))
    query = (
        stream.writeStream.format("memory").queryName("left_the_bin").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    # the last deletion says it is 2 February less a day; a left on 30 January, b leaves on 18 February
    assert [tuple(r) for r in spark.table("left_the_bin").collect()] == [("a", moment("2024-01-01"), moment("2024-01-30"))]


def test_fingerprint_stream_handles_only_misses(spark, tmp_path, pictures):
    images = read_images(spark, pictures)
    index = spark.createDataFrame([record(x) for x in ("ramp", "back", "elsewhere")], INDEX)
    stored = FP.fingerprint_rows(FP.featurize(images), index.filter("asset_id = 'ramp'"), now())
    seen = []
    path, folder = str(tmp_path / "prints"), str(tmp_path / "in")
    for _ in range(2):  # the second time every image comes again
        images.repartition(3).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(images.schema).option("maxFilesPerTrigger", 2).parquet(folder)
        stream_fp.fingerprint_new_images(stream, index, stored, path, str(tmp_path / "cp")).awaitTermination()
        seen.append(sorted(r.asset_id for r in stream_fp.read_prints(spark, path).collect()))
    assert seen == [["back"], ["back"]]
    new = stream_fp.fingerprints_of(stream_fp.read_prints(spark, path), index, now())
    merged = FP.upsert_photos(stored, new)
    assert [r.asset_id for r in FP.needs_analysis(index, merged, "similar").collect()] == ["elsewhere"]  # no image of it has come
    # a print of an earlier state of the asset is not stored
    edited = index.withColumn("pixel_width", F.lit(7))
    assert stream_fp.fingerprints_of(stream_fp.read_prints(spark, path), edited, now()).count() == 0


def test_batches_do_not_scan_index_or_log(spark, tmp_path):
    """After the first batch a micro-batch reads its own files and the state of its own keys."""
    index = spark.createDataFrame([record(x) for x in "abcd"], INDEX)
    folder, path = str(tmp_path / "in"), str(tmp_path / "log")
    rows = [[("a", "modify", moment("2024-01-02"), 1)], [("b", "modify", moment("2024-01-03"), 2)]]
    progress = []

    def start(stream):
        query = changes.maintain_index(stream, index, path, str(tmp_path / "cp"))
        query.awaitTermination()
        progress.append([p for p in query.recentProgress if p.numInputRows])
        return query

    in_steps(spark, folder, rows, CHANGES, start)
    last = progress[-1][-1]
    assert last.numInputRows == 1 and len(last.sources) == 1
    assert last.stateOperators[0].numRowsTotal == 4  # two changed assets beside the two that only the index named


def test_checkpoint_folder_comes_from_the_session(spark):
    folder = session.checkpoint_dir(spark)
    assert folder and session.checkpoint_dir(spark) == folder
    assert session.cut_lineage(spark.range(3)).count() == 3
