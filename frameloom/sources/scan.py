"""Data source that lists picture files and reads no more of them than their headers.

``spark.read.format("media_scan").load(folder)`` gives asset_id, path, kind, pixel_width, pixel_height, file_size, modified and source.
The driver counts folders level by level until there are enough of them for the tasks; each task lists its own folder and opens the
files it finds. The files of a large folder are dealt by a hash of their names. Local and shared folders are walked entry by entry, so
no process holds a folder's list, and a file is looked at by its own task alone; other stores give Arrow a whole folder at a time. A filter on ``modified`` is pushed into the listing, so files out of its range are not opened. Files whose header
is not that of a picture are skipped.

Folders are opened with Arrow's file systems (local and shared folders, object stores); for stores that only Spark reaches there is
``images.read_images``.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "asset_id string, path string, kind string, pixel_width int, pixel_height int, file_size bigint, modified timestamp, source string"
# Bytes of a file that are read at a time, and the most of it that is looked through for the frame of a JPEG.
HEAD_BYTES = 1 << 12
MOST_BYTES = 1 << 22
BATCH_FILES = 1000


def picture_size(read) -> tuple[int, int] | None:
    """(width, height) from a file's header; None if it is no picture. ``read(offset, n)`` gives at most n bytes from there."""
    head = read(0, 32)
    if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR" and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        return struct.unpack("<HH", head[6:10])
    if head[:2] == b"BM" and len(head) >= 26:
        width, height = struct.unpack("<ii", head[18:26])
        return width, abs(height)
    if head[:2] == b"\xff\xd8":
        return _jpeg_size(read)
    return None


def _jpeg_size(read) -> tuple[int, int] | None:
    at = 2
    while at < MOST_BYTES:
        segment = read(at, 9)
        if len(segment) < 9 or segment[0] != 0xFF:
            return None
        marker = segment[1]
        if marker == 0xFF:  # filling
            at += 1
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", segment[5:9])
            return width, height
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:  # markers without a length
            at += 2
        else:
            at += 2 + struct.unpack(">H", segment[2:4])[0]
    return None


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, bool, fs.FileInfo | None]]:
    """(path, is a folder, is a file, what the listing told of it) of what lies in a folder itself, one at a time."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as entries:
            for entry in entries:
                yield entry.path, entry.is_dir(), entry.is_file(), None
    else:
        for info in store.get_file_info(fs.FileSelector(folder)):
            yield info.path, info.type == fs.FileType.Directory, info.type == fs.FileType.File, info


def _share_of(path: str, shares: int) -> int:
    return zlib.crc32(os.fsencode(path.rsplit("/", 1)[-1])) % shares


class _Share(InputPartition):
    """A folder with all below it, or a share of the files that lie in a folder itself."""

    def __init__(self, folder: str, recursive: bool, share: int, shares: int) -> None:
        self.folder, self.recursive, self.share, self.shares = folder, recursive, share, shares


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.tasks = int(options.get("tasks", "64"))
        self.since: list[tuple[datetime, bool]] = []
        self.until: list[tuple[datetime, bool]] = []

    def pushFilters(self, filters):
        for f in filters:
            time = getattr(f, "value", None) if getattr(f, "attribute", None) == ("modified",) else None
            if isinstance(time, datetime) and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.since.append((_utc(time), isinstance(f, GreaterThan)))
            if isinstance(time, datetime) and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.until.append((_utc(time), isinstance(f, LessThan)))
            yield f  # a file's time may have digits that Spark's has not, so Spark looks again

    def _wanted(self, modified: datetime) -> bool:
        # Spark's times end with microseconds
        after = all(modified > t or (modified == t and not strict) for t, strict in self.since)
        return after and all(modified < t or (modified == t and not strict) for t, strict in self.until)

    def partitions(self):
        store, root = _opened(self.path)
        found, level = [], [root]
        while level and len(found) + len(level) < self.tasks:
            below = []
            for folder in level:
                files = 0
                for path, is_folder, _, _ in _entries(store, folder):
                    if is_folder:
                        below.append(path)
                    else:
                        files += 1
                shares = min(self.tasks, -(-files // BATCH_FILES))
                found += [_Share(folder, False, i, shares) for i in range(shares)]
            level = below
        return found + [_Share(folder, True, 0, 1) for folder in level]

    def _files(self, store: fs.FileSystem, partition: _Share) -> Iterator[fs.FileInfo]:
        folders = [partition.folder]
        while folders:
            for path, is_folder, is_file, info in _entries(store, folders.pop()):
                if is_folder and partition.recursive:
                    folders.append(path)
                elif is_file and _share_of(path, partition.shares) == partition.share:
                    yield info or store.get_file_info(path)

    def read(self, partition: _Share) -> Iterator[pa.RecordBatch]:
        store, root = _opened(self.path)
        rows = []
        for entry in self._files(store, partition):
            if entry.type != fs.FileType.File:  # gone meanwhile
                continue
            modified = datetime.fromtimestamp((entry.mtime_ns or 0) // 1000 / 1e6, timezone.utc)
            if not self._wanted(modified):
                continue
            with store.open_input_file(entry.path) as file:
                size = picture_size(lambda offset, n: file.read_at(min(n, max(0, entry.size - offset)), offset) if offset < entry.size else b"")
            if size is None or not all(0 < x < 1 << 31 for x in size):
                continue
            name = re.sub(r"\.[^./]*$", "", entry.path.rsplit("/", 1)[-1])
            rows.append((name, entry.path[len(root.rstrip("/")) :], "photo", *size, entry.size, modified, "userLibrary"))
            if len(rows) == BATCH_FILES:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _utc(time: datetime) -> datetime:
    return time.astimezone(timezone.utc) if time.tzinfo else time.replace(tzinfo=timezone.utc)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.timestamp("us", "UTC"), pa.string()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names)


class MediaScan(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_scan"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def scan_folder(spark: SparkSession, folder: str, since: datetime | None = None) -> DataFrame:
    """The pictures below ``folder``, newest first; ``path`` starts below it. ``since``: only those modified then or later."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MediaScan)
    rows = spark.read.format("media_scan").load(folder)
    rows = rows if since is None else rows.filter(F.col("modified") >= F.lit(since))
    return rows.orderBy(F.desc("modified"), "asset_id")
