"""Suffix-array dedup (operator 5): repeated byte strings by a depth-limited radix sort.

Only suffixes up to the threshold length matter, so they are sorted by few most-significant-digit passes, and each pass
looks only at what the one before left undecided. Equal groups at full depth are exactly the repeated windows.

* A window is a string of ``depth`` bytes. It is filed under its anchor, the leftmost smallest of its ``GRAM``-byte
  hashes: equal windows have equal anchors at equal places. Neighbouring windows share anchors, so a run of windows is one
  row, about one per 30 bytes of text.
* Digit 1, the anchor: a run whose anchor occurs once is unique and leaves. Of runs with equal contents all but the first
  are repeats as a whole; the first stands for them in the next pass.
* Digit 2, the part that all windows of a cell of ``CELL`` neighbouring places have in common; cells alike.
* Digit 3, the whole window, only for cells that differ but share digit 2.

Rows of a group stream through in order; a task holds one of them. Strings are told apart by two 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm import kernels as K
from frameloom.llm.common import CHUNK_BYTES, released, saved

DEPTH = 100
GRAM = 32
CELL = 8
# Rows that a map task compares with each other before they are shuffled.
ROWS_AT_ONCE = 1 << 20
_SEED = 5
# A place: first window (31 bits), windows - 1 (8), anchor - first window (8). The text it is in is named by doc and tag.
_COLUMNS = ["kind", "key", "full", "doc", "at", "tag"]
_KINDS = "kind byte, key long, full long, doc long, at long, tag long"
SPAN, OPEN = 0, 1


def _packed(start: np.ndarray, windows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 32) | ((windows - 1).astype(np.int64) << 24) | (anchor.astype(np.int64) << 16)


def _unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 32, ((at >> 24) & 255) + 1, (at >> 16) & 255


def _leftmost_smallest(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of its leftmost smallest one."""
    n = len(h) - width + 1
    best, at, span = h, np.arange(len(h), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        m = len(best) - step
        right = best[step:] < best[:m]
        at = np.where(right, at[step:], at[:m])
        best = np.where(right, best[step:], best[:m])
        span += step
    return at[:n]


class Bytes:
    """A stretch of bytes with hashes of any of its strings."""

    def __init__(self, data: np.ndarray, power: K.Powers, table: np.ndarray):
        self.power = power.reach(len(data) + 1)
        self.total = np.zeros(len(data) + 1, dtype=K.U64)
        np.cumsum(table[data] * self.power.up[: len(data)], out=self.total[1:])

    def hashes(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return K.mix((self.total[end] - self.total[first]) * self.power.down[first] + (end - first).astype(K.U64))


def _runs(data: np.ndarray, offsets: np.ndarray, depth: int, power: K.Powers, table: np.ndarray):
    """(anchor hash, content hash, row, first window in the text, windows, anchor - first window) of all runs."""
    if len(data) < depth:
        none = np.zeros(0, np.int64)
        return none.astype(K.U64), none.astype(K.U64), none, none, none, none
    text = Bytes(data, power, table)
    grams = K.mix((text.total[GRAM:] - text.total[:-GRAM]) * power.down[: len(data) - GRAM + 1])
    anchor = _leftmost_smallest(grams, depth - GRAM + 1)
    ok = np.zeros(len(anchor) + 1, dtype=bool)
    lengths = np.diff(offsets)
    row_of = np.repeat(np.arange(len(lengths)), lengths)[: len(anchor)]
    ok[:-1] = np.arange(len(anchor)) + depth <= offsets[row_of + 1]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row_of[1:] != row_of[:-1]), [True]])
    first = np.flatnonzero(new[:-1] & ok[:-1])
    last = np.flatnonzero(ok[:-1] & (new[1:] | ~ok[1:]))
    row = row_of[first]
    full = text.hashes(first, last + depth)
    return grams[anchor[first]], full, row, first - offsets[row], last - first + 1, anchor[first] - first


def _out(kind: int, key: np.ndarray, full: np.ndarray, doc: np.ndarray, at: np.ndarray, tag: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int8)), *map(pa.array, (key, full, doc, at, tag))], _COLUMNS)


def _map_runs(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power, table = K.Powers(), K.byte_table(_SEED)
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            key, full, doc, at, tag = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((tag, at, doc, full, key))
            key, full, doc, at, tag = key[order], full[order], doc[order], at[order], tag[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (full[1:] != full[:-1])])
            # equal to an earlier run of this task; the same place of a repeated row is not earlier
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            later = ~new & ((doc != doc[lead]) | (at >> 32 != at[lead] >> 32))
            # another text of the doc with the first one's content and place
            new |= ~later & np.concatenate([[True], tag[1:] != tag[:-1]])
            yield _out(OPEN, key[new], full[new], doc[new], at[new], tag[new])
            if later.any():
                yield _out(SPAN, K.signed(K.mix(at[later].view(K.U64) + doc[later].view(K.U64))), np.zeros(int(later.sum()), np.int64), doc[later], at[later], tag[later])

        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            docs, tags = np.asarray(batch.column("doc")), np.asarray(batch.column("tag"))
            for lo, hi in K.slices(offsets, CHUNK_BYTES):
                key, full, row, first, windows, anchor = _runs(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], depth, power, table)
                held.append((K.signed(key), K.signed(full), docs[lo + row], _packed(first, windows, anchor), tags[lo + row]))
                if sum(len(x[0]) for x in held) >= ROWS_AT_ONCE:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _split(batches: Iterator[pa.RecordBatch], extra: str | None = None) -> Iterator[tuple[int, dict[str, np.ndarray], list | None]]:
    """Of rows in order of (key, full, doc, at, tag): (SPAN, rows equal to an earlier one) and (OPEN, the first of each
    content whose key has several contents, and other texts of its doc that have it at the same place). One row is
    carried from batch to batch."""
    lead_key = lead_full = lead_doc = lead_at = last_tag = None
    pending = None  # the only content so far of the running key
    for batch in batches:
        kind = np.asarray(batch.column("kind")) if "kind" in batch.schema.names else None
        cols = {n: np.asarray(batch.column(n)) for n in ("key", "full", "doc", "at", "tag")}
        blobs = batch.column(extra) if extra else None
        if kind is not None and (kind == SPAN).any():
            ready = kind == SPAN
            yield SPAN, {n: c[ready] for n, c in cols.items()}, None
            cols = {n: c[~ready] for n, c in cols.items()}
        key, full, doc, at, tag = (cols[n] for n in ("key", "full", "doc", "at", "tag"))
        n = len(key)
        if not n:
            continue
        same_key = np.concatenate([[lead_key is not None and key[0] == lead_key], key[1:] == key[:-1]])
        same_full = same_key & np.concatenate([[lead_key is not None and full[0] == lead_full], full[1:] == full[:-1]])
        lead = np.maximum.accumulate(np.where(same_full, -1, np.arange(n)))
        of = np.maximum(lead, 0)
        first_doc = np.where(lead < 0, lead_doc if lead_doc is not None else 0, doc[of])
        first_at = np.where(lead < 0, lead_at if lead_at is not None else 0, at[of])
        later = same_full & ((doc != first_doc) | (at >> 32 != first_at >> 32))
        if later.any():
            yield SPAN, {k: c[later] for k, c in cols.items()}, None
        other_tag = np.concatenate([[last_tag is None or tag[0] != last_tag], tag[1:] != tag[:-1]])
        last_tag = tag[-1]
        new = np.flatnonzero(~same_full | (~later & other_tag))
        if len(new):
            head = ~same_key[new]  # starts a key
            next_head = np.concatenate([head[1:], [True]])
            alone = head & next_head
            last_alone = bool(alone[-1])
            take = ~alone
            if not head[0] and pending is not None:
                yield OPEN, pending[0], pending[1]
            pending = None
            chosen = new[take]
            if len(chosen):
                yield OPEN, {k: c[chosen] for k, c in cols.items()}, blobs.take(pa.array(chosen)).to_pylist() if extra else None
            if last_alone:
                i = new[-1:]
                pending = ({k: c[i] for k, c in cols.items()}, blobs.take(pa.array(i)).to_pylist() if extra else None)
            i = new[-1]
            lead_key, lead_full, lead_doc, lead_at = key[i], full[i], doc[i], at[i]


def _first_digit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for kind, c, _ in _split(batches):
        yield _out(kind, *(c[n] for n in _COLUMNS[1:]))


def _map_cells(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power, table, other = K.Powers(), K.byte_table(_SEED), K.byte_table(_SEED + 1)
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            docs, tags, runs = np.asarray(batch.column("doc")), np.asarray(batch.column("tag")), batch.column("runs")
            run_ends = np.asarray(runs.offsets)
            places = np.asarray(runs.flatten())
            run_ends = run_ends - run_ends[0]
            for lo, hi in K.slices(offsets, CHUNK_BYTES):
                part = data[offsets[lo] : offsets[hi]]
                text, again = Bytes(part, power, table), Bytes(part, power, other)
                mine = places[run_ends[lo] : run_ends[hi]]
                row = np.repeat(np.arange(lo, hi), np.diff(run_ends[lo : hi + 1]))
                start, windows, anchor = _unpacked(mine)
                base = (offsets[row] - offsets[lo])
                which = np.repeat(np.arange(len(mine)), windows)
                place = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
                first = base[which] + start[which] + place  # byte in the part
                back = anchor[which] - place  # anchor - window
                cell = back // CELL
                new = np.concatenate([[True], (which[1:] != which[:-1]) | (cell[1:] != cell[:-1])])
                heads = np.flatnonzero(new)
                sizes = np.diff(np.append(heads, len(which)))
                w = which[heads]
                core = base[w] + start[w] + anchor[w] - cell[heads] * CELL
                key = text.hashes(core, core + depth - CELL + 1)
                full = text.hashes(first[heads], first[heads] + sizes - 1 + depth) + back[heads].astype(K.U64)
                each = K.signed(again.hashes(first, first + depth)).astype("<i8").tobytes()
                blobs = [each[8 * h : 8 * (h + s)] for h, s in zip(heads.tolist(), sizes.tolist())]
                at = _packed(start[w] + place[heads], sizes, np.zeros(len(w), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(key)), pa.array(K.signed(full)), pa.array(docs[row[w]]), pa.array(at), pa.array(tags[row[w]]), pa.array(blobs, pa.binary())], [*_COLUMNS[1:], "windows"])

    return run


def _second_digit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for kind, c, blobs in _split(batches, "windows"):
        if kind == SPAN:
            yield _out(SPAN, *(c[n] for n in _COLUMNS[1:]))
            continue
        start, windows, _ = _unpacked(c["at"])
        which = np.repeat(np.arange(len(windows)), windows)
        place = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
        one = np.ones(len(which), np.int64)
        at = _packed(start[which] + place, one, one * 0)
        yield _out(OPEN, c["key"][which], np.frombuffer(b"".join(blobs), "<i8").astype(np.int64), c["doc"][which], at, c["tag"][which])


def _last_digit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (key, full, doc, at, tag), full being the window: all but the first."""
    for kind, c, _ in _split(batches):
        if kind == SPAN:
            yield _out(SPAN, *(c[n] for n in _COLUMNS[1:]))


def _cut_out(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = batch.column("text"), batch.column("places")
            cols: tuple[list, ...] = ([], [], [], [])
            for i in range(batch.num_rows):
                raw = (texts[i].as_py() or "").encode()
                if places[i].is_valid and len(places[i]):
                    start, windows, _ = _unpacked(np.asarray(places[i].values))
                    edge = np.zeros(len(raw) + 1, dtype=np.int32)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + windows - 1 + depth, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                else:
                    kept, spans = raw, 0
                for col, value in zip(cols, (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def repeated_places(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc, tag, places): for every text, the packed runs of windows that start earlier elsewhere.

    ``rows`` has doc, tag and text.
    """
    order = ["key", "full", "doc", "at", "tag"]
    runs = rows.mapInArrow(K.thrifty(_map_runs(depth)), _KINDS)
    first = saved(runs.repartition("key").sortWithinPartitions(*order).mapInArrow(K.thrifty(_first_digit), _KINDS), "digit-1")
    released(rows.sparkSession)
    asked = first.filter(F.col("kind") == OPEN).groupBy("doc", "tag").agg(F.collect_list("at").alias("runs"))
    cells = rows.join(asked, ["doc", "tag"]).select("doc", "tag", "text", "runs").mapInArrow(K.thrifty(_map_cells(depth)), "key long, full long, doc long, at long, tag long, windows binary")
    second = saved(cells.repartition("key").sortWithinPartitions(*order).mapInArrow(K.thrifty(_second_digit), _KINDS), "digit-2")
    released(rows.sparkSession)
    windows = second.filter(F.col("kind") == OPEN).repartition("key").sortWithinPartitions(*order)
    third = windows.mapInArrow(K.thrifty(_last_digit), _KINDS)
    found = first.filter(F.col("kind") == SPAN).unionByName(second.filter(F.col("kind") == SPAN)).unionByName(third)
    return found.groupBy("doc", "tag").agg(F.collect_list("at").alias("places"))


def remove_repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of ``docs``.

    A byte goes when a string of ``depth`` bytes over it also starts earlier: in a smaller doc_id, or in the same one at
    an earlier start. Null and empty texts have 0 bytes. A null doc_id comes before all others. Rows that repeat a doc_id
    and text are one document and give equal rows; different texts under one doc_id are compared by their starts. An
    empty table gives no rows; doc_id must be a whole number; other columns are not read. A text has less than 2 GB.
    """
    lowest = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", lowest).alias("doc"), F.xxhash64("text").alias("tag"), "text")
    places = repeated_places(rows.select("doc", "tag", "text"), depth)
    joined = rows.join(places, ["doc", "tag"], "left").select("doc_id", "text", "places")
    return joined.mapInArrow(K.thrifty(_cut_out(depth)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
