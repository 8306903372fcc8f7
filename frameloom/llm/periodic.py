"""Periodic runs of words (operator 13): stretches that repeat a block of words four times or more.

A run is a stretch of consecutive words with smallest period q, as long as ``max(min_words, min_times * q)`` words, that no
neighbouring word extends keeping the period. Runs are found whole in every text:

* periods up to ``SHORT`` by direct lag scans: words are compared with the words q places on, in all texts of a chunk at once;
* longer ones by minimizers at several scales. At scale W, for periods above W up to 2 W, the place of the smallest hash in every
  window of W places is marked. Windows a period apart hold the same words, so in a run of four periods marks come back a
  period apart. A mark is named by the 2 W words from it on, that is by at least a period of words, so no mark between
  has its name, and a mark with the next of its name is a seed of the very period. Seeds are extended both ways.

A scale costs time in proportion to the words of the texts long enough for it, and there are as many scales as the longest text
has powers of two. Words are compared by hash first; what is found is compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm import kernels as K
from frameloom.llm.common import CHUNK_BYTES

MIN_WORDS = 6
MIN_TIMES = 4
# Longest period that is looked for by lag scans, and the scale of the first minimizers: a power of two.
SHORT = 16
# Bytes of collapsed text put together at a time.
JOIN_BYTES = 1 << 22

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _stretches(equal: np.ndarray, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place, end place) of the maximal stretches of period ``lag`` of at least ``least`` words."""
    change = np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8))
    start, stop = np.flatnonzero(change == 1), np.flatnonzero(change == -1) + lag
    long = stop - start >= least
    return start[long], stop[long]


class _Words:
    """The words of a chunk of texts, one after another, with the place where each text ends."""

    def __init__(self, data: np.ndarray, first: np.ndarray, end: np.ndarray, counts: np.ndarray) -> None:
        self.data, self.first, self.size = data, first, end - first
        self.name = K.word_hashes(data, first, end)
        self.ends = np.cumsum(counts)
        self.begins = self.ends - counts

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a and b have the same bytes; for words with equal hashes."""
        out = self.size[a] == self.size[b]
        pieces = K.eights(self.data)
        for k in range(0, int(self.size[a].max(initial=0)), 8):
            at = np.flatnonzero(out & (self.size[a] > k))
            if not len(at):
                break
            unlike = pieces[self.first[a[at]] + k] ^ pieces[self.first[b[at]] + k]
            left = np.minimum(self.size[a[at]] - k, 8).astype(np.uint64)
            out[at] = (unlike << (K.U64(64) - left * K.U64(8))) == 0
        return out

    def verified(self, start: int, stop: int, lag: int, least: int) -> list[tuple[int, int, int]]:
        """What is left of a stretch when its words are compared byte by byte: all of it, but for equal hashes of unequal words."""
        a = np.arange(start, stop - lag)
        equal = self.same(a, a + lag)
        if equal.all():
            return [(start, stop, lag)]
        return [(start + int(s), start + int(e), lag) for s, e in zip(*_stretches(equal, lag, least))]


def _extended(name: np.ndarray, at: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """The maximal stretch of period ``lag`` around the seed ``at``, inside the text from ``low`` to ``high``."""

    def agree(i: int, step: int, most: int) -> int:
        done, width = 0, 64
        while done < most:
            width = min(2 * width, most - done)
            a = name[i + done : i + done + width] if step > 0 else name[i - done - width : i - done][::-1]
            b = name[i + lag + done : i + lag + done + width] if step > 0 else name[i + lag - done - width : i + lag - done][::-1]
            unlike = a != b
            if unlike.any():
                return done + int(unlike.argmax())
            done += width
        return done

    return at - agree(at, -1, at - low), at + lag + agree(at, 1, high - lag - at)


def _seeded(words: _Words, min_times: int) -> list[tuple[int, int, int]]:
    """Stretches (start, end, period) of at least ``min_times`` periods above SHORT."""
    found = []
    # from here on only texts that are long enough for the scale
    counts = words.ends - words.begins
    rows = np.flatnonzero(counts >= min_times * (SHORT + 1))
    if not len(rows):
        return found
    place = np.concatenate([np.arange(words.begins[r], words.ends[r]) for r in rows])
    context, width = words.name[place], 1
    lowest = None  # for every place the smallest hash of SHORT words in a window of W places, and where it is
    while len(place):
        # hashes of the next 2 * width words, and of the whole rest of the chunk after its last words: those are never used
        while width < (2 * SHORT if lowest is None else 2 * scale):
            nearby = np.concatenate([context[width:], np.zeros(min(width, len(context)), K.U64)])
            context = K.mix(context * K.U64(0x9E3779B97F4A7C15) + nearby + K.U64(width))
            width *= 2
            if width == SHORT and lowest is None:
                scale, lowest, where = 1, context.copy(), np.arange(len(place))
                while scale < SHORT:
                    lowest, where = _wider(lowest, where, scale)
                    scale *= 2
        of = rows[np.searchsorted(words.ends[rows], place, side="right")]
        room = words.ends[of] - place
        # marks: places of window minima; a window and the 2 W words from its mark on must lie in the text
        window = np.flatnonzero(room >= 2 * scale)
        marks = np.unique(where[window])
        marks = marks[room[marks] >= 2 * scale]
        order = np.lexsort((marks, context[marks], of[marks]))
        marks = marks[order]
        lag = np.diff(marks)
        pair = (of[marks[1:]] == of[marks[:-1]]) & (context[marks[1:]] == context[marks[:-1]]) & (lag > scale) & (lag <= 2 * scale)
        seeds, lags = marks[:-1][pair], lag[pair]
        order = np.lexsort((seeds, lags))
        last, reach = 0, -1
        for at, q in zip(place[seeds[order]].tolist(), lags[order].tolist()):
            if q == last and at < reach:
                continue
            r = int(np.searchsorted(words.ends, at, side="right"))
            start, stop = _extended(words.name, at, q, int(words.begins[r]), int(words.ends[r]))
            last, reach = q, stop - q
            if stop - start >= min_times * q:
                found.append((start, stop, q))
        # the next scale, over the texts that can hold four of its periods
        lowest, where = _wider(lowest, where, scale)
        scale *= 2
        keep_rows = counts[rows] >= min_times * (scale + 1)
        if not keep_rows.all():
            keep = keep_rows[np.searchsorted(words.ends[rows], place, side="right")]
            moved = np.cumsum(keep) - 1
            place, context, lowest, where = place[keep], context[keep], lowest[keep], where[keep]
            # windows that reach into a text that went are not used either
            where = moved[where]
            rows = rows[keep_rows]
    return found


def _wider(lowest: np.ndarray, where: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Minima of windows of 2 * scale places from those of scale places; the first place of equal ones."""
    n = len(lowest) - scale
    if n <= 0:
        return lowest, where
    lowest, where = lowest.copy(), where.copy()
    later = lowest[scale:] < lowest[:n]
    lowest[:n] = np.where(later, lowest[scale:], lowest[:n])
    where[:n] = np.where(later, where[scale:], where[:n])
    return lowest, where


def runs_of(words: _Words, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of a chunk, by start, then period; places count from the chunk's first word."""
    found = []
    name, n = words.name, len(words.name)
    for lag in range(1, SHORT + 1):
        if n < min_times * lag:
            break
        equal = name[lag:] == name[:-lag]
        # pairs that reach into the next text
        for d in range(1, lag + 1):
            cut = words.ends[:-1] - d
            equal[cut[(cut >= 0) & (cut < len(equal))]] = False
        least = max(min_words, min_times * lag)
        for start, stop in zip(*(x.tolist() for x in _stretches(equal, lag, least))):
            found += words.verified(start, stop, lag, least)
    for start, stop, lag in _seeded(words, min_times):
        if stop - start >= min_words:
            found += words.verified(start, stop, lag, max(min_words, min_times * lag))
    # a multiple of the smallest period has the very same stretch
    smallest: dict[tuple[int, int], int] = {}
    for start, stop, lag in found:
        smallest[start, stop] = min(lag, smallest.get((start, stop), lag))
    table = np.array(sorted((s, q, e) for (s, e), q in smallest.items()), dtype=np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 2], table[:, 1]


def _joined(words: _Words, kept: np.ndarray) -> bytes:
    """The words joined by one space."""
    sizes = words.size[kept] + 1
    parts, ends = [], np.cumsum(sizes)
    lo = 0
    while lo < len(kept):
        base = ends[lo] - sizes[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + JOIN_BYTES, side="right")))
        if hi == lo + 1:
            at = int(words.first[kept[lo]])
            parts.append(words.data[at : at + int(sizes[lo]) - 1].tobytes() + b" ")
        else:
            shift = words.first[kept[lo:hi]] - (ends[lo:hi] - sizes[lo:hi] - base)
            at = np.repeat(shift, sizes[lo:hi]) + np.arange(ends[hi - 1] - base)
            piece = words.data[np.minimum(at, len(words.data) - 1)]
            piece[ends[lo:hi] - 1 - base] = 0x20
            parts.append(piece.tobytes())
        lo = hi
    return b"".join(parts)[:-1]


def _find(min_words: int, min_times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            for lo, hi in K.slices(offsets, CHUNK_BYTES):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                first, end, row = K.words(part, at)
                counts = np.bincount(row, minlength=hi - lo)
                words = _Words(part, first, end, counts)
                start, stop, period = runs_of(words, min_words, min_times)
                marks = np.zeros(len(first) + 1, np.int64)
                np.add.at(marks, start + period, 1)
                np.add.at(marks, stop, -1)
                dropped = np.cumsum(marks)[:-1] > 0
                kept = np.flatnonzero(~dropped)
                cut = np.searchsorted(kept, np.append(words.begins, len(first)))
                texts = [_joined(words, kept[a:b]).decode() for a, b in zip(cut[:-1], cut[1:])]
                of = np.searchsorted(words.ends, start, side="right")
                runs = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(of, np.arange(hi - lo + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(start - words.begins[of]), pa.array(stop - start), pa.array(period)], ["start", "length", "period"]),
                )
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(counts.astype(np.int64)), runs, pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return K.thrifty(run)


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per row of ``docs``: the runs of its text by start, then period, and its words
    joined by one space without those that a run only repeats, that is all of a run's words after its first period.

    Null and empty texts have no words, no runs and an empty collapsed text. Every row is looked at by itself, so repeated rows
    and null doc_ids have a row each. Texts of any length are looked at as a whole: a task holds a chunk of texts or one
    longer text. An empty table gives no rows; other columns are not read. ``min_times`` is 4 at least.
    """
    if min_times < 4:
        raise ValueError("seeds are sure to lie in runs of four periods or more")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_find(min_words, min_times), f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string")


# --- texts with planted repetition ----------------------------------------------------------------


def _echo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, parts, done = batch.column("text"), [], 0
        for i, g in enumerate(batch.column("chosen").to_pylist()):
            data, offsets = K.text_bytes(texts.slice(i, int(g is not None)))
            first, end, _ = K.words(data, offsets)
            n = len(first)
            if not n:
                continue
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            order = np.arange(n)
            order[a:] = a + (order[a:] - a) % p
            changed = _joined(_Words(data, first, end, np.array([n])), order).decode()
            parts += [texts.slice(done, i - done), pa.array([changed], pa.string())]
            done = i + 1
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.concat_arrays([*parts, texts.slice(done)])], ["doc_id", "text"])


def echoed_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the texts, chosen by the checksum of doc_id, the words from some place on repeat a block.

    With h = crc32 of the decimal doc_id and g = h // 10, a text of n words is changed where h % 10 = 0: words from a = g % n on
    become those of a block of 1 + (n - a) // (3 + g % 8) words, over and over. Rows without a doc_id and texts without words stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.when(h % 10 == 0, F.floor(h / 10).cast("long"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), chosen.alias("chosen"))
    return rows.mapInArrow(K.thrifty(_echo), "doc_id bigint, text string")


def longest_run(runs: Column) -> Column:
    """The longest of ``runs``; of equally long ones the first, then the one of the smaller period. Null where there is none."""
    key = lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))
    best = F.array_max(F.transform(runs, key))
    return F.when(best.isNotNull(), F.struct((-best["back"]).alias("start"), best["length"].alias("length"), (-best["short"]).alias("period")))


def run_digests(found: DataFrame) -> DataFrame:
    """One row per row of ``periodic_runs``: number of runs, the longest, and digests of runs and collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    best = longest_run(F.col("runs"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
