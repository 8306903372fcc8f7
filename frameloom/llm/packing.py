"""Best-fit packing of token sequences (operator 4).

Best-fit decreasing only looks at lengths, and there are at most as many lengths as a sequence has tokens. So the
fit is computed on the histogram of lengths: bins with the same room are one counted class, a segment tree over the
rooms finds the tightest class in logarithmic time, and a class takes its items in one step. The plan that comes
out (`Flow` rows, bounded by the capacity alone) tells every piece its sequence and offset from nothing but its
length and its number among the pieces of that length; these numbers are counted in Spark.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm import kernels as K
from frameloom.llm.common import saved
from frameloom.llm.tokens import byte_batches, public_path

CAPACITY = 1024
END_ID = 2
# Pieces that are numbered in one task.
NUMBERED_AT_ONCE = 500_000


class Rooms:
    """Segment tree over rooms 0..capacity: which of them have open bins."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.used = [False] * (2 * self.leaves)

    def set(self, room: int, used: bool) -> None:
        i = room + self.leaves
        self.used[i] = used
        while i > 1:
            i >>= 1
            self.used[i] = self.used[2 * i] or self.used[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """Smallest used room of at least ``least``."""
        i = least + self.leaves
        if self.used[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.used[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.used[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


class Flow(NamedTuple):
    """Pieces ``first``.. of a length go to bins ``bin``.. , ``per_bin`` in each, from ``offset`` on."""

    length: int
    first: int
    bin: int
    per_bin: int
    offset: int


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Flow]:
    """The plan of best-fit decreasing for ``histogram`` (pieces by length)."""
    rooms, groups, flows, opened = Rooms(capacity), {}, [], 0

    def put(room: int, start: int, count: int) -> None:
        if count and room:
            groups.setdefault(room, []).append((start, count))
            rooms.set(room, True)

    for length in sorted(histogram, reverse=True):
        done, left = 0, histogram[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                # every bin that opens takes as many as it holds before the next opens
                count = -(-left // (capacity // length))
                room, start, whole = capacity, opened, count
                opened += count
            else:
                start, whole = groups[room].pop()
                if not groups[room]:
                    rooms.set(room, False)
            per_bin = room // length
            full = min(whole, left // per_bin)
            offset = capacity - room
            if full:
                flows.append(Flow(length, done, start, per_bin, offset))
                put(room - per_bin * length, start, full)
                done, left = done + full * per_bin, left - full * per_bin
            rest = whole - full
            if left and rest:
                flows.append(Flow(length, done, start + full, left, offset))
                put(room - left * length, start + full, 1)
                done, left, rest, full = done + left, 0, rest - 1, full + 1
            put(room, start + full, rest)
    return flows


class Encoder:
    """Token ids as the tokenizers library gives them for the byte-level file.

    Texts of common characters go through tiktoken, which has the same vocabulary and merges and is several times
    as fast; all others, and those with a special token's text, go through tokenizers. The tests hold the two
    against each other over every such character.
    """

    def __init__(self, vocabulary: str):
        self.path = vocabulary if vocabulary.startswith("/") else public_path(vocabulary)
        self.fast = None
        if vocabulary == "byte_bpe_50k.json":
            import base64

            import public_tokenizers
            import tiktoken

            with open(public_path("byte_bpe_50k.tiktoken"), "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.uncommon = re.compile("[^\t\n\r -~\u00a0-\u017f\u2010-\u2027]")
        self.blanks = re.compile(r"\s{500}")

    @functools.cached_property
    def tokenizer(self):
        """The plain library, loaded when a text needs it."""
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def is_plain(self, text: str) -> bool:
        """Whether the fast way is known to agree: common characters, no special token's text, no run that a
        backtracking pattern would stumble over."""
        if self.fast is None or self.uncommon.search(text) or "<|endoftext|>" in text:
            return False
        if len(text) < 500:
            return True
        lengths = list(map(len, text.split()))
        if max(lengths, default=0) >= 2000:
            return False
        return len(text) - sum(lengths) < len(lengths) + 500 or not self.blanks.search(text)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        slow = []
        for i, text in enumerate(texts):
            if self.is_plain(text):
                out[i] = np.array(self.fast.encode_ordinary(text), dtype="<u4")
            else:
                slow.append(i)
        if slow:
            for i, e in zip(slow, self.tokenizer.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False)):
                out[i] = np.array(e.ids, dtype="<u4")
        return out


_PIECES = pa.schema([("key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; the first one is the shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(vocabulary: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            keys, texts = batch.column("key"), batch.column("text")
            for group in byte_batches((i, texts[i].as_py() or "") for i in range(batch.num_rows)):
                cols: list[list] = [[] for _ in _PIECES]
                for (row, _), ids in zip(group, encoder.ids([t for _, t in group])):
                    ids, key = np.concatenate([ids, end]), keys[row].as_py()
                    for number, (start, length) in enumerate(cut(len(ids), capacity)):
                        raw = ids[start : start + length].tobytes()
                        for col, value in zip(cols, (key, number, start, length, zlib.crc32(raw), raw if with_ids else None)):
                            col.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _PIECES)], schema=_PIECES)

    return run


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every text's ids and the end id, cut to at most ``capacity``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    made = rows.mapInArrow(K.thrifty(_pieces(vocabulary, capacity, end_id, with_ids)), "key long, piece int, start long, length long, ids_crc32 long, ids binary")
    made = made.withColumnRenamed("key", "doc_id")
    return made if with_ids else made.drop("ids")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: best-fit decreasing over all of them.

    ``pieces`` must be a stored table (it is read twice) with doc_id, piece, start, length and ids_crc32. Whole
    sequences (length = capacity) need no room in others and are numbered after the packed ones. Pieces of one length
    are numbered in order of doc_id within salts, and salts are put one behind the other, so a length that most
    pieces have is spread over many tasks. Equal rows are interchangeable.
    """
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    flows = best_fit_decreasing(counts, capacity)
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(parts, -(-sum(counts.values()) // NUMBERED_AT_ONCE))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    bases = bases.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = salted.withColumn("_at", F.row_number().over(inside)).join(bases, ["length", "_salt"])
    numbered = numbered.withColumn("_at", F.col("_at") - 1 + F.col("_base")).drop("_base", "_salt")
    by_length: dict[int, np.ndarray] = {}
    for length in counts:
        by_length[length] = np.array([f for f in flows if f.length == length], dtype=np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, at = (np.asarray(batch.column(n)) for n in ("length", "_at"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for value in np.unique(length):
                mine = np.flatnonzero(length == value)
                plan = by_length[int(value)]
                flow = plan[np.searchsorted(plan[:, 1], at[mine], side="right") - 1]
                turn = at[mine] - flow[:, 1]
                sequence[mine] = flow[:, 2] + turn // flow[:, 3]
                offset[mine] = flow[:, 4] + value * (turn % flow[:, 3])
            names = [n for n in batch.schema.names if n != "_at"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kept = [f for f in numbered.schema.fields if f.name != "_at"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return numbered.mapInArrow(K.thrifty(place), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """All ``docs`` as pieces in sequences of at most ``capacity`` tokens.

    Null and empty texts are one end id. A null doc_id is kept; repeated rows are packed each for itself. An empty
    table gives no rows. Other columns are not read.
    """
    return pack(saved(token_pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity)
