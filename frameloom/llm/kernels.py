"""Array kernels on text columns, used inside Arrow functions.

A text column is looked at as one byte array with offsets, straight from Arrow's buffers. Words are the
maximal runs of bytes other than space and 0x09-0x0D; in UTF-8 these bytes occur only as themselves.
Word hashes are 64-bit: the eight-byte pieces of a word go one after the other through ``mix``, which is no sum of
parts, so a pattern within a text does not cancel out as it does in a polynomial modulo 2^64; long words go through BLAKE2b.
Equal inputs always get equal hashes; different ones share a hash with a chance of about 2^-64 a pair.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

U64 = np.uint64
# Fixed odd multiplier of the polynomial and its inverse modulo 2^64.
RADIX = 0x9E3779B97F4A7C15
RADIX_INVERSE = pow(RADIX, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Words of more bytes are hashed one by one. The lowest 0 to 8 bytes of a number.
LONG_WORD = 256
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit words over all bits (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.ones(max(n, 1), dtype=U64)
    out[1:] = U64(base)
    return np.multiply.accumulate(out)[:n]


class Powers:
    """Powers of the multiplier and of its inverse, grown when a longer text comes."""

    def __init__(self) -> None:
        self.up, self.down = powers(RADIX, 1), powers(RADIX_INVERSE, 1)

    def reach(self, n: int) -> Powers:
        if len(self.up) < n:
            self.up, self.down = powers(RADIX, n), powers(RADIX_INVERSE, n)
        return self


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + column.offset + 1)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer text is a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte, row) of every word."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    change = np.diff(inside)
    begins = change == 1
    ends = change == -1
    # a word ends with its text even where the next text starts with a word
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    joined = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
    begins[joined] = True
    ends[joined] = True
    first, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return first, end, np.searchsorted(offsets, first, side="right") - 1


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of ``data`` on as one number, zeros after the end."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def word_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A hash of the bytes from each ``first`` to its ``end``, with A-Z as a-z if ``lower``."""
    size = end - first
    h = size.astype(U64) * U64(0xD1342543DE82EF95) + U64(0x9E3779B97F4A7C15)
    if len(first) == 0:
        return h
    data = _LOWER[data] if lower else data
    pieces = eights(data)
    todo = np.flatnonzero(size <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        todo = todo[size[todo] > k]
        if not len(todo):
            break
        left = np.minimum(size[todo] - k, 8)
        h[todo] = mix(h[todo] ^ (pieces[first[todo] + k] & _LOW_BYTES[left]) * U64(0xA0761D6478BD642F)) + U64(0x632BE59BD9B4E019)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[first[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(h)


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``size`` words; a row with fewer words, but some, gives all of them as one.

    ``counts``: words of each row, in the rows' order.
    """
    n_rows = len(counts)
    begin = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    row = np.repeat(np.arange(n_rows), counts)
    position = np.arange(len(hashes)) - begin[row]
    multiplier = np.arange(1, 2 * size, 2, dtype=U64) * U64(0xA0761D6478BD642F)
    whole = np.flatnonzero(position + size <= counts[row])
    h = np.zeros(len(whole), dtype=U64)
    for i in range(size):
        h = mix(h + hashes[whole + i] * multiplier[i])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        g = np.full(len(short), 0x5851F42D4C957F2D, dtype=U64)
        for i in range(size - 1):
            has = counts[short] > i
            g[has] = mix(g[has] + hashes[begin[short[has]] + i] * multiplier[i])
        h, r = np.concatenate([h, g]), np.concatenate([row[whole], short])
        order = np.argsort(r, kind="stable")
        return h[order], r[order]
    return h, row[whole]


def distinct_by_row(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each row, ordered by row then hash, with how often each occurs there."""
    if len(h) == 0:
        return h, row, np.zeros(0, np.int64)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    head = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
    at = np.flatnonzero(head)
    return h[at], row[at], np.diff(np.append(at, len(h)))


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as the signed numbers Spark has."""
    return x.view(np.int64)


def squeezed(numbers: np.ndarray, ascending: bool = False) -> bytes:
    """Whole numbers as compressed bytes; ascending ones by their gaps. Bytes of equal weight lie together."""
    gaps = np.diff(numbers, prepend=numbers.dtype.type(0)) if ascending else numbers
    planes = np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = 8 if not len(numbers) else max(1, 8 - int(np.argmax(planes[::-1].any(axis=1)))) if planes.any() else 1
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(planes[:used].tobytes())


def unsqueezed(raw: bytes, ascending: bool = False) -> np.ndarray:
    used = raw[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(used, -1)
    full = np.zeros((planes.shape[1], 8), np.uint8)
    full[:, :used] = planes.T
    out = full.reshape(-1).view("<u8")
    return np.cumsum(out, dtype=np.uint64) if ascending else out


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def thrifty(run: Callable) -> Callable:
    """An Arrow function that gives its memory back at the end: Python workers live on, idle, beside the next ones."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
