"""Close pairs of 64-bit hashes inside a task, without comparing all with all.

The bits in which the hashes differ at all are cut into k groups. Two hashes at most r bits apart agree in k - r groups at least, so
hashes are sorted by every choice of k - r groups, and only those with equal bits there are compared. More groups mean more
sorting and smaller sets; k is what costs least for the number of hashes at hand. A set that is still large is cut again
by the bits in which its own hashes differ: concentrated hashes, as flat pictures have, are split until they are few or all that
differ is a few bits.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np

# Sets that are compared as a whole, and pairs held at a time.
SET_ROWS = 2048
PAIRS_AT_ONCE = 1 << 21

Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _groups(bits: np.ndarray, k: int) -> list[np.uint64]:
    """Masks of k groups of these bits, of about one size."""
    cuts = [round(i * len(bits) / k) for i in range(k + 1)]
    return [np.uint64(sum(1 << int(b) for b in bits[lo:hi])) for lo, hi in zip(cuts, cuts[1:])]


def _choice(rows: int, bits: int, radius: int) -> int:
    """Number of groups with the least work: a sort for each choice of groups, and the pairs in its sets."""

    def work(k: int) -> float:
        in_set = rows / 2.0 ** (bits * (k - radius) / k)
        return math.comb(k, radius) * rows * (20.0 + math.log2(max(rows, 2)) + in_set / 2.0)

    return min(range(radius + 1, min(bits, radius + 7) + 1), key=work)


def all_pairs(hashes: np.ndarray, ends: np.ndarray, radius: int) -> Iterator[Pairs]:
    """Close pairs of places whose row lies before ``ends`` of the first."""
    n = len(hashes)
    count = ends - np.arange(n) - 1
    total = np.concatenate([[0], np.cumsum(count)])
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS_AT_ONCE, side="right")) - 1)
        some = count[lo:hi]
        ia = np.repeat(np.arange(lo, hi), some)
        ib = ia + 1 + np.arange(len(ia)) - np.repeat(total[lo:hi] - total[lo], some)
        bits = np.bitwise_count(hashes[ia] ^ hashes[ib])
        close = bits <= radius
        if close.any():
            yield ia[close], ib[close], bits[close]
        lo = hi


def close_pairs(hashes: np.ndarray, radius: int) -> Iterator[Pairs]:
    """(i, j, bits) of every pair of rows whose hashes differ in at most ``radius`` bits, once, in parts."""
    n = len(hashes)
    if n < 2:
        return
    differ = np.bitwise_or.reduce(hashes ^ hashes[0])
    bits = np.array([b for b in range(64) if int(differ) >> b & 1])
    if n <= SET_ROWS or len(bits) <= radius + 1:
        yield from all_pairs(hashes, np.full(n, n), radius)
        return
    k = _choice(n, len(bits), radius)
    masks = _groups(bits, k)
    for chosen in itertools.combinations(range(k), k - radius):
        key = hashes & np.bitwise_or.reduce([masks[g] for g in chosen])
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(heads, n))
        # sets of one row have no pairs, large ones are cut again
        small = order[np.repeat((sizes > 1) & (sizes <= SET_ROWS), sizes)]
        kept = sizes[(sizes > 1) & (sizes <= SET_ROWS)]
        parts = [(small, all_pairs(hashes[small], np.repeat(np.cumsum(kept), kept), radius))]
        for at in np.flatnonzero(sizes > SET_ROWS):
            rows = order[heads[at] : heads[at] + sizes[at]]
            parts.append((rows, close_pairs(hashes[rows], radius)))
        for rows, found in parts:
            for ia, ib, apart in found:
                ia, ib = rows[ia], rows[ib]
                # a pair counts for the first groups that it agrees in
                first, left = np.ones(len(ia), bool), np.full(len(ia), k - radius)
                for g in range(chosen[-1] + 1):
                    agree = (hashes[ia] ^ hashes[ib]) & masks[g] == 0
                    first &= agree == (g in chosen)
                    left -= agree
                first &= left == 0
                if first.any():
                    yield np.minimum(ia, ib)[first], np.maximum(ia, ib)[first], apart[first]
