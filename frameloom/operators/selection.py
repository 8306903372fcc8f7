"""The first n rows under an order, found without sorting.

The size at rank n comes from histograms over the digits of the sizes, leading ones first: each pass counts the rows of the digit that
the rank falls into, and what is collected is one number for each value of a digit. Where more rows than are wanted share
that size, the same goes on over the characters of their names. One filter then tells the first n rows from the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.config import LARGE_VIDEOS, LargeVideoRules
from frameloom.operators.ranking import top_count

DIGIT_BITS = 14


def _nth_size(rows: DataFrame, n: int, size: str, digit_bits: int) -> tuple[int, int, int]:
    """(size at rank n from the largest, rows that are larger, rows of that size)."""
    low, high = rows.agg(F.min(size), F.max(size)).first()
    before, base, shift = 0, low, max(0, (high - low).bit_length() - digit_bits)
    here = rows
    while True:
        digit = F.shiftright(F.col(size) - F.lit(base), shift)
        counts = sorted(here.groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
        for row in counts:
            if before + row.n >= n:
                break
            before += row.n
        base += row.digit << shift
        if not shift:
            return base, before, row.n
        here = rows.filter(F.col(size).between(base, base + (1 << shift) - 1))
        shift = max(0, shift - digit_bits)


def _nth_name(rows: DataFrame, n: int, name: str) -> str:
    """The name at rank n; names are unique or equal rows share one."""
    prefix, before = "", 0
    while True:
        here = rows.filter(F.col(name).startswith(prefix)) if prefix else rows
        low, high, count = here.agg(F.min(name), F.max(name), F.count(F.lit(1))).first()
        if low == high or before + 1 == n:
            return low
        if before + count == n:
            return high
        while len(prefix) < min(len(low), len(high)) and low[len(prefix)] == high[len(prefix)]:
            prefix += low[len(prefix)]
        step = F.substring(F.col(name), len(prefix) + 1, 1)
        counts = sorted(here.filter(F.col(name).startswith(prefix)).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect())
        for row in counts:
            if before + row.n >= n:
                break
            before += row.n
        if not row.step:  # the name that ends here
            return prefix
        prefix += row.step


def is_among_first(rows: DataFrame, n: int, size: str = "file_size", name: str = "asset_id", digit_bits: int = DIGIT_BITS) -> Column:
    """Whether a row is among the n of largest size, ties by the smaller name; rows without a size come last, by name.

    ``rows`` is read a few times: pass a checkpointed or stored table. Names are unique and not null.
    """
    sized = rows.filter(F.col(size).isNotNull())
    known = sized.count()
    if n <= 0:
        return F.lit(False)
    if n <= known:
        nth, larger, equal = _nth_size(sized, n, size, digit_bits)
        first = F.col(size) > nth
        ties = rows.filter(F.col(size) == nth)
        same, wanted, of_size = F.col(size) == nth, n - larger, equal
    else:
        first, same = F.col(size).isNotNull(), F.col(size).isNull()
        ties = rows.filter(same)
        wanted, of_size = n - known, ties.count()
    if wanted < of_size:
        same = same & (F.col(name) <= _nth_name(ties, wanted, name))
    return F.coalesce(first | same, F.lit(False)) if n <= known else first | same


def mark_top(rows: DataFrame, rules: LargeVideoRules = LARGE_VIDEOS) -> DataFrame:
    """``rows`` with is_top for the leading fraction by size, as ``ranking.mark_top`` gives it for ranked rows."""
    return rows.withColumn("is_top", is_among_first(rows, top_count(rows.count(), rules)))
