"""Feature vectors, difference hashes and their distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.config import DUPLICATE_PHOTOS, DuplicatePhotoRules

GRID_COLUMNS, GRID_ROWS = 9, 8


def _sum_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(vector: Column) -> Column:
    """Unit vector in double of a usable vector; empty and all-zero vectors give NULL elements or none,
    so filter with ``is_usable`` first."""
    v = vector.cast("array<double>")
    # array_repeat evaluates the norm once per row; inside the lambda it would be once per element
    return F.zip_with(v, F.array_repeat(F.nullif(l2_norm(v), F.lit(0.0)), F.size(v)), lambda x, n: x / n)


def is_usable(vector: Column) -> Column:
    """Predicate on a raw vector: not empty, no NULL inside, not all zero."""
    return F.coalesce(l2_norm(vector) > 0, F.lit(False))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Dot product of unit vectors clamped to [-1, 1]; 0 on length mismatch or empty input."""
    dot = _sum_of(F.zip_with(a, b, lambda x, y: x * y))
    clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), clamped).otherwise(F.lit(0.0))


def feature_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of unit vectors; NULL (never a match) when they cannot be compared."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.sqrt(_sum_of(squares)))


def dhash(grid: Column) -> Column:
    """64 left < right comparisons of a 9 x 8 grid, row by row, first comparison in the highest bit."""

    # the grid stays outside the lambdas: an inlined grid expression would run once per bit
    rising = F.zip_with(grid, F.slice(grid, 2, GRID_COLUMNS * GRID_ROWS - 1), lambda left, right: left < right)
    within_row = F.filter(rising, lambda _, i: i % GRID_COLUMNS != GRID_COLUMNS - 1)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    bits = F.aggregate(within_row, zero, lambda h, up: F.shiftleft(h, 1).bitwiseOR(F.when(up, one).otherwise(zero)))
    return F.when(F.size(grid) == GRID_COLUMNS * GRID_ROWS, bits)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def classify_match(distance: Column, bits: Column, rules: DuplicatePhotoRules = DUPLICATE_PHOTOS) -> Column:
    return (
        F.when((distance <= rules.max_distance) & (bits <= rules.max_hamming), F.lit("duplicate"))
        .when((distance <= rules.similar_max_distance) & (bits <= rules.similar_max_hamming), F.lit("similar"))
        .otherwise(F.lit("distinct"))
    )


def fingerprint_key(*parts: Column) -> Column:
    """128 hash bits over everything a match depends on: equal keys are identical copies.

    Two 64-bit hashes with different seeds; both read the binary values inside generated code, which is
    far cheaper than hashing the text of a vector.
    """
    return F.concat(
        F.lpad(F.hex(F.xxhash64(*parts)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("second"), *reversed(parts))), 16, "0")
    )
