"""Scalar columns over one asset row. All are built-in expressions inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.config import BIN, LARGE_VIDEOS, MIB, BinRules, LargeVideoRules


def pixels(width: Column, height: Column) -> Column:
    return width.cast("long") * height.cast("long")


def _ratio(width: Column, height: Column) -> Column:
    return F.greatest(width, height).cast("double") / F.least(width, height).cast("double")


def photo_aspect_ratio(width: Column, height: Column) -> Column:
    """Long side over short side; sides below 1 count as 1."""
    one = F.lit(1)
    return _ratio(F.greatest(width, one), F.greatest(height, one))


def video_aspect_ratio(width: Column, height: Column) -> Column:
    """Long side over short side; 1.0 when either side is not positive."""
    return F.when((width > 0) & (height > 0), _ratio(F.greatest(width, F.lit(1)), F.greatest(height, F.lit(1)))).otherwise(
        F.lit(1.0)
    )


def aspect_tier(width: Column, height: Column, scale: int = 100) -> Column:
    return F.round(photo_aspect_ratio(width, height) * scale).cast("int")


def megapixel_tier(width: Column, height: Column, scale: int = 2) -> Column:
    one = F.lit(1)
    area = F.greatest(width, one).cast("double") * F.greatest(height, one).cast("double")
    return F.round(area / 1_000_000.0 * scale).cast("int")


def format_duration(seconds: Column) -> Column:
    """MM:SS, or H:MM:SS from one hour on."""
    total = F.round(seconds).cast("long")
    hours = F.floor(total / 3600)
    minutes = F.floor((total % 3600) / 60)
    rest = total % 60
    return (
        F.when((seconds > 0) & (hours > 0), F.format_string("%d:%02d:%02d", hours, minutes, rest))
        .when(seconds > 0, F.format_string("%02d:%02d", minutes, rest))
        .otherwise(F.lit("00:00"))
    )


def format_total_duration(seconds: Column) -> Column:
    """Two leading units of a summed duration."""
    total = F.round(seconds).cast("long")
    hours = F.floor(total / 3600)
    minutes = F.floor((total % 3600) / 60)
    rest = total % 60
    return (
        F.when(hours > 0, F.format_string("%dh %dm", hours, minutes))
        .when(minutes > 0, F.format_string("%dm %ds", minutes, rest))
        .otherwise(F.format_string("%ds", rest))
    )


def _decimal_text(size: Column, unit: int, digits: int) -> Column:
    # whole-number arithmetic, so that no engine's float formatting decides the last digit
    step = unit // 10**digits
    scaled = F.floor((size + step // 2) / F.lit(step)).cast("long")
    if digits == 0:
        return scaled.cast("string")
    base = 10**digits
    return F.concat(
        F.floor(scaled / F.lit(base)).cast("string"),
        F.lit("."),
        F.lpad((scaled % base).cast("string"), digits, "0"),
    )


def format_bytes(size: Column, null_if_unknown: bool = True) -> Column:
    """Decimal units: B and KB whole, MB one digit, GB and TB two."""
    text = (
        F.when(size < 1000, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1_000_000, F.concat(_decimal_text(size, 1000, 0), F.lit(" KB")))
        .when(size < 1_000_000_000, F.concat(_decimal_text(size, 1_000_000, 1), F.lit(" MB")))
        .when(size < 1_000_000_000_000, F.concat(_decimal_text(size, 1_000_000_000, 2), F.lit(" GB")))
        .otherwise(F.concat(_decimal_text(size, 1_000_000_000_000, 2), F.lit(" TB")))
    )
    return F.when(size > 0, text) if null_if_unknown else F.when(size.isNotNull(), text)


def resolution_label(width: Column, height: Column, separator: str = " × ") -> Column:
    """4K / 1080p / 720p in either orientation, else the size, "" when unknown."""
    long_side, short_side = F.greatest(width, height), F.least(width, height)
    return (
        F.when(~((width > 0) & (height > 0)), F.lit(""))
        .when((long_side >= 3840) & (short_side >= 2160), F.lit("4K"))
        .when((long_side >= 1920) & (short_side >= 1080), F.lit("1080p"))
        .when((long_side >= 1280) & (short_side >= 720), F.lit("720p"))
        .otherwise(F.concat(width.cast("string"), F.lit(separator), height.cast("string")))
    )


def bin_kind(kind: Column) -> Column:
    return F.when(kind == "video", F.lit("video")).otherwise(F.lit("photo"))


def known_size(size: Column) -> Column:
    """NULL and non-positive sizes both mean unknown."""
    return F.when(size > 0, size)


def resolve_size(own: Column, looked_up: Column) -> Column:
    return F.coalesce(known_size(own), known_size(looked_up), own)


def estimated_size(duration: Column, rules: LargeVideoRules = LARGE_VIDEOS) -> Column:
    return F.greatest(
        F.lit(rules.min_estimated_bytes).cast("long"), (duration * rules.bytes_per_second).cast("long")
    )


def days_remaining(deleted_at: Column, now: Column, rules: BinRules = BIN) -> Column:
    """Whole days until the retention ends, never below 0."""
    ends = F.unix_micros(deleted_at.cast("timestamp")) + rules.retention_days * 86_400_000_000
    left = F.floor((ends - F.unix_micros(now.cast("timestamp"))) / 86_400_000_000)
    return F.greatest(F.lit(0), left.cast("int"))


def is_expired(deleted_at: Column, now: Column, rules: BinRules = BIN) -> Column:
    return days_remaining(deleted_at, now, rules) == 0


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with a denominator of at least 1."""
    return part.cast("double") / F.greatest(whole, F.lit(1)).cast("double") * 100.0


_MIB = float(MIB)

# Overlapping by design: a name is a predicate, not a partition. NULL sizes match only "all".
VIDEO_SIZE_FILTERS = {
    "all": lambda size: F.lit(True),
    "under100MB": lambda size: size / _MIB < 100,
    "under500MB": lambda size: size / _MIB < 500,
    "under1GB": lambda size: size / _MIB < 1024,
    "over1GB": lambda size: size / _MIB >= 1024,
}
LARGE_VIDEO_SIZE_FILTERS = {
    "all": lambda size: F.lit(True),
    "min100MB": lambda size: size / _MIB >= 100,
    "min500MB": lambda size: size / _MIB >= 500,
    "min1GB": lambda size: size / _MIB >= 1024,
    "min2GB": lambda size: size / _MIB >= 2048,
}
GROUP_SIZE_FILTERS = {
    "all": lambda size: F.lit(True),
    "under100MB": lambda size: size / _MIB < 100,
    "between100And500MB": lambda size: (size / _MIB >= 100) & (size / _MIB < 500),
    "min500MB": lambda size: size / _MIB >= 500,
    "min1GB": lambda size: size / _MIB >= 1024,
}


def size_matches(filters: dict, name: str, size: Column) -> Column:
    return F.coalesce(filters[name](size), F.lit(False))
