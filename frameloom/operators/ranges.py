"""Duration-range and aspect matching of videos without comparing all pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.config import DUPLICATE_VIDEOS, PLANS, DuplicateVideoRules
from frameloom.functions import media
from frameloom.session import cut_lineage

# Durations are measured in steps of their own tolerance, so that "within tolerance" is at most one
# step everywhere. Cells are a little narrower than a step: any two videos of one cell are in tolerance.
CELL_WIDTH = 0.98
REACH = 2


def tolerance_scale(duration: Column, rules: DuplicateVideoRules = DUPLICATE_VIDEOS) -> Column:
    """Seconds below the knee of max(seconds, ratio * duration), logarithmic above it."""
    knee = rules.min_tolerance_seconds / rules.tolerance_ratio
    step = math.log1p(rules.tolerance_ratio)
    low = duration / rules.min_tolerance_seconds
    high = knee / rules.min_tolerance_seconds + F.log(F.greatest(duration, F.lit(knee)) / knee) / step
    return F.when(duration < knee, low).otherwise(high)


def in_tolerance(shorter: Column, longer: Column, rules: DuplicateVideoRules = DUPLICATE_VIDEOS) -> Column:
    return longer - shorter <= F.greatest(F.lit(rules.min_tolerance_seconds), shorter * rules.tolerance_ratio)


def video_profiles(videos: DataFrame) -> DataFrame:
    """Videos with their duration and aspect ratio."""
    return videos.select(
        "asset_id",
        "duration",
        media.video_aspect_ratio(F.col("pixel_width"), F.col("pixel_height")).alias("aspect"),
    )


def _placed(videos: DataFrame, rules: DuplicateVideoRules) -> DataFrame:
    """Videos with their duration step and aspect step. Any two videos of one (step, shape) cell match."""
    return (
        video_profiles(videos)
        .withColumn("step", F.floor(tolerance_scale(F.col("duration"), rules) / CELL_WIDTH))
        .withColumn("shape", F.floor(F.col("aspect") / rules.max_aspect_difference))
    )


def videos_in_range(asked: np.ndarray, durations: np.ndarray, videos: np.ndarray, rules: DuplicateVideoRules) -> np.ndarray:
    """For each asked duration: how many videos have one in tolerance, from running counts over sorted ``durations``."""

    def fits(shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
        return longer - shorter <= np.maximum(rules.min_tolerance_seconds, shorter * rules.tolerance_ratio)

    n = len(durations)
    padded = np.append(durations, np.nan)  # fits nothing
    high = np.searchsorted(durations, asked + np.maximum(rules.min_tolerance_seconds, asked * rules.tolerance_ratio), "right")
    low = np.searchsorted(durations, np.minimum(asked - rules.min_tolerance_seconds, asked / (1 + rules.tolerance_ratio)), "left")
    # the last place of rounding is decided by the rule itself
    while (more := fits(asked, padded[high])).any():
        high += more
    while (less := (high > 0) & (padded[high - 1] >= asked) & ~fits(asked, padded[high - 1])).any():
        high -= less
    while (more := (low > 0) & fits(padded[low - 1], asked)).any():
        low -= more
    while (less := (low < n) & (padded[low] < asked) & ~fits(padded[low], asked)).any():
        low += less
    running = np.concatenate([[0], np.cumsum(videos)])
    return running[np.maximum(high, low)] - running[low]


def _count_in_range(rules: DuplicateVideoRules):
    """Profiles with those of a neighbouring cell: per aspect ratio of the cell, partners are a range of durations."""

    def run(askers: pa.Table, cell: pa.Table) -> pa.Table:
        duration, aspect = (np.asarray(askers.column(c)) for c in ("a_duration", "a_aspect"))
        partners = np.zeros(askers.num_rows, np.int64)
        if cell.num_rows and askers.num_rows:
            d, a, v = (np.asarray(cell.column(c)) for c in ("duration", "aspect", "videos"))
            order = np.lexsort((d, a))
            d, a, v = d[order], a[order], v[order]
            for lo, hi in zip(starts := np.flatnonzero(np.append(True, a[1:] != a[:-1])), np.append(starts[1:], len(a))):
                mine = np.flatnonzero(np.abs(aspect - a[lo]) <= rules.max_aspect_difference)
                partners[mine] += videos_in_range(duration[mine], d[lo:hi], v[lo:hi], rules)
        found = np.flatnonzero(partners)
        return pa.table({"duration": pa.array(duration[found]), "aspect": pa.array(aspect[found]), "videos": askers.column("a_videos").take(pa.array(found)), "partners": pa.array(partners[found])})

    return run


def candidate_partners(
    videos: DataFrame, rules: DuplicateVideoRules = DUPLICATE_VIDEOS, lot_profiles: int = PLANS.lot_profiles
) -> DataFrame:
    """Per distinct (duration, aspect): its videos and how many other videos pass the range join.

    The binned range join runs over distinct profiles with counts, so any number of videos of one length
    and shape is a single row. Profiles of one cell all match, so they are counted by the cell's total; between
    neighbouring cells the partners of a profile are ranges of sorted durations, counted without visiting them.
    """
    profiles = cut_lineage(
        _placed(videos, rules).groupBy("step", "shape", "duration", "aspect").agg(F.count("*").alias("videos"))
    )
    key = ["step", "shape"]
    totals = profiles.groupBy(*key).agg(F.sum("videos").alias("in_cell"))
    own = profiles.join(totals, key).select("duration", "aspect", "videos", (F.col("in_cell") - F.col("videos")).alias("partners"))
    same = profiles.select("duration", "aspect", "videos", (F.col("videos") - 1).alias("partners"))
    near = profiles.select(
        *[F.col(c).alias(f"a_{c}") for c in ("duration", "aspect", "videos", "step", "shape")],
        F.explode(F.sequence(F.col("step") - REACH, F.col("step") + REACH)).alias("step"),
    ).withColumn("shape", F.explode(F.sequence(F.col("a_shape") - 1, F.col("a_shape") + 1)))
    elsewhere = (F.col("step") != F.col("a_step")) | (F.col("shape") != F.col("a_shape"))
    # a busy cell is several lots on either side, so no task holds a whole one; those who ask are its neighbours
    lots = profiles.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(lot_profiles)).cast("int").alias("lots"))
    dealt = F.pmod(F.xxhash64("duration", "aspect"), F.col("lots")).cast("int")
    asked = F.pmod(F.xxhash64("a_duration", "a_aspect", F.lit(1)), F.col("lots") * 4).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("lots") - 1))
    held = profiles.join(lots, key).withColumn("lot", dealt).withColumn("from", F.explode(F.sequence(F.lit(0), F.col("lots") * 4 - 1)))
    askers = near.filter(elsewhere).join(lots, key).withColumn("from", asked).withColumn("lot", every)
    group = [*key, "lot", "from"]
    askers = askers.select(*[F.col(c).alias(f"q_{c}") for c in group], "a_duration", "a_aspect", "a_videos")
    across = (
        askers.groupBy(*[f"q_{c}" for c in group])
        .cogroup(held.select(*group, "duration", "aspect", "videos").groupBy(*group))
        .applyInArrow(_count_in_range(rules), "duration double, aspect double, videos long, partners long")
    )
    parts = own.unionByName(same).unionByName(across)
    return parts.groupBy("duration", "aspect").agg(F.max("videos").alias("videos"), F.sum("partners").alias("partners"))


def range_links(videos: DataFrame, rules: DuplicateVideoRules = DUPLICATE_VIDEOS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(videos with their cell, links between cells, cells that are groups by themselves): a graph with the
    components of the graph over all matching pairs.

    A cell is one step of duration and one step of aspect ratio. Any two of its videos match, so a cell is a
    single node and needs no pairs. Two cells are linked when any of their videos match, which is decided
    without comparing videos:

    * same duration step: the widest of the narrower cell against the narrowest of the wider one;
    * same aspect step: the longest of the shorter cell against the shortest of the longer one. That is the
      closest pair, and the tolerance grows with the shorter duration;
    * both steps different: the same test for each pair of exact aspect ratios, of which a step holds few.
    """
    placed = _placed(videos, rules)
    # few rows, read by every test below: one pass over the videos instead of one per test
    ratios = cut_lineage(
        placed.groupBy("step", "shape", "aspect").agg(
            F.count("*").alias("videos"), F.min("duration").alias("shortest"), F.max("duration").alias("longest")
        )
    )
    cells = ratios.groupBy("step", "shape").agg(
        F.sum("videos").alias("videos"),
        F.min("shortest").alias("shortest"),
        F.max("longest").alias("longest"),
        F.min("aspect").alias("narrowest"),
        F.max("aspect").alias("widest"),
    )

    def shifted(rows: DataFrame, steps: Column, shapes: Column) -> DataFrame:
        """Rows as the left side of an equi-join on the step and shape they look at."""
        own = rows.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns])
        return own.withColumn("step", F.explode(steps)).withColumn("shape", F.explode(shapes))

    def name(prefix: str = "") -> Column:
        return F.concat_ws("@", f"{prefix}step", f"{prefix}shape")

    step, shape = F.col("a_step"), F.col("a_shape")
    later = F.array(*[step + i for i in range(1, REACH + 1)])
    bound = rules.max_aspect_difference
    on = ["step", "shape"]
    side_by_side = (
        shifted(cells, F.array(step), F.array(shape + 1))
        .join(cells, on)
        .filter(F.col("narrowest") - F.col("a_widest") <= bound)
    )
    one_after_another = (
        shifted(cells, later, F.array(shape))
        .join(cells, on)
        .filter(in_tolerance(F.col("a_longest"), F.col("shortest"), rules))
    )
    across = (
        shifted(ratios, later, F.array(shape - 1, shape + 1))
        .join(ratios, on)
        .filter(
            in_tolerance(F.col("a_longest"), F.col("shortest"), rules)
            & (F.abs(F.col("a_aspect") - F.col("aspect")) <= bound)
        )
    )
    links = [part.select(name("a_").alias("a"), name().alias("b")) for part in (side_by_side, one_after_another, across)]
    own = cells.filter("videos > 1").select(name().alias("cell"))
    return (
        placed.select("asset_id", name().alias("cell")),
        links[0].unionByName(links[1]).unionByName(links[2].distinct()),
        own,
    )
