"""All thresholds, as frozen objects that operators take as arguments.

The values of the rule classes are fixed values: results depend on them.
"""

from __future__ import annotations

from dataclasses import dataclass

MIB = 1024 * 1024


@dataclass(frozen=True)
class DuplicatePhotoRules:
    """Re-encoded copies of one picture."""

    max_hamming: int = 4
    max_distance: float = 0.05
    similar_max_hamming: int = 16
    similar_max_distance: float = 0.22
    aspect_scale: int = 100
    megapixel_scale: int = 2


@dataclass(frozen=True)
class SimilarPhotoRules:
    """Different shots of one subject; pairs over the ceiling with close hashes are duplicates, not similar."""

    threshold: float = 0.86
    duplicate_ceiling: float = 0.985
    max_duplicate_hamming: int = 4
    max_aspect_difference: float = 0.35


@dataclass(frozen=True)
class DuplicateVideoRules:
    """Stage 1 compares duration and shape, stage 2 compares keyframes in order."""

    min_tolerance_seconds: float = 1.0
    tolerance_ratio: float = 0.03
    max_aspect_difference: float = 0.25
    max_frame_distance: float = 0.22
    max_mean_distance: float = 0.16
    min_frames: int = 4
    max_frames: int = 5
    sample_fractions: tuple[float, ...] = (0.10, 0.30, 0.50, 0.70, 0.90)
    frame_tolerance_seconds: float = 0.2
    min_duration_seconds: float = 0.3
    min_sampled_frames: int = 3


@dataclass(frozen=True)
class LargeVideoRules:
    top_fraction: float = 0.15
    min_estimated_bytes: int = 500_000
    bytes_per_second: float = 2_500_000.0


@dataclass(frozen=True)
class BinRules:
    retention_days: int = 30
    urgent_days: int = 3


@dataclass(frozen=True)
class MatchTuning:
    """Physical knobs of the pair matcher; no value changes a result."""

    # most rows and bytes of vectors of one block: a task holds two blocks, and each row is copied once per block
    # of its scope, so blocks are as large as a task has room for
    block_rows: int = 65_536
    block_bytes: int = 32 * MIB
    # a task scores tile x tile pairs at a time, so this bounds its working memory
    tile_rows: int = 512
    # scopes above this many rows are split on vector cells (and hash bands where the scorer has hashes)
    split_rows: int = 50_000
    # scopes of photos with hashes above this many rows are parted into those of close hashes before vectors are moved
    hash_rows: int = 4096
    # bounds of what is collected and shipped to the tasks
    max_pivots: int = 1024
    # pivots every row is matched with to find hot families; 256 miss one of 5 % of the rows once in 500,000 runs,
    # and a missed family costs time, not results
    max_hubs: int = 256
    # rows of a run that all others are matched with first where only connectivity is wanted: a family of 2 % of a
    # block is missed once in four, and then costs time, not results
    run_hubs: int = 64
    # moving one row is reckoned as dear as scoring this many pairs when the number of cells is chosen
    pairs_per_moved_row: float = 2000.0
    sample_rows: int = 4096
    # partitions that are put together at most
    partitions: int = 4
    # principal directions that a grid of cells may cut and pieces of one at most; sample rows that its work is estimated on
    grid_directions: int = 12
    grid_bins: int = 64
    cost_rows: int = 2048
    # families whose pairs are summed at most; the least rows of one in the sample, and the least share of it
    max_families: int = 64
    family_rows: int = 8
    family_share: float = 0.005
    # near rows that balls are sought in, at most 8,192, and the least rows of one; sides of directions that put rows in order, and rows
    # that directions come from where a task finds them
    chunk_rows: int = 2048
    ball_rows: int = 4
    # share of rows in balls from which no cells are made
    balls_share: float = 0.75
    code_bits: int = 24
    direction_rows: int = 512


@dataclass(frozen=True)
class ReportRules:
    # smallest share of the overview's ring that a category is drawn with
    min_share: float = 0.02


@dataclass(frozen=True)
class PlanTuning:
    """Physical knobs of the other operators; no value changes a result."""

    # rounds of component contraction before it is an error, and edges a task contracts before the first
    component_rounds: int = 60
    local_edges: int = 200_000
    # ranks within a group use a window up to this many rows of one group, ranges of the full key beyond
    window_rows: int = 1_000_000
    # distinct duration profiles of a cell that a task holds
    lot_profiles: int = 100_000


DUPLICATE_PHOTOS = DuplicatePhotoRules()
SIMILAR_PHOTOS = SimilarPhotoRules()
DUPLICATE_VIDEOS = DuplicateVideoRules()
LARGE_VIDEOS = LargeVideoRules()
BIN = BinRules()
TUNING = MatchTuning()
REPORT = ReportRules()
PLANS = PlanTuning()
