"""Exact pair matching inside scopes, reduced where the pairs are found.

A *node* is one distinct fingerprint (identical copies are one weighted node). Nodes of one *scope* may
match each other. No pair ever leaves the task that scored it: a task compares two blocks of bounded size
and returns, per matched node, a local tree edge plus pair count, score sum and best score. A group of k
matching nodes therefore costs O(k) rows per block pair and never k * k rows.

Scopes beyond ``split_rows`` are first cut into cells that keep every possible match together:

* vector cells: each node goes to its nearest pivot's cell and, among those with a lower number, to every cell whose
  bisecting plane is within the match radius. Two matching points always meet in the lower of their two
  home cells, and only there is the pair scored;
* cells of the scorer itself: bands of the difference hash, or bins of the aspect ratio.

Pivots may be taken by a single frame of videos, and cells may be boxes over the leading principal directions of a sample, for a
projection never lengthens a distance. Several such partitions are put together, as long as one more lessens the work
estimated on the sample. Rows that lie close together are put into small balls beforehand and stay together in
blocks; inside a task, balls too far apart to hold a match are not scored: clusters cost their own pairs, and a pair of centres for each
pair of balls.

Where only connectivity is wanted, nodes are first compared with the pivots. Nodes matching the same pivot
are connected already, so the largest such family of a cell is compared with the rest of the cell but not
with itself: a hot family of near copies costs linear work. Callers can name such sets themselves: nodes that share a
value of ``settled`` are not compared with each other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.config import (
    DUPLICATE_PHOTOS,
    DUPLICATE_VIDEOS,
    SIMILAR_PHOTOS,
    TUNING,
    DuplicatePhotoRules,
    DuplicateVideoRules,
    MatchTuning,
    SimilarPhotoRules,
)
from frameloom.functions import vectors as V
from frameloom.operators.components import connected_components, join_labels
from frameloom.operators.hamming import SET_ROWS, all_pairs, close_pairs
from frameloom.session import cut_lineage

Hits = tuple[np.ndarray, np.ndarray, np.ndarray]

MATCH_SCHEMA = "node string, root string, matches long, score_sum double, best_score double"


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _lengths(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return pc.list_value_length(column).to_numpy(zero_copy_only=False)


def _hashes(column) -> tuple[np.ndarray, np.ndarray]:
    known = ~np.asarray(column.is_null())
    return column.fill_null(0).to_numpy().astype(np.int64).view(np.uint64), known


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _may_be_within(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Whether rows may be so near: one product in single precision, with room for its rounding."""
    one, other = (a * a).sum(1), (b * b).sum(1)
    left = np.column_stack([-2.0 * a, one, np.ones(len(a))]).astype(np.float32)
    right = np.column_stack([b, np.ones(len(b)), other]).astype(np.float32)
    largest = max(1.0, np.fmax.reduce(one, initial=0.0), np.fmax.reduce(other, initial=0.0))
    return left @ right.T <= np.float32(limit * limit + 1e-6 * (a.shape[1] + 100) * largest)


def _pair_distances(a: np.ndarray, b: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Distances of single pairs by their differences: exact to the last digits, also near zero."""
    out = np.empty(len(ia))
    step = max(1, (1 << 20) // max(1, a.shape[1]))
    for i in range(0, len(ia), step):
        gap = a[ia[i : i + step]] - b[ib[i : i + step]]
        out[i : i + step] = np.sqrt((gap * gap).sum(axis=1))
    return out


def _pair_cosines(points: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    out = np.empty(len(ia))
    step = max(1, (1 << 20) // max(1, points.shape[1]))
    for i in range(0, len(ia), step):
        out[i : i + step] = (points[ia[i : i + step]] * points[ib[i : i + step]]).sum(axis=1)
    return np.clip(out, -1.0, 1.0)


# Hash bands: with 4 differing bits spread over 5 bands, one band is equal.
def band_edges(max_hamming: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of max_hamming + 1 bands over 64 bits."""
    bands = max_hamming + 1
    cuts = [round(i * 64 / bands) for i in range(bands + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


@dataclass(frozen=True)
class DuplicateScorer:
    """Close hashes, then close vectors; the score is the distance."""

    rules: DuplicatePhotoRules = DUPLICATE_PHOTOS
    columns = ("dhash", "vec")
    best = "min"
    has_points = True
    self_score = 0.0

    @property
    def radius(self) -> float:
        return self.rules.max_distance

    widths = staticmethod(lambda rows: _lengths(rows["vec"]))

    @staticmethod
    def row_bytes() -> Column:
        return F.greatest(F.size("vec") * 8, F.lit(8))

    def prepare(self, rows: pa.Table) -> dict:
        hashes, known = _hashes(rows["dhash"])
        return {"points": _matrix(rows["vec"], rows.num_rows), "hash": hashes, "known": known}

    def score(self, a: dict, b: dict) -> Hits:
        close = np.bitwise_count(a["hash"][:, None] ^ b["hash"][None, :]) <= self.rules.max_hamming
        close &= a["known"][:, None] & b["known"][None, :]
        if not close.any():
            return _NO_HITS
        if close.mean() > 0.05:  # one product is less work than many pairs; what it finds is measured again
            close &= _distances(a["points"], b["points"]) <= self.rules.max_distance + 1e-6
        ia, ib = np.nonzero(close)
        distance = _pair_distances(a["points"], b["points"], ia, ib)
        near = distance <= self.rules.max_distance
        return ia[near], ib[near], distance[near]

    def pairs_of_runs(self, data: dict, ends: np.ndarray) -> Iterator[Hits]:
        """Matches of places whose row lies before ``ends`` of the first, in parts."""
        for ia, ib, _ in all_pairs(data["hash"], ends, self.rules.max_hamming):
            known = data["known"][ia] & data["known"][ib]
            ia, ib = ia[known], ib[known]
            distance = _pair_distances(data["points"], data["points"], ia, ib)
            near = distance <= self.rules.max_distance
            yield ia[near], ib[near], distance[near]

    def split(self, nodes: DataFrame) -> DataFrame:
        keys = [
            F.struct(
                F.lit(i).alias("band"),
                F.shiftrightunsigned("dhash", lo).bitwiseAND(F.lit((1 << width) - 1)).alias("bits"),
            )
            for i, (lo, width) in enumerate(band_edges(self.rules.max_hamming))
        ]
        return (
            nodes.withColumn("_k", F.explode(F.array(*keys)))
            .withColumn("cell", F.concat_ws(":", "_k.band", "_k.bits"))
            .withColumn("band", F.col("_k.band"))
            .drop("_k")
        )

    def first_band(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of the first band in which two hashes agree: where the pair is scored."""
        x = a ^ b
        found = np.full(x.shape, -1)
        for i, (lo, width) in reversed(list(enumerate(band_edges(self.rules.max_hamming)))):
            found[(x >> np.uint64(lo)) & np.uint64((1 << width) - 1) == 0] = i
        return found


@dataclass(frozen=True)
class SimilarScorer:
    """Close aspect ratio and high cosine, minus true duplicates; the score is the cosine."""

    rules: SimilarPhotoRules = SIMILAR_PHOTOS
    columns = ("dhash", "vec", "aspect")
    best = "max"
    has_points = True
    self_score = 1.0

    @property
    def radius(self) -> float:
        return float(np.sqrt(max(0.0, 2.0 - 2.0 * self.rules.threshold)))

    widths = staticmethod(lambda rows: _lengths(rows["vec"]))

    @staticmethod
    def row_bytes() -> Column:
        return F.greatest(F.size("vec") * 8, F.lit(8))

    def prepare(self, rows: pa.Table) -> dict:
        hashes, known = _hashes(rows["dhash"])
        return {
            "points": _matrix(rows["vec"], rows.num_rows),
            "hash": hashes,
            "known": known,
            "aspect": rows["aspect"].to_numpy(),
        }

    def score(self, a: dict, b: dict) -> Hits:
        cosine = np.clip(a["points"] @ b["points"].T, -1.0, 1.0)
        close = cosine >= self.rules.threshold
        if not close.any():
            return _NO_HITS
        close &= np.abs(a["aspect"][:, None] - b["aspect"][None, :]) <= self.rules.max_aspect_difference
        ia, ib = np.nonzero(close)
        return self._but_duplicates(a, b, ia, ib, cosine[ia, ib])

    def _but_duplicates(self, a: dict, b: dict, ia: np.ndarray, ib: np.ndarray, value: np.ndarray) -> Hits:
        bits = np.bitwise_count(a["hash"][ia] ^ b["hash"][ib])
        duplicate = (
            (value >= self.rules.duplicate_ceiling)
            & a["known"][ia]
            & b["known"][ib]
            & (bits <= self.rules.max_duplicate_hamming)
        )
        return ia[~duplicate], ib[~duplicate], value[~duplicate]

    def pairs_of_runs(self, data: dict, ends: np.ndarray) -> Iterator[Hits]:
        """Matches of places whose row lies before ``ends`` of the first, in parts."""
        for ia, ib, _ in all_pairs(np.zeros(len(ends), np.uint64), ends, 0):
            near = np.abs(data["aspect"][ia] - data["aspect"][ib]) <= self.rules.max_aspect_difference
            ia, ib = ia[near], ib[near]
            value = _pair_cosines(data["points"], ia, ib)
            close = value >= self.rules.threshold
            yield self._but_duplicates(data, data, ia[close], ib[close], value[close])

    def split(self, nodes: DataFrame) -> DataFrame:
        own = F.floor(F.col("aspect") / self.rules.max_aspect_difference)
        return (
            nodes.withColumn("_own", own)
            .withColumn("_k", F.explode(F.array(F.col("_own"), F.col("_own") - 1)))
            .withColumn("cell", F.col("_k").cast("string"))
            .withColumn("home", F.col("_k") == F.col("_own"))
            .drop("_k", "_own")
        )


# Steps of a code on each side of zero, and what room codes need: no vector of at most this many components is further from its code.
CODE_STEPS = 32767
CODE_WIDTH = 1 << 16
CODE_SLACK = 0.005
# What a product of two rows costs beside a unit for each component, and what a component costs where pairs are measured singly.
PRODUCT_COST = 24.0
PAIR_COST = 60.0
# Room for rounding in bounds of single precision.
BOUND_ROOM = 1e-6


@dataclass(frozen=True)
class CodeScorer:
    """Whether ``SimilarScorer`` could match two vectors, by whole numbers that stand for them: every match is among the hits.

    ``digits`` times ``scale`` is the vector but for ``slack``, so a product of codes is that of the vectors but for both slacks.
    """

    rules: SimilarPhotoRules = SIMILAR_PHOTOS
    columns = ("digits", "scale", "slack", "aspect")
    best = "max"
    has_points = True
    self_score = 1.0
    # rows are a quarter as wide as vectors
    block_factor = 2

    @property
    def radius(self) -> float:
        return SimilarScorer(self.rules).radius + 2.0 * CODE_SLACK

    widths = staticmethod(lambda rows: pc.binary_length(rows["digits"]).to_numpy() // 2)

    @staticmethod
    def row_bytes() -> Column:
        return F.greatest(F.length("digits"), F.lit(8))

    def prepare(self, rows: pa.Table) -> dict:
        scale = rows["scale"].to_numpy().astype(np.float32)
        column = rows["digits"].combine_chunks()
        _, ends, data = column.buffers()
        ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + rows.num_rows + 1]
        points = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.int16).reshape(rows.num_rows, -1).astype(np.float32)
        points *= scale[:, None]
        return {"points": points, "slack": rows["slack"].to_numpy(), "aspect": rows["aspect"].to_numpy()}

    @staticmethod
    def _room(width: int) -> float:
        # rounding of single precision, in the products and in the points
        return 1e-7 * (width + 100)

    def score(self, a: dict, b: dict) -> Hits:
        cosine = a["points"] @ b["points"].T
        close = cosine >= self.rules.threshold - 2.0 * CODE_SLACK - self._room(a["points"].shape[1])
        if not close.any():
            return _NO_HITS
        close &= np.abs(a["aspect"][:, None] - b["aspect"][None, :]) <= self.rules.max_aspect_difference
        ia, ib = np.nonzero(close)
        return self._within_slack(a, b, ia, ib, cosine[ia, ib])

    def _within_slack(self, a: dict, b: dict, ia: np.ndarray, ib: np.ndarray, value: np.ndarray) -> Hits:
        value = value.astype(float)
        one, other = a["slack"][ia], b["slack"][ib]
        near = value + one + other + one * other + self._room(a["points"].shape[1]) >= self.rules.threshold
        return ia[near], ib[near], value[near]

    def bounds(self, data: dict, sample_rows: int) -> np.ndarray:
        """Short rows whose products are at least those of the codes: leading components and the length of what is left.

        How many components are taken is what costs least on a sample of the rows; all of them is always a choice.
        """
        points = data["points"]
        width = points.shape[1]
        # rows with anything but numbers match nothing
        whole = np.isfinite(points).all(axis=1)
        some = points[whole][:: max(1, -(-int(whole.sum()) // sample_rows))].astype(float)
        if not len(some):
            return points
        directions = np.linalg.svd(some, full_matrices=False)[2].T
        least = self.least(data)
        if not least > 0.0:
            return points

        def shortened(rows: np.ndarray, count: int) -> np.ndarray:
            turned = rows @ directions[:, :count]
            left = (rows * rows).sum(axis=1) - (turned * turned).sum(axis=1)
            # the room is more than what single precision takes off
            return np.column_stack([turned, np.sqrt(np.maximum(left, 0.0) + BOUND_ROOM)]).astype(np.float32)

        best, cost = 0, PRODUCT_COST + width
        for count in (7, 15, 23, 31, 47, 63, 95, 127):
            if count + 1 >= width or count > directions.shape[1]:
                break
            short = shortened(some, count)
            passed = (short @ short.T >= least).mean() - 1.0 / len(some)
            tried = PRODUCT_COST + count + 1 + PAIR_COST * width * max(passed, 0.0)
            if tried < cost:
                best, cost = count, tried
        if not best:
            return points
        out = np.empty((len(points), best + 1), np.float32)
        for lo in range(0, len(points), 1 << 13):
            out[lo : lo + (1 << 13)] = shortened(points[lo : lo + (1 << 13)].astype(float), best)
        out[~whole] = 0.0
        return out

    def least(self, data: dict) -> np.float32:
        """What the product of two codes is at least where their vectors match."""
        slack = float(np.fmax.reduce(data["slack"], initial=0.0))
        least = self.rules.threshold - 2.0 * slack - slack * slack - 2.0 * self._room(data["points"].shape[1])
        return np.float32(least - BOUND_ROOM)

    def score_between(self, data: dict, least: np.float32, left: np.ndarray, right: np.ndarray) -> Hits:
        """As ``score`` of two sets of rows, by their ``bound`` first; hits are places in the sets."""
        # eight answers are looked at as one number
        high = np.zeros((len(left), -(-len(right) // 8) * 8), bool)
        np.greater_equal(data["bound"][left] @ data["bound"][right].T, least, out=high[:, : len(right)])
        words = np.flatnonzero(high.view(np.uint64))
        if not len(words):
            return _NO_HITS
        word, place = np.nonzero(high.reshape(-1, 8)[words])
        ia, ib = np.divmod(words[word] * 8 + place, high.shape[1])
        if len(ia) > 0.02 * high.size:
            whole = {k: data[k] for k in ("points", "slack", "aspect")}
            return self.score(_take(whole, left), _take(whole, right))  # one product is less work than many pairs
        close = np.abs(data["aspect"][left[ia]] - data["aspect"][right[ib]]) <= self.rules.max_aspect_difference
        ia, ib = ia[close], ib[close]
        points = data["points"]
        value = np.einsum("ij,ij->i", points[left[ia]], points[right[ib]])
        one, other = data["slack"][left[ia]], data["slack"][right[ib]]
        near = value + one + other + one * other + self._room(points.shape[1]) >= self.rules.threshold
        return ia[near], ib[near], value[near].astype(float)

    def split(self, nodes: DataFrame) -> DataFrame:
        return SimilarScorer(self.rules).split(nodes)


@dataclass(frozen=True)
class FrameScorer:
    """Frame k against frame k, where both are there: every distance and the mean in bounds; the score is the mean.

    ``frames`` are the frames of a video one after another, ``present`` says which of them are there. With
    ``align="position"`` missing frames were left out before, so the first ones are always there; with
    ``align="fraction"`` every frame keeps its place in the video.
    """

    rules: DuplicateVideoRules = DUPLICATE_VIDEOS
    align: str = "position"
    columns = ("frames", "n_frames", "present")
    best = "min"
    self_score = 0.0

    @property
    def has_points(self) -> bool:
        # frames that two videos share may be any, so no fixed ones bound the distance
        return self.align == "position"

    @property
    def radius(self) -> float:
        # squares of the first frames sum to at most the largest distance times the sum of all distances
        rules = self.rules
        return min(rules.max_frame_distance, math.sqrt(rules.max_frame_distance * rules.max_mean_distance * rules.max_frames / rules.min_frames))

    @property
    def first_cosine(self) -> float:
        """The least product of two first frames that are close, if they are unit vectors but for 1e-6."""
        return 1.0 - self.rules.max_frame_distance**2 / 2.0 - 1e-5

    widths = staticmethod(lambda rows: _lengths(rows["frames"]) // np.maximum(_lengths(rows["present"]), 1))

    @staticmethod
    def row_bytes() -> Column:
        return F.greatest(F.size("frames") * 8, F.lit(8))

    def prepare(self, rows: pa.Table) -> dict:
        places = _lengths(rows["present"])
        column = rows["frames"]
        flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
        frames = flat.to_numpy(zero_copy_only=False).reshape(int(places.sum()), -1)
        filled = np.arange(int(places.max()))[None, :] < places[:, None]
        padded = np.zeros((*filled.shape, frames.shape[1]))
        padded[filled] = frames
        column = rows["present"]
        flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
        present = np.zeros(filled.shape, bool)
        present[filled] = flat.to_numpy(zero_copy_only=False)
        data = {"frames": padded, "present": present}
        if self.has_points:
            first = padded[:, : self.rules.min_frames, :]
            data["points"] = first.reshape(len(places), -1) / np.sqrt(self.rules.min_frames)
        return data

    def score(self, a: dict, b: dict) -> Hits:
        most = min(a["frames"].shape[1], b["frames"].shape[1])
        here, there = a["present"][:, :most], b["present"][:, :most]
        close = here.astype(np.float32) @ there.T.astype(np.float32) >= self.rules.min_frames
        # products of whole tiles as long as many pairs are left; what is left is measured pair by pair, exactly
        for k in range(most):
            if k and close.mean() <= 0.05:
                break
            near = _may_be_within(a["frames"][:, k, :], b["frames"][:, k, :], self.rules.max_frame_distance)
            if not (here[:, k].all() and there[:, k].all()):
                near |= ~(here[:, k][:, None] & there[:, k][None, :])
            close &= near
            if not close.any():
                return _NO_HITS
        rows = np.flatnonzero(close.any(axis=1))
        ia, ib = np.nonzero(close[rows])
        return self._measured(a, b, rows[ia], ib, most)

    def _measured(self, a: dict, b: dict, ia: np.ndarray, ib: np.ndarray, most: int) -> Hits:
        """The matches among single pairs."""
        total, both = np.zeros(len(ia)), np.zeros(len(ia), np.int64)
        for k in range(most):
            compared = a["present"][ia, k] & b["present"][ib, k]
            distance = np.where(compared, _pair_distances(a["frames"][:, k, :], b["frames"][:, k, :], ia, ib), 0.0)
            near = distance <= self.rules.max_frame_distance
            ia, ib, total, both = ia[near], ib[near], (total + distance)[near], (both + compared)[near]
        mean = total / np.maximum(both, 1)
        match = (mean <= self.rules.max_mean_distance) & (both >= self.rules.min_frames)
        return ia[match], ib[match], mean[match]

    def pairs_of_runs(self, data: dict, ends: np.ndarray) -> Iterator[Hits]:
        """Matches of places whose row lies before ``ends`` of the first, in parts."""
        for ia, ib, _ in all_pairs(np.zeros(len(ends), np.uint64), ends, 0):
            yield self._measured(data, data, ia, ib, data["frames"].shape[1])

    def split(self, nodes: DataFrame) -> DataFrame:
        return nodes


@dataclass(frozen=True)
class HashScorer:
    """Close hashes alone; the score is the number of differing bits."""

    rules: DuplicatePhotoRules = DUPLICATE_PHOTOS
    columns = ("dhash",)
    best = "min"
    has_points = False
    self_score = 0.0
    # rows are narrow and a task does not compare all of them, so blocks are large
    block_factor = 16

    @staticmethod
    def row_bytes() -> Column:
        return F.greatest(F.lit(8), F.lit(8))

    def pairs(self, hashes: np.ndarray) -> Iterator[Hits]:
        """All close pairs of a run, in parts."""
        for ia, ib, bits in close_pairs(hashes, self.rules.max_hamming):
            yield ia, ib, bits.astype(float)

    def prepare(self, rows: pa.Table) -> dict:
        return {"hash": _hashes(rows["dhash"])[0]}

    def score(self, a: dict, b: dict) -> Hits:
        bits = np.bitwise_count(a["hash"][:, None] ^ b["hash"][None, :])
        ia, ib = np.nonzero(bits <= self.rules.max_hamming)
        return ia, ib, bits[ia, ib].astype(float)

    def split(self, nodes: DataFrame) -> DataFrame:
        return DuplicateScorer(self.rules).split(nodes)

    def first_band(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return DuplicateScorer(self.rules).first_band(a, b)


# Room for rounding in bounds on distances.
_ROOM = 1e-9
# Hits that a task holds before it joins their labels.
EDGES_AT_ONCE = 1 << 16
# Chunks of rows up to which a task looks for no balls of videos or codes.
BALL_CHUNKS = 8

_NO_HITS: Hits = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

Scorer = DuplicateScorer | SimilarScorer | CodeScorer | FrameScorer | HashScorer


# --- inside a task --------------------------------------------------------------------------------


def _take(block: dict, rows: np.ndarray) -> dict:
    return {k: v[rows] for k, v in block.items()}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one ``pair`` value at a time from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("pair").to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for lo, hi in zip(starts, starts[1:]):
            if held and keys[lo] != key:
                yield pa.Table.from_batches(held)
                held = []
            key = keys[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _near_hubs(data: dict, label: np.ndarray, rank: np.ndarray, scorer: Scorer, tuning: MatchTuning) -> np.ndarray:
    """Labels after matching every row of a run with a few of them: families of any size become one label."""
    n = len(label)
    hubs = np.unique(np.linspace(0, n - 1, min(n, tuning.run_hubs)).astype(int))
    block = _take(data, hubs)
    for lo in range(0, n, tuning.tile_rows):
        own = np.arange(lo, min(lo + tuning.tile_rows, n))
        ia, ib, _ = scorer.score(_take(data, own), block)
        label = join_labels(label, rank[own[ia]], rank[hubs[ib]])
    return label


def _settled_codes(rows: pa.Table) -> np.ndarray:
    """A number for each value of ``settled``, -1 where there is none."""
    if "settled" not in rows.column_names:
        return np.full(rows.num_rows, -1)
    return rows["settled"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)


def principal_directions(sample: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` orthonormal directions, as columns, along which the sample is spread most."""
    centred = sample - sample.mean(axis=0)
    _, spread, directions = np.linalg.svd(centred, full_matrices=False)
    return directions[: min(most, int((spread > 1e-9).sum()))].T


def place_code(points: np.ndarray, middle: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """On which side of the middle a row lies along each direction, the first in the highest bit: rows of near codes are near."""
    sides = (points - middle) @ directions > 0
    return (sides.astype(np.int64) << np.arange(directions.shape[1])[::-1]).sum(axis=1)


def tight_balls(points: np.ndarray, reach: float, tuning: MatchTuning) -> np.ndarray:
    """A ball number for every row, chunk by chunk: rows within ``reach`` of a first one. Loose rows, which make no ball of some
    rows, are one wide ball of their chunk; its number is negative."""
    out = np.zeros(len(points), np.int64)
    used = 0
    for lo in range(0, len(points), tuning.chunk_rows):
        part = points[lo : lo + tuning.chunk_rows]
        close = _distances(part, part) <= reach
        own, n = np.full(len(part), -1), 0
        for i in range(len(part)):
            if own[i] < 0:
                members = close[i] & (own < 0)
                members[i] = True
                own[members] = n
                n += 1
        sizes = np.bincount(own, minlength=n)
        kept = sizes >= tuning.ball_rows
        number = np.where(kept, used + np.cumsum(kept), -1 - used)
        out[lo : lo + len(part)] = number[own]
        used += int(kept.sum()) + 1
    return out


class _Balls:
    """Centres and radii of balls of rows."""

    def __init__(self, points: np.ndarray, ball: np.ndarray) -> None:
        _, self.of = np.unique(ball, return_inverse=True)
        order = np.argsort(self.of, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(self.of[order]) > 0))
        sizes = np.diff(np.append(starts, len(order)))
        self.centres = np.add.reduceat(points[order], starts) / sizes[:, None]
        away = points[order] - np.repeat(self.centres, sizes, axis=0)
        self.radii = np.sqrt(np.maximum.reduceat((away * away).sum(axis=1), starts))

    def near(self, rows: np.ndarray, radius: float) -> np.ndarray:
        """Whether each row's ball is so near to a ball of ``rows`` that two of their rows may be within ``radius``."""
        own = np.unique(self.of[rows])
        gap = _distances(self.centres[own], self.centres) - self.radii[own][:, None] - self.radii[None, :]
        # distances by product lose digits near zero
        return (gap <= radius + 1e-6).any(axis=0)[self.of]


def _score_run(rows: pa.Table, scorer: Scorer, tuning: MatchTuning, connectivity_only: bool, tally: list | None = None) -> pa.RecordBatch | None:
    """Score the one or two blocks of a run tile by tile and reduce to one row per matched node.

    A tile is scored with the rows of balls that may hold a match of it; tiles of one settled set are not scored. Where only
    connectivity is wanted, rows are put in order of what some hubs connect already, and tiles of a single component
    are not scored. ``tally`` gets the number of pairs of each tile that is.
    """
    tile_rows = tuning.tile_rows
    block_no = rows["block"].to_numpy()
    is_cross = rows["is_cross"][0].as_py()
    first = np.flatnonzero(block_no == block_no.min())
    second = np.flatnonzero(block_no != block_no.min()) if is_cross else first
    n = rows.num_rows
    if not len(second) or n < 2:
        return None
    data = scorer.prepare(rows)
    home, vector_home = np.asarray(rows["home"]), np.asarray(rows["vector_home"])
    band = rows["band"][0].as_py()
    weight = rows["weight"].to_numpy().astype(float)
    # labels run over the rank of the names, so that roots are the smallest names and a group found by
    # one task needs no further contraction
    node = rows["node"].to_numpy()
    order = np.argsort(node)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)

    settled = _settled_codes(rows)
    matches, total = np.zeros(n), np.zeros(n)
    pick = np.minimum if scorer.best == "min" else np.maximum
    best = np.full(n, np.inf if scorer.best == "min" else -np.inf)
    label = np.arange(n)
    edges: list[tuple[np.ndarray, np.ndarray]] = []

    def link() -> None:
        nonlocal label
        if edges:
            label = join_labels(label, rank[np.concatenate([a for a, _ in edges])], rank[np.concatenate([b for _, b in edges])])
            edges.clear()

    def count(ia: np.ndarray, ib: np.ndarray, value: np.ndarray) -> None:
        keep = (home[ia] | home[ib]) & (vector_home[ia] | vector_home[ib])
        keep &= (settled[ia] < 0) | (settled[ia] != settled[ib])
        if band >= 0:
            keep &= scorer.first_band(data["hash"][ia], data["hash"][ib]) == band
        ia, ib, value = ia[keep], ib[keep], value[keep]
        if not len(ia):
            return
        for one, other in () if connectivity_only else ((ia, ib), (ib, ia)):
            np.add.at(matches, one, weight[other])
            np.add.at(total, one, value * weight[other])
            pick.at(best, one, value)
        edges.append((ia, ib))
        if sum(len(a) for a, _ in edges) > EDGES_AT_ONCE:
            link()

    if isinstance(scorer, HashScorer) and n > tile_rows:
        side = block_no == block_no.min()
        for ia, ib, value in scorer.pairs(data["hash"]):
            across = (side[ia] != side[ib]) if is_cross else np.ones(len(ia), bool)
            count(ia[across], ib[across], value[across])
        link()
        first = first[:0]
    balls = None
    # pairs of first frames and of codes cost little: where there are few rows, balls cost more than they spare
    cheap = isinstance(scorer, FrameScorer | CodeScorer) and n <= BALL_CHUNKS * tuning.chunk_rows
    if scorer.has_points and n > tile_rows and ("ball" in rows.column_names or not cheap):
        if "ball" in rows.column_names:
            ball = rows["ball"].to_numpy()
        else:
            some = data["points"][:: max(1, n // tuning.direction_rows)]
            middle, directions = np.median(some, axis=0), principal_directions(some, tuning.code_bits)
            order_by_code = np.argsort(place_code(data["points"], middle, directions), kind="stable")
            ball = np.empty(n, np.int64)
            ball[order_by_code] = tight_balls(data["points"][order_by_code], scorer.radius / 2.0, tuning)
        balls = _Balls(data["points"], ball)
        # loose rows last: what is compared with them is nearly everything
        for key in (ball, ball < 0, settled):
            first, second = (x[np.argsort(key[x], kind="stable")] for x in (first, second))
    if connectivity_only and n > tuning.run_hubs:
        label = _near_hubs(data, label, rank, scorer, tuning)
        # families that fill a tile come one after the other, all else stays in the order of balls
        family = np.where(np.bincount(label, minlength=n)[label] >= tile_rows // 4, label, -1)[rank]
        first, second = (x[np.argsort(family[x], kind="stable")] for x in (first, second))
    by_bounds = isinstance(scorer, CodeScorer) and n > tile_rows
    if by_bounds:
        data["bound"], least = scorer.bounds(data, tuning.direction_rows), scorer.least(data)
        margin = scorer.rules.max_aspect_difference + _ROOM
    few, i = max(1, tile_rows // 4), 0
    while i < len(first):
        # few balls to a tile, so few are near one of them; as many pairs at a time
        high, wide = (tile_rows, tile_rows) if balls is None else (few, 4 * tile_rows)
        if by_bounds and (balls is None or ball[first[i]] < 0):
            high, wide = tile_rows, 2 * tile_rows
        left = first[i : i + high]
        tile = None if by_bounds else _take(data, left)
        places = np.arange(0 if is_cross else i, len(second))
        if balls is not None:
            places = places[balls.near(left, scorer.radius)[second[places]]]
        if by_bounds:
            aspect, own = data["aspect"][second[places]], data["aspect"][left]
            places = places[(aspect >= own.min() - margin) & (aspect <= own.max() + margin)]
        for j in range(0, len(places), wide):
            at = places[j : j + wide]
            right = second[at]
            if settled[left[0]] >= 0 and (settled[left] == settled[left[0]]).all() and (settled[right] == settled[left[0]]).all():
                continue
            if connectivity_only and (label[rank[left]] == label[rank[left[0]]]).all() and (label[rank[right]] == label[rank[left[0]]]).all():
                continue
            if tally is not None:
                tally.append(len(left) * len(right))
            ia, ib, value = scorer.score_between(data, least, left, right) if by_bounds else scorer.score(tile, _take(data, right))
            if not is_cross:
                once = i + ia < at[ib]
                ia, ib, value = ia[once], ib[once], value[once]
            count(left[ia], right[ib], value)
        link()
        i += high

    hit = np.flatnonzero(label[rank] != rank if connectivity_only else matches > 0)
    if not len(hit):
        return None
    root = node[order[label[rank[hit]]]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(node[hit], pa.string()),
            pa.array(root, pa.string()),
            pa.array(matches[hit].astype(np.int64)),
            pa.array(total[hit]),
            pa.array(best[hit], mask=~np.isfinite(best[hit])),
        ],
        names=["node", "root", "matches", "score_sum", "best_score"],
    )


# --- cells ----------------------------------------------------------------------------------------


def voronoi(points: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell per row, membership matrix): home plus every cell a match could live in."""
    to_pivot = _distances(points, pivots) ** 2
    home = to_pivot.argmin(1)
    gap = to_pivot - to_pivot[np.arange(len(points)), home][:, None]
    # distance to the bisecting plane of pivots i and j is (d_i^2 - d_j^2) / (2 |i - j|)
    inside = gap <= 2.0 * (radius + _ROOM) * _distances(pivots, pivots)[home] + _ROOM
    inside[np.arange(len(points)), home] = True
    return home, inside


@dataclass(frozen=True)
class Pivots:
    """Cells around pivots, by ``points`` or by one frame: then reference videos are the pivots."""

    pivots: np.ndarray
    radius: float
    frame: int | None = None

    @property
    def size(self) -> int:
        return len(self.pivots)

    def bins(self, data: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own bin of every row, row, bin): the bins that a row's matches can lie in, by row."""
        home, inside = voronoi(_space(data, self.frame), self.pivots, self.radius)
        row, bin_ = np.nonzero(inside)
        return home.astype(np.int64), row, bin_.astype(np.int64)


@dataclass(frozen=True)
class PrincipalGrid:
    """Boxes over principal directions; their number is the product over the directions, so it is not bounded by the sample
    that the cuts come from. A projection never lengthens a distance, so a row's matches lie in boxes within the radius."""

    directions: np.ndarray
    cuts: tuple[np.ndarray, ...]
    radius: float

    @property
    def size(self) -> int:
        return math.prod(len(c) + 1 for c in self.cuts)

    def bins(self, data: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        projected = data["points"] @ self.directions
        n = len(projected)
        home = np.zeros(n, np.int64)
        row, cell, squares = np.arange(n), np.zeros(n, np.int64), np.zeros(n)
        limit = (self.radius + _ROOM) ** 2
        for k, cut in enumerate(self.cuts):
            x = projected[:, k]
            home = home * (len(cut) + 1) + np.searchsorted(cut, x, side="right")
            edges = np.concatenate([[-np.inf], cut, [np.inf]])
            gap = np.maximum(0.0, np.maximum(edges[None, :-1] - x[:, None], x[:, None] - edges[None, 1:]))
            total = squares[:, None] + (gap * gap)[row]
            at, bin_ = np.nonzero(total <= limit)
            row, cell, squares = row[at], cell[at] * (len(cut) + 1) + bin_, total[at, bin_]
        return home, row, cell


def _space(data: dict, frame: int | None) -> np.ndarray:
    return data["points"] if frame is None else data["frames"][:, frame, :]


@dataclass(frozen=True)
class Cells:
    """Cells that several partitions make together: rows match only if all of them allow it."""

    parts: tuple[Pivots | PrincipalGrid, ...] = ()

    def place(self, data: dict, most: float = math.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(row, cell, whether it is the row's own): its own cell and every cell before it that could hold a match.

        Of two matching rows the one with the later cell thus comes to the earlier one, and only there they are scored. None
        where a row would be looked for in more than ``most`` cells on average.
        """
        n = len(data["points"])
        home, row, cell = np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64)
        for part in self.parts:
            own, of, bin_ = part.bins(data)
            home = home * part.size + own
            count = np.bincount(of, minlength=n)
            start = np.cumsum(count) - count
            times = count[row]
            if times.sum() > most * n:
                return None
            at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(start[row], times)
            cell = np.repeat(cell, times) * part.size + bin_[at]
            row = np.repeat(row, times)
        before = cell <= home[row]
        row, cell = row[before], cell[before]
        return row, cell, cell == home[row]

    def cost(self, data: dict, rows: int, tuning: MatchTuning) -> float:
        """Estimated work of ``rows`` rows like the sample ``data``: pairs scored plus rows moved."""
        n = len(data["points"])
        # no saving pays for more copies than this
        dearest = min(1024.0, max(2.0, rows / 2.0 / max(tuning.pairs_per_moved_row, 1e-9)))
        placed = self.place(data, 2.0 * dearest)
        if placed is None:
            return math.inf
        _, cell, own = placed
        _, cell = np.unique(cell, return_inverse=True)
        owned, held = np.bincount(cell[own], minlength=cell.max() + 1).astype(float), np.bincount(cell).astype(float)
        pairs = (owned * (held - owned) + owned * np.maximum(owned - 1, 0) / 2.0).sum() / max(1, n * (n - 1))
        return pairs * rows * rows + held.sum() / n * rows * tuning.pairs_per_moved_row


def _partitions(data: dict, scorer: Scorer, tuning: MatchTuning) -> Iterator[Pivots | PrincipalGrid]:
    """Ways to part rows like the sample: around some of them, by all that is compared or by one frame."""
    frames = range(scorer.rules.min_frames) if isinstance(scorer, FrameScorer) else []
    for frame, radius in [(None, scorer.radius), *((f, scorer.rules.max_frame_distance) for f in frames)]:
        space = _space(data, frame)
        _, distinct = np.unique(space, axis=0, return_index=True)
        space = space[np.sort(distinct)]
        count = 8
        while count <= min(tuning.max_pivots, len(space)):
            yield Pivots(space[:count], radius, frame)
            count *= 4


def finest_grid(cells: Cells, cost: float, points: np.ndarray, data: dict, radius: float, rows: int, tuning: MatchTuning) -> tuple[Cells, float]:
    """``cells`` and a grid of least estimated work: the direction that helps most is cut twice as fine, as long as one helps.

    Directions and cuts come from ``points``, the estimate from other rows, ``data``.
    """
    directions = principal_directions(points, tuning.grid_directions)
    projected = points @ directions
    shape, best = [1] * directions.shape[1], cells

    def grid(bins: list[int]) -> Cells:
        used = [k for k, n in enumerate(bins) if n > 1]
        cuts = tuple(np.unique(np.quantile(projected[:, k], np.arange(1, bins[k]) / bins[k])) for k in used)
        return Cells((*cells.parts, PrincipalGrid(directions[:, used], cuts, radius)))

    while True:
        tried = []
        for k in range(len(shape)):
            finer = [2 * n if i == k else n for i, n in enumerate(shape)]
            candidate = grid(finer)
            if finer[k] <= tuning.grid_bins and math.prod(p.size for p in candidate.parts) < 2**62:
                tried.append((candidate.cost(data, rows, tuning), k, finer, candidate))
        if not tried or min(t[:2] for t in tried)[0] >= 0.98 * cost:
            return best, cost
        cost, _, shape, best = min(tried, key=lambda t: t[:2])


def choose_cells(data: dict, scorer: Scorer, rows: int, tuning: MatchTuning = TUNING) -> Cells:
    """Cells of least estimated work on a sample: partitions are put together as long as one more pays. None is always a choice."""
    # rows that cells are made from look better placed than others, so the work is estimated on others
    half = len(data["points"]) // 2
    makers = _take(data, np.arange(half))
    few = _take(data, np.arange(half, min(len(data["points"]), half + tuning.cost_rows)))
    best = Cells()
    if half < 2:
        return best
    cost = best.cost(few, rows, tuning)
    for _ in range(tuning.partitions):
        tried = [finest_grid(best, cost, makers["points"], few, scorer.radius, rows, tuning)] if not any(isinstance(p, PrincipalGrid) for p in best.parts) else []
        for part in _partitions(makers, scorer, tuning):
            candidate = Cells((*best.parts, part))
            if math.prod(p.size for p in candidate.parts) < 2**62:
                tried.append((candidate, candidate.cost(few, rows, tuning)))
        better = min(tried, key=lambda t: t[1], default=(best, cost))
        if better[1] >= 0.98 * cost:
            return best
        best, cost = better
    return best


@dataclass(frozen=True)
class _Guide:
    """What the sampled vectors of one length give: cells, and hubs with their names and scopes."""

    cells: Cells
    hubs: dict
    names: np.ndarray
    scopes: np.ndarray

    @staticmethod
    def of(sample: pa.Table, scorer: Scorer, rows: int, tuning: MatchTuning, find_cells: bool) -> _Guide:
        prepared = scorer.prepare(sample)
        _, distinct = np.unique(prepared["points"], axis=0, return_index=True)
        distinct = np.sort(distinct)
        prepared = _take(prepared, distinct)
        cells = choose_cells(prepared, scorer, rows, tuning) if find_cells else Cells()
        hubs = np.arange(min(tuning.max_hubs, len(distinct)))
        names = np.asarray(sample["node"].to_pylist(), object)[distinct]
        scopes = np.asarray(sample["scope"].to_pylist(), object)[distinct]
        return _Guide(cells, _take(prepared, hubs), names[hubs], scopes[hubs])


def _with_balls(nodes: DataFrame, scorer: Scorer, tuning: MatchTuning) -> DataFrame:
    """``nodes`` with the ball of each row and the chunk that the ball was made in; chunks have a bounded number of near rows.

    Rows are dealt by range of their code and then by name, so a hot code is many chunks. What is shipped is a few directions
    for each length of vector in a bounded sample.
    """
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(tuning.sample_rows).toArrow()
    widths = scorer.widths(sample)
    guides = {}
    for width in np.unique(widths):
        points = scorer.prepare(sample.take(np.flatnonzero(widths == width)))["points"]
        guides[int(width)] = np.median(points, axis=0), principal_directions(points, tuning.code_bits)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            widths, code = scorer.widths(rows), np.zeros(batch.num_rows, np.int64)
            for width in np.unique(widths):
                if int(width) in guides:
                    at = np.flatnonzero(widths == width)
                    code[at] = place_code(scorer.prepare(rows.take(at))["points"], *guides[int(width)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(widths.astype(np.int32))], names=[*batch.schema.names, "code", "width"])

    def balled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, chunk = TaskContext.get().partitionId() << 36, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, tuning.chunk_rows):
                part = batch.slice(lo, tuning.chunk_rows)
                rows = pa.Table.from_batches([part])
                widths, ball = scorer.widths(rows), np.zeros(part.num_rows, np.int64)
                for width in np.unique(widths):
                    at = np.flatnonzero(widths == width)
                    found = tight_balls(scorer.prepare(rows.take(at))["points"], scorer.radius / 2.0, tuning)
                    number = base + (chunk << 13)
                    ball[at] = np.where(found < 0, -1 - number, number + found)
                    chunk += 1
                names = [n for n in part.schema.names if n not in ("code", "width")]
                of = np.where(ball < 0, -1 - ball, ball) >> 13
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(of), pa.array(ball)], names=[*names, "chunk", "ball"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    order = ["scope", "width", "code", F.xxhash64("node")]
    dealt = cut_lineage(nodes.mapInArrow(coded, f"{fields}, code bigint, width int")).repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(dealt.mapInArrow(balled, f"{fields}, chunk bigint, ball bigint"))


def _with_vector_cells(
    nodes: DataFrame, scorer: Scorer, rows: int, tuning: MatchTuning, find_hubs: bool, find_cells: bool = True
) -> DataFrame:
    """One row per (node, vector cell), with the pivot a node matches where hubs are wanted.

    The sample has a fixed size, so what is collected and shipped does not grow with the data. Vectors of
    different length are never compared: each length has pivots and hubs of its own, and rows of a length
    that the sample missed are one cell.
    """
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(tuning.sample_rows).toArrow()
    widths = scorer.widths(sample)
    guides = {int(w): _Guide.of(sample.take(np.flatnonzero(widths == w)), scorer, rows, tuning, find_cells) for w in np.unique(widths)}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            of_width = scorer.widths(pa.Table.from_batches([batch]))
            for width in np.unique(of_width):
                part = batch.take(pa.array(np.flatnonzero(of_width == width)))
                guide = guides.get(int(width))
                data = scorer.prepare(pa.Table.from_batches([part]))
                hub = np.full(part.num_rows, None, object)
                if find_hubs and guide is not None:
                    own_scope = part.column("scope").to_numpy(zero_copy_only=False)
                    ia, ib, _ = scorer.score(data, guide.hubs)
                    same = own_scope[ia] == guide.scopes[ib]
                    lowest = np.full(part.num_rows, len(guide.names))
                    np.minimum.at(lowest, ia[same], ib[same])
                    hit = lowest < len(guide.names)
                    hub[hit] = guide.names[lowest[hit]]
                if guide is not None:
                    row, cell, own = guide.cells.place(data)
                else:
                    row, cell, own = np.arange(part.num_rows), np.zeros(part.num_rows, np.int64), np.ones(part.num_rows, bool)
                out = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [
                        *out.columns,
                        pa.array(hub[row], pa.string()),
                        pa.array(cell),
                        pa.array(own),
                    ],
                    names=[*out.schema.names, "hub", "vector_cell", "vector_home"],
                )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    placed = nodes.mapInArrow(assign, f"{fields}, hub string, vector_cell bigint, vector_home boolean")
    return placed.withColumn("has_guests", F.lit(any(g.cells.parts for g in guides.values())))


# --- close hashes first ---------------------------------------------------------------------------


def _whole_runs(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[pa.Table]:
    """Tables of about ``most`` rows from batches sorted by ``key``; rows of one key stay together."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            table = pa.Table.from_batches(held).combine_chunks()
            of = table[key].to_numpy()
            # the last run may go on
            cut = int(np.flatnonzero(np.append(True, of[1:] != of[:-1]))[-1])
            if cut:
                yield table.slice(0, cut)
            held, rows = table.slice(cut).to_batches(), table.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _run_ends(of: np.ndarray) -> np.ndarray:
    """For every row the place after the last one of its run."""
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    sizes = np.diff(np.append(starts, len(of)))
    return np.repeat(starts + sizes, sizes)


def _hash_links(hashes: DataFrame, scorer: DuplicateScorer, tasks: int, tuning: MatchTuning) -> DataFrame:
    """Links (node, root) between distinct hashes of one scope, enough to connect all that are close; hashes are named by a number.

    Numbers are hashes themselves: two that fall together connect more, never less.
    """
    narrow = hashes.select("scope", "dhash", F.xxhash64("scope", "dhash").alias("node"))
    cells = scorer.split(narrow).select(F.xxhash64("scope", "cell").alias("cell"), "dhash", "node")
    largest, rows = cells.groupBy("cell").count().agg(F.max("count"), F.sum("count")).first()
    if (largest or 0) > tuning.block_rows:
        # more of one band than a task should hold: dealt in blocks
        named = narrow.select(F.col("node").cast("string").alias("node"), "scope", F.lit(1).alias("weight"), "dhash")
        found = match_nodes(cut_lineage(named), HashScorer(scorer.rules), tuning, connectivity_only=True)
        return found.select(F.col("node").cast("long").alias("node"), F.col("root").cast("long").alias("root"))

    def linked(table: pa.Table) -> pa.RecordBatch:
        cell, hashes = table["cell"].combine_chunks().to_numpy(zero_copy_only=False), _hashes(table["dhash"])[0]
        label = np.arange(len(cell))
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        sizes = np.diff(np.append(starts, len(cell)))
        few = np.repeat((sizes > 1) & (sizes <= SET_ROWS), sizes)
        kept = sizes[(sizes > 1) & (sizes <= SET_ROWS)]
        small = np.flatnonzero(few)
        parts = [(small, all_pairs(hashes[small], np.repeat(np.cumsum(kept), kept), scorer.rules.max_hamming))]
        for i in np.flatnonzero(sizes > SET_ROWS):
            rows = np.arange(starts[i], starts[i] + sizes[i])
            parts.append((rows, close_pairs(hashes[rows], scorer.rules.max_hamming)))
        for rows, found in parts:
            for ia, ib, _ in found:
                label = join_labels(label, rows[ia], rows[ib])
        moved = np.flatnonzero(label != np.arange(len(label)))
        node = table["node"].to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], names=["node", "root"])

    # a task costs more than a few rows
    tasks = max(1, min(tasks, -(-(rows or 0) // tuning.block_rows)))
    dealt = cells.repartition(tasks, "cell").sortWithinPartitions("cell")
    run = lambda batches: (linked(table) for table in _whole_runs(batches, "cell", tuning.block_rows))
    return dealt.mapInArrow(run, "node long, root long").filter("node <> root")


def within_close_hashes(nodes: DataFrame, scorer: DuplicateScorer, tasks: int, tuning: MatchTuning = TUNING) -> DataFrame:
    """``nodes`` with scopes cut down to those whose hashes a chain of close ones connects; nodes alone in theirs are left out.

    Matching nodes have close hashes, so no match is lost, and until then only hashes are moved.
    """
    narrow = nodes.filter("dhash IS NOT NULL").select("node", "scope", "dhash")
    hashes = cut_lineage(narrow.select("scope", "dhash").distinct())
    linked = connected_components(_hash_links(hashes, scorer, tasks, tuning), "node", "root")
    family = linked.select(F.col("node").alias("_hash"), F.col("component").alias("_family"))
    named = narrow.withColumn("_hash", F.xxhash64("scope", "dhash")).join(family, "_hash", "left")
    return _within_families(nodes, named.withColumn("_family", F.coalesce("_family", "_hash")))


def _within_families(nodes: DataFrame, named: DataFrame) -> DataFrame:
    """``nodes`` with scopes cut down to families of several nodes, and ``in_scope``, their number. ``named``: node, scope, _family."""
    named = named.select("node", F.col("scope").alias("_scope"), F.concat_ws("/", "scope", "_family").alias("_within"))
    several = named.groupBy("_within").agg(F.count("*").alias("in_scope")).filter("in_scope >= 2")
    named = named.join(several, "_within")
    return nodes.withColumnRenamed("scope", "_scope").join(named, ["node", "_scope"]).withColumnRenamed("_within", "scope").select(*nodes.columns, "in_scope")


def _codes(nodes: DataFrame) -> DataFrame:
    """``nodes`` with codes for vectors: whole numbers of ``scale``, and how far from the vector they are. Nodes are named by a number."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vec")
            lengths, flat = _lengths(column), column.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            scale = np.maximum.reduceat(np.abs(flat), ends[:-1]) / CODE_STEPS if len(lengths) else np.empty(0)
            # stored in single precision, so that codes are made for what is read
            scale = np.maximum(scale.astype(np.float32), np.float32(1e-30))
            wide = np.repeat(scale.astype(float), lengths)
            steps = np.clip(np.rint(flat / wide), -CODE_STEPS, CODE_STEPS)
            gap = flat - steps * wide
            slack = np.sqrt(np.add.reduceat(gap * gap, ends[:-1])) if len(lengths) else np.empty(0)
            codes = pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(steps.astype(np.int16))])
            others = [n for n in batch.schema.names if n != "vec"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in others), codes, pa.array(scale), pa.array(slack)], names=[*others, "digits", "scale", "slack"])

    number = F.xxhash64("node").cast("string").alias("node")
    narrow = nodes.select(number, "scope", F.lit(1).cast("long").alias("weight"), "aspect", "vec", *(["settled"] if "settled" in nodes.columns else []))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields if f.name != "vec")
    return narrow.mapInArrow(code, f"{fields}, digits binary, scale float, slack double")


def within_close_codes(nodes: DataFrame, scorer: SimilarScorer, tasks: int, tuning: MatchTuning = TUNING) -> DataFrame:
    """``nodes`` with scopes cut down to those that a chain of close codes connects; nodes alone in theirs are left out.

    Codes of matching nodes are close, so no match is lost, and until then only codes are moved. Two nodes whose numbers fall together
    connect more, never less.
    """
    return _within_linked_codes(nodes, nodes, CodeScorer(scorer.rules), tasks, tuning)


def within_close_frames(nodes: DataFrame, scorer: FrameScorer, tasks: int, tuning: MatchTuning = TUNING) -> DataFrame:
    """As ``within_close_codes`` for videos, whose first frames are unit vectors and always compared: until then only codes of those are moved."""
    nodes = nodes.filter(F.size("present") >= scorer.rules.min_frames)
    first = F.slice("frames", F.lit(1), _frame_width()).alias("vec")
    settled = ["settled"] if "settled" in nodes.columns else []
    named = nodes.select("node", "scope", F.lit(0.0).alias("aspect"), first, *settled)
    return _within_linked_codes(nodes, named, CodeScorer(SimilarPhotoRules(threshold=scorer.first_cosine, max_aspect_difference=1.0)), tasks, tuning)


def _frame_width() -> Column:
    return F.floor(F.size("frames") / F.greatest(F.size("present"), F.lit(1))).cast("int")


def _within_linked_codes(nodes: DataFrame, vectors: DataFrame, codes: CodeScorer, tasks: int, tuning: MatchTuning) -> DataFrame:
    links = _match(cut_lineage(_codes(vectors).withColumn("row_bytes", codes.row_bytes())), codes, tuning, True, tasks)
    linked = connected_components(links.select(F.col("node").cast("long").alias("node"), F.col("root").cast("long").alias("root")), "node", "root")
    family = linked.select(F.col("node").alias("_hash"), F.col("component").alias("_family"))
    return _within_families(nodes, nodes.select("node", "scope", F.xxhash64("node").alias("_hash")).join(family, "_hash"))


def _match_small(nodes: DataFrame, scorer: DuplicateScorer | SimilarScorer | FrameScorer, tuning: MatchTuning, connectivity_only: bool, tasks: int) -> DataFrame:
    """``match_nodes`` of scopes of few rows each, many of them at a time; rows are moved once."""

    def scored(rows: pa.Table) -> pa.RecordBatch:
        data = scorer.prepare(rows)
        node, weight, settled = rows["node"].to_numpy(), rows["weight"].to_numpy().astype(float), _settled_codes(rows)
        n = rows.num_rows
        matches, total, label = np.zeros(n), np.zeros(n), np.arange(n)
        pick = np.minimum if scorer.best == "min" else np.maximum
        best = np.full(n, np.inf if scorer.best == "min" else -np.inf)
        for ia, ib, value in scorer.pairs_of_runs(data, _run_ends(rows["scope"].to_numpy())):
            keep = (settled[ia] < 0) | (settled[ia] != settled[ib])
            ia, ib, value = ia[keep], ib[keep], value[keep]
            for one, other in () if connectivity_only else ((ia, ib), (ib, ia)):
                np.add.at(matches, one, weight[other])
                np.add.at(total, one, value * weight[other])
                pick.at(best, one, value)
            label = join_labels(label, ia, ib)
        hit = np.flatnonzero(label != np.arange(n) if connectivity_only else matches > 0)
        columns = [pa.array(node[hit], pa.string()), pa.array(node[label[hit]], pa.string()), pa.array(matches[hit].astype(np.int64)), pa.array(total[hit])]
        return pa.RecordBatch.from_arrays([*columns, pa.array(best[hit], mask=~np.isfinite(best[hit]))], names=["node", "root", "matches", "score_sum", "best_score"])

    at_once = 16 * tuning.tile_rows // (scorer.rules.max_frames if isinstance(scorer, FrameScorer) else 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(batches, "scope", max(1, at_once)):
            widths = scorer.widths(table)
            for width in np.unique(widths):
                yield scored(table.take(np.flatnonzero(widths == width)).combine_chunks())

    return nodes.repartition(tasks, "scope").sortWithinPartitions("scope", "node").mapInArrow(run, MATCH_SCHEMA)


# --- the operator ---------------------------------------------------------------------------------


def _rows_per_block(rows: Column, work: Column, row_bytes: Column, tasks: int, tuning: MatchTuning, factor: int = 1) -> Column:
    """Large blocks copy rows less often; they shrink only as far as it takes to keep all tasks busy, each cell by its share of ``work``."""
    blocks_wanted = F.ceil(F.sqrt(F.lit(2.0 * tasks) * _square(rows) / work))
    most = F.least(F.lit(tuning.block_rows * factor), F.greatest(F.lit(1), F.floor(F.lit(tuning.block_bytes) / row_bytes)))
    smallest = F.least(F.lit(tuning.tile_rows), most)
    return F.least(most, F.greatest(smallest, F.ceil(rows / blocks_wanted)))


def _square(rows: Column) -> Column:
    return rows.cast("double") * rows.cast("double")


def _with_work(sizes: DataFrame, rows: str) -> DataFrame:
    """``sizes`` with the squares of all its ``rows`` together."""
    # one group, named by what the optimizer takes for a column, so that it is joined by key
    named = sizes.withColumn("_one", F.col(rows) % 1)
    return named.join(F.broadcast(named.groupBy("_one").agg(F.sum(_square(F.col(rows))).alias("work"))), "_one").drop("_one")


def _blocks(cells: DataFrame, tasks: int, tuning: MatchTuning, factor: int = 1) -> DataFrame:
    """Give every row its block and one copy per block pair it takes part in.

    A cell has blocks of four kinds: rows of its own or visitors, each of its largest family or not. Visitors are not compared
    with each other, nor is the family.
    """
    key = ["scope", "cell", "vector_cell"]
    row_bytes = F.max("row_bytes") if "row_bytes" in cells.columns else F.lit(8)
    # visitors of a vector cell, or else those of the scorer's own cells
    cells = cells.withColumn("is_own", F.when(F.col("has_guests"), F.col("vector_home")).otherwise(F.col("home")))
    own_rows = F.count_if("is_own")
    families = cells.groupBy(*key, "hub").agg(F.count("*").alias("n"), own_rows.alias("own"), row_bytes.alias("bytes"))
    of_major = lambda value: F.max_by(value, F.when(F.col("hub").isNotNull(), F.struct("n", "hub")))
    zero = F.lit(0).cast("long")
    sizes = families.groupBy(*key).agg(
        F.sum("n").alias("total"),
        F.sum("own").alias("total_own"),
        F.max("bytes").alias("bytes"),
        of_major("hub").alias("major"),
        F.coalesce(of_major("n"), zero).alias("major_rows"),
        F.coalesce(of_major("own"), zero).alias("major_own"),
    )
    rows = {
        "own": F.col("total_own") - F.col("major_own"),
        "own_major": F.col("major_own"),
        "guest": F.col("total") - F.col("total_own") - F.col("major_rows") + F.col("major_own"),
        "guest_major": F.col("major_rows") - F.col("major_own"),
    }
    per_block = _rows_per_block(F.col("total"), F.col("work"), F.col("bytes"), tasks, tuning, factor)
    sizes = _with_work(sizes.filter("total >= 2"), "total").withColumn("per_block", per_block)
    sizes = sizes.withColumns({f"n_{kind}": F.ceil(n / F.col("per_block")) for kind, n in rows.items()})
    sizes = sizes.select(*key, "major", *(f"n_{kind}" for kind in rows)).filter("n_own > 0 OR (n_own_major > 0 AND n_guest > 0)")
    own, own_major, guest, guest_major = (F.col(f"n_{kind}") for kind in rows)

    def numbers(first: Column, n: Column) -> Column:
        return F.when(n > 0, F.sequence(first, first + n - 1)).otherwise(F.array().cast("array<bigint>"))

    in_major = F.coalesce(F.col("hub") == F.col("major"), F.lit(False))
    near = "chunk" if "chunk" in cells.columns else "node"
    spread = lambda first, n: first + F.pmod(F.xxhash64(near), F.greatest(n, F.lit(1)))
    is_own = F.col("is_own")
    block = (
        F.when(is_own & ~in_major, spread(zero, own))
        .when(is_own, spread(own, own_major))
        .when(~in_major, spread(own + own_major, guest))
        .otherwise(spread(own + own_major + guest, guest_major))
    )
    partners = (
        F.when(is_own & ~in_major, numbers(zero, own + own_major + guest + guest_major))
        .when(is_own, F.concat(numbers(zero, own), numbers(own + own_major, guest)))
        .when(~in_major, numbers(zero, own + own_major))
        .otherwise(numbers(zero, own))
    )
    return (
        cells.join(sizes, key)
        .withColumn("block", block)
        .withColumn("other", F.explode(partners))
        .withColumn("is_cross", F.col("block") != F.col("other"))
        .withColumn("pair", F.concat_ws("/", *key, F.least("block", "other"), F.greatest("block", "other")))
        .drop("major", "other", *key, "hub", "chunk", "is_own", "has_guests", "row_bytes", *(f"n_{kind}" for kind in rows))
    )


def match_nodes(
    nodes: DataFrame, scorer: Scorer, tuning: MatchTuning = TUNING, connectivity_only: bool = False
) -> DataFrame:
    """Partial match rows (MATCH_SCHEMA): tree edges and, unless ``connectivity_only``, exact statistics.

    ``nodes`` needs node, scope, weight and the scorer's columns, and is read more than once: pass a
    checkpointed or stored table. With a column ``settled``, nodes that share a value of it are not compared with
    each other; of such sets the largest of a cell is not even laid out against itself. Rows of one node come from several
    tasks; aggregate by node for totals, feed (node, root) to the components.
    """
    named = "settled" in nodes.columns
    nodes = nodes.select("node", "scope", "weight", *scorer.columns, scorer.row_bytes().alias("row_bytes"), *(["settled"] if named else []))
    # as many tasks as the session shuffles with, fewer when there are fewer block pairs to score
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    within = _narrowing(nodes, scorer, tuning)
    if within is not None:
        nodes = cut_lineage(within(nodes, scorer, tasks, tuning))
        small = F.col("in_scope") <= tuning.tile_rows
        most, rows = nodes.agg(F.max("in_scope"), F.count_if(small)).first()
        # a task costs more than a few rows
        few = max(1, min(tasks, -(-rows // (16 * tuning.tile_rows))))
        found = _match_small(nodes.filter(small).drop("in_scope"), scorer, tuning, connectivity_only, few)
        # only the large ones are laid out in blocks, and only the largest cut into cells
        for low, high in ((tuning.tile_rows, tuning.split_rows), (max(tuning.tile_rows, tuning.split_rows), math.inf)):
            if (most or 0) > low and high > low:
                part = nodes.filter((F.col("in_scope") > low) & (F.col("in_scope") <= F.lit(float(high)))).drop("in_scope")
                found = found.unionByName(_match(cut_lineage(part), scorer, tuning, connectivity_only, tasks))
        return found
    return _match(nodes, scorer, tuning, connectivity_only, tasks)


def _narrowing(nodes: DataFrame, scorer: Scorer, tuning: MatchTuning) -> Callable[..., DataFrame] | None:
    """What cuts large scopes down before vectors are moved."""
    if not isinstance(scorer, DuplicateScorer) and type(scorer) is not SimilarScorer and not isinstance(scorer, FrameScorer):
        return None
    width = _frame_width() if isinstance(scorer, FrameScorer) else F.size("vec")
    widest, largest = nodes.groupBy("scope").agg(F.max(width).alias("w"), F.count("*").alias("n")).agg(F.max("w"), F.max("n")).first()
    if (largest or 0) <= tuning.hash_rows:
        return None
    if isinstance(scorer, DuplicateScorer):
        return within_close_hashes
    if widest > CODE_WIDTH:
        return None
    if isinstance(scorer, SimilarScorer):
        return within_close_codes
    if not scorer.has_points or scorer.rules.min_frames < 1 or scorer.first_cosine < 0.5:
        return None
    norm = V.l2_norm(F.slice("frames", F.lit(1), width))
    uneven = nodes.filter(F.size("present") >= scorer.rules.min_frames).filter(~F.coalesce(F.abs(norm - 1.0) <= 1e-6, F.lit(False)))
    return within_close_frames if uneven.isEmpty() else None


def _match(nodes: DataFrame, scorer: Scorer, tuning: MatchTuning, connectivity_only: bool, tasks: int) -> DataFrame:
    """``match_nodes`` without a look at hashes first."""
    named = "settled" in nodes.columns
    factor = getattr(scorer, "block_factor", 1)
    blocks = F.ceil(F.col("count") / _rows_per_block(F.col("count"), F.col("work"), F.col("bytes"), tasks, tuning, factor))
    sizes = nodes.groupBy("scope").agg(F.count("*").alias("count"), F.max("row_bytes").alias("bytes")).filter("count >= 2")
    largest, runs = _with_work(sizes, "count").agg(F.max("count"), F.sum(blocks * (blocks + 1) / 2)).first()
    is_large = (largest or 0) > tuning.split_rows * factor
    if not is_large:
        tasks = min(tasks, int(runs or 1))
    defaults = {
        "cell": F.lit(""),
        "home": F.lit(True),
        "band": F.lit(-1),
        "hub": F.lit(None).cast("string"),
        "vector_cell": F.lit(0).cast("long"),
        "vector_home": F.lit(True),
        "has_guests": F.lit(False),
    }
    cells = nodes
    find_hubs = connectivity_only and not named
    if is_large and scorer.has_points:
        nodes = _with_balls(nodes, scorer, tuning)
        # where most rows lie in balls, those spare more work than cells, and no row is copied for it
        in_balls = nodes.agg(F.avg((F.col("ball") >= 0).cast("double"))).first()[0] or 0.0
        placed = _with_vector_cells(nodes, scorer, largest, tuning, find_hubs, in_balls < tuning.balls_share)
        # read again for the hubs' edges
        placed = cut_lineage(placed) if find_hubs else placed
        cells = scorer.split(placed)
    elif is_large:
        cells = scorer.split(nodes)
    cells = cells.withColumns({k: v for k, v in defaults.items() if k not in cells.columns})
    cells = cells.withColumn("hub", F.col("settled")) if named else cells
    laid_out = _blocks(cells, tasks, tuning, factor).repartition(tasks, "pair").sortWithinPartitions("pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            result = _score_run(rows, scorer, tuning, connectivity_only)
            if result is not None:
                yield result

    found = laid_out.mapInArrow(run, MATCH_SCHEMA)
    if is_large and scorer.has_points and find_hubs:
        hub_edges = (
            placed.filter("vector_home AND hub IS NOT NULL AND hub <> node")
            .select(
                "node",
                F.col("hub").alias("root"),
                F.lit(0).cast("long").alias("matches"),
                F.lit(0.0).alias("score_sum"),
                F.lit(None).cast("double").alias("best_score"),
            )
        )
        found = found.unionByName(hub_edges)
    return found


def collapse_copies(features: DataFrame, scorer: Scorer) -> DataFrame:
    """One weighted node per distinct fingerprint. ``features`` carries the key as ``node``."""
    rows = features.groupBy("node", "scope").agg(
        F.count("*").alias("weight"), *[F.first(c).alias(c) for c in scorer.columns]
    )
    return cut_lineage(rows.select("node", "scope", "weight", *scorer.columns))


def node_statistics(nodes: DataFrame, found: DataFrame, scorer: Scorer) -> DataFrame:
    """Per node with a match: matches, score_sum and best_score as one of its copies sees them."""
    pick = F.min if scorer.best == "min" else F.max
    cross = found.groupBy("node").agg(
        F.sum("matches").alias("matches"), F.sum("score_sum").alias("score_sum"), pick("best_score").alias("best_score")
    )
    own = nodes.select("node", "weight", copies_match(scorer).alias("_own"))
    others = F.when(F.col("_own"), F.col("weight") - 1).otherwise(F.lit(0))
    self_score = F.when(others > 0, F.lit(scorer.self_score))
    better = F.least if scorer.best == "min" else F.greatest
    return (
        own.join(cross, "node", "left")
        .select(
            "node",
            "weight",
            (F.coalesce("matches", F.lit(0)) + others).alias("matches"),
            (F.coalesce("score_sum", F.lit(0.0)) + others * scorer.self_score).alias("score_sum"),
            better("best_score", self_score).alias("best_score"),
        )
        .filter("matches > 0")
    )


def copies_match(scorer: Scorer):
    """Whether the identical copies behind one node match each other."""
    if isinstance(scorer, SimilarScorer):
        return F.col("dhash").isNull()  # with a hash they are duplicates, not similar
    if isinstance(scorer, DuplicateScorer | HashScorer):
        return F.col("dhash").isNotNull()
    return F.col("n_frames") >= scorer.rules.min_frames


def matched_components(nodes: DataFrame, found: DataFrame, scorer: Scorer) -> DataFrame:
    """(node, component) of every node in a group of at least two assets."""
    linked = connected_components(found, "node", "root")
    alone = (
        nodes.filter(copies_match(scorer) & (F.col("weight") > 1))
        .select("node")
        .join(linked, "node", "left_anti")
        .select("node", F.col("node").alias("component"))
    )
    return linked.unionByName(alone)
