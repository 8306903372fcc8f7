"""Sums over all pairs of large families of similar photos, without scoring their pairs.

Vectors within half the match angle of a centre match each other, whichever they are: two of them are at most the whole angle apart. So a
*family*, the photos in such a cap whose aspect ratios lie in one window, needs no verification. For a photo x of a family of total
weight W and weighted vector sum S the matches are W less its own weight, and their scores sum to x . S less its own part: linear
in the family, however large.

What is not linear is left to the matcher: photos outside of families against everything, and the pairs of a family that are
duplicates and so do not count as similar; those have close hashes, are found by hash bands, and are taken off again.

Centres come from a bounded sample; a family that is missed costs time, not results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.config import TUNING, DuplicatePhotoRules, MatchTuning
from frameloom.operators.matching import MATCH_SCHEMA, DuplicateScorer, Hits, SimilarScorer, match_nodes
from frameloom.session import cut_lineage

# Room for rounding in bounds.
_ROOM = 1e-9


@dataclass(frozen=True)
class TwinScorer(SimilarScorer):
    """The pairs that ``SimilarScorer`` leaves out although their vectors are close: duplicates. The score is the cosine."""

    @property
    def radius(self) -> float:
        return float(np.sqrt(max(0.0, 2.0 - 2.0 * self.rules.duplicate_ceiling)))

    def _bands(self) -> DuplicateScorer:
        return DuplicateScorer(DuplicatePhotoRules(max_hamming=self.rules.max_duplicate_hamming))

    def score(self, a: dict, b: dict) -> Hits:
        close = np.bitwise_count(a["hash"][:, None] ^ b["hash"][None, :]) <= self.rules.max_duplicate_hamming
        close &= a["known"][:, None] & b["known"][None, :]
        ia, ib = np.nonzero(close)
        cosine = np.clip((a["points"][ia] * b["points"][ib]).sum(axis=1), -1.0, 1.0)
        twin = cosine >= max(self.rules.duplicate_ceiling, self.rules.threshold)
        return ia[twin], ib[twin], cosine[twin]

    def split(self, nodes: DataFrame) -> DataFrame:
        return self._bands().split(nodes)

    def first_band(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._bands().first_band(a, b)


class Family(NamedTuple):
    scope: str
    centre: np.ndarray
    aspect: float
    #: a photo of the family that every other one of it matches
    node: str
    vec: np.ndarray
    hash: np.uint64
    known: bool


def _in_cap(points: np.ndarray, aspect: np.ndarray, centre: np.ndarray, middle: float, scorer: SimilarScorer) -> np.ndarray:
    cap = np.cos(np.arccos(scorer.rules.threshold) / 2.0)
    return (points @ centre >= cap + _ROOM) & (np.abs(aspect - middle) <= scorer.rules.max_aspect_difference / 2.0 - _ROOM)


def find_families(sample: pa.Table, scorer: SimilarScorer, tuning: MatchTuning = TUNING) -> list[Family]:
    """Caps that hold many rows of the sample: around the mean of the rows that match the row with the most matches, over and over."""
    found = []
    scopes = np.asarray(sample["scope"].to_pylist(), object)
    widths = scorer.widths(sample)
    for scope in sorted(set(scopes.tolist())):
        for width in np.unique(widths[scopes == scope]):
            part = sample.take(np.flatnonzero((scopes == scope) & (widths == width)))
            data = scorer.prepare(part)
            points, aspect = data["points"], data["aspect"]
            close = (points @ points.T >= scorer.rules.threshold) & (np.abs(aspect[:, None] - aspect[None, :]) <= scorer.rules.max_aspect_difference)
            left, open_ = np.ones(len(points), bool), np.ones(len(points), bool)
            least = max(tuning.family_rows, tuning.family_share * sample.num_rows)
            while len(found) < tuning.max_families and (left & open_).any():
                degree = np.where(left & open_, close[:, left].sum(axis=1), -1)
                seed = int(degree.argmax())
                if degree[seed] < least:
                    break
                open_[seed] = False
                own = left & close[seed]
                for _ in range(3):
                    centre = points[own].mean(axis=0)
                    centre = centre / max(np.linalg.norm(centre), 1e-300)
                    middle = float(np.median(aspect[own]))
                    inside = left & _in_cap(points, aspect, centre, middle, scorer)
                    if not inside.any():
                        break
                    own = inside
                if inside.sum() < least:
                    continue
                rep = np.flatnonzero(inside)[int((points[inside] @ centre).argmax())]
                found.append(Family(str(scope), centre, middle, part["node"][int(rep)].as_py(), points[rep], data["hash"][rep], bool(data["known"][rep])))
                left &= ~inside
    return found


def _with_family(nodes: DataFrame, families: list[Family], scorer: SimilarScorer) -> DataFrame:
    """``nodes`` with ``settled``: the number of the first family that a node lies in.

    A duplicate of a family's own photo stays outside, so that all others match that photo and are linked by it.
    """
    rules = scorer.rules

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            widths, of = scorer.widths(rows), np.full(batch.num_rows, -1)
            scopes = batch.column("scope").to_numpy(zero_copy_only=False)
            names = batch.column("node").to_numpy(zero_copy_only=False)
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                data = scorer.prepare(rows.take(at))
                for i, f in enumerate(families):
                    if len(f.centre) != width:
                        continue
                    inside = (of[at] < 0) & (scopes[at] == f.scope) & _in_cap(data["points"], data["aspect"], f.centre, f.aspect, scorer)
                    twin = data["known"] & f.known & (np.bitwise_count(data["hash"] ^ f.hash) <= rules.max_duplicate_hamming)
                    twin &= (data["points"] @ f.vec >= rules.duplicate_ceiling - _ROOM) & (names[at] != f.node)
                    of[at[inside & ~twin]] = i
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if i < 0 else str(i) for i in of.tolist()], pa.string())], names=[*batch.schema.names, "settled"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return nodes.mapInArrow(assign, f"{fields}, settled string")


def _sums(members: DataFrame, families: list[Family], scorer: SimilarScorer) -> list[tuple[float, np.ndarray]]:
    """(weight, weighted sum of vectors) of every family; what is collected is bounded by families and vector length."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            of = np.array([int(x) for x in batch.column("settled").to_pylist()], dtype=np.int64)
            weight = batch.column("weight").to_numpy().astype(float)
            for i in np.unique(of):
                at = np.flatnonzero(of == i)
                points = scorer.prepare(rows.take(at))["points"]
                row = np.concatenate([[weight[at].sum()], weight[at] @ points])
                totals[int(i)] = totals.get(int(i), 0.0) + row
        for i, row in totals.items():
            n = len(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(row)], ["family", "place", "value"])

    found = members.mapInArrow(partial, "family int, place int, value double").groupBy("family", "place").agg(F.sum("value").alias("value"))
    out = [(0.0, np.zeros(len(f.centre))) for f in families]
    table = found.toArrow()
    for i in range(len(families)):
        own = table.filter(pc.equal(table["family"], i))
        if own.num_rows:
            values = own["value"].to_numpy()[np.argsort(own["place"].to_numpy())]
            out[i] = (float(values[0]), values[1:])
    return out


def match_similar(nodes: DataFrame, scorer: SimilarScorer, tuning: MatchTuning = TUNING) -> DataFrame:
    """As ``match_nodes``, but pairs inside large families are summed, not scored; ``best_score`` is not known for those.

    Totals per node and links are the same. ``nodes`` is read more than once: pass a checkpointed or stored table.
    """
    largest = nodes.groupBy("scope").count().agg(F.max("count")).first()[0] or 0
    if largest <= tuning.split_rows:
        return match_nodes(nodes, scorer, tuning)
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(tuning.sample_rows).toArrow()
    families = find_families(sample, scorer, tuning)
    if not families:
        return match_nodes(nodes, scorer, tuning)
    placed = cut_lineage(_with_family(nodes, families, scorer))
    members = placed.filter("settled IS NOT NULL")
    sums = _sums(members, families, scorer)

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            of = np.array([int(x) for x in batch.column("settled").to_pylist()], dtype=np.int64)
            for i in np.unique(of):
                at = np.flatnonzero(of == i)
                part = rows.take(at)
                points, own = scorer.prepare(part)["points"], part["weight"].to_numpy().astype(float)
                weight, total = sums[i]
                matches = np.rint(weight - own).astype(np.int64)
                scores = points @ total - own * (points * points).sum(axis=1)
                some = matches > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        part["node"].combine_chunks().filter(pa.array(some)),
                        pa.array([families[i].node] * int(some.sum()), pa.string()),
                        pa.array(matches[some]),
                        pa.array(scores[some]),
                        pa.nulls(int(some.sum()), pa.float64()),
                    ],
                    names=["node", "root", "matches", "score_sum", "best_score"],
                )

    inside = members.mapInArrow(closed, MATCH_SCHEMA)
    alike = cut_lineage(members.select("node", F.concat_ws("/", "scope", "settled").alias("scope"), "weight", *scorer.columns))
    twins = match_nodes(alike, TwinScorer(scorer.rules), tuning)
    off = twins.select("node", F.col("node").alias("root"), (-F.col("matches")).alias("matches"), (-F.col("score_sum")).alias("score_sum"), F.lit(None).cast("double").alias("best_score"))
    return match_nodes(placed, scorer, tuning).unionByName(inside).unionByName(off)
