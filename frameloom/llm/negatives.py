"""Hard-negative mining (operator 12) with coordinate pruning in the manner of LEMP.

For an anchor, its best other rows of the same label are positives; for each positive the best rows of other labels whose
score lies in a range given by the positive's are hard negatives. Both are the same search: the best k rows of each of an
anchor's score windows, over all rows.

Rows are put into classes by length, classes into cells of bounded size, and anchors go to the cells that can hold something for
them: a score is at most the product of both lengths. Inside a cell rows lie in buckets by length, longest first. A bucket
has for every coordinate the list of its rows in order of that coordinate of the unit vector. The lowest score that
still counts for an anchor bounds the angle to a row of the bucket from above, and so for each of the anchor's focus
coordinates (its largest) the value that such a row can have there: a range of the sorted list. Rows that lie in the ranges of all focus
coordinates are candidates, and candidates are scored exactly. Where ranges leave most of a bucket, its rows are all scored in one
matrix product. What is found raises the lowest score for the next bucket, and what one cell of the longest rows gives raises it for all
other cells.

Anchors are a stated share of the rows against all rows, in blocks: cells times lots of anchors, each of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm import kernels as K
from frameloom.llm.common import saved

POSITIVES = 5
NEGATIVES = 3
LOW_PERCENT, HIGH_PERCENT = 50, 95
SCALE = 256
# Classes of length in all, numbers in the vectors of a cell and of a lot of anchors, rows of a bucket.
CLASSES = 16
CELL_VALUES = 1 << 20
LOT_VALUES = 1 << 18
BUCKET_ROWS = 512
# Focus coordinates of an anchor, and the share of a bucket above which all of it is scored at once.
FOCUS = 4
DENSE_SHARE = 0.25
# Relative room for rounding in bounds.
SLACK = 1e-9

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def relabelled(rows: DataFrame, every: int = 7, labels: int = 10, key: str = "vec_id", label: str = "label") -> DataFrame:
    """``rows`` with the next label where the key is divisible by ``every``."""
    return rows.withColumn(label, F.when(F.col(key) % every == 0, (F.col(label) + 1) % labels).otherwise(F.col(label)))


def _whole(scale: float):
    """Rows as whole numbers: (id, label, anchor, dim, norm, vec) of those that have all components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vec")
            sizes = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
            flat = column.flatten()
            values = np.asarray(flat.fill_null(np.nan), dtype=np.float64) if flat.null_count else np.asarray(flat, dtype=np.float64)
            ends = np.cumsum(sizes)
            with np.errstate(over="ignore"):
                whole = np.floor(values * scale)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(whole))])
            fine = np.flatnonzero((sizes > 0) & (bad[ends] == bad[ends - sizes]))
            if not len(fine):
                continue
            with np.errstate(over="ignore"):
                norm = np.sqrt(np.add.reduceat(whole * whole, (ends - sizes)[fine])) if len(fine) == len(sizes) else np.array([np.linalg.norm(whole[ends[i] - sizes[i] : ends[i]]) for i in fine])
            part = batch.take(pa.array(fine))
            at = np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in fine])
            vec = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[fine])]).astype(np.int32)), pa.array(whole[at]))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), part.column("anchor"), pa.array(sizes[fine].astype(np.int32)), pa.array(norm), vec], ["id", "label", "anchor", "dim", "norm", "vec"])

    return K.thrifty(run)


def usable(rows: DataFrame, is_anchor: Column, key: str, label: str, vector: str, scale: float) -> DataFrame:
    """(id, label, anchor, dim, norm, vec): the rows that take part, one for each key, as whole numbers."""
    known = rows.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull())
    plain = known.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("vec"))
    whole = plain.mapInArrow(_whole(scale), "id long, label string, anchor boolean, dim int, norm double, vec array<double>")
    one = whole.groupBy("id").agg(F.min(F.struct("label", "dim", "vec", "norm", "anchor")).alias("r"))
    return one.select("id", "r.label", "r.anchor", "r.dim", "r.norm", "r.vec")


# --- inside a task --------------------------------------------------------------------------------


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    return np.asarray(table.column(column).combine_chunks().flatten(), dtype=np.float64).reshape(table.num_rows, -1)


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Whole-number products of the rows of a with those of b; beyond 64 bits the nearest number of 64 bits."""
    if exact:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return np.array([[min(max(x, LEAST), MOST) for x in row] for row in whole(a) @ whole(b).T], dtype=np.int64).reshape(len(a), len(b))


def feasible(units: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) value that a unit vector can have in each coordinate if its cosine with the unit vector is ``cosine`` or more."""
    angle, room = np.arccos(np.clip(units, -1, 1)), np.arccos(np.clip(cosine, -1, 1))[:, None]
    most = np.where(angle <= room, 1.0, np.cos(angle - room))
    least = np.where(angle + room >= np.pi, -1.0, np.cos(angle + room))
    return least - SLACK, most + SLACK


class _Bucket:
    """Rows of about one length with a sorted list for every coordinate."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> None:
        self.rows, self.vectors, self.longest = rows, vectors, float(norms.max())
        units = vectors / np.maximum(norms, 1e-300)[:, None]
        self.order = np.argsort(units, axis=0, kind="stable")
        self.values = np.take_along_axis(units, self.order, axis=0)
        self.place = np.empty_like(self.order)
        np.put_along_axis(self.place, self.order, np.broadcast_to(np.arange(len(rows))[:, None], self.order.shape), axis=0)

    def ranges(self, focus: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The feasible part of the sorted list of each focus coordinate."""
        low, high = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
        for f in np.unique(focus):
            at = focus == f
            low[at] = np.searchsorted(self.values[:, f], least[at], side="left")
            high[at] = np.searchsorted(self.values[:, f], most[at], side="right")
        return low, high

    def candidates(self, focus: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ask, row of the bucket) of the rows that lie in all ranges of an ask: its shortest range, checked against the others."""
        width = np.maximum(high - low, 0)
        best = width.argmin(axis=1)
        asks = np.arange(len(focus))
        n = width[asks, best]
        ask = np.repeat(asks, n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[ask, best[ask]]
        row = self.order[place, focus[ask, best[ask]]]
        inside = np.ones(len(ask), bool)
        for j in range(focus.shape[1]):
            at = self.place[row, focus[ask, j]]
            inside &= (at >= low[ask, j]) & (at < high[ask, j])
        return ask[inside], row[inside]


def _best(group: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each group: highest score first, then smallest id."""
    order = np.lexsort((ids, ~scores, group))
    group, ids, scores = group[order], ids[order], scores[order]
    top = np.arange(len(group)) - np.searchsorted(group, group, side="left") < k
    return group[top], ids[top], scores[top]


def _search(k: int, same_label: bool, work: list | None = None):
    """For the anchors of a lot the best k rows of a cell in each of their windows, of their label or of all others."""

    def run(asks: pa.Table, cell: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 3
        windows = 1
        if asks.num_rows and cell.num_rows:
            names = pa.chunked_array([*asks.column("q_label").chunks, *cell.column("label").chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
            ask_label, row_label = names[: asks.num_rows], names[asks.num_rows :]
            ask_id, row_id = np.asarray(asks.column("q_id")), np.asarray(cell.column("id"))
            a, p = _matrix(asks, "q_vec"), _matrix(cell, "vec")
            bounds = [[np.asarray(x, np.int64) for x in asks.column(c).to_pylist()] for c in ("lows", "highs")]
            windows = max(map(len, bounds[0]))
            low, high = (np.stack([np.concatenate([x, np.full(windows - len(x), fill, np.int64)]) for x in b]) for b, fill in zip(bounds, (1, 0)))
            open_ = low <= high
            a_norm, p_norm = np.linalg.norm(a, axis=1), np.linalg.norm(p, axis=1)
            exact = float(np.abs(a).max()) * float(np.abs(p).max()) * a.shape[1] < 2.0**53
            by_length = np.argsort(-p_norm, kind="stable")
            units = a / np.maximum(a_norm, 1e-300)[:, None]
            focus = np.argsort(-np.abs(units), axis=1, kind="stable")[:, :FOCUS]
            focal = np.take_along_axis(units, focus, axis=1)
            for start in range(0, len(p), BUCKET_ROWS):
                rows = by_length[start : start + BUCKET_ROWS]
                bucket = _Bucket(rows, p[rows], p_norm[rows])
                need = np.where(open_, low, MOST).min(axis=1).astype(np.float64)
                reach = a_norm * bucket.longest
                live = open_.any(axis=1) & ((need <= 0) | (need <= reach * (1 + SLACK)))
                if not live.any():
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    cosine = np.where(need > 0, need / reach, -1.0)
                least, most = feasible(focal, cosine)
                lo, hi = bucket.ranges(focus, least, most)
                few = live & (need > 0) & ((hi - lo).min(axis=1) <= DENSE_SHARE * len(rows))
                hits = []
                dense = np.flatnonzero(live & ~few)
                if len(dense):
                    scores = _products(a[dense], bucket.vectors, exact)
                    fits = (ask_label[dense][:, None] == row_label[rows][None, :]) == same_label
                    fits &= ask_id[dense][:, None] != row_id[rows][None, :]
                    for w in range(windows):
                        ok = fits & (scores >= low[dense, w][:, None]) & (scores <= high[dense, w][:, None]) & open_[dense, w][:, None]
                        if len(rows) > k and ok.any():
                            ok &= scores >= np.partition(np.where(ok, scores, LEAST), len(rows) - k, axis=1)[:, len(rows) - k][:, None]
                        i, j = np.nonzero(ok)
                        hits.append((dense[i] * windows + w, row_id[rows[j]], scores[i, j]))
                sparse = np.flatnonzero(few)
                pairs = 0
                if len(sparse):
                    i, j = bucket.candidates(focus[sparse], lo[sparse], hi[sparse])
                    i, pairs = sparse[i], len(i)
                    fits = ((ask_label[i] == row_label[rows[j]]) == same_label) & (ask_id[i] != row_id[rows[j]])
                    i, j = i[fits], j[fits]
                    scores = np.einsum("ij,ij->i", a[i], bucket.vectors[j]).astype(np.int64) if exact else np.array([_products(a[x : x + 1], bucket.vectors[y : y + 1], False)[0, 0] for x, y in zip(i, j)], np.int64)
                    for w in range(windows):
                        ok = (scores >= low[i, w]) & (scores <= high[i, w]) & open_[i, w]
                        hits.append((i[ok] * windows + w, row_id[rows[j[ok]]], scores[ok]))
                if work is not None:
                    work.append((len(dense) * len(rows) + pairs, len(a) * len(rows)))
                found = list(_best(*(np.concatenate([f, *h]) for f, h in zip(found, zip(*hits))), k)) if hits else found
                # a window that has k rows needs no lower score than its last
                group, n = np.unique(found[0], return_counts=True)
                full = group[n == k]
                last = found[2][np.cumsum(n)[n == k] - 1]
                low[full // windows, full % windows] = np.maximum(low[full // windows, full % windows], last)
            ask_of = ask_id[found[0] // windows]
        else:
            ask_of = found[0]
        return pa.table({"ask": pa.array(ask_of, pa.int64()), "window": pa.array(found[0] % windows, pa.int32()), "id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.int64())})

    return run


# --- the search -----------------------------------------------------------------------------------


def _with_class(rows: DataFrame) -> DataFrame:
    """``rows`` with their class of length: 0 for the longest of their dimension. What is collected is CLASSES numbers a dimension."""
    cuts = rows.groupBy("dim").agg(F.percentile_approx("norm", [i / CLASSES for i in range(CLASSES - 1, 0, -1)], 10_000).alias("cuts")).collect()
    if not cuts:
        return rows.withColumn("length_class", F.lit(0))
    by_dim = F.create_map(*(x for r in cuts for x in (F.lit(r.dim), F.array(*map(F.lit, r.cuts)))))
    return rows.withColumn("length_class", F.size(F.filter(by_dim[F.col("dim")], lambda cut: cut > F.col("norm"))))


def _asked(asks: DataFrame, rows: DataFrame, stats: DataFrame, key: list[str], k: int, same_label: bool) -> DataFrame:
    """(ask, window, id, score): the best k of each cell that an ask goes to. ``stats`` has the cells, with ``first`` and ``last`` part to look into."""
    reach = F.col("q_norm") * F.col("longest") * (1 + SLACK)
    need = F.array_min(F.transform(F.arrays_zip("lows", "highs"), lambda w: F.when(w["lows"] <= w["highs"], w["lows"])))
    ask_key = [F.col("q_label") if c == "label" else F.col(c) for c in key]
    named = asks.select("*", *(c.alias(f"k_{i}") for i, c in enumerate(ask_key) if key[i] != "length_class"))
    same = [F.col(f"k_{i}") == F.col(c) for i, c in enumerate(key) if c != "length_class"]
    on = same[0] if len(same) == 1 else same[0] & same[1]
    small = F.broadcast(stats) if "label" not in key else stats
    at = named.drop("dim").join(small, on).filter(need.isNotNull() & ((need <= 0) | (need.cast("double") <= reach)) & (F.col("first") <= F.col("last")))
    at = at.withColumn("part", F.explode(F.sequence("first", "last")))
    cell = [*key, "part"]
    lots = at.groupBy(*key).agg(F.greatest(F.lit(1), F.ceil(F.countDistinct("q_id") * F.first("dim") / F.lit(LOT_VALUES))).cast("int").alias("lots"))
    at = at.join(lots, key).withColumn("lot", F.pmod(F.xxhash64("q_id", F.lit(2)), F.col("lots")).cast("int"))
    at = at.select(*(F.col(c).alias(f"q_{c}") if c in ("label",) else F.col(c).alias(f"a_{c}") for c in cell), F.col("lot").alias("a_lot"), "q_id", "q_vec", "lows", "highs", *([] if "label" in key else ["q_label"]))
    held = rows.join(stats.select(*key, "parts"), key).join(lots, key)
    held = held.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    held = held.select(*cell, "lot", "id", "vec", *([] if "label" in key else ["label"]))
    left = [*("q_label" if c == "label" else f"a_{c}" for c in cell), "a_lot"]
    return at.groupBy(*left).cogroup(held.groupBy(*cell, "lot")).applyInArrow(_search(k, same_label), "ask long, window int, id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("ask", "window").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(asks: DataFrame, rows: DataFrame, k: int, same_label: bool, name: str) -> DataFrame:
    """(ask, window, id, score, rank): the best k rows of every window (lows, highs) of every ask, of its label or of other labels.

    ``asks`` has q_id, q_label, dim, q_norm, q_vec, lows and highs, ``rows`` what ``usable`` gives with length_class; both are stored.
    """
    key = ["dim", "label", "length_class"] if same_label else ["dim", "length_class"]
    size = F.ceil(F.count(F.lit(1)) * F.col("dim") / F.lit(CELL_VALUES)).cast("int")
    stats = saved(rows.groupBy(*key).agg(size.alias("parts"), F.max("norm").alias("longest")), f"{name}-cells")
    longest_first = Window.partitionBy(*key[:-1]).orderBy("length_class")
    stats = stats.withColumn("turn", F.row_number().over(longest_first))
    # one cell of the longest rows first: what it gives is the least that counts elsewhere
    first = stats.filter("turn = 1").withColumns({"first": F.lit(0), "last": F.lit(0)})
    begun = saved(_first(_asked(asks, rows, first, key, k, same_label), k), f"{name}-begun")
    bar = begun.filter(F.col("rank") == k).groupBy("ask").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("bar"))
    raised = F.transform("lows", lambda low, i: F.greatest(low, F.coalesce(F.col("bar")[i.cast("int")], low)))
    raised_asks = saved(asks.join(bar, asks["q_id"] == bar["ask"], "left").withColumn("lows", raised).drop("ask", "bar"), f"{name}-raised")
    rest = stats.withColumns({"first": F.when(F.col("turn") == 1, 1).otherwise(0), "last": F.col("parts") - 1})
    more = _asked(raised_asks, rows, rest, key, k, same_label)
    return _first(begun.drop("rank").unionByName(more), k)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW_PERCENT, high: int = HIGH_PERCENT, scale: float = SCALE, key: str = "vec_id", label: str = "label", vector: str = "embedding"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``is_anchor`` names.

    Components count as floor(scale * x), a score is the inner product of these whole numbers. An anchor's positives are its best ``positives``
    other rows of the same label; for each the best ``negatives`` rows of other labels are returned whose score is from
    ``low`` to ``high`` per cent of the positive's. Higher scores come first, ties by the smaller key; where there are
    fewer, all are returned. A positive with a negative score has no negatives.

    Rows without key, label or vector, with an empty vector or with any null or non-finite component take no part. Of rows that
    repeat a key the one with the smallest label, then vector, takes part. Vectors of different dimension have no score.
    Scores beyond 64 bits count as the nearest number of 64 bits. An empty table gives no rows; other columns are not read.
    """
    stored = saved(usable(rows, is_anchor, key, label, vector, scale), "whole")
    stored = saved(_with_class(stored), "vectors")
    anchors = stored.filter("anchor").select(F.col("id").alias("q_id"), F.col("label").alias("q_label"), "dim", F.col("norm").alias("q_norm"), F.col("vec").alias("q_vec"))
    anything = anchors.withColumns({"lows": F.array(F.lit(LEAST)), "highs": F.array(F.lit(MOST))})
    best = saved(search(anything, stored, positives, True, "positives"), "positives")
    part = lambda p, percent, up: F.expr(f"({p} div 100) * {percent} + (({p} % 100) * {percent} + {99 if up else 0}) div 100")
    ranges = best.filter("score >= 0").withColumns({"low": part("score", low, True), "high": part("score", high, False)})
    windows = ranges.groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("w"))
    asks = saved(anchors.join(windows, anchors["q_id"] == windows["ask"]).select(*anchors.columns, F.col("w.low").alias("lows"), F.col("w.high").alias("highs")), "asks")
    found = search(asks, stored, negatives, False, "negatives")
    of = best.select(F.col("ask").alias("anchor_id"), (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = found.select(F.col("ask").alias("anchor_id"), "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return of.join(found, ["anchor_id", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


NEGATIVES_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) <= 3
"""
