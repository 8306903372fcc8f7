"""Approximate nearest neighbours (operator 9) by cross-polytope hashing.

A unit vector goes through fast pseudo-rotations (random signs, then a Hadamard transform, three times) and is assigned to
the signed axis it comes nearest to; several such axes make a bucket, and several independent tables of buckets make the
index. A query looks into the buckets next best for it too (multiprobe). What lies there is compared exactly, in double
precision, on the original vectors.

Buckets see directions only, nearness also lengths. So vectors are put into bands of about one length, each band is an index
of its own, and a query goes to all bands of its dimension: a long vector at a wide angle is looked for among long ones.

A bucket is cut into cells of bounded size by row, and a query goes to each of them, so a bucket that holds a third of
all vectors is many tasks. A cell returns the best vec_ids of each of its queries; the best of all cells are the answer.

Probes and tables are chosen for recall, which the tests measure against brute force.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm import kernels as K
from frameloom.llm.common import saved

# Vectors of a cell, and queries compared with it at a time.
CELL_ROWS = 2048
QUERY_ROWS = 1024
# Pairs whose products a task holds at a time.
PAIRS_AT_ONCE = 1 << 16
# Longest to shortest vector of a band, and bands of a dimension at most; the last one holds all that are shorter.
BAND_RATIO = 1.25
BANDS = 40


class Index(NamedTuple):
    """Axes are put together until buckets hold about ``bucket_rows`` vectors; a query looks into the ``probes`` nearest
    axes of each turn, and into every bucket that these make. There are ``tables`` tables for each turn, so that recall
    does not fall where a turn is added; a band too small for a turn is one bucket. For data without clusters, as random
    vectors are, more probes or tables are the price of recall."""

    tables: int = 12
    probes: int = 10
    bucket_rows: int = 512
    seed: int = 9


def hadamard(x: np.ndarray) -> np.ndarray:
    """Hadamard transform of rows; their length is a power of two."""
    x, n, h = x.copy(), x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def rotated(units: np.ndarray, table: int, turn: int, seed: int) -> np.ndarray:
    """Rows after the pseudo-rotation of this table and turn, padded to a power of two."""
    width = 1 << max(1, (units.shape[1] - 1).bit_length())
    signs = np.random.default_rng([seed, width, table, turn]).choice([-1.0, 1.0], (3, width))
    x = np.zeros((len(units), width))
    x[:, : units.shape[1]] = units
    for s in signs:
        x = hadamard(x * s)
    return x


def buckets_of(units: np.ndarray, table: int, turns: int, seed: int, probes: int = 1) -> np.ndarray:
    """Rows by the ``probes ** turns`` buckets that the nearest signed axes of each turn make."""
    width = 1 << max(1, (units.shape[1] - 1).bit_length())
    out = np.zeros((len(units), 1), dtype=np.int64)
    for turn in range(turns):
        x = rotated(units, table, turn, seed)
        both = np.concatenate([x, -x], axis=1)
        n = min(probes, 2 * width)
        axes = both.argmax(axis=1)[:, None] if n == 1 else np.argpartition(-both, n - 1, axis=1)[:, :n]
        out = (out[:, :, None] * (2 * width) + axes[:, None, :]).reshape(len(units), -1)
    return out


def _assign(index: Index, turns: dict[int, dict[int, int]], probing: bool):
    """Rows by their buckets: in the tables of their band, or when ``probing`` in those of all bands of their dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims = np.asarray(batch.column("row")), np.asarray(batch.column("dim"))
            own = None if probing else np.asarray(batch.column("band"))
            for dim in np.unique(dims):
                bands = turns[int(dim)]
                for n_turns in sorted(set(bands.values())):
                    alike = [b for b, t in bands.items() if t == n_turns]
                    rows = np.flatnonzero((dims == dim) if probing else (dims == dim) & np.isin(own, alike))
                    if not len(rows):
                        continue
                    vectors = batch.column("vector").take(pa.array(rows))
                    full = np.asarray(vectors.flatten()).astype(np.float64).reshape(len(rows), dim)
                    full = full / np.abs(full).max(axis=1, keepdims=True)
                    units = full / np.linalg.norm(full, axis=1, keepdims=True)
                    for table in range(index.tables * n_turns or 1):
                        found = buckets_of(units, table, n_turns, index.seed, index.probes if probing else 1)
                        n = found.size
                        for band in alike if probing else [None]:
                            of = np.full(n, band, np.int32) if probing else own[rows].astype(np.int32)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(n, dim, np.int32)), pa.array(of), pa.array(np.full(n, table, np.int32)), pa.array(found.reshape(-1)), pa.array(np.repeat(ids[rows], found.shape[1]))],
                                ["dim", "band", "table", "bucket", "row"],
                            )

    return run


def _compare(k: int):
    """Queries with the vectors of a cell: for each the best k vec_ids, with the best of their vectors."""

    def run(queries: pa.Table, cell: pa.Table) -> pa.Table:
        cols: tuple[list, ...] = ([], [], [])
        if queries.num_rows and cell.num_rows:
            dim = cell.column("dim")[0].as_py()
            matrix = lambda t, name: np.asarray(t.column(name).combine_chunks().flatten()).astype(np.float64).reshape(t.num_rows, dim)
            ids, base = np.asarray(cell.column("id")), matrix(cell, "vector")
            by_id = np.argsort(ids, kind="stable")
            ids, base = ids[by_id], base[by_id]
            heads = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            names, of = ids[heads], np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(ids))))
            asked, all_asked = np.asarray(queries.column("q_id")), matrix(queries, "q_vector")
            for lo in range(0, len(asked), QUERY_ROWS):
                q = all_asked[lo : lo + QUERY_ROWS]
                rough = q @ base.T
                slack = 1e-9 * np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(base, axis=1)[None, :].max()
                best = np.maximum.reduceat(rough, heads, axis=1)
                best[names[None, :] == asked[lo : lo + QUERY_ROWS, None]] = -np.inf
                if len(names) > k:
                    bound = np.partition(best, len(names) - k, axis=1)[:, len(names) - k][:, None] - slack
                else:
                    bound = np.full((len(q), 1), -np.inf)
                # of an id only what may be its best
                row, at = np.nonzero((best >= bound)[:, of] & (rough >= best[:, of] - slack))
                other = ids[at] != asked[lo + row]
                row, at = row[other], at[other]
                # summed in one order for every pair, so equal vectors have equal scores
                exact = np.empty(len(row))
                for i in range(0, len(row), PAIRS_AT_ONCE):
                    part = slice(i, i + PAIRS_AT_ONCE)
                    exact[part] = (q[row[part]] * base[at[part]]).sum(axis=1)
                order = np.lexsort((-exact, of[at], row))
                row, at, exact = row[order], at[order], exact[order]
                once = np.append(True, (row[1:] != row[:-1]) | (of[at[1:]] != of[at[:-1]]))[: len(row)]
                row, at, exact = row[once], at[once], exact[once]
                order = np.lexsort((ids[at], -exact, row))
                row, at, exact = row[order], at[order], exact[order]
                place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
                top = place < k
                for col, values in zip(cols, (asked[lo + row[top]], ids[at[top]], exact[top])):
                    col.append(values)
        cat = lambda c, t: pa.array(np.concatenate(c) if c else np.zeros(0), t)
        return pa.table({"query_id": cat(cols[0], pa.int64()), "vec_id": cat(cols[1], pa.int64()), "score": cat(cols[2], pa.float64())})

    return run


def nearest(vectors: DataFrame, is_query, k: int = 20, index: Index = Index(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows that the column ``is_query`` names, the k nearest found among all others.

    Nearness is the largest inner product of the original vectors; ties go to the smaller vec_id. Vectors that are null,
    empty, zero, or hold null or non-finite components take no part, neither do rows without a key; vectors of different
    lengths are not compared. Of rows that repeat a key the query's own are all left out, and the others count once with
    their best vector. A query with fewer than k candidates in its buckets is compared with all of its length. An empty
    table gives no rows; other columns are not read.
    """
    plain = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    value = F.col(vector).cast(plain)
    fine = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    rows = vectors.filter(F.col(key).isNotNull() & fine)
    rows = rows.select(F.col(key).cast("long").alias("id"), F.size(value).alias("dim"), value.alias("vector"), is_query.alias("is_query"))
    # rows are told apart by a number of their own, as several may have one id
    rows = saved(rows.withColumn("log_length", _log_length(F.col("vector"))).withColumn("row", F.monotonically_increasing_id()), "vectors")
    longest = {r.dim: r.longest for r in rows.groupBy("dim").agg(F.max("log_length").alias("longest")).collect()}
    rows = rows.withColumn("band", _by_dim(longest) - F.col("log_length")) if longest else rows.withColumn("band", F.lit(0.0))
    rows = rows.withColumn("band", F.least(F.floor(F.col("band") / F.lit(math.log(BAND_RATIO))), F.lit(BANDS - 1)).cast("int")).drop("log_length")
    turns: dict[int, dict[int, int]] = {}
    for dim, band, n in rows.groupBy("dim", "band").agg(F.count(F.lit(1)).alias("n")).orderBy("dim", "band").collect():
        axes = 2 << max(1, (dim - 1).bit_length())
        turns.setdefault(dim, {})[band] = round(math.log(max(1.0, n / index.bucket_rows)) / math.log(axes))
    kind = "dim int, band int, table int, bucket long, row long"
    places = saved(rows.select("row", "dim", "band", "vector").mapInArrow(K.thrifty(_assign(index, turns, False)), kind), "buckets")
    queries = rows.filter("is_query").select("row", "id", "dim", "vector")
    probed = saved(queries.mapInArrow(K.thrifty(_assign(index, turns, True)), kind), "probes")
    found = saved(_top(_in_cells(probed, places, queries, rows, k), k), "found")

    # whoever found fewer ids than there were: all vectors of the first table's buckets, which are all there are
    sizes = {r.dim: r.n for r in rows.groupBy("dim").agg(F.countDistinct("id").alias("n")).collect()}
    enough = F.least(F.lit(k), _by_dim(sizes) - 1) if sizes else F.lit(0)
    counts = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("have"))
    every = queries.join(counts, "id", "left")
    short = every.filter(F.coalesce("have", F.lit(0)) < enough).select("id").distinct()
    if sizes and short.limit(1).count():
        first = places.filter("table = 0")
        again = queries.join(short, "id", "left_semi")
        everywhere = first.select("dim", "band", "table", "bucket").distinct().join(again.select("row", "dim"), "dim").select("dim", "band", "table", "bucket", "row")
        more = _top(_in_cells(everywhere, first, again, rows, k), k)
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(more)
    return found.select("query_id", "rank", "vec_id", "score")


def _by_dim(values: dict[int, float]) -> Column:
    """What ``values`` has for the column dim."""
    return F.create_map(*(F.lit(x) for p in values.items() for x in p))[F.col("dim")]


def _log_length(vector: Column) -> Column:
    """Logarithm of a vector's length; its largest component is taken out first, so squares neither over- nor underflow."""
    most = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    total = F.aggregate(vector, F.lit(0.0), lambda t, x: t + F.pow(x.cast("double") / most, F.lit(2.0)))
    return F.log(most) + F.log(total) / F.lit(2.0)


def _in_cells(probed: DataFrame, places: DataFrame, queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The best k of every query in every cell of its buckets; vectors and queries are cut into cells alike."""
    bucket = ["dim", "band", "table", "bucket"]
    size = lambda df, most, name: df.groupBy(*bucket).agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias(name))
    cut = size(places, CELL_ROWS, "cells").join(size(probed, QUERY_ROWS, "lots"), bucket)
    cell, lot = F.pmod(F.xxhash64("row"), F.col("cells")).cast("int"), F.pmod(F.xxhash64("row", F.lit(1)), F.col("lots")).cast("int")
    group = [*bucket, "cell", "lot"]
    stored = places.join(cut, bucket).withColumn("cell", cell).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    asked = probed.join(cut, bucket).withColumn("lot", lot).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    stored = stored.join(rows.select("row", "id", "vector"), "row").select(*group, "id", "vector")
    asked = asked.join(queries.drop("dim"), "row").select(*(F.col(c).alias(f"q_{c}") for c in (*group, "id", "vector")))
    return asked.groupBy(*(f"q_{c}" for c in group)).cogroup(stored.groupBy(*group)).applyInArrow(_compare(k), "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
