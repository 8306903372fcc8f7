"""Times of the pair matcher on made-up features, larger and more clustered than the benchmark tables.

usage: python tools/stress.py <case> <rows> [cores]

Cases: ``clusters`` (similar photos, a hundred a cluster, centres of few strong directions), ``spread`` (random vectors), ``family``
(one family of similar photos), ``hashes`` (distinct hashes of one band), ``videos`` (one duration and shape, copies in pairs).
"""

from __future__ import annotations

import os
import sys
import time

import numpy as np
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from frameloom.operators import blocking, families  # noqa: E402
from frameloom.operators import matching as M  # noqa: E402
from frameloom.session import cut_lineage, local_session  # noqa: E402

DIMS = 64


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _vectors(case: str, ids: np.ndarray) -> np.ndarray:
    """Vectors by row number: the same whichever task makes them."""
    out = np.empty((len(ids), DIMS))
    for i, n in enumerate(ids.tolist()):
        own = np.random.default_rng([5, n])
        if case == "spread":
            out[i] = own.normal(size=DIMS)
        elif case == "family":
            out[i] = np.random.default_rng([6, 0]).normal(size=DIMS) + 0.15 * own.normal(size=DIMS)
        else:
            centre = np.random.default_rng([7, n // 100]).normal(size=DIMS) * np.where(np.arange(DIMS) < 12, 1.0, 0.1)
            out[i] = _unit(centre) + 0.02 * own.normal(size=DIMS)
    return _unit(out)


def photos(spark: SparkSession, case: str, rows: int) -> DataFrame:
    def make(batches):
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            vec = _vectors(case, ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(np.arange(len(ids) + 1, dtype=np.int32) * DIMS, vec.reshape(-1))], ["id", "vec"])

    made = spark.range(0, rows, 1, 32).mapInArrow(make, "id long, vec array<double>")
    name = F.format_string("n%010d", "id")
    return cut_lineage(made.select(name.alias("node"), F.lit("s").alias("scope"), F.lit(1).cast("long").alias("weight"), F.xxhash64("id").alias("dhash"), "vec", F.lit(1.5).alias("aspect")))


def videos(spark: SparkSession, rows: int) -> DataFrame:
    def make(batches):
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            flat = [np.concatenate([_unit(np.random.default_rng([8, n // 2, f]).normal(size=DIMS) + 0.005 * (n % 2)) for f in range(4)]) for n in ids.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([x.tolist() for x in flat], pa.list_(pa.float64()))], ["id", "frames"])

    made = spark.range(0, rows, 1, 32).mapInArrow(make, "id long, frames array<double>")
    yes = F.array_repeat(F.lit(True), 4)
    return cut_lineage(made.select(F.format_string("n%010d", "id").alias("node"), F.lit("s").alias("scope"), F.lit(1).cast("long").alias("weight"), "frames", F.lit(4).alias("n_frames"), yes.alias("present")))


def main(case: str, rows: int, cores: int = 8) -> None:
    spark = local_session(cores)
    if case == "hashes":
        hashes = cut_lineage(spark.range(rows).select(F.shiftrightunsigned(F.xxhash64("id"), 13).alias("dhash"), F.lit(1).cast("long").alias("photos")).distinct())
        start = time.time()
        n = blocking.close_hashes(hashes, []).count()
        print(f"{case} {rows} rows, {cores} cores: {time.time() - start:.1f} s, {n} hashes with a close one", flush=True)
        return
    nodes = videos(spark, rows) if case == "videos" else photos(spark, case, rows)
    scored = spark.sparkContext.accumulator(0)
    plain = M._score_run

    def counted(table, scorer, tuning, connectivity_only):
        tally: list = []
        out = plain(table, scorer, tuning, connectivity_only, tally)
        scored.add(sum(tally))
        return out

    M._score_run = counted
    nodes.count()
    start = time.time()
    if case == "videos":
        found = M.match_nodes(nodes, M.FrameScorer(), connectivity_only=True).agg(F.countDistinct("node"))
    else:
        found = families.match_similar(nodes, M.SimilarScorer()).agg(F.sum("matches"))
    value = found.first()[0]
    print(f"{case} {rows} rows, {cores} cores: {time.time() - start:.1f} s, {scored.value:.3g} pairs scored ({scored.value / (rows * rows / 2):.4f} of all), result {value}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], int(sys.argv[2]), int(sys.argv[3]) if len(sys.argv) > 3 else 8)
