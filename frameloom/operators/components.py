"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.config import PLANS
from frameloom.session import cut_lineage


def join_labels(label: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Component labels (smallest row number) after adding edges to already labelled rows."""
    while True:
        a, b = label[ia], label[ib]
        apart = a != b
        if not apart.any():
            return label
        ia, ib, a, b = ia[apart], ib[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        label = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped


def _local_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task sees of the graph as trees of depth one: the same components, and most of the depth gone."""
    held: list[pa.RecordBatch] = []

    def trees() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ends = pa.chunked_array([*table.column("v").chunks, *table.column("u").chunks]).combine_chunks()
        names = ends.unique()
        names = names.take(pc.sort_indices(names))
        at = pc.index_in(ends, names).to_numpy(zero_copy_only=False)
        label = join_labels(np.arange(len(names)), at[: table.num_rows], at[table.num_rows :])
        moved = np.flatnonzero(label != np.arange(len(names)))
        held.clear()
        return pa.RecordBatch.from_arrays([names.take(pa.array(moved)), names.take(pa.array(label[moved]))], ["v", "u"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= PLANS.local_edges:
            yield trees()
    if held:
        yield trees()


def _star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (v, u) with u < v.

    Only minima are aggregated per node, so partial aggregation takes the weight of a hub off the
    shuffle; the join back has one row per node on its right side, which lets the adaptive skew join
    split a hub's edges.
    """
    # large star: every larger neighbour of a node moves to the smallest node around it
    both = edges.select(F.col("v").alias("n"), F.col("u").alias("x")).unionByName(
        edges.select(F.col("u").alias("n"), F.col("v").alias("x"))
    )
    lowest = both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m"))
    large = both.filter("x > n").join(lowest, "n").select(F.col("x").alias("v"), F.col("m").alias("u"))
    # small star: a node and its smaller neighbours move to the smallest of them
    parent = large.groupBy("v").agg(F.min("u").alias("m"))
    moved = large.join(parent, "v").filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return moved.unionByName(parent.select("v", F.col("m").alias("u"))).distinct()


def _is_settled(edges: DataFrame) -> bool:
    """Every node is either a root or a child of exactly one root."""
    roles = edges.select(F.col("v").alias("n"), F.lit(1).alias("parents"), F.lit(0).alias("children")).unionByName(
        edges.select(F.col("u").alias("n"), F.lit(0).alias("parents"), F.lit(1).alias("children"))
    )
    per_node = roles.groupBy("n").agg(F.sum("parents").alias("parents"), F.max("children").alias("is_parent"))
    open_nodes = per_node.filter("parents > 1 OR (parents > 0 AND is_parent > 0)")
    return open_nodes.limit(1).count() == 0


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = PLANS.component_rounds) -> DataFrame:
    """(node, component) for every node of an edge; the component is named by its smallest node.

    Every task first contracts the edges it reads. Each round is checkpointed, so lineage stays one round deep and a lost executor costs one round.
    The loop ends when every node hangs on one root; rounds grow with the logarithm of the component
    size, and running out of them is an error, never a partial result.
    """
    ends = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ends.schema.fields)
    current = cut_lineage(ends.mapInArrow(_local_trees, schema).distinct())
    for _ in range(max_rounds):
        if _is_settled(current):
            members = current.select(F.col("v").alias("node"), F.col("u").alias("component"))
            roots = current.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
            return members.unionByName(roots)
        current = cut_lineage(_star_round(current))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
