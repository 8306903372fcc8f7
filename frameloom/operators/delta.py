"""Matching after a change: only new nodes are compared, all others keep what was found for them.

A ``MatchState`` holds the nodes of a library with the label of their component. An update takes the assets that came, changed or
went:

* nodes that are new are matched with each other and with the stored nodes that could match them at all (those in a cell of theirs),
  stored nodes are not compared with each other;
* a component that lost a node may fall apart, so its other nodes are matched again, with each other alone;
* all other components are one point each: what was found links points and new nodes, and the labels of what is linked merge.

What is scored, and the graph whose components are sought, grow with the change and with the components it touches; the stored tables are
read, joined with small ones, and not moved.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.config import TUNING, MatchTuning
from frameloom.operators.components import connected_components
from frameloom.operators.matching import Scorer, collapse_copies, copies_match, match_nodes
from frameloom.session import cut_lineage


class MatchState(NamedTuple):
    """``members``: asset_id, node. ``nodes``: node, scope, the scorer's columns, component (null where nothing matches)."""

    members: DataFrame
    nodes: DataFrame


def match_state(rows: DataFrame, scorer: Scorer, tuning: MatchTuning = TUNING) -> MatchState:
    """The state of a library from scratch. ``rows``: asset_id, node, scope and the scorer's columns, one row per asset."""
    nodes = collapse_copies(rows, scorer)
    linked = connected_components(match_nodes(nodes, scorer, tuning, connectivity_only=True), "node", "root")
    labelled = nodes.drop("weight").join(linked, "node", "left")
    return MatchState(cut_lineage(rows.select("asset_id", "node")), cut_lineage(labelled))


def _cells(nodes: DataFrame, scorer: Scorer) -> DataFrame:
    """(node, scope, cell): nodes that match share a scope and a cell; no vectors are looked at."""
    narrow = nodes.select("node", "scope", *(c for c in scorer.columns if c in ("dhash", "aspect")))
    split = scorer.split(narrow)
    return (split if "cell" in split.columns else split.withColumn("cell", F.lit(""))).select("node", "scope", "cell")


def nodes_to_score(kept: DataFrame, added: DataFrame, scorer: Scorer) -> DataFrame:
    """New nodes and the stored ones that share a cell with one of them, these as one settled set."""
    keys = _cells(added, scorer).select("scope", "cell").distinct()
    near = _cells(kept, scorer).join(keys, ["scope", "cell"], "left_semi").select("node").distinct()
    columns = ["node", "scope", F.lit(1).alias("weight"), *scorer.columns]
    old = kept.join(near, "node", "left_semi").select(*columns, F.lit("kept").alias("settled"))
    return added.select(*columns, F.lit(None).cast("string").alias("settled")).unionByName(old)


def update_state(state: MatchState, rows: DataFrame, gone: DataFrame, scorer: Scorer, tuning: MatchTuning = TUNING) -> MatchState:
    """The state after a change.

    ``rows`` are the new and changed assets as in ``match_state``; ``gone`` (asset_id) are the assets whose earlier row no longer holds:
    deleted ones, and changed ones that may have no row any more. The result is what ``match_state`` gives for the whole library.
    """
    rows = cut_lineage(rows.select("asset_id", "node", "scope", *scorer.columns))
    gone = cut_lineage(gone.select("asset_id").unionByName(rows.select("asset_id")).distinct())
    emptied = state.members.join(gone, "asset_id", "left_semi").select("node").distinct()
    members = cut_lineage(state.members.join(gone, "asset_id", "left_anti").unionByName(rows.select("asset_id", "node")))
    lost = cut_lineage(emptied.join(members.join(emptied, "node", "left_semi").select("node").distinct(), "node", "left_anti"))
    offered = collapse_copies(rows, scorer).drop("weight")
    known = state.nodes.join(offered.select("node"), "node", "left_semi").select("node")
    added = cut_lineage(offered.join(known, "node", "left_anti"))

    broken = cut_lineage(state.nodes.join(lost, "node", "left_semi").filter("component IS NOT NULL").select("component").distinct())
    kept = state.nodes.join(lost, "node", "left_anti").join(broken.withColumn("is_broken", F.lit(True)), "component", "left")
    kept = kept.withColumn("point", F.when(F.col("is_broken"), F.col("node")).otherwise(F.coalesce("component", "node")))

    edges = match_nodes(cut_lineage(nodes_to_score(kept, added, scorer)), scorer, tuning, connectivity_only=True).select("node", "root")
    loose = kept.filter("is_broken").withColumn("scope", F.concat_ws("/", "scope", "component")).withColumn("weight", F.lit(1))
    again = match_nodes(cut_lineage(loose.select("node", "scope", "weight", *scorer.columns)), scorer, tuning, connectivity_only=True)
    edges = cut_lineage(edges.unionByName(again.select("node", "root")))
    ends = edges.select("node").unionByName(edges.select(F.col("root").alias("node"))).distinct()
    points = kept.filter("point <> node").join(ends, "node", "left_semi").select("node", F.col("point").alias("root"))
    linked = connected_components(edges.unionByName(points), "node", "root").select(F.col("node").alias("point"), F.col("component").alias("merged"))

    columns = ["node", "scope", *scorer.columns]
    # a component that nothing touched keeps its label, also where its point is in no edge
    stays = F.when(F.col("is_broken").isNull(), F.col("component"))
    old = kept.join(linked, "point", "left").select(*columns, F.coalesce("merged", stays).alias("component"))
    new = added.join(linked, added["node"] == linked["point"], "left").select(*columns, F.col("merged").alias("component"))
    return MatchState(members, cut_lineage(old.unionByName(new)))


def grouped_members(state: MatchState, scorer: Scorer) -> DataFrame:
    """(asset_id, node, component) of every asset in a group of at least two."""
    copies = state.members.groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    alone = F.when(copies_match(scorer) & (F.col("copies") > 1), F.col("node"))
    named = state.nodes.join(copies, "node").select("node", F.coalesce(F.col("component"), alone).alias("component"))
    return cut_lineage(state.members.join(named.filter("component IS NOT NULL"), "node").select("asset_id", "node", "component"))
