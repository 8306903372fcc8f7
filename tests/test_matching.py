"""The pair matcher against brute force, with tunings that force blocks, cells and hubs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.config import MatchTuning, SimilarPhotoRules
from frameloom.operators import matching as M
from frameloom.operators.hamming import close_pairs
from frameloom.session import cut_lineage

PLAIN = MatchTuning()
BLOCKS = MatchTuning(block_rows=7, tile_rows=3)
CELLS = MatchTuning(block_rows=8, split_rows=10, max_pivots=64, sample_rows=128, pairs_per_moved_row=0.0, grid_directions=0, partitions=1)
# grids too, several partitions put together, and tiles that boxes tell apart
GRIDS = MatchTuning(block_rows=8, tile_rows=3, split_rows=10, max_pivots=64, sample_rows=128, pairs_per_moved_row=0.0)
TUNINGS = pytest.mark.parametrize("tuning", [PLAIN, BLOCKS, CELLS, GRIDS], ids=["plain", "blocks", "cells", "grids"])
DIMS = 8


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def brute_components(names, edges):
    parent = {n: n for n in names}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for n in names:
        groups.setdefault(find(n), set()).add(n)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def photo_rows(seed, clusters=6, size=12, spread=0.02):
    """Near copies around a few centres, with loose rows between them."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(clusters):
        centre, bits = unit(rng.normal(size=DIMS)), int(rng.integers(0, 2**63))
        for _ in range(size):
            vec = unit(centre + rng.normal(size=DIMS) * spread)
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            h = bits
            for f in flips:
                h ^= 1 << int(f)
            h = h - 2**64 if h >= 2**63 else h
            rows.append((f"n{len(rows):03d}", "s" + str(c % 2), 1, h, vec.tolist(), float(1 + (c % 3) * 0.3)))
    return rows


def hamming(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def collected(spark, nodes, scorer, tuning, connectivity_only=False):
    found = cut_lineage(M.match_nodes(nodes, scorer, tuning, connectivity_only))
    statistics = {r.node: r for r in M.node_statistics(nodes, found, scorer).collect()}
    components = {}
    for r in M.matched_components(nodes, found, scorer).collect():
        components.setdefault(r.component, set()).add(r.node)
    return statistics, {frozenset(g) for g in components.values()}


def expected_statistics(edges):
    out = {}
    for a, b, score in edges:
        for n in (a, b):
            out.setdefault(n, []).append(score)
    return out


def check(spark, nodes, scorer, tuning, names, edges):
    if tuning is CELLS:
        placed = M._with_vector_cells(nodes, scorer, len(names), tuning, False)
        assert placed.select("vector_cell").distinct().count() > 2
        assert placed.filter("NOT vector_home").count() > 0
    statistics, components = collected(spark, nodes, scorer, tuning)
    want = expected_statistics(edges)
    assert set(statistics) == set(want)
    pick = min if scorer.best == "min" else max
    for name, scores in want.items():
        row = statistics[name]
        assert row.matches == len(scores)
        assert row.score_sum == pytest.approx(sum(scores), abs=1e-6)
        assert row.best_score == pytest.approx(pick(scores), abs=1e-6)
    groups = brute_components(names, [e[:2] for e in edges])
    assert components == groups
    assert collected(spark, nodes, scorer, tuning, connectivity_only=True)[1] == groups


@TUNINGS
def test_duplicates_equal_brute_force(spark, tuning):
    rows = photo_rows(1, spread=0.012)
    schema = "node string, scope string, weight long, dhash long, vec array<double>, aspect double"
    nodes = cut_lineage(spark.createDataFrame(rows, schema).drop("aspect"))
    edges = [
        (a[0], b[0], float(np.linalg.norm(np.subtract(a[4], b[4]))))
        for a, b in itertools.combinations(rows, 2)
        if a[1] == b[1] and hamming(a[3], b[3]) <= 4 and np.linalg.norm(np.subtract(a[4], b[4])) <= 0.05
    ]
    assert len(edges) > 50
    check(spark, nodes, M.DuplicateScorer(), tuning, [r[0] for r in rows], edges)


@pytest.mark.parametrize(
    "tuning", [MatchTuning(hash_rows=0), MatchTuning(hash_rows=0, block_rows=5, tile_rows=3, split_rows=6, max_pivots=16, sample_rows=64)], ids=["small", "cells"]
)
def test_only_rows_of_close_hashes_are_laid_out(spark, tuning, monkeypatch):
    rows = photo_rows(3, spread=0.012)
    # loose rows of the same scopes, one without a hash
    rng = np.random.default_rng(4)
    rows += [(f"x{i:03d}", f"s{i % 2}", 1, int(rng.integers(0, 2**62)) if i else None, unit(rng.normal(size=DIMS)).tolist(), 1.0) for i in range(60)]
    schema = "node string, scope string, weight long, dhash long, vec array<double>, aspect double"
    nodes = cut_lineage(spark.createDataFrame(rows, schema).drop("aspect"))
    edges = [
        (a[0], b[0], float(np.linalg.norm(np.subtract(a[4], b[4]))))
        for a, b in itertools.combinations([r for r in rows if r[3] is not None], 2)
        if a[1] == b[1] and hamming(a[3], b[3]) <= 4 and np.linalg.norm(np.subtract(a[4], b[4])) <= 0.05
    ]
    assert len(edges) > 50
    check(spark, nodes, M.DuplicateScorer(), tuning, [r[0] for r in rows], edges)
    kept = M.within_close_hashes(nodes, M.DuplicateScorer(), 4, tuning).collect()
    assert {r.node for r in kept} <= {r[0] for r in rows[:72]} and max(r.in_scope for r in kept) <= 12
    assert len({r.scope for r in kept}) >= 6


@pytest.mark.parametrize(
    "tuning, settled",
    [
        (MatchTuning(hash_rows=0, block_rows=5, tile_rows=3), False),
        (MatchTuning(hash_rows=0, block_rows=5, tile_rows=3, split_rows=6, max_pivots=16, sample_rows=64, chunk_rows=16, pairs_per_moved_row=0.0), True),
    ],
    ids=["blocks", "cells"],
)
def test_only_rows_of_close_codes_are_laid_out(spark, tuning, settled):
    rows = [(n, "s", w, None if i % 9 == 0 else h, v, a) for i, (n, s, w, h, v, a) in enumerate(photo_rows(2, spread=0.12))]
    # loose vectors of another length, so of another scope
    rng = np.random.default_rng(8)
    rows += [(f"x{i:03d}", "t", 1, i, unit(rng.normal(size=3 * DIMS)).tolist(), 1.0) for i in range(40)]
    sets = {r[0]: "one" if settled and i < 9 else None for i, r in enumerate(rows)}
    schema = "node string, scope string, weight long, dhash long, vec array<double>, aspect double, settled string"
    nodes = spark.createDataFrame([(*r, sets[r[0]]) for r in rows], schema)
    nodes = cut_lineage(nodes if settled else nodes.drop("settled"))
    edges = []
    for a, b in itertools.combinations(rows, 2):
        if len(a[4]) != len(b[4]) or abs(a[5] - b[5]) > 0.35 or (sets[a[0]] and sets[a[0]] == sets[b[0]]):
            continue
        cosine = float(np.dot(a[4], b[4]))
        twin = None not in (a[3], b[3]) and hamming(a[3], b[3]) <= 4 and cosine >= 0.985
        if cosine >= 0.86 and not twin:
            edges.append((a[0], b[0], cosine))
    assert len(edges) > 50
    check(spark, nodes, M.SimilarScorer(), tuning, [r[0] for r in rows], edges)
    kept = M.within_close_codes(nodes, M.SimilarScorer(), 4, tuning).collect()
    assert {x for a, b, _ in edges for x in (a, b)} <= {r.node for r in kept} < {r[0] for r in rows}
    assert len({r.scope for r in kept}) >= 4


def test_codes_lose_no_match(spark):
    """Products of codes are those of the vectors but for the slacks, also where a component is all of a vector."""
    rng = np.random.default_rng(9)
    vectors = unit(np.concatenate([rng.normal(size=(60, 16)), np.eye(16), np.eye(16) + 1e-6]))
    rows = [(f"n{i:03d}", "s", v.tolist(), 1.0) for i, v in enumerate(vectors)]
    coded = M._codes(spark.createDataFrame(rows, "node string, scope string, vec array<double>, aspect double")).toArrow()
    numbers = spark.createDataFrame(rows, "node string, scope string, vec array<double>, aspect double").select(F.xxhash64("node").cast("string")).collect()
    order = [coded["node"].to_pylist().index(r[0]) for r in numbers]
    data = M.CodeScorer().prepare(coded.take(order))
    slack = data["slack"]
    assert (slack <= M.CODE_SLACK).all()
    apart = np.abs(data["points"].astype(float) @ data["points"].astype(float).T - vectors @ vectors.T)
    assert (apart <= slack[:, None] + slack[None, :] + slack[:, None] * slack[None, :] + 1e-7).all()
    for threshold in np.sort((vectors @ vectors.T)[np.triu_indices(len(vectors), 1)])[::97]:
        scorer = M.CodeScorer(SimilarPhotoRules(threshold=float(threshold)))
        ia, ib, _ = scorer.score(data, data)
        assert set(zip(*(x.tolist() for x in np.nonzero(vectors @ vectors.T >= threshold)))) <= set(zip(ia.tolist(), ib.tolist()))


def test_bounds_of_codes_lose_no_match_and_are_short():
    """Codes are compared by a few leading components first; rows with anything but numbers match nothing and hide nothing."""
    rng = np.random.default_rng(11)
    centres = unit(rng.normal(size=(40, 64)))
    points = unit(np.concatenate([rng.normal(size=(700, 64)), np.repeat(centres, 5, axis=0) + 0.04 * rng.normal(size=(200, 64))]))
    points[[3, 750]] = np.nan
    n = len(points)
    data = {"points": points.astype(np.float32), "slack": np.where(np.isnan(points[:, 0]), np.nan, 1e-4), "aspect": 1.0 + rng.integers(0, 3, n) * 0.3}
    scorer = M.CodeScorer()
    data["bound"] = scorer.bounds(data, 512)
    assert data["bound"].shape[1] < 40
    left, right = rng.permutation(n)[:500], rng.permutation(n)[:611]
    cut = M._take({k: data[k] for k in ("points", "slack", "aspect")}, left), M._take({k: data[k] for k in ("points", "slack", "aspect")}, right)
    expected = {(int(a), int(b)) for a, b, _ in zip(*scorer.score(*cut))}
    assert len(expected) > 500
    assert {(int(a), int(b)) for a, b, _ in zip(*scorer.score_between(data, scorer.least(data), left, right))} == expected


def test_only_videos_of_close_first_frames_are_laid_out(spark):
    rng = np.random.default_rng(12)
    rows = []
    for c in range(14):
        # the first frame alone does not make a match
        first, rest = unit(rng.normal(size=DIMS)), unit(rng.normal(size=(5, 4, DIMS)))
        for i in range(5):
            frames = unit(np.concatenate([first[None], rest[0 if i < 3 else i]]) + rng.normal(size=(5, DIMS)) * 0.03)
            rows.append((f"n{len(rows):03d}", "s", 1, frames[: 5 - i % 2].reshape(-1).tolist(), 5 - i % 2, [True] * (5 - i % 2)))
    rows += [(f"x{i:03d}", "s", 1, unit(rng.normal(size=(5, DIMS))).reshape(-1).tolist(), 5, [True] * 5) for i in range(30)]
    schema = "node string, scope string, weight long, frames array<double>, n_frames int, present array<boolean>"
    nodes = cut_lineage(spark.createDataFrame(rows, schema))
    edges = []
    for a, b in itertools.combinations(rows, 2):
        k = min(a[4], b[4]) * DIMS
        apart = np.linalg.norm((np.array(a[3][:k]) - np.array(b[3][:k])).reshape(-1, DIMS), axis=1)
        if (apart <= 0.22).all() and apart.mean() <= 0.16:
            edges.append((a[0], b[0], float(apart.mean())))
    assert len(edges) > 10
    tuning = MatchTuning(hash_rows=0, block_rows=5, tile_rows=4)
    assert M._narrowing(nodes, M.FrameScorer(), tuning) is M.within_close_frames
    check(spark, nodes, M.FrameScorer(), tuning, [r[0] for r in rows], edges)
    kept = M.within_close_frames(nodes, M.FrameScorer(), 4, tuning).collect()
    assert {x for a, b, _ in edges for x in (a, b)} <= {r.node for r in kept} and max(r.in_scope for r in kept) <= 15
    # products of frames of other lengths say nothing of distances
    longer = nodes.withColumn("frames", F.transform("frames", lambda x: 2.0 * x))
    assert M._narrowing(longer, M.FrameScorer(), tuning) is None


def test_small_cells_are_cut_into_fewer_blocks(spark):
    rows = [("a", i) for i in range(60)] + [(f"s{c}", i) for c in range(10) for i in range(6)]
    cells = spark.createDataFrame([(f"n{c}{i}", c) for c, i in rows], "node string, scope string").selectExpr(
        "*", "'' AS cell", "0L AS vector_cell", "CAST(NULL AS STRING) AS hub", "true AS home", "true AS vector_home", "false AS has_guests"
    )
    copies = {r.small: r["count"] for r in M._blocks(cells, 8, MatchTuning(tile_rows=1)).groupBy(F.col("node").startswith("ns").alias("small")).count().collect()}
    # one block of 6 rows has no copies, four blocks of the large cell have four each
    assert copies == {True: 60, False: 240}


@TUNINGS
def test_similar_equal_brute_force(spark, tuning):
    rows = [(n, "s", w, None if i % 9 == 0 else h, v, a) for i, (n, s, w, h, v, a) in enumerate(photo_rows(2, spread=0.12))]
    schema = "node string, scope string, weight long, dhash long, vec array<double>, aspect double"
    nodes = cut_lineage(spark.createDataFrame(rows, schema))
    edges = []
    for a, b in itertools.combinations(rows, 2):
        cosine = float(np.dot(a[4], b[4]))
        if cosine < 0.86 or abs(a[5] - b[5]) > 0.35:
            continue
        if cosine >= 0.985 and a[3] is not None and b[3] is not None and hamming(a[3], b[3]) <= 4:
            continue
        edges.append((a[0], b[0], cosine))
    assert len(edges) > 50
    check(spark, nodes, M.SimilarScorer(), tuning, [r[0] for r in rows], edges)


@TUNINGS
def test_frames_equal_brute_force(spark, tuning):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(5):
        centre = unit(rng.normal(size=(5, DIMS)))
        for _ in range(12):
            count = int(rng.choice([3, 4, 5, 5]))
            frames = unit(centre[:count] + rng.normal(size=(count, DIMS)) * 0.035)
            rows.append((f"v{len(rows):03d}", "s" + str(c % 2), 1, frames.ravel().tolist(), count))
    rows = [r for r in rows if r[4] >= 4]
    nodes = cut_lineage(
        spark.createDataFrame(
            [(*r, [True] * r[4]) for r in rows],
            "node string, scope string, weight long, frames array<double>, n_frames int, present array<boolean>",
        )
    )
    edges = []
    for a, b in itertools.combinations(rows, 2):
        n = min(a[4], b[4])
        d = np.linalg.norm(
            np.reshape(a[3], (-1, DIMS))[:n] - np.reshape(b[3], (-1, DIMS))[:n], axis=1
        )
        if a[1] == b[1] and (d <= 0.22).all() and d.mean() <= 0.16:
            edges.append((a[0], b[0], float(d.mean())))
    assert len(edges) > 50
    check(spark, nodes, M.FrameScorer(), tuning, [r[0] for r in rows], edges)


def test_hot_family_is_not_compared_with_itself(spark):
    """Near copies of one picture share a hub; with connectivity only, no pair of them is laid out."""
    rng = np.random.default_rng(4)
    centre = unit(rng.normal(size=DIMS))
    rows = [
        (f"n{i:04d}", "s", 1, 5, unit(centre + rng.normal(size=DIMS) * 0.001).tolist()) for i in range(400)
    ]
    nodes = cut_lineage(
        spark.createDataFrame(rows, "node string, scope string, weight long, dhash long, vec array<double>")
    )
    tuning = MatchTuning(block_rows=32, split_rows=50, max_pivots=16, sample_rows=64)
    scorer = M.DuplicateScorer()
    placed = scorer.split(M._with_vector_cells(nodes, scorer, 400, tuning, True)).withColumn("home", F.lit(True))
    assert M._blocks(placed, 4, tuning).count() == 0
    components = M.matched_components(nodes, M.match_nodes(nodes, scorer, tuning, True), scorer).collect()
    assert len(components) == 400 and len({r.component for r in components}) == 1


def test_identical_copies_are_one_weighted_node(spark):
    vec = unit(np.arange(1.0, DIMS + 1)).tolist()
    features = spark.createDataFrame(
        [(f"a{i}", "k1", "s", 7, vec) for i in range(5)], "asset_id string, node string, scope string, dhash long, vec array<double>"
    )
    scorer = M.DuplicateScorer()
    nodes = M.collapse_copies(features, scorer)
    assert [(r.node, r.weight) for r in nodes.collect()] == [("k1", 5)]
    statistics, components = collected(spark, nodes, scorer, PLAIN)
    assert statistics["k1"].matches == 4 and statistics["k1"].best_score == 0.0
    assert components == {frozenset({"k1"})}
    # with a hash they are duplicates of each other, so they are not similar
    similar = M.collapse_copies(features.withColumn("aspect", F.lit(1.0)), M.SimilarScorer())
    assert collected(spark, similar, M.SimilarScorer(), PLAIN) == ({}, set())


@pytest.mark.parametrize("seed", range(5))
def test_cells_keep_every_match_together(seed):
    """Pivots, a single frame's pivots, a grid, and all of them put together."""
    rng = np.random.default_rng(seed)
    frames = unit(np.concatenate([unit(rng.normal(size=(8, 2, 6))) + rng.normal(size=(8, 2, 6)) * 0.1 for _ in range(40)]))
    points = frames.reshape(len(frames), -1) / np.sqrt(2)
    data, radius = {"points": points, "frames": frames}, 0.3
    pivots, by_frame = M.Pivots(points[:32], radius), M.Pivots(frames[:32, 1], radius, 1)
    grid = M.finest_grid(M.Cells(), np.inf, points, data, radius, 10_000, PLAIN)[0].parts
    assert len(grid) == 1 and grid[0].size > 1
    distance = np.linalg.norm(points[:, None] - points[None, :], axis=2)
    by_frames = np.linalg.norm(frames[:, None] - frames[None, :], axis=3)
    match = (distance <= radius) & (by_frames <= radius).all(axis=2)
    for parts in [(pivots,), (by_frame,), grid, (pivots, by_frame, *grid)]:
        row, cell, own = M.Cells(parts).place(data)
        assert (np.bincount(row[own], minlength=len(points)) == 1).all()
        home = np.empty(len(points), np.int64)
        home[row[own]] = cell[own]
        held = set(zip(row.tolist(), cell.tolist()))
        for i, j in zip(*np.nonzero(np.triu(match, 1))):
            low = int(min(home[i], home[j]))
            assert (int(i), low) in held and (int(j), low) in held


@pytest.mark.parametrize("spread, n", [(64, 5000), (30, 20_000), (14, 9000)])
def test_close_pairs_equal_all_pairs(spread, n):
    """Hashes over all bits, over some, and so many over few that sets are cut again and again."""
    rng = np.random.default_rng(n)
    bits = rng.permutation(64)[:spread].astype(np.uint64)
    raw = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) << np.uint64(1)
    hashes = np.unique(np.bitwise_or.reduce([((raw >> np.uint64(i)) & np.uint64(1)) << b for i, b in enumerate(bits)]))
    near = hashes[: len(hashes) // 4] ^ (np.uint64(1) << bits[3]) ^ (np.uint64(1) << bits[9])
    hashes = rng.permutation(np.unique(np.concatenate([hashes, near])))
    got = {}
    for i, j, apart in close_pairs(hashes, 4):
        for x, y, d in zip(i.tolist(), j.tolist(), apart.tolist()):
            assert x < y and (x, y) not in got
            got[x, y] = d
    for i in range(len(hashes)):
        d = np.bitwise_count(hashes[i + 1 :] ^ hashes[i])
        for j in np.flatnonzero(d <= 4).tolist():
            assert got.pop((i, i + 1 + j)) == d[j]
    assert not got


def test_hash_bands_and_labels():
    edges = M.band_edges(4)
    assert sum(w for _, w in edges) == 64 and len(edges) == 5
    ia, ib = np.array([0, 3, 1]), np.array([1, 4, 2])
    label = M.join_labels(np.arange(6), ia, ib)
    assert label.tolist() == [0, 0, 0, 3, 3, 5]
    assert M.join_labels(label, np.array([4]), np.array([2])).tolist() == [0, 0, 0, 0, 0, 5]
