"""Delta matching against a full run, and sums over families against all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frameloom.config import SIMILAR_PHOTOS, DuplicatePhotoRules, MatchTuning
from frameloom.operators import delta, families, matching
from frameloom.operators.matching import DuplicateScorer, SimilarScorer
from frameloom.session import cut_lineage

SCORER = DuplicateScorer(DuplicatePhotoRules())
ROWS = "asset_id string, node string, scope string, dhash long, vec array<double>"


def picture(rng, place, hash_):
    """A row on a chain: neighbours on the chain match, others do not; hashes differ by a bit or two."""
    angle = 0.035 * place
    bits = int(hash_) ^ (1 << int(rng.integers(0, 62)))
    return bits, [float(np.cos(angle)), float(np.sin(angle)), 0.0]


def rows_of(pictures):
    """(asset_id, node, ...) of {asset_id: (hash, vector)}."""
    return [(a, f"{h:020d}{v}", "s", h, v) for a, (h, v) in pictures.items()]


def labels(state):
    return {(r.node, r.component) for r in state.nodes.select("node", "component").collect()}


def frame(spark, pictures):
    return spark.createDataFrame(rows_of(pictures), ROWS)


def test_updates_equal_full_runs(spark):
    """Chains grow, merge, lose links in the middle and move; copies come and go."""
    rng = np.random.default_rng(3)
    now = {f"p{i}": picture(rng, int(rng.integers(0, 120)), 5 << 20) for i in range(60)}
    now["twin"] = now["p0"]
    state = delta.match_state(frame(spark, now), SCORER)
    for turn in range(4):
        names = sorted(now)
        deleted = [str(x) for x in rng.choice(names, 6, replace=False)]
        edited = {str(x): picture(rng, int(rng.integers(0, 120)), 5 << 20) for x in rng.choice(names, 4, replace=False) if x not in deleted}
        copied = {f"c{turn}": now[next(x for x in names if x not in deleted and x not in edited)]}
        added = {f"n{turn}_{i}": picture(rng, int(rng.integers(0, 120)), 5 << 20) for i in range(5)} | copied
        for x in deleted:
            del now[x]
        now |= edited | added
        gone = spark.createDataFrame([(x,) for x in [*deleted, "never there"]], "asset_id string")
        state = delta.update_state(state, frame(spark, edited | added), gone, SCORER)
        whole = delta.match_state(frame(spark, now), SCORER)
        assert labels(state) == labels(whole)
        ours, theirs = ({tuple(r) for r in delta.grouped_members(s, SCORER).collect()} for s in (state, whole))
        assert ours == theirs and ours


def test_a_bridge_that_goes_splits_its_component(spark):
    at = lambda p, h=0: (h, [float(np.cos(0.035 * p)), float(np.sin(0.035 * p)), 0.0])
    chain = {f"p{i}": at(i) for i in range(7)} | {"far": at(60)}
    state = delta.match_state(frame(spark, chain), SCORER)
    assert state.nodes.select("component").distinct().count() == 2  # the chain, and none for the one that is far
    nothing = spark.createDataFrame([], ROWS)
    state = delta.update_state(state, nothing, spark.createDataFrame([("p3",)], "asset_id string"), SCORER)
    sizes = sorted(r["count"] for r in delta.grouped_members(state, SCORER).groupBy("component").count().collect())
    assert sizes == [3, 3]
    # an asset that changed into something that cannot be matched has no row any more
    state = delta.update_state(state, nothing, spark.createDataFrame([("p0",), ("p1",)], "asset_id string"), SCORER)
    assert delta.grouped_members(state, SCORER).select("asset_id").count() == 3
    assert {r.asset_id for r in state.members.collect()} == {"p2", "p4", "p5", "p6", "far"}


def test_empty_library_and_empty_change(spark):
    nothing = spark.createDataFrame([], ROWS)
    gone = nothing.select("asset_id")
    state = delta.match_state(nothing, SCORER)
    one = {"a": (1, [1.0, 0.0]), "b": (1, [1.0, 0.0])}
    state = delta.update_state(state, frame(spark, one), gone, SCORER)
    assert delta.grouped_members(state, SCORER).count() == 2
    again = delta.update_state(state, nothing, gone, SCORER)
    assert labels(again) == labels(state)


def test_rows_scored_grow_with_the_change(spark):
    rng = np.random.default_rng(1)
    base = spark.createDataFrame(
        [(f"n{i}", "s", int(h), [1.0, 0.0]) for i, h in enumerate(rng.integers(-(2**62), 2**62, 20_000))], "node string, scope string, dhash long, vec array<double>"
    )
    counts = []
    for n in (5, 50, 500):
        new = [(f"x{i}", "s", int(h), [1.0, 0.0]) for i, h in enumerate(rng.integers(-(2**62), 2**62, n))]
        added = spark.createDataFrame(new, base.schema)
        counts.append(delta.nodes_to_score(base, added, SCORER).count())
    # five bands of 12 or 13 bits: a new node meets some 20 of 20,000
    assert counts[0] < 5 * 40 and counts[1] < 50 * 40 and counts[0] < counts[1] < counts[2] < 0.6 * 20_500


def test_settled_nodes_are_not_compared(spark):
    rows = [(f"n{i}", "s", 1, 0, [1.0, 0.001 * i], "a" if i < 40 else ("b" if i < 60 else None)) for i in range(70)]
    df = spark.createDataFrame(rows, "node string, scope string, weight long, dhash long, vec array<double>, settled string")
    tuning = MatchTuning(tile_rows=8, block_rows=16)
    found = {r.node: r.matches for r in matching.match_nodes(df, SCORER, tuning).groupBy("node").agg(F.sum("matches").alias("matches")).collect()}
    for i, (name, *_, own) in enumerate(rows):
        want = sum(1 for j, r in enumerate(rows) if j != i and abs(i - j) * 0.001 <= 0.05 and (own is None or r[5] != own))
        assert found.get(name, 0) == want


# --- families -------------------------------------------------------------------------------------


def similar_rows(seed, n_family, n_other, dim=24):
    """A tight family, a looser one, photos around both, and duplicates inside the family."""
    rng = np.random.default_rng(seed)
    centre, other = rng.normal(size=(2, dim))
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    centre, other = unit(centre), unit(other)
    tight = unit(centre + 0.2 / np.sqrt(dim) * rng.normal(size=(n_family, dim)))
    loose = unit(other + 0.55 / np.sqrt(dim) * rng.normal(size=(n_other, dim)))
    between = unit(centre + rng.uniform(0.2, 1.0, (n_other, 1)) * other)
    vecs = np.concatenate([tight, loose, between])
    hashes = rng.integers(-(2**62), 2**62, len(vecs))
    hashes[1::7] = hashes[0]  # with close vectors these are duplicates
    aspects = 1.5 + 0.05 * rng.integers(0, 12, len(vecs))
    return [
        (f"n{i:05d}", "s", int(rng.integers(1, 4)), None if i % 11 == 3 else int(h), [float(x) for x in v], float(a))
        for i, (h, v, a) in enumerate(zip(hashes, vecs, aspects))
    ]


SIMILAR = "node string, scope string, weight long, dhash long, vec array<double>, aspect double"


@pytest.mark.parametrize("seed", [0, 1])
def test_family_sums_equal_all_pairs(spark, seed):
    rows = cut_lineage(spark.createDataFrame(similar_rows(seed, 400, 120), SIMILAR))
    scorer = SimilarScorer(SIMILAR_PHOTOS)
    plain = matching.match_nodes(rows, scorer, MatchTuning())
    tuning = MatchTuning(split_rows=100, tile_rows=64, block_rows=128)
    table = rows.toArrow()
    found = families.find_families(table, scorer, tuning)
    assert found and sum(f.known for f in found) >= 0
    fast = cut_lineage(families.match_similar(rows, scorer, tuning))
    assert fast.filter("best_score IS NULL").count() >= 150
    totals = lambda f: {r.node: (r.matches, round(r.total, 7)) for r in f.groupBy("node").agg(F.sum("matches").alias("matches"), F.sum("score_sum").alias("total")).filter("matches > 0").collect()}
    assert totals(fast) == totals(plain)
    components = lambda f: {tuple(r) for r in matching.matched_components(rows, f, scorer).collect()}
    assert components(fast) == components(plain)


def test_grids_pay_where_directions_tell_rows_apart():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(600, 6)) * [3, 2, 1, 0.5, 0.2, 0.1]
    scorer = SimilarScorer(SIMILAR_PHOTOS)
    cells = matching.choose_cells({"points": points}, scorer, 1_000_000)
    assert cells.parts and cells.cost({"points": points}, 1_000_000, MatchTuning()) < 1_000_000**2 / 4
    # spread points cannot be told apart by a few directions, and moving rows would cost more than scoring them
    spread = rng.normal(size=(500, 64))
    assert matching.choose_cells({"points": spread / np.linalg.norm(spread, axis=1, keepdims=True)}, scorer, 1_000).parts == ()


def test_far_tiles_are_not_scored(spark):
    """Tiles of different clusters are told apart by their boxes, and the answer is that of all pairs."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(16, 8))
    vecs = (centres[rng.integers(0, 16, 3000)] + 0.02 * rng.normal(size=(3000, 8)))
    vecs = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    table = pa.table(
        {
            "node": [f"n{i}" for i in range(3000)], "weight": np.ones(3000, np.int64), "dhash": rng.integers(-(2**62), 2**62, 3000), "vec": vecs.tolist(), "aspect": np.ones(3000),
            "block": np.zeros(3000, np.int64), "is_cross": [False] * 3000, "home": [True] * 3000, "vector_home": [True] * 3000, "band": [-1] * 3000,
        }
    )
    scorer = SimilarScorer(SIMILAR_PHOTOS)
    tally = []
    out = matching._score_run(table, scorer, MatchTuning(tile_rows=64), False, tally).to_pandas()
    cosine = vecs @ vecs.T
    want = (cosine >= SIMILAR_PHOTOS.threshold).sum(axis=1) - 1
    got = np.zeros(3000, int)
    got[[int(x[1:]) for x in out["node"]]] = out["matches"]
    assert (got == want).all()
    assert sum(tally) < 0.4 * 3000 * 3000 / 2
    # what is connected does not depend on the order that rows are scored in
    linked = matching._score_run(table, scorer, MatchTuning(tile_rows=64, run_hubs=2), True).to_pandas()
    full = matching._score_run(table, scorer, MatchTuning(tile_rows=4096), False).to_pandas()
    root = lambda t: dict(zip(t["node"], t["root"]))
    one, other = root(linked), root(full)
    assert {n: other.get(n, n) for n in table["node"].to_pylist()} == {n: one.get(n, n) for n in table["node"].to_pylist()}
