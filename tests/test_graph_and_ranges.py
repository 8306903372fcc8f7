"""Components, duration ranges and hash bands against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.config import DUPLICATE_VIDEOS, MatchTuning
from frameloom.operators import blocking, ranges
from frameloom.operators.components import connected_components
from frameloom.plans.videos import video_candidates
from tests.test_matching import brute_components


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r.component, set()).add(r.node)
    return out


def test_components_of_random_graphs(spark):
    for seed in range(3):
        rng = random.Random(seed)
        edges = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)]
        df = spark.createDataFrame(edges, "a string, b string")
        found = grouped(connected_components(df, "a", "b").collect())
        names = {n for e in edges for n in e}
        assert {frozenset(g) for g in found.values()} == brute_components(names, edges)
        assert all(name == min(group) for name, group in found.items())


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, 2000 + i) for i in range(300)]
    df = spark.createDataFrame(chain + hub, "a long, b long")
    sizes = {r.component: r["count"] for r in connected_components(df, "a", "b").groupBy("component").count().collect()}
    assert sizes == {0: 201, 1000: 301}


def test_self_edges_alone_make_no_component(spark):
    df = spark.createDataFrame([("a", "a")], "a string, b string")
    assert connected_components(df, "a", "b").count() == 0


def random_videos(seed, count=150):
    rng = random.Random(seed)
    durations = [rng.choice([rng.uniform(0, 5), rng.uniform(30, 36), rng.uniform(100, 130), 33.3333333, 15.0]) for _ in range(count)]
    sizes = [(1920, 1080), (1440, 1080), (1000, 1000), (0, 10), (2400, 1080), (1300, 1000)]
    return [(f"v{i:03d}", "video", d, *rng.choice(sizes)) for i, d in enumerate(durations)]


def matches(a, b):
    def ratio(v):
        return max(v[3], v[4]) / min(v[3], v[4]) if v[3] > 0 and v[4] > 0 else 1.0

    low, high = sorted((a[2], b[2]))
    return high - low <= max(1.0, low * 0.03) and abs(ratio(a) - ratio(b)) <= 0.25


SCHEMA = "asset_id string, kind string, duration double, pixel_width int, pixel_height int"


def test_range_links_have_the_components_of_all_pairs(spark):
    for seed in range(4):
        videos = random_videos(seed)
        pairs = [(a[0], b[0]) for a, b in itertools.combinations(videos, 2) if matches(a, b)]
        groups = {}
        for r in video_candidates(spark.createDataFrame(videos, SCHEMA)).collect():
            groups.setdefault(r.component, set()).add(r.asset_id)
        assert {frozenset(g) for g in groups.values()} == brute_components([v[0] for v in videos], pairs)


@pytest.mark.parametrize("lot_profiles", [100_000, 5])
def test_candidate_partner_counts(spark, lot_profiles):
    videos = random_videos(9)
    df = spark.createDataFrame(videos, SCHEMA)
    partners = ranges.candidate_partners(df, lot_profiles=lot_profiles)
    total = partners.agg(F.sum(F.col("videos") * F.col("partners"))).first()[0]
    assert total == 2 * sum(matches(a, b) for a, b in itertools.combinations(videos, 2))


def test_videos_in_range_equals_the_rule():
    rng = np.random.default_rng(11)
    rules = DUPLICATE_VIDEOS
    durations = np.unique(np.concatenate([rng.uniform(0, 200, 400), rng.integers(0, 200, 60) * 1.0, rng.integers(0, 200, 60) * 1.03]))
    videos = rng.integers(1, 5, len(durations))
    asked = np.concatenate([durations, durations * 1.03, durations + 1.0, rng.uniform(0, 300, 200)])
    low, high = np.minimum(asked[:, None], durations[None, :]), np.maximum(asked[:, None], durations[None, :])
    fits = high - low <= np.maximum(rules.min_tolerance_seconds, low * rules.tolerance_ratio)
    assert (ranges.videos_in_range(asked, durations, videos, rules) == (fits * videos).sum(1)).all()


def test_tolerance_bounds_are_inclusive(spark):
    videos = [("a", "video", 10.0, 4, 3), ("b", "video", 11.0, 4, 3), ("c", "video", 12.5, 4, 3)]
    rows = video_candidates(spark.createDataFrame(videos, SCHEMA)).collect()
    assert {r.asset_id for r in rows} == {"a", "b"}


def test_range_join_has_no_cartesian_product(spark):
    df = spark.createDataFrame(random_videos(1), SCHEMA)
    plan = ranges.candidate_partners(df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("split_rows", [50_000, 10])
def test_close_hashes_equal_all_pairs(spark, split_rows):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**63))
    values = {base}
    for _ in range(300):
        v = base
        for b in rng.choice(64, rng.integers(0, 9), replace=False):
            v ^= 1 << int(b)
        values.add(v)
    values |= {int(v) for v in rng.integers(0, 2**63, 50)}
    photos = {v: 1 + i % 3 for i, v in enumerate(sorted(values))}
    want = {}
    for v in values:
        near = [(photos[w] - (w == v), (v ^ w).bit_count()) for w in values if (v ^ w).bit_count() <= 4 and (w != v or photos[v] > 1)]
        if near:
            want[v - 2**64 if v >= 2**63 else v] = (photos[v], sum(n for n, _ in near), photos[v] * sum(n for n, _ in near), min(h for _, h in near))
    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v, n) for v, n in photos.items()], "dhash long, photos long")
    tuning = MatchTuning(split_rows=split_rows, block_rows=16, tile_rows=5)
    rows = blocking.close_hashes(df, [], tuning=tuning).collect()
    assert {r.dhash: tuple(r)[1:] for r in rows} == want


def test_photos_without_a_hash_are_nobody_s_partner(spark):
    df = spark.createDataFrame([(None,)] * 10 + [(7,), (7,)], "dhash long")
    assert [tuple(r) for r in blocking.close_hashes(blocking.hash_counts(df), []).collect()] == [(7, 2, 1, 2, 0)]
