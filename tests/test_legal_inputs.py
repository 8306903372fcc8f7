"""Groups on every legal input: null, empty and zero vectors, null hashes, two vector lengths; any tuning."""

import itertools

import numpy as np
import pytest

from frameloom.config import MatchTuning
from frameloom.plans import photos as P
from frameloom.plans import videos as VD
from tests.test_matching import brute_components

TUNINGS = [
    MatchTuning(split_rows=s, max_hubs=h, block_rows=16, tile_rows=4, max_pivots=32, sample_rows=64, pairs_per_moved_row=0.0, run_hubs=4)
    for s in (5, 50, 10**9)
    for h in (1, 256)
]
PHOTO = "asset_id string, kind string, pixel_width int, pixel_height int, file_size long"
VIDEO = "asset_id string, kind string, duration double, pixel_width int, pixel_height int, file_size long"


def near(rng, centre, spread):
    return (centre + rng.normal(size=len(centre)) * spread).tolist()


@pytest.fixture(scope="module")
def library():
    rng = np.random.default_rng(8)
    odd = [None, [], [0.0] * 8, [0.0] * 16, [1.0, None] + [0.0] * 6]
    rows = []
    for c, size in enumerate((8, 16, 8, 16)):
        centre, bits = rng.normal(size=size), int(rng.integers(0, 2**62))
        for i in range(14):
            rows.append((f"p{c}_{i:02d}", None if i % 5 == 4 else bits ^ (1 << i % 3), near(rng, centre * (1 + i % 2), 0.01 if i < 8 else 0.1)))
        rows += [(f"p{c}_odd{j}", bits, v) for j, v in enumerate(odd)]
    return rows


def unit(v):
    a = np.array([np.nan if x is None else x for x in v or []], float)
    return a / np.linalg.norm(a) if len(a) and np.isfinite(a).all() and a.any() else None


def same_groups(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.group_id, set()).add(r.asset_id)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("tuning", TUNINGS)
def test_photo_groups(spark, library, tuning):
    assets = spark.createDataFrame([(n, "photo", 40, 40, 5) for n, _, _ in library], PHOTO)
    features = spark.createDataFrame(library, "asset_id string, dhash long, vec array<double>")
    known = [(n, h, unit(v)) for n, h, v in library if unit(v) is not None]
    bits = lambda a, b: None if a is None or b is None else (a ^ b).bit_count()
    duplicates, similar, scores = [], [], {}
    for (a, ha, va), (b, hb, vb) in itertools.combinations(known, 2):
        if len(va) != len(vb):
            continue
        distance, cosine, d = np.linalg.norm(va - vb), min(1.0, float(va @ vb)), bits(ha, hb)
        if d is not None and d <= 4 and distance <= 0.05:
            duplicates.append((a, b))
        if cosine >= 0.86 and not (cosine >= 0.985 and d is not None and d <= 4):
            similar.append((a, b))
            scores[a, b] = cosine
    names = [n for n, _, _ in known]
    assert len(duplicates) > 20 and len(similar) > 20
    assert same_groups(P.duplicate_photo_groups(assets, features, tuning=tuning).collect()) == brute_components(names, duplicates)
    found = P.similar_photo_groups(assets, features, spark.createDataFrame([], "asset_id string"), tuning=tuning).collect()
    groups = brute_components(names, similar)
    assert same_groups(found) == groups
    mean = {g: np.mean([s for (a, _), s in scores.items() if a in g]) for g in groups}
    for r in found:
        assert r.average_similarity == pytest.approx(next(m for g, m in mean.items() if r.asset_id in g), abs=1e-9)
    matches = {r.asset_id: r.matches for r in P.similar_matches(assets, features, tuning=tuning).collect()}
    assert matches == {n: k for n in names if (k := sum(n in e for e in similar))}


@pytest.mark.parametrize("align", ["position", "fraction"])
@pytest.mark.parametrize("tuning", TUNINGS[::2])
def test_video_groups(spark, tuning, align):
    rng = np.random.default_rng(9)
    rows = []
    for c, size in enumerate((6, 10)):
        centres = rng.normal(size=(5, size))
        for i in range(10):
            frames = [near(rng, f, 0.02 if i < 6 else 0.2) for f in centres]
            if i == 1:
                frames[2] = [0.0] * size
            if i == 2:
                frames[4] = None
            if i == 3:
                frames = frames[:3] + [[], None]
            rows.append((f"v{c}_{i}", frames))
    assets = spark.createDataFrame([(n, "video", 10.0, 40, 40, 5) for n, _ in rows], VIDEO)
    frames = spark.createDataFrame(rows, "asset_id string, frames array<array<double>>")
    prints = {n: [unit(f) for f in fs if align == "fraction" or unit(f) is not None] for n, fs in rows}
    edges = []
    for a, b in itertools.combinations(prints, 2):
        pairs = [(x, y) for x, y in zip(prints[a], prints[b]) if x is not None and y is not None]
        if len(pairs) >= 4 and len(pairs[0][0]) == len(pairs[0][1]):
            d = [np.linalg.norm(x - y) for x, y in pairs]
            if max(d) <= 0.22 and np.mean(d) <= 0.16:
                edges.append((a, b))
    assert len(edges) > 10
    assert same_groups(VD.duplicate_video_groups(assets, frames, tuning=tuning, align=align).collect()) == brute_components(list(prints), edges)


def test_photos_nobody_could_compare_are_no_duplicates(spark):
    rows = [(f"n{i}", 5, v) for i, v in enumerate([None, None, [], [], [0.0, 0.0], [0.0, 0.0]])]
    assets = spark.createDataFrame([(n, "photo", 40, 40, 5) for n, _, _ in rows], PHOTO)
    features = spark.createDataFrame(rows, "asset_id string, dhash long, vec array<double>")
    assert P.duplicate_photo_groups(assets, features).count() == 0
    assert P.similar_photo_groups(assets, features, spark.createDataFrame([], "asset_id string")).count() == 0
