"""Toxicity and nearest vectors: held-out accuracy, recall against brute force, awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import ann, pii, quality, toxicity
from tests.llm.helpers import SCHEMA, awkward, documents, prose, words


def labelled(n):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1000, 1000 + n):
        toxic = int(rng.random() < 0.3)
        text = prose(i, rng.randint(20, 60)).split()
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(["idiot", "worthless", "Scum,"]))
        rows.append((i, " ".join(text), "en", "a", 0))
        labels.append((i, None, toxic))
    return rows, labels


def test_toxicity(spark):
    rows, labels = labelled(900)
    docs = documents(spark, awkward() + rows)
    table = spark.createDataFrame([*labels, labels[0], (None, 1, 1), (1, 1, None), (2, None, 0)], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(docs, table).collect()
    assert len(found) == len(awkward()) + len(rows)
    truth = {i: t for i, _, t in labels}
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    unseen = [r for r in found if r.held_out and r.doc_id in truth]
    hits = [r.predicted == truth[r.doc_id] for r in unseen]
    assert len(unseen) > 200 and sum(hits) / len(hits) > 0.97
    empty = {r.score for r in found if r.doc_id in (4, 5, 6)}
    assert len(empty) == 1
    assert sorted(map(tuple, toxicity.toxicity(docs, table).collect()), key=repr) == sorted(map(tuple, found), key=repr)


def test_held_out_labels_are_never_learned_from(spark):
    rows, labels = labelled(300)
    docs = documents(spark, rows)
    schema = "doc_id long, quality int, toxic int"
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    one, other = (toxicity.toxicity(docs, spark.createDataFrame(x, schema)) for x in (labels, flipped))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))


def test_toxicity_without_rows_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(spark.createDataFrame([], SCHEMA), none).count() == 0
    assert {r.score for r in toxicity.toxicity(documents(spark), none).collect()} == {0.5}


def vectors(n, dim, seed):
    return np.random.default_rng(seed).normal(size=(n, dim)).round(3)


def plain_nearest(rows, k):
    """By query: ids and scores of the k nearest, ties to the smaller id."""
    out = {}
    for key, q in rows:
        if key % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), other) for other, v in rows if other != key and len(v) == len(q))
            out[key] = [(o, -s) for s, o in scored[:k]]
    return out


SCHEMA_V = "vec_id long, embedding array<double>, dim int, cell string"


@pytest.mark.parametrize("dim,index,least", [(16, ann.Index(), 0.9), (12, ann.Index(probes=32), 1.0), (16, ann.Index(tables=2, probes=32, bucket_rows=8), 1.0)])
def test_nearest(spark, monkeypatch, dim, index, least):
    monkeypatch.setattr(ann, "CELL_ROWS", 60)
    monkeypatch.setattr(ann, "QUERY_ROWS", 7)
    base = vectors(400, dim, 1)
    base[100:180] = base[100]  # a hot vector
    rows = [(i, list(map(float, v))) for i, v in enumerate(base)]
    odd = [(900, None), (920, []), (940, [0.0] * dim), (960, [1.0, None] + [0.0] * (dim - 2)), (980, [float("nan")] * dim), (1000, [float("inf")] + [1.0] * (dim - 1))]
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows + odd] + [(None, rows[0][1], 3, "x")], SCHEMA_V)
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20, index).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    true = plain_nearest(rows, 20)
    assert found.keys() == true.keys()
    by_id = dict(rows)
    for key, mine in found.items():
        assert len(mine) == 20 and mine == sorted(mine, key=lambda x: (-x[1], x[0]))
        assert all(math.isclose(s, sum(a * b for a, b in zip(by_id[key], by_id[o])), rel_tol=1e-9, abs_tol=1e-12) for o, s in mine)
    hits = sum(len({o for o, _ in found[q]} & {o for o, _ in true[q]}) for q in true)
    assert hits >= least * 20 * len(true)
    if least == 1.0:
        assert {q: [o for o, _ in x] for q, x in found.items()} == {q: [o for o, _ in x] for q, x in true.items()}


@pytest.mark.parametrize("n,spread", [(3000, 0.0), (6000, 1.0)])
def test_recall_with_two_turns_and_uneven_lengths(spark, n, spread):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(n, 32))
    base *= np.exp(spread * rng.normal(size=n))[:, None] / np.linalg.norm(base, axis=1)[:, None]
    rows = [(i, v.tolist(), 3, "x") for i, v in enumerate(base)]
    index = ann.Index(bucket_rows=1)
    assert (index.tables, index.probes) == (ann.Index().tables, ann.Index().probes)
    asked = np.arange(0, n, 100)
    found = {(r.query_id, r.vec_id) for r in ann.nearest(spark.createDataFrame(rows, SCHEMA_V), F.col("vec_id") % 100 == 0, 20, index).collect()}
    scores = base[asked] @ base.T
    scores[np.arange(len(asked)), asked] = -np.inf
    true = {(int(q), int(o)) for q, line in zip(asked, np.argsort(-scores, axis=1)[:, :20]) for o in line}
    assert len(found) == len(true) and len(found & true) >= 0.9 * len(true)


def test_few_candidates_and_several_lengths(spark):
    rows = [(i, list(map(float, v))) for i, v in enumerate(vectors(9, 4, 2))] + [(20 + i, list(map(float, v))) for i, v in enumerate(vectors(30, 5, 3))] + [(100, [1.0])]
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], SCHEMA_V)
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20, ann.Index(tables=1, probes=1)).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    true = {q: [o for o, _ in x] for q, x in plain_nearest(rows, 20).items() if x}
    assert found.keys() == true.keys() and len(found[0]) == 8 and sorted(found[0]) == sorted(true[0]) and found[20] == true[20]


@pytest.mark.parametrize("index", [ann.Index(), ann.Index(tables=1, probes=1, bucket_rows=1)])
def test_ids_of_many_rows(spark, index):
    base = vectors(200, 8, 5)
    rows = [(i, list(map(float, v))) for i, v in enumerate(base)]
    # a hot id nearest to the first queries, and many rows of a query's own id
    rows += [(500, [float(x) for x in 3 * base[0] + 0.01 * v]) for v in vectors(60, 8, 6)]
    rows += [(40, [float(x) for x in 2 * base[40] + 0.01 * v]) for v in vectors(60, 8, 7)]
    best = {}
    for key, q in rows:
        for other, v in rows:
            if key % 20 == 0 and other != key:
                score = sum(a * b for a, b in zip(q, v))
                best.setdefault(key, {})
                best[key][other] = max(best[key].get(other, -math.inf), score)
    true = {q: {o for o, _ in sorted(x.items(), key=lambda p: (-p[1], p[0]))[:20]} for q, x in best.items()}
    found = {}
    for r in ann.nearest(spark.createDataFrame([(i, v, 3, "x") for i, v in rows], SCHEMA_V), F.col("vec_id") % 20 == 0, 20, index).collect():
        assert math.isclose(r.score, best[r.query_id][r.vec_id], rel_tol=1e-9)
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found.keys() == true.keys() and all(len(x) == len(set(x)) == 20 for x in found.values())
    if index.probes > 1:
        assert {q: set(x) for q, x in found.items()} == true


def test_no_vectors(spark):
    assert ann.nearest(spark.createDataFrame([], SCHEMA_V), F.col("vec_id") % 20 == 0).count() == 0


def test_hadamard_keeps_lengths():
    x = vectors(50, 16, 4)
    assert np.allclose(np.linalg.norm(ann.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(ann.hadamard(ann.hadamard(x)), x)


def test_label_models_recover_planted_reliabilities():
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.8
    accuracy = [0.95, 0.85, 0.7]
    v = np.stack([np.where(rng.random(len(good)) < 0.3, quality.ABSTAIN, np.where((rng.random(len(good)) < a) == good, quality.GOOD, quality.BAD)) for a in accuracy], axis=1)
    patterns, counts = np.unique(quality.patterns_of(v), return_counts=True)
    model = quality.fit_votes(quality.votes_of(patterns, 3), counts.astype(float))
    assert abs(model.share - 0.8) < 0.1
    right = model.table[1, :, quality.GOOD] / (model.table[1, :, quality.GOOD] + model.table[1, :, quality.BAD])
    assert right[0] > right[1] > right[2] > 0.5
    soft = np.array([0.1, 0.9])
    weights = pii.fit_classifier(np.array([[pii.NO] * 6, [pii.YES] * 6]), np.array([50.0, 50.0]), soft)
    assert pii.span_features(np.array([[pii.YES] * 6])) @ weights > 0 > pii.span_features(np.array([[pii.NO] * 6])) @ weights


# --- 6: the updates of the toxicity model ----------------------------------------


def plain_features(text):
    w = []
    for x in words(text):
        x = re.sub("[A-Z]", lambda m: m.group().lower(), x)
        x = x[1:] if len(x) > 1 and x[0] in ".,;:!?\"'()[]" else x
        w.append(x[:-1] if len(x) > 1 and x[-1] in ".,;:!?\"'()[]" else x)
    stems = {("stem", x.encode()[:5]) for x in w if len(x.encode()) > 5}
    return {("word", x) for x in w} | stems | {("pair", *p) for p in zip(w, w[1:])} | {("skip", *p) for p in zip(w, w[2:])}


def plain_ftrl(rows, epochs):
    """The textbook's updates, a feature at a time."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        rate = (toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA
        if f == "bias":
            return -z[f] / rate
        return 0.0 if abs(z[f]) <= toxicity.L1 else -(z[f] - math.copysign(toxicity.L1, z[f])) / (rate + toxicity.L2)

    score = lambda text: 1 / (1 + math.exp(-sum(map(weight, plain_features(text))) - weight("bias")))
    for _ in range(epochs):
        for text, label in rows:
            g = score(text) - label
            for f in [*plain_features(text), "bias"]:
                w = weight(f)
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA * w
                n[f] += g * g
    return score


def test_scores_equal_a_plain_version(spark):
    rng = random.Random(11)
    good, bad = [f"fine{x}" for x in "abcdefgh"], ["Awful,", "(nasty", "vile!", "ärger"]
    texts = [" ".join(rng.choice(good + bad * (i % 3 == 0)) for _ in range(rng.randint(4, 12))) for i in range(240)] + ["", None, " "]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    learned = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 != 1]
    learned.sort(key=lambda i: hashlib.md5(f"{toxicity.SEED}|{i}".encode()).hexdigest())
    score = plain_ftrl([(texts[i], int(i % 3 == 0)) for i in learned], toxicity.EPOCHS)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(texts) and len({round(r.score, 3) for r in got.values()}) > 50
    for i, text in enumerate(texts):
        assert math.isclose(got[i].score, score(text), abs_tol=1e-9)
        assert got[i].held_out == (i not in set(learned)) and got[i].predicted == (got[i].score >= 0.7)
