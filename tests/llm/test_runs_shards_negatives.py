"""Periodic runs, sharding and hard negatives against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frameloom.llm import kernels as K
from frameloom.llm import negatives, periodic, sharding
from tests.llm.helpers import SCHEMA, awkward, documents, words


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def alternating(n):
    """Two words of n bytes that differ everywhere and are alike in every sum over their bytes."""
    x = [0]
    while len(x) < n:
        x += [1 - y for y in x]
    return "".join("ab"[y] for y in x[:n]), "".join("ba"[y] for y in x[:n])


# --- 13: periodic runs ---------------------------------------------


def plain_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, q, e) for (s, e), q in out.items())


def plain_digest(doc_id, text):
    w = [x for x in words(text)]
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    drop = {i for s, q, e in runs for i in range(s + q, e)}
    best = max(((e - s, -s, -q) for s, q, e in runs), default=None)
    best = (-best[1], best[0], -best[2], 1000 * best[0] // -best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{e - s},{q}\n" for s, q, e in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    return (doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def periodic_texts(n, seed):
    """Texts over few words with planted runs of all periods, one inside or beside another."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.choice([1, 5, 6, 7, 30, 70, 200, 700])
        vocabulary = [f"{x}{'ä' * (ord(x) % 3)}" for x in "abcdefghij"[: rng.choice([1, 2, 3, 10])]]
        w = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(rng.randint(0, 4)):
            a, p = rng.randrange(size), rng.randint(1, max(1, size // 5))
            for k in range(a, min(size, a + rng.randint(0, 6 * p))):
                w[k] = w[a + (k - a) % p]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w), "en", "a", 0))
    return rows


def test_periodic_runs(spark):
    long = (5000, " ".join(f"w{i % 997}" for i in range(30_000)), "en", "a", 0)  # a period of many scales
    rows = awkward() + [(100 + r[0], *r[1:]) for r in periodic_texts(150, 3)] + [long]
    docs = documents(spark, rows)
    got = collected(periodic.run_digests(periodic.periodic_runs(periodic.echoed_tails(docs))))
    small = [plain_digest(r[0], r[1]) for r in rows if r[0] != 5000]
    assert [r for r in got if r[0] != 5000] == sorted(small, key=repr)
    (row,) = [r for r in got if r[0] == 5000]
    assert zlib.crc32(b"5000") % 10 and row[1:6] == (1, 0, 30_000, 997, 30_090)


def test_periodic_runs_keep_texts_and_spans(spark):
    docs = spark.createDataFrame([(1, "go " + "la lo " * 5 + "end", "en", "a", 0), (2, None, None, None, None)], SCHEMA)
    one, two = periodic.periodic_runs(docs).orderBy("doc_id").collect()
    assert one.collapsed == "go la lo end" and [tuple(r) for r in one.runs] == [(1, 10, 2)]
    assert (two.n_words, two.runs, two.collapsed) == (0, [], "")
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, min_times=3)


def test_words_with_equal_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(K, "word_hashes", lambda data, first, end, lower=False: np.zeros(len(first), K.U64))
    text = pa.array(["a b a b a b a b a b x", "c c c c c c d e f g h i j"])
    data, offsets = K.text_bytes(text)
    first, end, row = K.words(data, offsets)
    start, stop, period = periodic.runs_of(periodic._Words(data, first, end, np.bincount(row)))
    assert list(zip(start, stop, period)) == [(0, 10, 2), (11, 17, 1)]


@pytest.mark.parametrize("n", [64, 256, 300, 1024, 8192])
def test_no_structure_makes_hashes_collide(n):
    a, b = (x.encode() for x in alternating(n))
    data = np.frombuffer(a + b, np.uint8)
    first, end = np.array([0, len(a)]), np.array([len(a), len(data)])
    one, other = K.word_hashes(data, first, end)
    assert one != other


# --- 11: sharding --------------------------------------------------


def plain_shard(doc_id, shards):
    key = "-" if doc_id is None else f"={doc_id}"
    score = lambda s: 1 / -math.log((int(hashlib.md5(f"shard-1|{s}|{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)
    return max(range(shards), key=lambda s: (score(s), -s))


def shard_rows():
    hot = [(None, "same", "en", "a", 0)] * 400 + [(None, f"other {i}", "en", "a", 0) for i in range(300)]
    return awkward() + hot + [(1000 + i, f"text {i % 7}", None, None, None) for i in range(900)]


@pytest.mark.parametrize("piece_rows, copies", [(16_384, 65_536), (5, 3)])
def test_sharding(spark, monkeypatch, piece_rows, copies):
    monkeypatch.setattr(sharding.numbered, "__defaults__", ("shard", "slot", piece_rows, copies, sharding.SEED))
    rows = shard_rows()
    got = sharding.shard_documents(documents(spark, rows)).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), "key", plain_shard(r[0], 8), plain_shard(r[0], 9)) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r.grown_shard in (r.shard, 8) for r in got)


def test_slots_do_not_depend_on_layout(spark):
    docs = documents(spark, shard_rows())
    once = collected(sharding.shard_documents(docs))
    again = collected(sharding.shard_documents(docs.repartition(7).orderBy(F.rand(3))))
    assert once == again


def test_shards_follow_their_weights(spark):
    keys = spark.range(40_000).withColumnRenamed("id", "doc_id")
    weights = [1.0, 3.0, 0.0, 4.0]
    sizes = {r.shard: r["count"] for r in sharding.sharded(keys, weights=weights).groupBy("shard").count().collect()}
    assert 2 not in sizes and all(abs(sizes[s] - 5000 * weights[s]) < 5 * math.sqrt(40_000 / 4) for s in sizes)
    moved = sharding.movement(keys, weights, [1.0, 3.0, 2.0, 4.0]).collect()
    assert all(r.new_shard in (r.shard, 2) for r in moved)
    moved = sharding.movement(keys, weights, [1.0, 2.0, 0.0, 4.0]).collect()
    assert all(r.shard in (r.new_shard, 1) for r in moved)


def test_sharding_runs_without_python(spark):
    plan = sharding.shard_documents(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert sharding.shard_documents(documents(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(["doc_id"], [0.0])


# --- 12: hard negatives --------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, id int, dim string, cuts int"


def vectors(n, dim=12, seed=0, spread=0.0):
    """Clustered vectors of uneven lengths with ties, copies and unusable rows."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    v = centres[rng.integers(0, 6, n)] + 0.3 * rng.normal(size=(n, dim))
    v = v / np.linalg.norm(v, axis=1, keepdims=True) * np.exp(spread * rng.normal(size=(n, 1)))
    v[n // 2 : n // 2 + 9] = v[0]
    return [(i, [float(np.float32(x)) for x in row], int(rng.integers(0, 4)), 1, "x", 2) for i, row in enumerate(v)]


def unusable(dim=12):
    one = [0.5] * dim
    return [
        (None, one, 1, 0, "", 0), (9001, None, 1, 0, "", 0), (9002, one, None, 0, "", 0), (9003, [], 1, 0, "", 0),
        (9004, [None, *one[1:]], 1, 0, "", 0), (9005, [float("nan"), *one[1:]], 1, 0, "", 0), (9006, [float("-inf"), *one[1:]], 1, 0, "", 0),
        (9050, one[:3], 1, 0, "", 0), (9051, one[:3], 1, 0, "", 0), (9052, one[:3], 2, 0, "", 0), (9100, [0.0] * dim, 1, 0, "", 0),
        (50, [9.0] * dim, 3, 0, "", 0),  # repeats a key with a larger label
    ]


def plain_negatives(rows, every=50):
    kept = {}
    for vec_id, v, label, *_ in rows:
        if vec_id is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        row = (str(label), len(v), [math.floor(256 * x) for x in v])
        kept[vec_id] = min(kept.get(vec_id, row), row)
    out = []
    for a, (label, n, v) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), b, lab) for b, (lab, m, w) in kept.items() if b != a and m == n)
        for p, pos, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and -50 * p <= -100 * s[0] <= -95 * p][:3]
            out += [(a, pos, i + 1, neg, -p, -s) for i, (s, neg, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("spread, cell, lot, bucket", [(0.0, 1 << 20, 1 << 18, 512), (0.8, 400, 40, 7)])
def test_hard_negatives(spark, monkeypatch, spread, cell, lot, bucket):
    monkeypatch.setattr(negatives, "CELL_VALUES", cell)
    monkeypatch.setattr(negatives, "LOT_VALUES", lot)
    monkeypatch.setattr(negatives, "BUCKET_ROWS", bucket)
    rows = vectors(700, spread=spread, seed=int(10 * spread)) + unusable()
    df = spark.createDataFrame(rows, VECTORS)
    got = negatives.hard_negatives(negatives.relabelled(df), F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)


def test_hard_negatives_of_few_rows(spark):
    df = spark.createDataFrame(vectors(3), VECTORS)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.hard_negatives(df.filter("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0
    large = spark.createDataFrame([(0, [3e30, 1.0], 1, 0, "", 0), (1, [2e30, 5.0], 1, 0, "", 0), (2, [1.0, 1.0], 1, 0, "", 0)], VECTORS)
    assert negatives.hard_negatives(large, F.col("vec_id") == 0).count() == 0


def ask_table(rows, low, high):
    return pa.table({"q_id": [r[0] for r in rows], "q_label": [str(r[2]) for r in rows], "q_vec": [[256 * x // 1 for x in r[1]] for r in rows], "lows": [[low]] * len(rows), "highs": [[high]] * len(rows)})


def cell_table(rows):
    return pa.table({"id": [r[0] for r in rows], "label": [str(r[2]) for r in rows], "vec": [[256 * x // 1 for x in r[1]] for r in rows]})


def test_lengths_and_coordinates_prune(monkeypatch):
    """On clustered rows of uneven lengths a small part of all pairs is scored, and the answer is that of all pairs."""
    monkeypatch.setattr(negatives, "BUCKET_ROWS", 128)
    rows = vectors(6000, dim=16, seed=4, spread=0.7)
    asks = rows[:40]
    work = []
    got = negatives._search(5, True, work)(ask_table(asks, negatives.LEAST, negatives.MOST), cell_table(rows)).to_pylist()
    a, p = (np.floor(256 * np.array([r[1] for r in x])).astype(np.int64) for x in (asks, rows))
    want = []
    for i, r in enumerate(asks):
        scored = sorted((-int(s), b[0]) for s, b in zip(p @ a[i], rows) if b[2] == r[2] and b[0] != r[0])[:5]
        want += [(r[0], b, -s) for s, b in scored]
    assert sorted((x["ask"], x["id"], x["score"]) for x in got) == sorted(want)
    done, every = map(sum, zip(*work))
    assert done < 0.25 * len(asks) * len(rows)
    assert every <= len(asks) * len(rows)


def test_feasible_ranges_hold(monkeypatch):
    rng = np.random.default_rng(7)
    q, p = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.normal(size=(50, 5)), rng.normal(size=(4000, 5))))
    cosine = rng.uniform(-0.5, 1, 50)
    least, most = negatives.feasible(q, cosine)
    for i in range(50):
        close = p[p @ q[i] >= cosine[i]]
        assert ((close >= least[i]) & (close <= most[i])).all()
