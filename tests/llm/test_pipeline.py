"""The pipeline against a plain version of its stages, and the registry."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from frameloom.llm import mixing, pii, quality, tokens
from tests.llm.helpers import documents, prose, words
from tests.llm.test_text_operators import plain_best_fit, plain_components, plain_targets

FOLDER = "/root/testdata/sf0.001"


def test_registry():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "personal data", "source mixing", "best-fit packing"]


def test_stages_keep_columns(spark):
    docs = documents(spark, [(i, prose(i, 60) + ".", "en", f"s{i % 4}", 0) for i in range(20)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns


def test_stages_on_awkward_rows(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, FOLDER).collect()
        assert rows, name


def test_pipeline_equals_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    found = quality.measures(pa.array([r[1] for r in rows], pa.large_string()))
    patterns = quality.patterns_of(quality.votes(found))
    known, at, counts = np.unique(patterns, return_inverse=True, return_counts=True)
    v = quality.votes_of(known, len(quality.RULES))
    good = quality.fit_votes(v, counts.astype(float)).posterior(v)[at] >= quality.KEEP_FROM
    rows = [r for r, ok in zip(rows, good & ~quality.fails_base(found["n_words"], found["n_repeat_words"])) if ok]
    rows = by_component(rows)
    rows = [(r[0], pii.mask(r[1], [s._asdict() for s in pii.base_spans(r[1])]), r[3]) for r in rows]
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    goal, copies = plain_targets(sizes), Counter()
    for source in sizes:
        mine = sorted((r for r in rows if r[2] == source), key=lambda r: hashlib.md5(f"{mixing.SEED}|{r[0]}".encode()).hexdigest())
        whole = int(goal[source] // sizes[source])
        extra, before = goal[source] - whole * sizes[source], 0
        for key, text, _ in mine:
            n = len(words(text))
            copies[key] += min(2, whole + (2 * before + n <= 2 * extra + 1e-9))
            before += n
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.public_path("byte_bpe_50k.json"))
    expected, lengths = Counter(), []
    for key, text, _ in rows:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        edges = [0, *range(min(first, len(ids)), len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(edges, edges[1:])):
            raw = np.array(ids[a:b], "<u4").tobytes()
            expected[(key, piece, a, b - a, zlib.crc32(raw))] += copies[key]
            lengths += [b - a] * copies[key]
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == +expected
    assert len({r.sequence_id for r in out}) == plain_best_fit(lengths, 1024)


def test_near_copies_of_eighty_per_cent_go(spark):
    base = prose(3, 200, 4000).split()
    rows = [(1, " ".join(base), "en", "a", 0), (2, " ".join(base[:164]), "en", "a", 0), (3, " ".join(base[:150]), "en", "a", 0)]
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, rows[:2]), FOLDER).collect()
    assert [r.doc_id for r in kept] == [1]
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, [rows[0], rows[2]]), FOLDER).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3]


def by_component(rows):
    smallest = {c[0]: c[2] for c in plain_components(rows)}
    return [r for r in rows if smallest[r[0]] == r[0]]


@pytest.mark.parametrize("name", ["op7_mixing"])
def test_native_plans_have_no_python(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
