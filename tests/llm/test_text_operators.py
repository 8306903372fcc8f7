"""Operators on documents against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from frameloom.llm import lm, mixing, ngram_join, packing, pii, quality, suffix_dedup, tokens
from tests.llm.helpers import SCHEMA, awkward, documents, prose, words


def by_row(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- 1: n-gram Jaccard join --------------------------------------


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in words(text)]
    return {tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))} if w else set()


def plain_components(rows):
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = []
    for i, r in enumerate(rows):
        ids = [s[0] for s, x in zip(rows, label) if x == label[i] and s[0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids else r[0]))
    return sorted(out, key=repr)


def families(n):
    """Texts with copies and near copies at all distances around the threshold."""
    rows = []
    for family in range(3):
        base = prose(family, 150 + 40 * family).split()
        for copy in range(n):
            text = list(base)
            for k in range(copy % 9):
                text[(copy * 31 + k * 17) % len(text)] = f"new{copy}x{k}"
            rows.append((len(rows), " ".join(text), "en", "a", 0))
    return rows


def plain_links(rows):
    sets = [shingles(r[1]) for r in rows]
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 85 * len(a | b)
    return [sum(linked(a, b) for j, b in enumerate(sets) if i != j) for i, a in enumerate(sets)]


@pytest.mark.parametrize("block_rows, items", [(2000, 1 << 20), (7, 1 << 20), (2000, 900)])
def test_jaccard_components(spark, monkeypatch, block_rows, items):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(ngram_join, "BLOCK_ITEMS", items)
    monkeypatch.setattr(ngram_join, "ITEMS_AT_ONCE", 500)
    rows = awkward() + [(100 + r[0], *r[1:]) for r in families(25)]
    found = ngram_join.jaccard_components(documents(spark, rows))
    assert by_row(found.select("doc_id", "n_shingles", "component_id")) == plain_components(rows)
    links = Counter((r.doc_id, r.n_links) for r in found.collect())
    assert links == Counter((r[0], n) for r, n in zip(rows, plain_links(rows)))


def chance_family(n, seed=0):
    """Texts over a few words: n-grams hold all of them together, and next to none are linked."""
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice("abcdefghijkl") for _ in range(24)), "en", "a", 0) for i in range(n)]


@pytest.mark.parametrize("block_rows", [40, 8])
def test_jaccard_by_gram_equals_all_pairs(spark, monkeypatch, block_rows):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block_rows)
    rows = chance_family(400)
    # copies and near copies of some of them, also such that share a frequent n-gram
    rows += [(1000 + i, r[1], "en", "a", 0) for i, r in enumerate(rows[:9])]
    rows += [(2000 + i, r[1] + " m", "en", "a", 0) for i, r in enumerate(rows[:30])]
    found = ngram_join.jaccard_components(documents(spark, rows))
    assert by_row(found.select("doc_id", "n_shingles", "component_id")) == plain_components(rows)
    assert sorted((r.doc_id, r.n_links) for r in found.collect()) == sorted((r[0], n) for r, n in zip(rows, plain_links(rows)))


def test_unlinked_families_are_laid_out_in_proportion(spark, monkeypatch):
    laid_out = {}
    plain = ngram_join._block_product
    for n in (3000, 6000):
        counted = spark.sparkContext.accumulator(0)

        def product(threshold, n_buckets):
            def run(table):
                counted.add(table.num_rows)
                return plain(threshold, n_buckets)(table)

            return run

        monkeypatch.setattr(ngram_join, "_block_product", product)
        monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 100)
        assert ngram_join.jaccard_components(documents(spark, chance_family(n))).filter("n_links > 0").count() < n / 50
        laid_out[n] = counted.value
    # a class has some four n-grams in its prefix; every part of a family with every other would be 60 rows a class
    assert all(rows < 6 * n for n, rows in laid_out.items())


def test_jaccard_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TOP_FREQUENCY", 3)
    rows = [(r[0], r[1] + " the same end of every text here", *r[2:]) for r in families(12)]
    found = ngram_join.jaccard_components(documents(spark, rows)).select("doc_id", "n_shingles", "component_id")
    assert by_row(found) == plain_components(rows)


def test_shared_rows_across_batches():
    rows = [(s, c) for s, cs in ((1, [5]), (2, [1, 1, 4]), (3, [2, 3, 7, 9, 9, 11]), (4, [8]), (6, [1, 2])) for c in cs]
    for step in (1, 2, 5, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows[i : i + step]], pa.int64()), pa.array([c for _, c in rows[i : i + step]], pa.int64())], ["shingle", "cls"]) for i in range(0, len(rows), step)]
        out = sorted(tuple(r.values()) for b in ngram_join._shared(iter(batches)) for r in b.to_pylist())
        assert out == [(2, 1, 2), (2, 4, 2), (3, 2, 5), (3, 3, 5), (3, 7, 5), (3, 9, 5), (3, 11, 5), (6, 1, 2), (6, 2, 2)]


def test_representatives_keep_columns_and_one_of_each_group(spark):
    docs = documents(spark)
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    # base, its copy, near copy and null-id copy are one group, named by the null id; empty texts stay
    assert sorted(x for x in ids if x is not None) == [4, 5, 6, 7, 9, 10, 11, 12, 13, 14]
    assert ids.count(None) == 2


# --- 2: quality rules --------------------------------------------


def plain_measures(text):
    text = text or ""
    w = words(text)
    lines, seen, repeated = 0, set(), 0
    for line in text.split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def test_measures(spark):
    rows = awkward() + [(50, "one two three four five six seven eight nine " * 4, "en", "a", 0), (51, "a\n" * 40 + "<b>\n" * 3, "en", "a", 0)]
    found = quality.judged(documents(spark, rows))
    got = sorted(((r.doc_id, *(r[m] for m in quality.MEASURES[:5])) for r in found.collect()), key=repr)
    assert got == sorted(((r[0], *plain_measures(r[1])) for r in rows), key=repr)
    for r in found.collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_votes_are_learned(spark):
    good = [(i, prose(i, 80) + " And so on, it goes. Well.", "en", "a", 0) for i in range(60)]
    bad = [(100 + i, " ".join(w.upper() + "***" for w in prose(i, 80).split()), "en", "a", 0) for i in range(20)]
    found = {r.doc_id: r.kept for r in quality.judged(documents(spark, good + bad)).collect()}
    assert all(found[r[0]] for r in good) and not any(found[r[0]] for r in bad)
    docs = documents(spark, good + bad)
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in good}


# --- 3: personal data --------------------------------------------


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        d = int(c) * (1 + i % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, text or "") if ok(m.group())]


def test_base_spans_random():
    import random

    rng = random.Random(3)
    parts = ["a", "b.", "@", ".", "-", "1", "22", "255", "256", "+", " ", "(", ")", "_", "%", "0", "4111111111111111", "é", "a@b.c"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.joined(pii.base_spans(text)) == ",".join(plain_spans(text)), text


def test_personal_data(spark):
    found = pii.personal_data(documents(spark)).collect()
    expected = sorted(((r[0], hashlib.sha256(",".join(plain_spans(r[1])).encode()).hexdigest()) for r in awkward()), key=repr)
    assert sorted(((r.doc_id, r.base_sha256) for r in found), key=repr) == expected
    one = next(r for r in found if r.doc_id == 12)
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 1, 1) and set(plain_spans(awkward()[11][1])) <= set(one.spans.split(","))


def test_long_runs_take_linear_time():
    assert pii.base_spans("a" * 300_000 + "@") == [] and pii.base_spans("1" * 300_000) == []
    assert pii.base_spans("1." * 100_000)[:1] == [pii.Span(1, 0, 7, True)]
    assert pii.base_spans("+1" + " " * 300_000) == []


def test_masked(spark):
    docs = documents(spark)
    out = pii.masked(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r for r in out.collect()}
    assert texts[12].text == "mail me at <EMAIL> or <PHONE>, card <CARD>, host <IP> now" and texts[12].n_chars == len(texts[12].text)
    assert texts[7].text == "two words" and texts[4].text is None and texts[5].text == ""


def test_looser_spans_are_added_where_the_labelers_agree(spark):
    strict = [(i, f"phone +1 (386) 555-37{i:02d} is mine", "en", "a", 0) for i in range(30)]
    loose = [(100 + i, f"call my phone (386) 555-47{i:02d} please", "en", "a", 0) for i in range(30)]
    found = {r.doc_id: r.spans for r in pii.personal_data(documents(spark, strict + loose)).collect()}
    assert found[100] == "phone:14:28" and found[1] == "phone:6:23"


# --- 4 and 8: tokens and packing ---------------------------------


def test_fast_encoding_equals_the_library():
    encoder = packing.Encoder("byte_bpe_50k.json")
    points = [chr(c) for c in range(0x530) if chr(c) not in "\ud800"] + [chr(c) for c in range(0x2000, 0x2070)]
    texts = [pattern.format(c) for c in points for pattern in ("{0}", "a{0}b", " {0} ", "1{0}{0}2", "x {0}y", "{0}\n{0} ")]
    texts += ["a" * 5000, " " * 5000, "it's we'll I'D don’t", "<|endoftext|> a<|endoftext|>"] + [r[1] or "" for r in awkward()]
    plain = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.ids(texts)] == plain


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.public_path("byte_bpe_50k.json"))
    rows = packing.pack_documents(documents(spark), "byte_bpe_50k.json").collect()
    ids = {}
    for key, text in {(r[0], r[1]) for r in awkward()}:
        ids.setdefault(key, []).append(tokenizer.encode(text or "", add_special_tokens=False).ids + [2])
    for r in rows:
        raw = [pa.array(x[r.start : r.start + r.length], pa.uint32()).buffers()[1].to_pybytes()[: 4 * r.length] for x in ids[r.doc_id]]
        assert r.ids_crc32 in {zlib.crc32(x) for x in raw}
        assert r.length == 1024 or r.piece == 0
    assert sum(r.length for r in rows) == sum(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in awkward())
    gapless(rows, 1024)


def gapless(rows, capacity):
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert all(x <= capacity for x in at.values())
    return len(at)


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_best_fit_decreasing_opens_as_many_bins_as_the_plain_one():
    import random

    rng = random.Random(4)
    for _ in range(200):
        capacity = rng.randint(1, 60)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        flows = packing.best_fit_decreasing(Counter(lengths), capacity)
        used, ends = {}, Counter()
        for length, n in Counter(lengths).items():
            mine = sorted((f for f in flows if f.length == length), key=lambda f: f.first)
            for at in range(n):
                f = [f for f in mine if f.first <= at][-1]
                turn = at - f.first
                b, offset = f.bin + turn // f.per_bin, f.offset + length * (turn % f.per_bin)
                used.setdefault(b, []).append((offset, length))
                ends[b] += length
        for b, items in used.items():
            at = 0
            for offset, length in sorted(items):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(used) == plain_best_fit(lengths, capacity)


@pytest.mark.parametrize("vocabulary", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(tokens, "PIECE_CHARS", 50)
    if vocabulary.endswith(".model"):
        import sentencepiece

        count = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=tokens.public_path(vocabulary)).encode(t))
    else:
        from tokenizers import Tokenizer

        count = lambda t: len(Tokenizer.from_file(tokens.public_path(vocabulary)).encode(t, add_special_tokens=False).ids)
    rows = awkward() + [(60, "a  b   c ▁ d ▁▁e " * 40, "en", "a", 0), (61, " lead and trail " * 30 + " ", "en", "a", 0), (62, "word\n next\t word  " * 30, "en", "a", 0)]
    found = tokens.count_tokens(documents(spark, rows), vocabulary)
    assert by_row(found) == sorted(((r[0], len((r[1] or "").encode()), count(r[1] or "")) for r in rows), key=repr)


# --- 5: suffix-array dedup ---------------------------------------


def plain_removed(rows, depth=100):
    """By (doc_id, text): bytes, removed bytes, spans and the hash of what stays."""
    first = {}
    for key, text in rows:
        b = (text or "").encode()
        for s in range(len(b) - depth + 1):
            w = b[s : s + depth]
            place = (-1 if key is None else key, s)
            first[w] = min(first.get(w, place), place)
    out = []
    for key, text in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - depth + 1):
            if first[b[s : s + depth]] < (-1 if key is None else key, s):
                gone[s : s + depth] = [True] * depth
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("at_once", [1 << 20, 40])
def test_repeats(spark, monkeypatch, at_once):
    monkeypatch.setattr(suffix_dedup, "ROWS_AT_ONCE", at_once)
    base = prose(7, 60)
    rows = [r for r in awkward() if r[0] != 11]
    rows += [(20 + i, prose(30 + i, 12) + base[i * 7 : i * 7 + 95 + i] + prose(60 + i, 9), "en", "a", 0) for i in range(15)]
    rows += [(40, base + base, "en", "a", 0), (41, "ab" * 300, "en", "a", 0), (42, "z" * 99, "en", "a", 0), (43, "z" * 100, "en", "a", 0), (44, "z" * 101, "en", "a", 0)]
    found = suffix_dedup.remove_repeats(documents(spark, rows))
    assert by_row(found) == plain_removed([r[:2] for r in rows])


def test_repeats_of_many_texts_under_one_doc_id(spark):
    shared = [prose(500 + i, 30) for i in range(40)]
    rows = []
    for i in range(2400):
        # passages at equal and other places of texts of one doc_id; whole, or a part that is longer elsewhere
        lead = f"{i % 3} " if i % 5 else ""
        text = lead + shared[i % 40][: 110 + i % 60] + prose(9000 + i, 6 + i % 30)
        rows.append((None if i % 3 == 0 else 7 if i % 3 == 1 else i, text, "en", "a", 0))
    found = suffix_dedup.remove_repeats(documents(spark, rows))
    assert by_row(found) == plain_removed([r[:2] for r in rows])


# --- 7: mixing ---------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), budget=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = budget * sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_w = sum(w[s] for s in names if s not in full)
        over = {s for s in names if s not in full and left * w[s] / open_w > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else left * w[s] / open_w for s in names}
        full |= over


def test_mixing(spark):
    rows = awkward() + [(200 + i, prose(i, 5 + i % 50), "en", f"s{i % 7}", 0) for i in range(300)]
    docs = documents(spark, rows)
    found = mixing.mix(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    goal = plain_targets(sizes)
    taken = Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    largest = {s: max(len(words(r[1])) for r in rows if r[3] == s) for s in sizes}
    assert all(abs(taken[s] - goal[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    assert by_row(mixing.mix(docs)) == sorted(map(tuple, found), key=repr)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    again = Counter()
    for r in mixed.collect():
        again[r.source] += len(words(r.text))
    assert again == +taken


# --- 10: language-model scores -----------------------------------


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_scores(spark, monkeypatch, order):
    import math

    monkeypatch.setattr(lm, "BLOCK_BYTES", 300)
    rows = [r for r in awkward() if r[0] not in (9, 10, 11)] + [(70 + i, prose(i % 4, 30, 40), "en", "a", 0) for i in range(12)]
    texts = [words(r[1]) for r in rows]
    own = [[Counter(tuple(w[i - n + 1 : i + 1]) for i in range(n - 1, len(w))) for n in range(1, order + 1)] for w in texts]
    every = [sum((o[n] for o in own), Counter()) for n in range(order)]
    total = sum(map(len, texts))
    expected = []
    for r, w, mine in zip(rows, texts, own):
        score, others = 0.0, total - len(w)
        rest = lambda g: every[len(g) - 1][g] - mine[len(g) - 1][g]  # noqa: B023, E731
        for i in range(len(w)):
            most = min(order, i + 1)
            for n in range(most, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if rest(g) > 0:
                    score += math.log(rest(g) / (rest(g[:-1]) if n > 1 else others)) + (most - n) * math.log(0.4)
                    break
            else:
                score += math.log(1 / (others + 1)) + most * math.log(0.4)
        expected.append((r[0], len(w), round(score, 6)))
    found = lm.backoff_scores(documents(spark, rows), order=order).collect()
    assert sorted(((r.doc_id, r.n_words, round(r.log_score, 6) + 0.0) for r in found), key=repr) == sorted(((a, b, c + 0.0) for a, b, c in expected), key=repr)
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in found)


# --- all: empty tables -------------------------------------------


@pytest.mark.parametrize(
    "operator",
    [
        ngram_join.jaccard_components,
        ngram_join.representatives,
        quality.judged,
        quality.kept_documents,
        pii.personal_data,
        pii.masked,
        lambda d: packing.pack_documents(d, "byte_bpe_50k.json"),
        suffix_dedup.remove_repeats,
        mixing.mix,
        mixing.mixed_documents,
        lambda d: tokens.count_tokens(d, "piece_bpe_32k.model"),
        lm.backoff_scores,
    ],
)
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0
