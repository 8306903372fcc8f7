"""Quality rules (operator 2): rules vote or abstain, and how far to trust each is learned without labels.

Every rule looks at one measure of a text and votes good, bad or not at all. Votes of a text are one of at most
3^rules patterns, so the corpus is counted by pattern and expectation-maximisation runs on the counts: it estimates
the share of good texts and, for either class, how often each rule votes how. The posterior of a pattern, not an
all-must-pass filter, decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm import kernels as K
from frameloom.llm.common import CHUNK_BYTES, saved

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_marked", "n_same")
REPEAT_WORDS = 8
BAD, GOOD, ABSTAIN = 0, 1, 2
KEEP_FROM = 0.5


class Rule(NamedTuple):
    """Votes by ``top / bottom``: bad outside [bad_below, bad_above], good inside [good_from, good_to], else not."""

    name: str
    top: str
    bottom: str
    bad_below: float
    good_from: float
    good_to: float
    bad_above: float


INF = float("inf")
RULES = (
    Rule("length", "n_words", "", 20, 50, INF, INF),
    Rule("word length", "word_chars", "n_words", 2.5, 3.5, 8.0, 11.0),
    Rule("symbols", "n_symbols", "n_words", -INF, -INF, 0.05, 0.25),
    Rule("repeated lines", "n_dup_lines", "n_lines", -INF, -INF, 0.1, 0.5),
    Rule("repeated words", "n_repeat_words", "n_words", -INF, -INF, 0.1, 0.3),
    Rule("capitals", "n_upper", "n_letters", -INF, -INF, 0.2, 0.5),
    Rule("stutter", "n_same", "n_words", -INF, -INF, 0.1, 0.3),
    Rule("marks", "n_marked", "n_words", -INF, 0.01, 0.35, 0.6),
)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in ".,;:!?#*$%&|<>"]] = True


def measures(column: pa.Array) -> dict[str, np.ndarray]:
    """MEASURES of every text of a column."""
    data, offsets = K.text_bytes(column)
    out = {m: np.zeros(len(offsets) - 1, np.int64) for m in MEASURES}
    for lo, hi in K.slices(offsets, CHUNK_BYTES):
        part, at, n = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], hi - lo
        first, end, row = K.words(part, at)
        counts = np.bincount(row, minlength=n)

        def per_row(flags: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags)])
            return total[at[1:]] - total[at[:-1]]

        points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        found = {
            "n_words": counts,
            "word_chars": np.bincount(row, weights=points[end] - points[first], minlength=n).astype(np.int64),
            "n_symbols": per_row(_SYMBOL[part]),
            "n_letters": per_row(_LETTER[part]),
            "n_upper": per_row(_UPPER[part]),
            "n_marked": np.bincount(row, weights=_MARK[part[end - 1]] if len(end) else None, minlength=n).astype(np.int64),
        }
        found["n_lines"], found["n_dup_lines"] = _lines(part, at, first)
        hashes = K.word_hashes(part, first, end)
        found["n_repeat_words"] = _repeated(hashes, counts, row)
        again = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        found["n_same"] = np.bincount(row[1:], weights=again, minlength=n).astype(np.int64)
        for m, values in found.items():
            out[m][lo:hi] = values
    return out


def _lines(part: np.ndarray, at: np.ndarray, first_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier line, by text."""
    n = len(at) - 1
    breaks = np.flatnonzero(part == 10)
    begin = np.unique(np.concatenate([at[:-1], breaks + 1]))
    begin = begin[begin < len(part)]
    if not len(begin):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    row = np.searchsorted(at, begin, side="right") - 1
    stop = np.append(begin[1:], len(part))
    stop = stop - (part[stop - 1] == 10)
    words_before = np.searchsorted(first_words, begin), np.searchsorted(first_words, stop)
    full = words_before[1] > words_before[0]
    h = K.word_hashes(part, begin[full], stop[full])
    _, r, times = K.distinct_by_row(h, row[full])
    lines = np.bincount(row[full], minlength=n)
    return lines, np.bincount(r, weights=times - 1, minlength=n).astype(np.int64)


def _repeated(hashes: np.ndarray, counts: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Words inside windows of REPEAT_WORDS words that a text has twice or more."""
    n = len(counts)
    begin = np.cumsum(counts) - counts
    start = np.flatnonzero(np.arange(len(hashes)) - begin[row] + REPEAT_WORDS <= counts[row]) if len(row) else np.zeros(0, np.int64)
    if not len(start):
        return np.zeros(n, np.int64)
    h = np.zeros(len(start), dtype=K.U64)
    for i in range(REPEAT_WORDS):
        h = K.mix(h + hashes[start + i] * K.U64(2 * i + 3))
    r = row[start]
    order = np.lexsort((h, r))
    h, r, start = h[order], r[order], start[order]
    same = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    twice = start[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + REPEAT_WORDS, -1)
    return np.bincount(row, weights=np.cumsum(edge)[:-1] > 0, minlength=n).astype(np.int64)


def votes(found: dict[str, np.ndarray], rules: tuple[Rule, ...] = RULES) -> np.ndarray:
    """Texts by rules: BAD, GOOD or ABSTAIN; a rule whose measure has no base does not vote."""
    columns = []
    for rule in rules:
        bottom = found[rule.bottom] if rule.bottom else np.ones_like(found[rule.top])
        value = found[rule.top] / np.maximum(bottom, 1)
        vote = np.where((value < rule.bad_below) | (value > rule.bad_above), BAD, np.where((value >= rule.good_from) & (value <= rule.good_to), GOOD, ABSTAIN))
        columns.append(np.where(bottom > 0, vote, ABSTAIN))
    return np.stack(columns, axis=1)


def patterns_of(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def votes_of(patterns: np.ndarray, n_rules: int) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(n_rules) % 3


class VoteModel(NamedTuple):
    """``share`` of good texts; ``table[c, r, v]``: chance that rule r votes v on a text of class c (0 bad, 1 good)."""

    share: float
    table: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Chance that texts with these votes are good."""
        logs = np.log(self.table)
        score = [sum(logs[c, r, v[:, r]] for r in range(v.shape[1])) for c in (0, 1)]
        gap = np.log(self.share) - np.log1p(-self.share) + score[1] - score[0]
        return 1 / (1 + np.exp(-np.clip(gap, -700, 700)))


def fit_votes(v: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: float = 0.02) -> VoteModel:
    """Expectation-maximisation over vote patterns with their counts.

    ``prior`` is the weight, relative to all texts, of what is believed before: rules are right more often than
    wrong, and most texts are good. It keeps the classes from swapping and chances from reaching 0.
    """
    total = max(float(counts.sum()), 1.0)
    weight = prior * total + 1
    believed = np.array([[0.55, 0.15, 0.3], [0.05, 0.65, 0.3]])  # by class: votes bad, good, none
    good, bad = (v == GOOD).sum(1), (v == BAD).sum(1)
    # any bad vote is a reason for doubt at the start, whatever the number of good ones
    chance = np.where(bad > 0, 0.5 ** bad * 0.6, 0.95) * np.where(good + bad > 0, 1, 0.8)
    model = VoteModel(0.5, np.stack([np.tile(believed[c], (v.shape[1], 1)) for c in (0, 1)]))
    for _ in range(rounds):
        mass = np.stack([counts * (1 - chance), counts * chance])
        table = np.empty_like(model.table)
        for c in (0, 1):
            for r in range(v.shape[1]):
                n = np.bincount(v[:, r], weights=mass[c], minlength=3) + weight * believed[c]
                table[c, r] = n / n.sum()
        share = (mass[1].sum() + 0.7 * weight) / (total + weight)
        model = VoteModel(float(share), table)
        again = model.posterior(v)
        done = np.abs(again - chance).max(initial=0) < 1e-9
        chance = again
        if done:
            break
    return model


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = measures(batch.column("text"))
        pattern = patterns_of(votes(found))
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(found[m]) for m in MEASURES), pa.array(pattern)], [*names, *MEASURES, "pattern"])


def _chances(patterns: DataFrame) -> dict[int, float]:
    """The chance of being good for each vote pattern of the rows; at most 3 ** rules of them."""
    counted = patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counted:
        return {}
    found, counts = np.array([r.pattern for r in counted], np.int64), np.array([r.n for r in counted], np.float64)
    v = votes_of(found, len(RULES))
    return dict(zip(found.tolist(), fit_votes(v, counts).posterior(v).tolist()))


def fails_base(n_words, n_repeat_words):
    """Fewer than 20 words, or over 30 % of them inside repeated windows; of columns or arrays."""
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def judged(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """(doc_id, measures, base_failed, good_chance, kept) per row of ``docs``.

    kept: the base rules hold (see ``fails_base``), and the posterior chance of being good is at least ``keep_from``.
    Null and empty texts have no words and fail. Repeated rows each count; a null doc_id is kept; an empty table gives no
    rows. Other columns are not read.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + "".join(f"{m} long, " for m in MEASURES) + "pattern long"
    measured = saved(rows.mapInArrow(K.thrifty(_measure), schema), "measures")
    known = docs.sparkSession.createDataFrame(list(_chances(measured).items()), "pattern long, good_chance double")
    out = measured.join(F.broadcast(known), "pattern").withColumn("base_failed", fails_base(F.col("n_words"), F.col("n_repeat_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("good_chance") >= keep_from)).drop("pattern")


def kept_documents(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs``, all columns, that ``judged`` keeps; texts are measured twice rather than shuffled.

    Null and empty texts and those without words fail the base rules and go. Repeated rows and rows without a doc_id are
    judged each by its own text. An empty table gives no rows.
    """
    text = F.col("text").cast("string").alias("text")
    chances = _chances(docs.select(text).mapInArrow(K.thrifty(_measure), "".join(f"{m} long, " for m in MEASURES) + "pattern long"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measures(batch.column(at).cast(pa.string()))
            good = np.array([chances[p] for p in patterns_of(votes(found)).tolist()], dtype=float) >= keep_from
            yield batch.filter(pa.array(good & ~fails_base(found["n_words"], found["n_repeat_words"])))

    return docs.mapInArrow(K.thrifty(run), docs.schema)
