"""Toxicity (operator 6): FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct lower-cased words, the first bytes of long ones, word pairs and pairs with one word
between, hashed to ``2**BITS`` places. FTRL-proximal keeps a rate per coordinate and L1 sparsity, so the weights are few and small enough to send to
every task: never more than the table of places.

Training reads the features of a bounded sample of the labelled rows, at most TRAIN_ROWS in a seeded order, in one task; texts
stay where they are. Scoring reads every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm import kernels as K
from frameloom.llm.common import CHUNK_BYTES, saved

BITS = 20
STEM_BYTES = 5
# Bound of the training sample, passes over it, and the seed of its order.
TRAIN_ROWS = 20_000
EPOCHS = 5
SEED = "toxic-1"
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 1.0
PREDICT_FROM = 0.7
_EDGE = frozenset(b".,;:!?\"'()[]")
_TRIM = np.zeros(256, dtype=bool)
_TRIM[list(_EDGE)] = True


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows: (first row, end row, feature places by row, ends of the rows in them)."""
    data, offsets = K.text_bytes(column)
    mask = K.U64((1 << BITS) - 1)
    for lo, hi in K.slices(offsets, CHUNK_BYTES):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        first, end, row = K.words(part, at)
        # one mark at either end of a word is not part of it
        longer = end - first > 1
        first = first + (longer & _TRIM[part[first]]) if len(first) else first
        end = end - ((end - first > 1) & _TRIM[part[end - 1]]) if len(end) else end
        h = K.word_hashes(part, first, end, lower=True)
        stem = K.word_hashes(part, first, np.minimum(end, first + STEM_BYTES), lower=True)
        long = end - first > STEM_BYTES
        found, rows = [h, K.mix(stem[long] + K.U64(0x3C6EF372FE94F82B))], [row, row[long]]
        for gap, salt in ((1, 0x1F83D9ABFB41BD6B), (2, 0x5BE0CD19137E2179)):
            if len(h) > gap:
                same = row[gap:] == row[:-gap]
                found.append(K.mix(h[:-gap][same] * K.U64(0xA0761D6478BD642F) + h[gap:][same] + K.U64(salt)))
                rows.append(row[gap:][same])
        place, r, _ = K.distinct_by_row(K.mix(np.concatenate(found)) & mask, np.concatenate(rows))
        yield lo, hi, place.astype(np.int64), np.cumsum(np.bincount(r, minlength=hi - lo))


class Ftrl:
    """FTRL-proximal; coordinate 0 of the extra place is the bias, which has no L1."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.bias = size

    def weights(self, places: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[places], self.n[places]
        shrink = np.maximum(np.abs(z) - self.l1, 0)
        return -np.sign(z) * shrink / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def bias_weight(self) -> float:
        return float(-self.z[self.bias] / ((self.beta + np.sqrt(self.n[self.bias])) / self.alpha))

    def learn(self, places: np.ndarray, label: int) -> None:
        w, b = self.weights(places), self.bias_weight()
        p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -50, 50)))
        g = p - label
        n = self.n[places]
        self.z[places] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[places] = n + g * g
        n0 = self.n[self.bias]
        self.z[self.bias] += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / self.alpha * b
        self.n[self.bias] = n0 + g * g


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of each text in place of the text."""
    for batch in batches:
        for lo, hi, place, ends in features(batch.column("text")):
            part = batch.slice(lo, hi - lo)
            lists = pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("turn", "doc_id", "tie", "toxic")), lists], ["turn", "doc_id", "tie", "toxic", "places"])


def _train(epochs: int):
    def run(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by([("turn", "ascending"), ("doc_id", "ascending"), ("tie", "ascending")])
        labels = np.asarray(sample.column("toxic"))
        lists = sample.column("places").combine_chunks()
        ends = np.asarray(lists.offsets)
        rows = np.split(np.asarray(lists.flatten()), (ends - ends[0])[1:-1]) if len(labels) else []
        model = Ftrl(1 << BITS)
        for _ in range(epochs):
            for places, label in zip(rows, labels):
                model.learn(places, int(label))
        w = model.weights(slice(0, 1 << BITS))
        used = np.flatnonzero(w)
        return pa.table({"place": pa.array(np.append(used, -1)), "weight": pa.array(np.append(w[used], model.bias_weight()))})

    return run


def _turn():
    return F.md5(F.concat_ws("|", F.lit(SEED), F.col("doc_id").cast("string")))


def train(docs: DataFrame, known: DataFrame, rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> dict[int, float]:
    """Weights by place, the bias at -1, from ``docs`` and their labels (doc_id, toxic), one row each.

    The sample is the first ``rows`` labels in the seeded order, so it is small enough to be sent to the texts; what comes back is the
    features of at most ``rows`` texts, at most 2 ** BITS each.
    """
    chosen = known.select("doc_id", F.col("toxic").cast("int").alias("toxic"), _turn().alias("turn")).orderBy("turn", "doc_id").limit(rows)
    known_texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    known_texts = known_texts.withColumn("tie", F.md5(F.coalesce("text", F.lit(""))))
    kind = known_texts.schema["doc_id"].dataType.simpleString()
    found = known_texts.mapInArrow(K.thrifty(_places), f"turn string, doc_id {kind}, tie string, toxic int, places array<int>")
    sample = found.orderBy("turn", "doc_id", "tie").limit(rows)
    fitted = sample.groupBy(F.lit(0).alias("all")).applyInArrow(_train(epochs), "place long, weight double")
    return {r.place: r.weight for r in saved(fitted, "weights").collect()}  # at most 2 ** BITS + 1 rows


def score(docs: DataFrame, weights: dict[int, float]) -> DataFrame:
    """(doc_id, score) for every row; an empty text gets what the bias says."""
    places, values = (np.array(x) for x in zip(*sorted(weights.items()))) if weights else (np.array([-1]), np.array([0.0]))
    bias = float(values[places == -1].sum())
    sent = docs.sparkSession.sparkContext.broadcast((places[places >= 0].astype(np.int32), values[places >= 0].astype(np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS)
        table[sent.value[0]] = sent.value[1]
        for batch in batches:
            out = np.full(batch.num_rows, bias)
            for lo, hi, place, ends in features(batch.column("text")):
                total = np.concatenate([[0.0], np.cumsum(table[place])])
                out[lo:hi] += total[ends] - total[np.append(0, ends[:-1])]
            chance = 1 / (1 + np.exp(-np.clip(out, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(chance)], ["doc_id", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(K.thrifty(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    Labels are learned from rows that are not held out, and are no input of a score. Null and empty texts get the
    score of the bias alone. Rows of ``labels`` that repeat a doc_id count once, with the larger label; a null doc_id is
    scored, not learned from; without labels every score is 0.5. An empty table gives no rows; other columns are not read.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out())
    scored = score(docs, train(docs, known)).withColumn("held_out", held_out())
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
