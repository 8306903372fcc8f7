"""Language-model scoring (operator 10): stupid backoff over n-gram counts of the whole corpus.

Texts become blocks of documents once: the words' hashes and each token's place among them. From a block come its
distinct n-grams of every order with their counts; an n-gram goes to the bucket that its hash names, where the counts of
all blocks are added, and the totals go back to the blocks that asked. So a frequent n-gram is one entry per block, not
per document, and nothing but a block or a bucket is ever in one task. Blocks and buckets have a bounded size; their
number grows with the input.

A document is scored by the counts of all others: its own occurrences are taken off before backing off, else every
n-gram would be known. The score of a word is count(n-gram) / count(context) at the highest order at which others have
the n-gram, times ``alpha`` for each order given up; a word that no other document has counts as one more order given up
and one occurrence among all words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm import kernels as K
from frameloom.llm.common import CHUNK_BYTES

ORDER = 2
ALPHA = 0.4
# Bytes of text in a block, and bytes of corpus text behind a bucket.
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        data, offsets = K.text_bytes(batch.column("text"))
        for lo, hi in K.slices(offsets, BLOCK_BYTES):
            hashes, counts = [], []
            local = offsets[lo : hi + 1]
            for a, b in K.slices(local, CHUNK_BYTES):
                part, at = data[local[a] : local[b]], local[a : b + 1] - local[a]
                first, end, row = K.words(part, at)
                hashes.append(K.word_hashes(part, first, end))
                counts.append(np.bincount(row, minlength=b - a))
            known, tokens, tally = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            # frequent words get small numbers, which are short when compressed
            rank = np.empty(len(known), np.int64)
            rank[np.argsort(-tally, kind="stable")] = np.arange(len(known))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column("doc_id").slice(lo, hi - lo)),
                    pa.array([K.squeezed(np.concatenate(counts))], pa.binary()),
                    pa.array([K.squeezed(known, ascending=True)], pa.binary()),
                    pa.array([K.squeezed(rank)], pa.binary()),
                    pa.array([K.squeezed(rank[tokens])], pa.binary()),
                ],
                ["block", "doc_ids", "n_words", "words", "ranks", "tokens"],
            )
            block += 1


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.text_bytes(batch.column("text"))
        n = sum(len(K.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])[0]) for lo, hi in K.slices(offsets, CHUNK_BYTES))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])


class Grams:
    """The n-grams of a block: per order, each token's n-gram and the n-grams' hashes and counts.

    ``ids[n-1][i]`` is the n-gram of order n that ends at token i, or -1 where the document is too short.
    """

    def __init__(self, block: dict, order: int):
        self.counts = K.unsqueezed(block["n_words"]).astype(np.int64)
        rank = K.unsqueezed(block["ranks"]).astype(np.int64)
        word = np.empty(len(rank), K.U64)
        word[rank] = K.unsqueezed(block["words"], ascending=True)
        token = K.unsqueezed(block["tokens"]).astype(np.int64)
        begin = np.cumsum(self.counts) - self.counts
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        self.position = np.arange(len(token)) - begin[self.row]
        self.ids, self.hashes, self.tally = [token], [word], [np.bincount(token, minlength=len(word))]
        for n in range(2, order + 1):
            here = np.flatnonzero(self.position >= n - 1)
            code, at, tally = np.unique(self.ids[-1][here - 1] * len(word) + token[here], return_inverse=True, return_counts=True)
            ids = np.full(len(token), -1, dtype=np.int64)
            ids[here] = at
            head, last = (code // len(word), code % len(word)) if len(word) else (code, code)
            self.hashes.append(K.mix(self.hashes[-1][head] * K.U64(0xA0761D6478BD642F) + word[last] + K.U64(n)))
            self.ids.append(ids)
            self.tally.append(tally)
        self.sizes = [len(h) for h in self.hashes]
        every = np.concatenate(self.hashes)
        self.sorted = np.argsort(every, kind="stable")
        self.every = every[self.sorted]

    def bucket_ends(self, bits: int) -> np.ndarray:
        """Ends of the buckets in the sorted n-grams."""
        if not bits:
            return np.array([len(self.every)])
        return np.searchsorted(self.every >> K.U64(64 - bits), np.arange(1 << bits, dtype=K.U64), side="right")

    def by_order(self, totals: np.ndarray) -> list[np.ndarray]:
        """Totals in the sorted order, back by order and n-gram."""
        plain = np.empty(len(totals), dtype=np.int64)
        plain[self.sorted] = totals
        return np.split(plain, np.cumsum(self.sizes)[:-1])


def _asks(order: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                grams = Grams(r, order)
                tally = np.concatenate(grams.tally)[grams.sorted]
                ends = grams.bucket_ends(bits)
                starts = np.concatenate([[0], ends[:-1]])
                full = np.flatnonzero(ends > starts)
                for part in np.array_split(full, max(1, len(full) // 64)):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(part.astype(np.int64)),
                            pa.array(np.full(len(part), r["block"], dtype=np.int64)),
                            pa.array([K.squeezed(grams.every[starts[b] : ends[b]], ascending=True) for b in part], pa.binary()),
                            pa.array([K.squeezed(tally[starts[b] : ends[b]]) for b in part], pa.binary()),
                        ],
                        ["bucket", "block", "grams", "tally"],
                    )

    return run


def _totals(table: pa.Table) -> pa.Table:
    """Of the asks of a bucket: the counts of all blocks, as each block asked for them."""
    grams = [K.unsqueezed(x.as_py(), ascending=True) for x in table.column("grams")]
    tally = np.concatenate([K.unsqueezed(x.as_py()) for x in table.column("tally")]).astype(np.int64)
    known, at = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.zeros(len(known), np.int64)
    np.add.at(total, at, tally)
    parts = np.split(total[at], np.cumsum([len(g) for g in grams])[:-1])
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "totals": pa.array([K.squeezed(p) for p in parts], pa.binary())})


def _own(group: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each token: how often its document has its n-gram."""
    _, at, n = np.unique(row * (int(group.max(initial=0)) + 1) + group, return_inverse=True, return_counts=True)
    return n[at]


def token_scores(grams: Grams, totals: list[np.ndarray], all_words: int, alpha: float) -> np.ndarray:
    """Log score of every token by the counts of the other documents."""
    others = [np.zeros(len(grams.row), np.int64) for _ in totals]
    for n, total in enumerate(totals):
        here = np.flatnonzero(grams.ids[n] >= 0)
        others[n][here] = total[grams.ids[n][here]] - _own(grams.ids[n][here], grams.row[here])
    words = (all_words - grams.counts)[grams.row]
    highest = np.minimum(grams.position + 1, len(totals))
    score = np.log(1.0 / (words + 1)) + np.log(alpha) * highest
    seen = np.flatnonzero(others[0] > 0)
    score[seen] = np.log(others[0][seen] / words[seen]) + np.log(alpha) * (highest[seen] - 1)
    for n in range(1, len(totals)):
        seen = np.flatnonzero(others[n] > 0)
        # the context's count, less the document's own
        score[seen] = np.log(others[n][seen] / others[n - 1][seen - 1]) + np.log(alpha) * (highest[seen] - n - 1)
    return score


def _score(order: int, all_words: int, alpha: float):
    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        ids, words, sums = [], [], []
        if block.num_rows:
            r = block.to_pylist()[0]
            grams = Grams(r, order)
            parts = sorted(zip(replies.column("bucket").to_pylist(), replies.column("totals").to_pylist()))
            totals = grams.by_order(np.concatenate([K.unsqueezed(p) for _, p in parts]).astype(np.int64)) if parts else grams.tally
            end = np.cumsum(grams.counts)
            begin = end - grams.counts
            scores = token_scores(grams, totals, all_words, alpha)
            sums = [float(scores[b:e].sum()) for b, e in zip(begin, end)]
            ids, words = block.column("doc_ids").combine_chunks().flatten(), grams.counts
        else:
            ids = pa.array([], block.schema.field("doc_ids").type.value_type)
        return pa.table({"doc_id": ids, "n_words": pa.array(words, pa.int64()), "log_score": pa.array(sums, pa.float64())})

    return run


def backoff_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) per row of ``docs``: stupid backoff by all other rows.

    Null and empty texts, or texts without words, have 0 words, a log_score of 0 and a null mean. Repeated rows are
    documents of their own and know each other's n-grams; a null doc_id is kept. An empty table gives no rows; other
    columns are not read. Words are told apart by 64-bit hashes. A text longer than BLOCK_BYTES is a block by itself.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    all_words = rows.select("text").mapInArrow(K.thrifty(_word_counts), "n long").agg(F.sum("n").alias("n")).first().n or 0
    bits = max(0, (all_words * 4 * order // BUCKET_BYTES).bit_length())
    # both readers take all columns, so one exchange serves the asks and, once the replies are there, the scores
    stored = rows.mapInArrow(K.thrifty(_blocks), f"block long, doc_ids array<{kind}>, n_words binary, words binary, ranks binary, tokens binary").repartition("block")
    asks = stored.mapInArrow(K.thrifty(_asks(order, bits)), "bucket long, block long, grams binary, tally binary")
    replies = asks.groupBy("bucket").applyInArrow(_totals, "block long, bucket long, totals binary")
    scored = stored.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        _score(order, all_words, alpha), f"doc_id {kind}, n_words long, log_score double"
    )
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


SCORES_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
b AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM t),
c AS (
  SELECT *, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c1,
         count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY doc_id, v, w) AS c2,
         count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS n
  FROM b),
p AS (SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS cv FROM c),
s AS (
  SELECT doc_id, CASE WHEN i > 0 AND c2 > 0 THEN ln(c2 / cv)
                      WHEN c1 > 0 THEN ln(c1 / n) + ln(0.4) * CASE WHEN i > 0 THEN 1 ELSE 0 END
                      ELSE ln(1.0 / (n + 1)) + ln(0.4) * CASE WHEN i > 0 THEN 2 ELSE 1 END END AS x
  FROM p)
SELECT d.doc_id, count(x)::BIGINT AS n_words, round(coalesce(sum(x), 0), 4) AS log_score, round(avg(x), 6) AS mean_log_score
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
