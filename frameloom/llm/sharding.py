"""Sharding by rendezvous hashing (operator 11), in DataFrame functions only.

Every pair of a record key and a shard gets a hash; the record goes to the shard with the highest score. A shard of weight w scores
-w / ln(u), u being the hash as a number between 0 and 1, so shards get rows in proportion to their weights. A score depends
on nothing but key, shard and weight: a new shard takes rows only into itself, a shard that goes leaves all others' rows
where they are, and a change of one weight moves rows only from or to its shard.

A row's place in its shard (slot) comes from the rows' order by a hash of key and content. Shards are cut along that order into
pieces of bounded size, rows are numbered inside pieces, and the pieces' sizes are put one behind the other. Rows that are equal
in all that counts are one row with a count until the end, so repeated rows never meet in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.common import fresh, saved

SEED = "shard-1"
SHARDS = 8
# Rows that a piece of a shard has on average, and copies of one row that a task writes out at a time.
PIECE_ROWS = 16_384
COPIES_AT_ONCE = 65_536
# Hex digits of a hash that are used: 52 bits, which a double holds exactly.
DIGITS = 13


def _bits(*parts: Column) -> Column:
    """52 bits of a hash of the parts as a whole number."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, DIGITS), 16, 10).cast("long")


def _text(column: str) -> Column:
    """A value as text; null has a text that no value has."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("-"))


def rendezvous(keys: Sequence[str], weights: Sequence[float], seed: str = SEED) -> Column:
    """The shard, from 0, that the key columns' values belong to; null values are a key like any other.

    Shards without weight get nothing. Equal scores go to the smaller shard.
    """
    if not weights or min(weights) < 0 or not any(weights):
        raise ValueError("weights are not negative, and some are above zero")
    scores = []
    for shard, weight in enumerate(weights):
        if weight:
            u = (_bits(F.lit(seed), F.lit(str(shard)), *map(_text, keys)).cast("double") + 0.5) / float(1 << 4 * DIGITS)
            scores.append(F.struct((F.lit(float(weight)) / -F.log(u)).alias("score"), F.lit(-shard).alias("back")))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["back"]).cast("int")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32) per row: bytes of the text plus 1, and its checksum; a null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def numbered(rows: DataFrame, shard: str = "shard", slot: str = "slot", piece_rows: int = PIECE_ROWS, copies: int = COPIES_AT_ONCE, seed: str = SEED) -> DataFrame:
    """``rows`` with a number in their shard, gapless from 0, in the order of a hash of all their values; ``rows`` are narrow.

    Equal rows get numbers one after another, so reruns give the same rows.
    """
    order, piece, n, before, base, part = (fresh(rows, x) for x in ("order", "piece", "n", "before", "base", "part"))
    columns = rows.columns
    once = saved(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias(n)).withColumn(order, _bits(F.lit(seed), *map(_text, columns))), "once")
    total, shards, most = once.agg(F.count(F.lit(1)), F.approx_count_distinct(shard), F.max(n)).first()
    bits = min(4 * DIGITS, max(0, math.ceil(math.log2(max(1, total / piece_rows / max(1, shards))))))
    once = once.withColumn(piece, F.shiftright(order, 4 * DIGITS - bits))
    sizes = once.groupBy(shard, piece).agg(F.sum(n).alias(base))
    earlier = Window.partitionBy(shard).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col(shard).alias(f"{shard}_"), F.col(piece).alias(f"{piece}_"), F.coalesce(F.sum(base).over(earlier), F.lit(0)).alias(base))
    inside = Window.partitionBy(shard, piece).orderBy(order, *(F.col(c) for c in columns)).rowsBetween(Window.unboundedPreceding, -1)
    placed = once.withColumn(before, F.coalesce(F.sum(n).over(inside), F.lit(0)))
    placed = placed.join(bases, F.col(shard).eqNullSafe(F.col(f"{shard}_")) & (F.col(piece) == F.col(f"{piece}_")))
    # many copies of one row are written out by many tasks
    lots = placed.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(copies).cast("long"))))
    lots = lots.hint("rebalance") if (most or 0) > copies else lots
    within = F.explode(F.sequence(F.col(part), F.least(F.col(part) + copies, F.col(n)) - 1))
    return lots.withColumn(slot, F.col(base) + F.col(before)).withColumn(part, within).select(*columns, (F.col(slot) + F.col(part)).alias(slot))


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, grown: Sequence[float] | None = None, seed: str = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row of ``docs``.

    The law is ``key``: doc_id and the shards' weights decide, nothing else, so copies of a text under other ids may lie in other
    shards. ``grown_shard`` is the shard under the weights ``grown``, one more shard of the average weight unless given; it
    is the shard itself or a new one where shards were only added. A null doc_id is one key: its rows share a shard.
    Null and empty texts have size 1. Repeated rows count each. An empty table gives no rows; other columns are not read.
    """
    after = [*weights, sum(weights) / len(weights)] if grown is None else grown
    rows = sized(docs).withColumn("shard", rendezvous(["doc_id"], weights, seed))
    found = numbered(rows, seed=seed)
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", rendezvous(["doc_id"], after, seed).alias("grown_shard"))


def sharded(docs: DataFrame, keys: Sequence[str] = ("doc_id",), weights: Sequence[float] = (1.0,) * SHARDS, seed: str = SEED, shard: str = "shard") -> DataFrame:
    """``docs``, whole rows, with the shard of their key columns: no shuffle, ready for ``write.partitionBy``."""
    return docs.withColumn(shard, rendezvous(keys, weights, seed))


def movement(docs: DataFrame, before: Sequence[float], after: Sequence[float], keys: Sequence[str] = ("doc_id",), seed: str = SEED) -> DataFrame:
    """(shard, new_shard, n_rows): how many rows a change of the weights moves from where to where; a row per pair of shards that has any."""
    both = docs.select(rendezvous(keys, before, seed).alias("shard"), rendezvous(keys, after, seed).alias("new_shard"))
    return both.groupBy("shard", "new_shard").agg(F.count(F.lit(1)).alias("n_rows"))


# The checksum goes through the text byte by byte with a table of its own making.
SHARDS_SQL = r"""
WITH t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS f),
b AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, coalesce('=' || doc_id::VARCHAR, '-') AS k,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM documents),
s AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, x: xor(a >> 8, f[(xor(a, x) & 255) + 1])))::BIGINT AS text_crc32,
         list_transform(range(9), lambda i: 1 / -ln((('0x' || substr(md5('shard-1|' || i || '|' || k), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496)) AS scores, k
  FROM b, t),
p AS (SELECT *, (list_position(scores[:8], list_max(scores[:8])) - 1)::INT AS shard, (list_position(scores, list_max(scores)) - 1)::INT AS grown_shard FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5('shard-1|' || k || '|=' || size || '|=' || text_crc32 || '|=' || shard), 1, 13))::BIGINT, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
FROM p
"""
