"""Mixing sources to target weights (operator 7), in DataFrame functions only.

Capped water-filling: a source of size s and weight w gets min(cap * s, level * w), where the level makes all targets
add up to the budget. That is what clamping sources and resharing their excess by weight ends at; the level comes
from running sums over the sources in order of cap * s / w.

Whole repetitions are given to every document. The fractional one goes to the first documents of each source in a
seeded order until its words are used up, so a source misses its target by half a document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.common import WORD, fresh, one_each, row_tag, saved

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_EPOCHS = 2.0
SEED = "mix-1"
# Hex digits of the seeded order that deal a source's documents to tasks.
BUCKET_DIGITS = 3


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target): water-filling over one row per source.

    Sources get the weights in turn by code point, null last. ``sources`` has a row per source, not per document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("_goal", F.lit(budget) * F.sum("source_size").over(whole))
        .withColumn("_full", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(cap))
        .withColumn("_open", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_goal") - F.col("_full")) / F.col("_open"))
    )
    # the level of the first source that it does not fill holds; none so: all are full
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("source_size") * F.lit(cap), F.col("_level"))
    ordered = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = level.withColumn("_level", F.first(fits, ignorenulls=True).over(ordered))
    ceiling = F.col("source_size") * F.lit(cap)
    target = F.when(F.col("_level").isNull(), ceiling).otherwise(F.least(ceiling, F.col("_level") * F.col("_w")))
    return found.select("source", "source_size", target.alias("target"))


def seeded_order(seed: str, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix takes them.

    Rows of equal doc_id, source and text count together, and what is taken of them is one of these rows, as often as all of them
    are. Null and empty texts have no words; they are taken as often as their place in the order says, at the cost of nothing. A
    null source is a source. An empty table gives no rows.
    """
    tag, times = fresh(docs, "tag"), fresh(docs, "times")
    tagged = docs.withColumn(tag, row_tag("doc_id", "source", "text"))
    plan = mix(tagged.select("doc_id", "source", "text", F.col(tag).alias("tag")), weights, budget, cap, seed, "tag")
    plan = plan.groupBy("tag").agg(F.sum("repetitions").alias(times)).filter(F.col(times) > 0)
    plan = saved(plan.withColumnRenamed("tag", tag), "repetitions")
    taken = one_each(tagged.join(plan, tag), tag)
    return taken.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = MAX_EPOCHS, seed: str = SEED, *keep: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, repetitions, taken, keep..) per row of ``docs``.

    Size is the number of words; null and empty texts have size 0 and are taken with 0 words. A null source is a
    source of its own. Repeated rows count each; a null doc_id is ordered like an empty one. Reruns agree: the order
    depends on seed and doc_id alone and all sums are of whole numbers. An empty table gives no rows.
    """
    sized = saved(
        docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *keep)
        .withColumn("_order", seeded_order(seed, "doc_id"))
        .withColumn("_bucket", F.substring("_order", 1, BUCKET_DIGITS)),
        "sized",
    )
    buckets = saved(sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_words")), "buckets")
    goals = targets(buckets.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, budget, cap)
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = buckets.select("source", "_bucket", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_base"))
    bases = bases.alias("b").join(goals.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select("b.*", "source_size", "target")
    inside = Window.partitionBy("source", "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p._bucket") == F.col("b._bucket"))
    joined = placed.alias("p").join(bases.alias("b"), same).select("p.*", "_base", "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = F.col("target") - F.floor(rate) * F.col("source_size")
    half_way = (F.col("_base") + F.col("_before")) * 2 + F.col("size") <= extra * 2
    repetitions = (F.floor(rate) + F.when(half_way, 1).otherwise(0)).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", F.least(repetitions, F.lit(int(cap)).cast("long")).alias("repetitions"), *keep).withColumn("taken", F.col("size") * F.col("repetitions"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1|' || coalesce(doc_id::VARCHAR, '')) AS o
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
l AS (
  SELECT *, row_number() OVER b2 AS k, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0::DOUBLE)) AS level
  FROM w WINDOW b AS (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b2 AS (ORDER BY source_size / w, source IS NULL, source)),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT arg_min(level, k) FROM l WHERE level * w <= 2.0::DOUBLE * source_size) * w, 2.0::DOUBLE * source_size)) AS target FROM l),
p AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * least(whole + CASE WHEN earlier * 2 + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END, 2))::BIGINT AS taken
FROM p
"""
