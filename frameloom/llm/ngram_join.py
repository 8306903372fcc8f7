"""N-gram Jaccard join (operator 1): a blocked sparse product of the document by n-gram incidence.

The incidence rows (n-gram, document class) are shuffled by n-gram once and read in order, block by block. Documents
with equal sets are one class. An n-gram that only one class has cannot add to any overlap, so its column goes; what is
left of a class is an upper bound on its overlap with anything, and a class whose rest is below the bound that its size
sets goes too. The others are ordered by frequency, and only classes that share an n-gram in the prefixes where their
overlap must begin are paired, again within size-derived bounds (length, and what can follow a shared n-gram).

The product is multiplied in blocks. Classes that prefixes hold together are a family; small families share blocks. A large
family is dealt in the way that moves fewer rows: every part of it with every other, as suits one great group of near copies,
or by prefix n-gram, as suits what chance alone holds together: then a class goes where an n-gram of its prefix is, a pair
counts where its first common n-gram is, and only a frequent n-gram is cut into parts.

A task counts the overlaps of its block's pairs, every pair of classes in one block only, and returns for each class how many
documents it is linked with there, and a forest of the links. So no pair leaves it, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm import kernels as K
from frameloom.llm.common import CHUNK_BYTES, fresh, one_each, released, row_tag, saved
from frameloom.operators.components import connected_components

SHINGLE_WORDS = 4
# Similarity in per cent.
THRESHOLD = 85
# Frequencies at and above this count as one in the order of n-grams; any order is right.
TOP_FREQUENCY = 1 << 16
# Classes in a part of the product, and n-grams of all of them.
BLOCK_ROWS = 2000
BLOCK_ITEMS = 1 << 20
# N-grams that a class is compared with at a time.
ITEMS_AT_ONCE = 1 << 21
# Incidence rows that a map task packs at a time, and partitions they go to at least.
ROWS_AT_ONCE = 1 << 18
SETS_AT_ONCE = 100_000
LEAST_PARTS = 64


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of rows: (first row, end row, hashes by row, their rows, set sizes)."""
    data, offsets = K.text_bytes(column)
    for lo, hi in K.slices(offsets, CHUNK_BYTES):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        first, end, row = K.words(part, at)
        counts = np.bincount(row, minlength=hi - lo)
        h, r = K.shingle_hashes(K.word_hashes(part, first, end, lower=True), counts, size)
        h, r, _ = K.distinct_by_row(h, r)
        yield lo, hi, h, r, np.bincount(r, minlength=hi - lo)


def _classes(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set; 0 for an empty one."""
    sums = np.zeros(len(sizes) + 1, dtype=K.U64)
    total = np.concatenate([np.zeros(1, K.U64), np.cumsum(K.mix(h + K.U64(0x632BE59BD9B4E019)), dtype=K.U64)])
    ends = np.cumsum(sizes)
    sums = total[ends] - total[ends - sizes]
    return np.where(sizes > 0, K.mix(sums + sizes.astype(K.U64) * K.U64(0x9FB21C651E98DF25)), K.U64(0))


def set_sizes(rows: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """``rows`` with n_shingles and cls in place of text; cls names the set and is null for an empty one."""
    keys = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, K.U64)
            for lo, hi, h, _, sizes in _sets(batch.column("text"), size):
                n[lo:hi], cls[lo:hi] = sizes, _classes(h, sizes)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keys), pa.array(n), pa.array(K.signed(cls), mask=n == 0)], [*(f.name for f in keys), "n_shingles", "cls"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keys)
    return rows.mapInArrow(K.thrifty(run), schema + "n_shingles long, cls long")


def incidence(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(shingle, cls): the incidence, dealt by n-gram and in order; each set once per task and SETS_AT_ONCE sets at most.

    What a batch has for a partition goes out as one compressed row, which is much less to move than a row each.
    """
    parts = max(LEAST_PARTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def packed(h: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
        part = (h >> K.U64(32)) * K.U64(parts) >> K.U64(32)
        order = np.argsort(part, kind="stable")
        h, cls, part = h[order], cls[order], part[order]
        ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part))
        rows = []
        for lo, hi in zip(np.append(0, ends[:-1]), ends):
            head = np.flatnonzero(np.append(True, cls[lo + 1 : hi] != cls[lo : hi - 1]))
            # hashes ascend within a set, so their gaps are short
            rows.append((int(part[lo]), K.squeezed(cls[lo:hi][head]), K.squeezed(np.diff(np.append(head, hi - lo))), K.squeezed(h[lo:hi], ascending=True)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["part", "classes", "sizes", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if len(seen) > SETS_AT_ONCE:
                seen.clear()
            for _, _, h, r, sizes in _sets(batch.column("text"), size):
                cls = _classes(h, sizes)
                new = np.zeros(len(cls), dtype=bool)
                for i, c in enumerate(cls.tolist()):
                    if sizes[i] and c not in seen:
                        seen.add(c)
                        new[i] = True
                keep = new[r]
                held.append((h[keep], cls[r[keep]]))
                if sum(len(x) for x, _ in held) >= ROWS_AT_ONCE:
                    yield packed(*map(np.concatenate, zip(*held)))
                    held = []
        if sum(len(x) for x, _ in held):
            yield packed(*map(np.concatenate, zip(*held)))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for classes, sizes, shingles in zip(*(batch.column(c).to_pylist() for c in ("classes", "sizes", "shingles"))):
                cls = np.repeat(K.unsqueezed(classes), K.unsqueezed(sizes).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(K.unsqueezed(shingles, ascending=True))), pa.array(K.signed(cls))], ["shingle", "cls"])

    dealt = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(K.thrifty(run), "part int, classes binary, sizes binary, shingles binary")
    return dealt.repartitionById(parts, "part").mapInArrow(K.thrifty(unpacked), "shingle long, cls long").sortWithinPartitions("shingle", "cls")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (shingle, cls): those whose shingle several classes have, once each, with its frequency.

    Rows of a shingle are held until its end, or until they are TOP_FREQUENCY; from there on they pass through.
    """

    def out(s: np.ndarray, c: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(s), pa.array(c), pa.array(df.astype(np.int32))], ["shingle", "cls", "df"])

    held_s, held_c = np.zeros(0, np.int64), np.zeros(0, np.int64)
    passing: tuple[int, int] | None = None  # shingle whose frequency is known to be the top one, last class of it
    for batch in batches:
        s, c = np.asarray(batch.column("shingle")), np.asarray(batch.column("cls"))
        if passing is not None:
            n = int(np.searchsorted(s != passing[0], True)) if len(s) and s[0] == passing[0] else 0
            if n:
                d = c[:n]
                new = np.concatenate([[d[0] != passing[1]], d[1:] != d[:-1]])
                yield out(s[:n][new], d[new], np.full(int(new.sum()), TOP_FREQUENCY))
                passing = (passing[0], int(d[-1]))
                s, c = s[n:], c[n:]
            if len(s):
                passing = None
        s, c = np.concatenate([held_s, s]), np.concatenate([held_c, c])
        if not len(s):
            continue
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])])
        s, c = s[new], c[new]
        heads = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        last = heads[-1]
        held_s, held_c = s[last:], c[last:]
        df = np.repeat(np.diff(np.append(heads[:-1], last)), np.diff(np.append(heads[:-1], last))) if len(heads) > 1 else np.zeros(0, np.int64)
        keep = df >= 2
        if keep.any():
            yield out(s[:last][keep], c[:last][keep], np.minimum(df[keep], TOP_FREQUENCY))
        if len(held_s) >= TOP_FREQUENCY:
            yield out(held_s, held_c, np.full(len(held_s), TOP_FREQUENCY))
            passing = (int(held_s[0]), int(held_c[-1]))
            held_s, held_c = held_s[:0], held_c[:0]
    if len(held_s) >= 2:
        yield out(held_s, held_c, np.full(len(held_s), len(held_s)))


class _Forest:
    """Union-find over the documents of a block."""

    def __init__(self, labels: np.ndarray):
        _, self.label = np.unique(labels, return_inverse=True)

    def join(self, a: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that bring a new component to ``a``'s."""
        fresh, at = np.unique(self.label[others], return_index=True)
        self.label[np.isin(self.label, fresh)] = self.label[a]
        return others[at]


def _block_product(threshold: int, n_buckets: int):
    """Links of a block: overlap counts of the pairs that the bounds leave.

    A block's rows have a side: 0 and 1 are compared with each other, -1 with all. In a block of a bucket only n-grams of that bucket
    make pairs, and a pair counts if its first common n-gram is one of them. What comes out is a row for each class that
    has links, with the documents it is linked with, and a forest: never more than two rows a class.
    """

    def run(table: pa.Table) -> pa.Table:
        cls, n, k, copies = (np.asarray(table.column(c)) for c in ("cls", "n", "k", "copies"))
        side, reach, bucket = np.asarray(table.column("side")), np.asarray(table.column("reach")), table.column("bucket")[0].as_py()
        lists = table.column("shingles").combine_chunks()
        ends = np.asarray(lists.offsets)
        ends, flat = ends - ends[0], np.asarray(lists.flatten())
        names, column = np.unique(flat, return_inverse=True)
        forest = _Forest(np.arange(len(cls)))
        begin = ends[:-1]
        # prefix entries by n-gram
        doc = np.repeat(np.arange(len(cls)), reach)
        pos = np.arange(len(doc)) - np.repeat(np.cumsum(reach) - reach, reach)
        if bucket >= 0:
            here = flat[begin[doc] + pos] % n_buckets == bucket
            doc, pos = doc[here], pos[here]
        gram = column[begin[doc] + pos]
        order = np.lexsort((doc, gram))
        by_doc, room, gram = doc[order], (k[doc] - pos)[order], gram[order]
        head = np.searchsorted(gram, gram, side="left")
        tail = np.searchsorted(gram, gram, side="right")
        slot = np.empty(len(order), np.int64)
        slot[order] = np.arange(len(order))
        slot_ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(cls)))])
        marked = np.zeros(len(names), dtype=np.int32)
        links: list[tuple[int, int]] = []
        linked_with = np.zeros(len(cls), np.int64)
        for a in range(len(cls)):
            near = []
            for i in slot[slot_ends[a] : slot_ends[a + 1]]:
                other = by_doc[head[i] : tail[i]]
                least = -(-threshold * (n[a] + n[other]) // (100 + threshold))
                fits = (other < a) & (np.minimum(room[i], room[head[i] : tail[i]]) >= least)
                near.append(other[fits])
            near = np.unique(np.concatenate(near)) if near else np.zeros(0, np.int64)
            near = near[(side[near] < 0) | (side[near] != side[a])]
            near = near[100 * np.minimum(n[near], n[a]) >= threshold * np.maximum(n[near], n[a])]
            if not len(near):
                continue
            marked[column[ends[a] : ends[a + 1]]] = 1
            all_sizes = ends[near + 1] - ends[near]
            cuts = np.unique(np.searchsorted(np.cumsum(all_sizes), np.arange(0, all_sizes.sum(), ITEMS_AT_ONCE)))
            for some in np.split(near, cuts[cuts > 0]):
                sizes = ends[some + 1] - ends[some]
                starts = np.cumsum(sizes) - sizes
                at = np.arange(sizes.sum()) + np.repeat(ends[some] - starts, sizes)
                shared = marked[column[at]]
                overlap = np.add.reduceat(shared, starts)
                found = 100 * overlap >= threshold * (n[a] + n[some] - overlap)
                if bucket >= 0 and found.any():
                    first = np.minimum.reduceat(np.where(shared > 0, at, len(flat) - 1), starts)
                    found &= flat[first] % n_buckets == bucket
                linked = some[found]
                if len(linked):
                    linked_with[a] += copies[linked].sum()
                    linked_with[linked] += copies[a]
                    links.extend((int(cls[a]), int(cls[b])) for b in forest.join(a, linked))
            marked[column[ends[a] : ends[a + 1]]] = 0
        some = linked_with > 0
        one, other = [np.array(x, np.int64) for x in zip(*links)] if links else [np.zeros(0, np.int64)] * 2
        return pa.table({
            "a": pa.array(np.concatenate([cls[some], one])),
            "b": pa.array(np.concatenate([cls[some], other])),
            "links": pa.array(np.concatenate([linked_with[some], np.zeros(len(one), np.int64)])),
        })

    return run


def _parts(rows: Column, items: Column) -> Column:
    """Parts of bounded size that so many classes with so many n-grams make."""
    return F.greatest(F.lit(1), F.ceil(rows / F.lit(BLOCK_ROWS)), F.ceil(items / F.lit(BLOCK_ITEMS))).cast("int")


def _pairs_of_parts(rows: DataFrame, name: Column) -> DataFrame:
    """Every row in a block with each part of its set (columns parts and bucket), itself included: block and side."""
    own = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(low == high, -1).when(F.col("own") == low, 0).otherwise(1)
    return rows.withColumn("block", F.concat_ws("/", name, low, high)).withColumn("side", side).select(*BLOCK_COLUMNS)


BLOCK_COLUMNS = ["block", "side", "bucket", "cls", "n", "k", "copies", "reach", "shingles"]


def class_links(sets: DataFrame, shingles: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b, links): links between classes.

    Rows with a = b have the number of documents that the class is linked with, one or more rows a class; the others are links
    with the same connected components as all links. ``sets`` has (cls, n_shingles), ``shingles`` the incidence in
    order of (shingle, cls) within its partitions.
    """
    spark = sets.sparkSession
    shared = shingles.mapInArrow(K.thrifty(_shared), "shingle long, cls long, df int")
    by_class = shared.repartition("cls").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("items"))
    sizes = sets.filter("cls IS NOT NULL").groupBy("cls").agg(F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"))
    least = F.ceil(F.lit(threshold) * F.col("n") / F.lit(100))
    rows = by_class.join(sizes, "cls").withColumn("k", F.size("items").cast("long")).filter(F.col("k") >= least)
    # the set has n - k n-grams of its own at the front of its order
    reach = (F.col("k") - least + 1).alias("reach")
    rows = saved(rows.select("cls", "n", "k", "copies", reach, F.col("items.shingle").alias("shingles")), "incidence")
    released(spark)

    # families: what shared prefix n-grams hold together
    grams = F.slice("shingles", F.lit(1), F.col("reach").cast("int"))
    prefix = saved(rows.select("cls", "k", F.explode(grams).alias("shingle")), "prefix")
    heads = prefix.groupBy("shingle").agg(F.min("cls").alias("head"))
    families = saved(connected_components(prefix.join(heads, "shingle").filter("cls <> head").select("cls", "head").distinct(), "cls", "head"), "families")
    families = families.select(F.col("node").alias("cls"), F.col("component").alias("family"))
    of_family = rows.select("cls", "k").join(families, "cls").groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.sum("k").alias("items"))
    of_family = saved(of_family.withColumn("parts", _parts(F.col("members"), F.col("items"))), "family-sizes")
    members, items = of_family.filter("parts = 1").agg(F.sum("members"), F.sum("items")).first()
    n_small = max(1, -(-(members or 0) // BLOCK_ROWS), -(-(items or 0) // BLOCK_ITEMS))
    nowhere = F.lit(-1).cast("long").alias("bucket")
    small = families.join(of_family.filter("parts = 1").select("family"), "family")
    packed = F.concat_ws("/", F.lit("s"), F.pmod(F.xxhash64("family"), F.lit(n_small)))
    blocks = rows.join(small, "cls").select(packed.alias("block"), F.lit(-1).alias("side"), nowhere, *BLOCK_COLUMNS[3:])

    large = of_family.filter("parts > 1")
    n_buckets = 1
    if large.limit(1).count():
        # only the classes of large families meet their prefixes
        in_large = saved(families.join(large.select("family"), "family"), "in-large")
        by_gram = prefix.join(in_large, "cls").groupBy("family", "shingle").agg(F.count(F.lit(1)).alias("c"), F.sum("k").alias("items"))
        dealt = by_gram.groupBy("family").agg(F.sum(F.col("c") * _parts(F.col("c"), F.col("items"))).alias("dealt"), F.sum("c").alias("entries"))
        ways = saved(large.join(dealt, "family").withColumn("by_gram", F.col("dealt") < F.col("members") * F.col("parts")), "ways")
        of_large = rows.join(in_large, "cls").join(ways.select("family", "parts", "by_gram", "entries"), "family")
        whole = of_large.filter("NOT by_gram").withColumn("bucket", nowhere)
        blocks = blocks.unionByName(_pairs_of_parts(whole, F.concat_ws("/", F.lit("f"), "family")))
        entries = ways.filter("by_gram").agg(F.sum("entries")).first()[0] or 0
        # half full, so that few but those of frequent n-grams are cut
        n_buckets = max(1, -(-2 * entries // BLOCK_ROWS))
        places = F.array_distinct(F.transform(grams, lambda g: F.pmod(g, F.lit(n_buckets).cast("long"))))
        spread = of_large.filter("by_gram").drop("parts").withColumn("bucket", F.explode(places))
        of_bucket = saved(spread.groupBy("bucket").agg(_parts(F.count(F.lit(1)), F.sum("k")).alias("parts")), "buckets")
        blocks = blocks.unionByName(_pairs_of_parts(spread.join(of_bucket, "bucket"), F.concat_ws("/", F.lit("g"), "bucket")))
    return saved(blocks.groupBy("block").applyInArrow(_block_product(threshold, n_buckets), "a long, b long, links long"), "links")


def grouped(rows: DataFrame, threshold: int = THRESHOLD, size: int = SHINGLE_WORDS) -> tuple[DataFrame, DataFrame]:
    """``rows`` (keys and text) with n_shingles and cls in place of text, and (cls, group, links) of the classes that have links.

    Classes of one group are linked; an empty set has no class. ``links`` counts the documents of other classes.
    """
    sets = saved(set_sizes(rows, size), "sets")
    links = class_links(sets, incidence(rows, size), threshold)
    found = connected_components(links.filter("a <> b"), "a", "b").select(F.col("node").alias("cls"), F.col("component").alias("group"))
    counts = links.filter("a = b").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    return sets, saved(found.join(counts, "cls"), "components")


def jaccard_components(docs: DataFrame, threshold: int = THRESHOLD, size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, cls, component_id, n_links) per row of ``docs``.

    Two documents are linked when 100 * intersection >= threshold * union of their sets of word n-grams;
    component_id is the smallest doc_id reachable, n_links the number of other rows that a row is linked with. Texts that are null,
    empty or without words have size 0, a null cls and are linked with nothing: their component is their own doc_id. Repeated rows
    and equal texts share a class. A null doc_id names no component: such a row gets the smallest doc_id it is
    linked to, or null. An empty table gives no rows; other columns are not read. Words and sets are told apart by 64-bit hashes.
    """
    sets, found = grouped(docs.select("doc_id", F.col("text").cast("string").alias("text")), threshold, size)
    own = sets.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("own_lowest"), (F.count(F.lit(1)) - 1).alias("others"))
    classes = own.join(found, "cls", "left").withColumn("group", F.coalesce("group", "cls"))
    lowest = classes.groupBy("group").agg(F.min("own_lowest").alias("lowest"))
    named = classes.join(lowest, "group").select("cls", "lowest", (F.col("others") + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = sets.join(saved(named, "classes"), "cls", "left")
    return out.select("doc_id", "n_shingles", "cls", F.coalesce("lowest", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def representatives(docs: DataFrame, threshold: int = THRESHOLD, size: int = SHINGLE_WORDS) -> DataFrame:
    """One row of ``docs``, all columns, for each group of linked texts: that of the smallest doc_id.

    Every text with an empty set stays; rows that repeat doc_id and text are one.
    """
    tag = fresh(docs, "tag")
    tagged = docs.withColumn(tag, row_tag("doc_id", "text"))
    sets, found = grouped(tagged.select("doc_id", F.col(tag).alias("tag"), F.col("text").cast("string").alias("text")), threshold, size)
    own = sets.filter("cls IS NOT NULL").groupBy("cls").agg(F.min(F.struct("doc_id", "tag")).alias("r"))
    classes = own.join(found, "cls", "left").withColumn("group", F.coalesce("group", "cls"))
    first = classes.groupBy("group").agg(F.min("r").alias("r")).select("r.tag")
    chosen = saved(first.unionByName(sets.filter("cls IS NULL").select("tag").distinct()), "chosen")
    released(docs.sparkSession)
    kept = tagged.join(chosen.withColumnRenamed("tag", tag), tag, "left_semi")
    return one_each(kept, tag).select(*docs.columns)


COMPONENTS_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, list_aggregate(ws[i:i + 3], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.d WHERE r.m < e.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(m) FROM r WHERE r.d = d.doc_id) AS component_id,
       (SELECT count(*) FROM e WHERE e.x = d.doc_id)::BIGINT AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
