"""Selection by histograms against a sort."""

import random

import pytest
from pyspark.sql import functions as F

from frameloom.operators import ranking, selection
from frameloom.session import cut_lineage


def rows_of(kind):
    rng = random.Random(kind)
    name = lambda i: rng.choice(["", "a", "ab", "abc", "ä", "z/long/common/prefix/"]) + f"{i:x}"
    sizes = {
        "spread": lambda: rng.randrange(1 << 45),
        "ties": lambda: rng.choice([7, 7, 7, 8, None]),
        "one": lambda: 5,
        "none": lambda: None,
        "signed": lambda: rng.randrange(-50, 50),
    }[kind]
    return [(name(i), sizes()) for i in range(400)]


@pytest.mark.parametrize("kind", ["spread", "ties", "one", "none", "signed"])
def test_first_rows_equal_a_sort(spark, kind):
    rows = rows_of(kind)
    df = cut_lineage(spark.createDataFrame(rows, "asset_id string, file_size long"))
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0].encode()))
    for n in (0, 1, 59, 200, 399, 400):
        got = {r.asset_id for r in df.filter(selection.is_among_first(df, n, digit_bits=6)).collect()}
        assert got == {r[0] for r in order[:n]}, n


def test_top_part_equals_ranks_and_nothing_is_sorted(spark):
    df = cut_lineage(spark.createDataFrame(rows_of("ties"), "asset_id string, file_size long").filter("file_size IS NOT NULL"))
    marked = selection.mark_top(df)
    ranked = ranking.mark_top(ranking.rank_by_size(df))
    top = lambda rows: {r.asset_id for r in rows.filter("is_top").collect()}
    assert top(marked) == top(ranked)
    plan = ranking.top_totals(marked)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "rangepartitioning" not in plan
    empty = df.filter(F.lit(False))
    assert ranking.top_totals(selection.mark_top(empty)).first().videos == 0
