"""Registered queries against their SQL on the smallest tables; golden numbers; plan shapes.

``tools/compare.py`` runs every query; here the slow reports over all three analyses are left to it.
"""

import os

import pytest

import __spark_entry__ as entry
from frameloom.operators import groups as G
from frameloom.registry.oracle import ORACLE
from frameloom.registry.queries import QUERIES
from tools.compare import differences, open_oracle

FOLDER = os.environ.get("FRAMELOOM_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="benchmark tables not here")

SLOW = {
    "dup_rollup", "total_cleanable", "dashboard_snapshot", "category_share", "preview_top3", "group_similarity",
    "deletion_candidates", "dup_video_group_filter", "exclude_ids", "group_storage", "best_copy", "groups_removing",
}


@pytest.fixture(scope="module")
def oracle():
    return open_oracle(FOLDER)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_equals_sql(spark, oracle, name):
    assert differences(spark, oracle, name, FOLDER) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) <= set(entry.queries())


def test_golden_group_counts(spark):
    duplicates = QUERIES["duplicate_photo_groups"](spark, "/root/testdata/sf0.001")
    rolled = G.rollup(duplicates).first()
    assert (rolled.group_count, rolled.member_count) == (397, 794)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["photo_candidate_pairs", "hamming_band_pairs", "video_candidate_pairs", "keyframe_sample", "bin_add", "analysis_key", "needs_analysis"])
def test_no_nested_loops(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scans_are_pruned_and_filtered(spark):
    plan = plan_of(QUERIES["bin_totals"](spark, FOLDER))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in plan
    assert "props" not in plan and "user_id" not in plan
