"""Contract of the registered queries, their SQL twins and the shape of their plans."""

import os
from itertools import combinations

import pytest

import __spark_entry__ as entry
from dataprobe import session
from dataprobe.operators import uniqueness

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plans_of(spark, name):
    """The plans of all tables that a query writes down on its way, and of its result."""
    session.PLANS = []
    try:
        last = plan_of(entry.queries()[name](spark, FOLDER))
        return [*session.PLANS, last]
    finally:
        session.PLANS = None


@needs_data
def test_a_level_of_column_sets_takes_one_scan(spark):
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    for size, scans in ((1, 1), (2, 1), (4, 4)):
        plan = plan_of(uniqueness._fingerprints(lines, list(combinations(lines.columns, size))))
        assert plan.count("FileScan parquet") == scans


def test_every_twin_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


@needs_data
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_its_twin(spark, name):
    from tools.check_oracle import compare
    outcome, rows, _, _ = compare(spark, FOLDER, name)
    assert outcome in ("equal", "rows only"), outcome
    assert rows > 0 or name == "lww_read"


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).columns == ["dep", "ref"]


NATIVE = ["ind_pairs", "ind_report", "gen_permutations", "gen_words", "resolve_hints", "join_hints", "resolve_tokens", "lww_merge",
          "lamport_fold", "set_next", "set_prev_gap", "set_xor", "top_per_group", "join_theta_self", "bloom_semi_join",
          "agg_set_intersection", "permutation_at"]


@needs_data
@pytest.mark.parametrize("name", NATIVE)
def test_plan_stays_in_the_engine(spark, name):
    plans = plans_of(spark, name)
    for node in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert not [p for p in plans if node in p], node


@needs_data
@pytest.mark.parametrize("name", ["lcs_best", "lcs_best_benchmark", "join_with_structs", "filter_broadcast_anti", "set_next_gap"])
def test_no_pairs_are_made(spark, name):
    assert not [p for p in plans_of(spark, name) if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p]


@needs_data
def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(entry.queries()["scan_parquet"](spark, FOLDER))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double>" in plan
    point = plan_of(entry.queries()["lww_read"](spark, FOLDER))
    assert "EqualTo(user_id,42)" in point
