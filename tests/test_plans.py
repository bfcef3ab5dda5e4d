"""Plan shapes that must hold at any scale."""

import pytest

from tidegate.plans import Tables, load

FOLDER = "/root/testdata/sf0.001"
REG = load()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(REG.plans))
def test_no_product_joins_and_no_row_udfs(planned, name):
    plan = plan_of(planned(name, FOLDER))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan


@pytest.mark.parametrize("name", ["top_k", "top_by_abs", "bm25_search", "vector_search_l2", "group_contributions"])
def test_top_k_is_limited_before_the_shuffle(spark, name):
    plan = plan_of(REG.plans[name](Tables(spark, FOLDER)))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_filters_and_columns_reach_the_scan(spark):
    t = Tables(spark, FOLDER)
    plan = plan_of(REG.plans["restrict_to"](t))
    assert "PushedFilters: [IsNotNull(quality), EqualTo(quality,1)" in plan
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan
    plan = plan_of(REG.plans["tier_columns"](t))
    for column in ("l_extendedprice", "l_tax", "o_orderpriority"):
        assert column not in plan


def test_summaries_combine_before_the_shuffle(spark):
    for name in ("class_table", "tier_columns", "missing_counts", "table_digest", "concept_coverage"):
        assert "partial_" in plan_of(REG.plans[name](Tables(spark, FOLDER)))
