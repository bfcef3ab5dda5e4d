"""Plan shapes of the corpus queries: what holds for the library holds for them."""

import pytest

from tidegate.llm import queries
from tidegate.plans import Tables

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.reg.plans))
def test_no_product_joins_and_no_row_udfs(spark, name):
    plan = queries.reg.plans[name](Tables(spark, FOLDER))._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan
    if name == "op5_chat_format":
        assert "Python" not in plan and "Arrow" not in plan
