"""Plan shape of every registered query: no cartesian products, no nested-loop
joins, and parquet scans that read a pruned schema of the given tables."""

import re

import pytest

from ledgerlens.plans import registry

WIDE = {"lineitem": 11, "orders": 6, "events": 6, "pages": 3}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_plan_shape(spark, sf_small, name):
    df = registry.queries()[name](spark, sf_small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    for table, ncols in WIDE.items():
        for m in re.finditer(rf"{table}\.parquet.*?ReadSchema: struct<([^>]*)>", plan, re.S):
            assert m.group(1).count(":") < ncols, f"{table} read with all columns"
