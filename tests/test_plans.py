"""Plan shape checks over every registered batch query: no cross products, no
nested-loop joins, pruned scans."""

import re

from sanscope.plans.registry import QUERIES, load_all

load_all()


def test_no_cross_or_nested_loop_joins(spark, sf):
    bad = {}
    for key in sorted(QUERIES):
        if key.startswith("stream_"):
            continue
        plan = QUERIES[key](spark, sf)._jdf.queryExecution().executedPlan().toString()
        found = [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin") if w in plan]
        if found:
            bad[key] = found
    assert not bad, bad


def test_scans_are_pruned(spark, sf):
    plan = QUERIES["domain_analysis"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    lineitem = [s for s in schemas if "l_orderkey" in s]
    assert lineitem and all("l_extendedprice" not in s and "l_shipdate" not in s for s in lineitem)
