"""Plans hold no all-pairs join and no window over the whole table."""

import pytest

import __spark_entry__ as registry

EAGER = ("run_log", "similar", "similar_ann", "hybrid_search", "customer_rfm_ltv", "ntile_distributed", "nearest_dc")
LAZY = [n for n in registry.QUERIES if n not in EAGER and not n.startswith(("stream_", "validate_", "clean_", "strict"))]


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are for tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", LAZY)
def test_joins_are_by_key(spark, small, no_broadcast, name):
    plan = registry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:  # only the last step of a total
            assert "Aggregate(keys=[]" in lines[i - 1], line


def test_time_filters_reach_the_files(spark, small):
    plan = registry.queries()["lookback_load"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate," in plan
