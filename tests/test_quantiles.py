import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shopspark.operators import quantiles
from shopspark.operators.quantiles import bucket_ends, with_ntiles


def test_bucket_ends():
    assert bucket_ends(10, 5) == [2, 4, 6, 8]
    assert bucket_ends(7, 5) == [2, 4, 5, 6]
    assert bucket_ends(3, 5) == [1, 2, 3, 3]


@pytest.mark.parametrize("fan_out", [3, 4096])
@pytest.mark.parametrize("n", [0, 1, 3, 5, 39, 500])
def test_equals_the_window_function(spark, monkeypatch, n, fan_out):
    monkeypatch.setattr(quantiles, "FAN_OUT", fan_out)
    rng = random.Random(n)
    data = [(i * 7 - 300, rng.choice([1, 1, 1, 2, 3]), rng.randrange(-10**9, 10**9)) for i in range(n)]
    df = spark.createDataFrame(data, "id bigint, few bigint, many bigint").cache()
    got = with_ntiles(df, {"a": "few", "b": "many"}, "id", 5)
    want = df.withColumn("a", F.ntile(5).over(W.orderBy("few", "id"))).withColumn(
        "b", F.ntile(5).over(W.orderBy("many", "id"))
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_all_values_alike(spark):
    df = spark.range(100).withColumn("v", F.lit(7).cast("bigint"))
    got = {r["t"]: r["count"] for r in with_ntiles(df, {"t": "v"}, "id", 4).groupBy("t").count().collect()}
    assert got == {1: 25, 2: 25, 3: 25, 4: 25}


def test_plan_has_no_single_partition_window(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 10)
    plan = with_ntiles(df, {"t": "v"}, "id", 5)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan and "Exchange" not in plan
