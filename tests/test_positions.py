"""Places in an ordered result against a sorted list."""

import random

import pytest
from pyspark.sql import functions as F

from shopspark.operators.positions import with_places, with_positions


def test_positions_follow_the_order(spark):
    rng = random.Random(3)
    values = [(i, rng.choice([None, *range(40)])) for i in range(2000)]
    df = spark.createDataFrame(values, "at int, part int").repartition(7)
    rows = with_positions(df.orderBy(F.desc_nulls_first("part"), "at")).collect()
    want = sorted(values, key=lambda v: (v[1] is not None, -(v[1] or 0), v[0]))
    assert [(r.at, r.part) for r in sorted(rows, key=lambda r: r.position)] == want
    assert sorted(r.position for r in rows) == list(range(1, 2001))


def test_ties_share_the_first_place(spark):
    rng = random.Random(4)
    # A third of the rows have one key; some have none.
    values = [(i, None if i % 50 == 0 else 5 if i % 3 == 0 else rng.randrange(30)) for i in range(1500)]
    df = spark.createDataFrame(values, "id int, v int").repartition(5)
    rows = with_places(df.orderBy(F.col("v").asc_nulls_first()), ["v"]).collect()
    key = lambda v: -1 if v is None else v
    ordered = sorted(key(v) for _, v in values)
    assert len(rows) == len(values) and all(r.place == ordered.index(key(r.v)) + 1 for r in rows)


def test_an_unsorted_result_is_seen(spark):
    df = spark.createDataFrame([(i, i * 7 % 100) for i in range(100)], "id int, v int")
    assert any(r.place != r.v + 1 for r in with_places(df, ["v"]).collect())


def test_defined_cases(spark):
    df = spark.createDataFrame([], "v int, position int")
    assert with_places(df.orderBy("v"), ["v"]).collect() == []
    with pytest.raises(ValueError):
        with_positions(df)
