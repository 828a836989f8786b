"""Metrics kept by change rows and by sketches, against full passes over the table."""

import random
from datetime import date

from conftest import rows, ts
from pyspark.sql import functions as F

from shopspark.operators.merge import MergeSpec
from shopspark.operators.sketches import BOUND, daily_sketches, exact_spans, span_estimates
from shopspark.plans.changes import SIGN, daily_item_sums, fold_daily, merge_with_changes
from shopspark.sources.monthly import MonthlyTable
from shopspark.storage import materialize

SCHEMA = "id bigint, created_at timestamp, status string, sale_price decimal(10,2)"


def items(spark, *given):
    return spark.createDataFrame([(i, ts(day) if day else None, status, price) for i, day, status, price in given], SCHEMA)


def test_sums_follow_the_changes(spark, tmp_path):
    rng = random.Random(9)
    days = ["2024-01-03", "2024-01-31", "2024-02-01", "2024-03-15", None]
    draw = lambda i: (i, rng.choice(days), rng.choice(["Complete", "Cancelled", "Returned"]), rng.choice([None, 10, 25]))
    spec, table = MergeSpec(), MonthlyTable(spark, str(tmp_path), "items", items(spark).schema)
    money = lambda given: [(i, d, s, None if p is None else __import__("decimal").Decimal(p)) for i, d, s, p in given]
    first = items(spark, *money([draw(i) for i in range(60)]))
    _, signed = merge_with_changes(table, first, spec)
    assert signed.where(F.col(SIGN) < 0).count() == 0
    sums = materialize(daily_item_sums(signed, F.col(SIGN)), "sums")
    assert rows(sums.dropna(subset=["day"])) == rows(daily_item_sums(table.read()).dropna(subset=["day"]))
    for batch in ([draw(i) for i in range(0, 80, 3)], [(i, "2024-05-01", "Complete", 1) for i in range(20)], []):
        done, signed = merge_with_changes(table, items(spark, *money(batch)), spec)
        counted = {r[0]: r[1] for r in signed.groupBy(SIGN).count().collect()}
        assert counted.get(-1, 0) == done.actions["update"]
        assert counted.get(1, 0) == done.actions["update"] + done.actions["insert"]
        sums = materialize(fold_daily(sums, signed), "sums")
        key = lambda df: sorted(map(str, df.collect()))
        assert key(sums) == key(daily_item_sums(table.read()))
    # A batch merged again changes nothing, so its change rows are none.
    assert merge_with_changes(table, table.read(), spec)[1].count() == 0


def test_sketches_of_spans(spark):
    visits = spark.range(30_000).select(
        (F.col("id") % 7000).alias("user_id"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 61 as int))").alias("created_at")
    )
    visits = visits.unionByName(spark.createDataFrame([(None, ts("2024-01-02")), (5, None)], visits.schema))
    daily = materialize(daily_sketches(visits, "user_id"), "sketches")
    assert daily.count() == 61
    spans = spark.createDataFrame([(date(2024, 1, 1), 1), (date(2024, 1, 10), 20), (date(2023, 12, 1), 400), (date(2025, 1, 1), 9)], "start date, days int")
    both = exact_spans(visits, "user_id", spans).join(span_estimates(daily, spans), ["start", "days"]).collect()
    assert {(r.days, r.exact) for r in both} >= {(400, 7000)} and len(both) == 3
    assert all(abs(r.estimate - r.exact) <= BOUND * r.exact for r in both)
