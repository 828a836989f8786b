"""Tables kept by month: what a merge rewrites, moves and leaves alone."""

import os

import pytest
from conftest import rows, ts

from shopspark.operators.merge import MergeSpec
from shopspark.plans.monthly import matched_months, merge_months
from shopspark.sources.monthly import TIMELESS, MonthlyTable

SCHEMA = "id bigint, created_at timestamp, name string"


def days(spark, *given):
    return spark.createDataFrame([(i, ts(day) if day else None, name) for i, day, name in given], SCHEMA)


@pytest.fixture()
def table(spark, tmp_path):
    schema = days(spark).schema
    table = MonthlyTable(spark, str(tmp_path), "t", schema, sort=("id",), lookup=("id",))
    assert rows(table.read()) == [] and not table.exists()
    first = days(spark, (1, "2024-01-05", "a"), (2, "2024-01-20", "b"), (3, "2024-02-01", "c"), (4, "2024-03-31", "d"), (5, None, "e"))
    done = merge_months(table, first, MergeSpec())
    assert done.actions == {"insert": 5, "update": 0, "unchanged": 0, "keep": 0} and done.rows_written == 5 and done.moved == 0
    assert table.months() == ["2024-01-01", "2024-02-01", "2024-03-01", TIMELESS]
    return table


def files(table):
    return {m: sorted(os.listdir(f"{table.path}/month={m}")) for m in table.months()}


def names(table):
    return {r.id: (r.created_at and f"{r.created_at:%Y-%m-%d}", r.name) for r in table.read().collect()}


def test_only_changed_months_are_written(spark, table):
    before = files(table)
    done = merge_months(table, days(spark, (2, "2024-01-20", "B"), (3, "2024-02-01", "c")), MergeSpec())
    assert (done.actions["update"], done.actions["unchanged"], done.months, done.rows_written) == (1, 1, ("2024-01-01",), 2)
    after = files(table)
    assert after.pop("2024-01-01") != before.pop("2024-01-01") and after == before
    assert names(table)[2] == ("2024-01-20", "B") and names(table)[1] == ("2024-01-05", "a")


def test_unchanged_batches_write_nothing(spark, table):
    before = files(table)
    done = merge_months(table, days(spark, (1, "2024-01-05", "a"), (5, None, "e")), MergeSpec())
    assert done.actions["unchanged"] == 2 and done.months == () and done.rows_written == 0
    assert merge_months(table, days(spark), MergeSpec()).actions["keep"] == 0
    assert files(table) == before


def test_rows_move_and_months_empty(spark, table):
    batch = days(spark, (3, "2024-03-02", "c"), (1, "2023-12-31", "a"), (5, "2024-03-01", "e"), (6, "2024-05-01", "f"))
    done = merge_months(table, batch, MergeSpec())
    assert done.moved == 3 and done.actions["insert"] == 1
    assert table.months() == ["2023-12-01", "2024-01-01", "2024-03-01", "2024-05-01"]
    assert names(table) == {
        1: ("2023-12-31", "a"), 2: ("2024-01-20", "b"), 3: ("2024-03-02", "c"), 4: ("2024-03-31", "d"), 5: ("2024-03-01", "e"),
        6: ("2024-05-01", "f"),
    }
    assert merge_months(table, batch, MergeSpec()).rows_written == 0


def test_frozen_time_keeps_the_month(spark, table):
    done = merge_months(table, days(spark, (3, "2024-07-01", "C")), MergeSpec(frozen=("created_at",)))
    assert done.moved == 0 and done.months == ("2024-02-01",) and names(table)[3] == ("2024-02-01", "C")


def test_insert_only_and_repeated_keys(spark, table):
    done = merge_months(table, days(spark, (1, "2024-01-05", "z"), (9, "2024-02-02", "n")), MergeSpec(frozen=("created_at", "name")))
    assert done.actions["insert"] == 1 and names(table)[1] == ("2024-01-05", "a") and names(table)[9] == ("2024-02-02", "n")
    with pytest.raises(ValueError, match="repeats"):
        merge_months(table, days(spark, (1, None, "x"), (1, None, "y")), MergeSpec())


def test_keys_alone_name_the_months(spark, table):
    batch = days(spark, (2, "2030-01-01", "b"), (77, "2031-01-01", "new"))
    assert matched_months(table, batch, MergeSpec()) == ["2024-01-01"]
    assert matched_months(table, batch, MergeSpec(keys=("id", "created_at"))) == ["2030-01-01", "2031-01-01"]
    keys = table.rows().select("id", "month")._jdf.queryExecution().executedPlan().toString()
    assert "name" not in keys.split("ReadSchema")[1]


def test_a_span_reads_its_months(spark, table):
    found = table.read_between("2024-01-10", "2024-02-02")
    assert rows(found.select("id")) == [(2,), (3,)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "month" in plan.split("PartitionFilters")[1][:200]


def test_id_filters_skip_row_groups(spark, tmp_path):
    """A look-up of an absent key within the range of the others reads no row where its column has a filter."""
    read = {}
    for lookup in ((), ("id",)):
        table = MonthlyTable(spark, f"{tmp_path}/{len(lookup)}", "t", days(spark).schema, lookup=lookup)
        table.overwrite(spark.range(0, 40_000, 2).selectExpr("id", "timestamp'2024-01-01' created_at", "'x' name", "'2024-01-01' month"))
        found = table.read().where("id = 20001")
        assert found.count() == 0
        plan = found._jdf.queryExecution().executedPlan()
        found.collect()
        metrics = plan.collectLeaves().head().metrics()
        read[lookup] = metrics.get("numOutputRows").get().value()
    assert read[()] > 0 and read[("id",)] == 0


def test_order_lines_are_dealt_once(spark, small):
    """The rank within an order, the join with its head and sums by order share one shuffle of the lines."""
    from shopspark.domain import RAW

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items = RAW["order_items"](spark, small)
        plan = items._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2, plan
        summed = items.groupBy("order_id").count()._jdf.queryExecution().executedPlan().toString()
        assert summed.count("Exchange hashpartitioning") == 2, summed
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_first_batch_goes_straight_to_its_months(spark, tmp_path, monkeypatch):
    """Nothing is stored, so the batch is neither matched by key nor parked before it is written."""
    from shopspark.plans import monthly

    parked = []
    plain = monthly.materialize
    monkeypatch.setattr(monthly, "materialize", lambda df, name: parked.append(name) or plain(df, name))
    batch = days(spark, (1, "2024-01-05", "a"), (None, "2024-01-20", "b"), (None, "2024-01-20", "b"), (3, None, None))
    table = MonthlyTable(spark, str(tmp_path), "t", batch.schema, sort=("id",))
    done = merge_months(table, batch, MergeSpec(), checked=True)
    assert parked == [] and done.actions == {"insert": 4, "update": 0, "unchanged": 0, "keep": 0}
    assert (done.moved, done.months, done.rows_written) == (0, ("2024-01-01", TIMELESS), 4)
    assert sorted(map(str, table.read().collect())) == sorted(map(str, batch.collect()))
    empty = MonthlyTable(spark, str(tmp_path), "empty", batch.schema)
    done = merge_months(empty, batch.limit(0), MergeSpec())
    assert set(done.actions.values()) == {0} and done.months == () and done.rows_written == 0 and not empty.exists()
