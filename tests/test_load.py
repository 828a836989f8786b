import os
from datetime import datetime, timedelta

import pytest
from conftest import rows

from shopspark import domain
from shopspark.operators.contracts import Contract, ContractViolation
from shopspark.operators.incremental import high_watermark, newer_than, within_lookback
from shopspark.operators.merge import MergeSpec
from shopspark.plans.load import extract, finish_layout, load_all, load_table, open_table, set_up, stage, stored_table, upsert
from shopspark.schemas import TABLES
from shopspark.sources.raw import read_raw
from shopspark.sources.versioned import VersionedTable

AS_OF = datetime(2023, 1, 6)


def ids(spark, *values, name="id"):
    return spark.createDataFrame([(v,) for v in values], f"{name} bigint")


def stock(spark, *centers):
    return spark.createDataFrame([(i, c) for i, c in enumerate(centers, 1)], "id int, product_distribution_center_id int").selectExpr(
        "id", "1 product_id", "timestamp'2023-01-01' created_at", "cast(null as timestamp) sold_at", "1.0D cost", "'c' product_category",
        "'n' product_name", "'b' product_brand", "2.0D product_retail_price", "'d' product_department", "'s' product_sku",
        "product_distribution_center_id",
    )


def orders(spark, *users, day="2023-01-02"):
    return spark.createDataFrame([(i, u) for i, u in enumerate(users, 1)], "order_id int, user_id int").selectExpr(
        "order_id", "user_id", "'Complete' status", f"timestamp'{day}' created_at", "cast(null as timestamp) returned_at",
        "cast(null as timestamp) shipped_at", "cast(null as timestamp) delivered_at", "1 num_of_item",
    )


def items(spark, *orders_):
    return spark.createDataFrame([(i, o) for i, o in enumerate(orders_, 1)], "id int, order_id int").selectExpr(
        "id", "order_id", "1 user_id", "1 product_id", "1 inventory_item_id", "'Complete' status",
        "timestamp'2023-01-02' created_at", "cast(null as timestamp) shipped_at", "cast(null as timestamp) delivered_at",
        "cast(null as timestamp) returned_at", "5.0D sale_price",
    )


def reader(spark, **tables):
    base = {"distribution_centers": ids(spark, 1), "users": ids(spark, 1), "products": ids(spark, 1),
            "inventory_items": ids(spark, 1), "orders": ids(spark, 1, name="order_id")}
    return lambda name: {**base, **tables}[name]


def test_orphan_products_are_left_out(spark):
    raw = spark.sql(
        "select id, 1.0D cost, 'c' category, 'n' name, 'b' brand, 2.0D retail_price, 'd' department, "
        "concat('s', id) sku, dc distribution_center_id from values (101, 1), (102, 999) t(id, dc)"
    )
    assert rows(extract(raw, "products", reader(spark)).select("id")) == [(101,)]


def test_watermark_is_strict_and_optional(spark):
    target = stock(spark, 1)
    raw = stock(spark, 1, 999)
    assert extract(raw, "inventory_items", reader(spark), target).count() == 0
    assert rows(extract(raw, "inventory_items", reader(spark), None).select("id")) == [(1,)]
    assert high_watermark(target) == datetime(2023, 1, 1) and high_watermark(target.limit(0)) is None
    late = newer_than(raw, datetime(2023, 1, 2), lateness=timedelta(days=2))
    assert late.count() == 2


def test_lookback_window(spark):
    raw = orders(spark, 1, day="2020-01-01")
    assert within_lookback(raw, datetime(2020, 1, 31), 30).count() == 1
    assert within_lookback(raw, datetime(2020, 2, 1), 30).count() == 0
    assert within_lookback(raw, AS_OF, None).count() == 1
    nothing = extract(raw, "orders", reader(spark), as_of=AS_OF, lookback=30)
    assert nothing.count() == 0 and dict(nothing.dtypes)["num_of_item"] == "bigint"


def test_orders_and_items_drop_broken_references(spark):
    assert rows(extract(orders(spark, 1, 999), "orders", reader(spark), as_of=AS_OF, lookback=10).select("order_id")) == [(1,)]
    assert rows(extract(items(spark, 1, 999), "order_items", reader(spark), as_of=AS_OF, lookback=10).select("id")) == [(1,)]


def test_unreadable_reference_stops_the_load(spark):
    def broken(name):
        raise OSError(f"no {name}")

    with pytest.raises(OSError, match="users"):
        extract(orders(spark, 1), "orders", broken, as_of=AS_OF)


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="num_of_item"):
        extract(orders(spark, 1).drop("num_of_item"), "orders", reader(spark), as_of=AS_OF)


def test_staging_counts_and_refuses(spark):
    df = ids(spark, 1, 2, 3)
    contract = Contract("t", rows={"big": lambda t: t["id"] > 2}, unique={"twice": (lambda t: t["id"],)})
    with pytest.raises(ContractViolation) as caught:
        stage(df, contract)
    assert caught.value.counts == {"big": 1}
    batch, staged = stage(ids(spark, 1, 2), contract)
    assert (staged.rows_in, staged.rows_out, batch.count()) == (2, 2, 2)
    with pytest.raises(ValueError):
        stage(df, Contract("t"))


def test_versions_move_only_on_change(spark, tmp_path):
    schema = "id bigint, name string"
    first = spark.createDataFrame([(1, "a")], schema)
    table = VersionedTable(spark, str(tmp_path), "t", first.schema)
    table.create()
    assert table.read().count() == 0
    assert upsert(table, first, MergeSpec())["insert"] == 1
    before = table.parts()
    assert upsert(table, first, MergeSpec()) == {"insert": 0, "update": 0, "unchanged": 1, "keep": 0}
    assert table.parts() == before
    assert upsert(table, first.limit(0), MergeSpec())["keep"] == 0 and table.parts() == before
    table.append(spark.createDataFrame([(2, "b")], schema))
    assert rows(table.read()) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="repeats"):
        upsert(table, first.unionByName(first), MergeSpec())
    # A batch that changes nothing makes no version.
    assert len(table.versions()) == 2 and table.remove_unused(keep=1) == []
    assert len(table.remove_unused(keep=0)) == 1 and rows(table.read()) == [(1, "a"), (2, "b")]


def test_whole_load_twice_is_once(spark, small, tmp_path):
    target = str(tmp_path)
    source = lambda name: domain.RAW[name](spark, small)
    set_up(spark, target)
    assert stored_table(spark, target, "users").count() == 0
    first = load_all(spark, source, target, datetime(2002, 1, 1), lookback=None)
    counts = {s.table: (s.rows_in, s.rows_out) for s in first.steps}
    assert counts["products"] == (200, 168) and counts["order_items"][0] == 6000
    stored = {s.table: stored_table(spark, target, s.table).count() for s in first.steps}
    assert stored == {s.table: s.rows_out for s in first.steps}
    second = load_all(spark, source, target, datetime(2002, 1, 1), lookback=None)
    assert all(s.actions["insert"] == s.actions["update"] == 0 for s in second.steps)
    assert {s.table: s.status for s in second.steps}["inventory_items"] == "empty"

    events = open_table(spark, target, "events")
    assert events.months() == ["2024-01-01"]
    assert events.read(["2024-01-01"]).count() == 1000 and events.read(["1999-01-01"]).count() == 0
    finish_layout(spark, target)
    assert stored_table(spark, target, "order_items").count() == stored["order_items"]
    log = first.frame(spark)
    assert log.filter("status = 'loaded'").count() == 7


def test_months_outside_the_batch_are_not_rewritten(spark, small, tmp_path):
    raw = domain.RAW["events"](spark, small)
    target = str(tmp_path)
    load_table(spark, raw, "events", target, AS_OF)
    files = sorted(os.listdir(f"{target}/events/month=2024-01-01"))
    later = raw.limit(5).withColumn("created_at", raw["created_at"] + domain.F.expr("interval 40 days"))
    load_table(spark, later, "events", target, AS_OF)
    assert sorted(os.listdir(f"{target}/events/month=2024-01-01")) == files
    assert len(open_table(spark, target, "events").months()) >= 2
    assert stored_table(spark, target, "events").count() == 1005


def test_partial_load_and_failed_step(spark, small, tmp_path):
    source = lambda name: domain.RAW[name](spark, small)
    run = load_all(spark, source, str(tmp_path), AS_OF, tables=["users"])
    assert [s.table for s in run.steps] == ["users"]
    with pytest.raises(ValueError, match="unknown"):
        load_all(spark, source, str(tmp_path), AS_OF, tables=["nope"])
    faulty = lambda name: domain.faulty(spark, small, name)
    with pytest.raises(ContractViolation):
        load_all(spark, faulty, str(tmp_path), AS_OF, tables=["users"], run=run)
    assert run.steps[-1].status == "failed"


def test_raw_files_by_name(spark, small, tmp_path):
    domain.RAW["users"](spark, small).withColumn("extra", domain.F.lit(1)).write.parquet(f"{tmp_path}/users.parquet")
    assert read_raw(spark, str(tmp_path), "users").columns == TABLES["users"].source_names
