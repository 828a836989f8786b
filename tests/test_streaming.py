from conftest import rows, ts
from pyspark.sql import functions as F

from shopspark import domain
from shopspark.operators.integrity import ForeignKey
from shopspark.operators.merge import MergeSpec
from shopspark.operators.rulebook import CONTRACTS
from shopspark.operators.sessions import sessionize
from shopspark.plans import sales
from shopspark.sources.raw import scan, scan_stream
from shopspark.sources.versioned import VersionedTable
from shopspark.streaming import ingest, metrics


def users_file(spark, path, *people):
    data = spark.createDataFrame(list(people), "id bigint, age smallint, created_at timestamp")
    data.selectExpr(
        "id", "age", "'M' gender", "'s' state", "'c' city", "'k' country", "0D latitude", "0D longitude", "'x' traffic_source",
        "created_at",
    ).coalesce(1).write.mode("append").parquet(path)


def test_new_files_are_merged_once(spark, tmp_path):
    folder, checkpoint = f"{tmp_path}/users", f"{tmp_path}/checkpoint"
    stream = lambda: ingest.stream_raw(spark, folder, "users")
    users_file(spark, folder, (1, 20, ts("2023-01-01")), (1, 21, ts("2023-01-02")), (2, 30, ts("2023-01-01")))
    table = VersionedTable(spark, str(tmp_path), "stored", stream().schema)
    ingest.upsert_stream(stream(), table, MergeSpec(), checkpoint, newest="created_at")
    assert rows(table.read().select("id", "age")) == [(1, 21), (2, 30)]
    before = table.parts()
    ingest.upsert_stream(stream(), table, MergeSpec(), checkpoint, newest="created_at")
    assert table.parts() == before
    users_file(spark, folder, (2, 31, ts("2023-01-03")), (3, 40, ts("2023-01-03")))
    ingest.upsert_stream(stream(), table, MergeSpec(), checkpoint, newest="created_at")
    assert rows(table.read().select("id", "age")) == [(1, 21), (2, 31), (3, 40)]


def test_bad_rows_are_set_aside(spark, tmp_path):
    folder = f"{tmp_path}/users"
    users_file(spark, folder, (1, 20, ts("2023-01-01")), (2, 20, None), (3, 20, ts("2023-01-01")))
    known = ForeignKey("id", spark.createDataFrame([(1,), (2,)], "id bigint"))
    good, bad = f"{tmp_path}/good", f"{tmp_path}/bad"
    ingest.quarantine_stream(
        ingest.stream_raw(spark, folder, "users"), CONTRACTS["users"], [known], good, bad, f"{tmp_path}/c"
    )
    assert rows(spark.read.parquet(good).select("id")) == [(1,)]
    assert sorted((r["id"], r["failed_rules"]) for r in spark.read.parquet(bad).collect()) == [
        (2, ["created_missing"]), (3, ["missing id"]),
    ]


def test_repeats_are_dropped(spark, small, tmp_path):
    twice = scan_stream(spark, small, "events").unionByName(scan_stream(spark, small, "events"))
    ingest.append_to(ingest.without_repeats(twice, ["event_id", "ts"], "ts"), f"{tmp_path}/o", f"{tmp_path}/c")
    out = spark.read.parquet(f"{tmp_path}/o")
    assert out.count() == out.select("event_id").distinct().count() == scan(spark, small, "events").count()


def batch_sessions(events):
    sessions = sessionize(events).where("session_id is not null").groupBy("user_id", "session_id")
    return rows(
        sessions.agg(
            F.min("ts").alias("started_at"),
            F.max("ts").alias("last_at"),
            F.count(F.lit(1)).alias("clicks"),
            F.max((F.col("event_type") == "purchase").cast("int")).alias("has_purchase"),
        ).drop("session_id")
    )


def fold_files(spark, folder, tmp_path):
    stream = scan_stream(spark, folder, "events").select("user_id", "ts", "event_type")
    empty = metrics.click_spans(scan(spark, folder, "events").limit(0))
    table = VersionedTable(spark, str(tmp_path), "sessions", empty.schema)
    table.replace(empty)
    fold = lambda stored, batch: metrics.fold_sessions(stored, metrics.click_spans(batch))
    ingest.merge_stream(stream, table, fold, f"{tmp_path}/c")
    return metrics.open_sessions(table.read())


def test_all_sessions_equal_the_batch(spark, small, tmp_path):
    got = fold_files(spark, small, tmp_path)
    events = scan(spark, small, "events")
    assert rows(got.select("user_id", "started_at", "last_at", "clicks", "has_purchase")) == batch_sessions(events)
    end = events.agg(F.max("ts")).first()[0]
    late = got.where(F.col("last_at") + F.expr("interval 12 hours") > F.lit(end))
    assert rows(got.where("is_open").select("user_id", "started_at")) == rows(late.select("user_id", "started_at"))


def test_late_clicks_join_sessions(spark, tmp_path):
    span = lambda *r: spark.createDataFrame(
        [(u, ts(a), ts(b), n, 0, 0, 0) for u, a, b, n in r],
        "user_id bigint, started_at timestamp, last_at timestamp, clicks bigint, has_cart int, has_purchase int, has_product_view int",
    )
    stored = span((1, "2024-01-01", "2024-01-01T01:00:00", 2), (1, "2024-01-01T14:00:00", "2024-01-01T15:00:00", 3), (2, "2024-01-01", "2024-01-01", 1))
    late = span((1, "2024-01-01T08:00:00", "2024-01-01T08:00:00", 1), (3, "2023-12-31", "2023-12-31", 1))
    got = metrics.fold_sessions(stored, late)
    assert rows(got.select("user_id", "started_at", "last_at", "clicks")) == [
        (1, ts("2024-01-01"), ts("2024-01-01T15:00:00"), 6), (2, ts("2024-01-01"), ts("2024-01-01"), 1), (3, ts("2023-12-31"), ts("2023-12-31"), 1),
    ]
    nobody = spark.createDataFrame([(None, ts("2024-01-01"), "click")], "user_id bigint, ts timestamp, event_type string")
    assert metrics.click_spans(nobody).count() == 0


def test_daily_sums_equal_the_batch(spark, small, tmp_path):
    shop = lambda t: domain.shop(spark, small, t)
    lines = domain.item_columns(scan_stream(spark, small, "lineitem"), domain.order_heads(spark, small))
    sums = metrics.daily_sales_stream(domain.clean(lines, "order_items"), shop("products"), shop("users"))
    table = VersionedTable(spark, str(tmp_path), "daily", sums.schema)
    ingest.upsert_stream(sums, table, MergeSpec(keys=("day", "country")), f"{tmp_path}/c", mode="update")
    batch = sales.daily_sales(shop("order_items"), shop("products"), shop("users"))
    assert rows(table.read().select("day", "country", "gmv", "net_revenue")) == rows(
        batch.select("day", "country", "gmv", "net_revenue")
    )
