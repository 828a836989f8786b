from datetime import date
from decimal import Decimal

from conftest import ts

from shopspark.plans import customers, products, sales, web


def items(spark, *data):
    """(order, user, product, status, day, price)"""
    rows = [(i, *d[:4], ts(d[4]), None, Decimal(str(d[5]))) for i, d in enumerate(data, 1)]
    return spark.createDataFrame(
        rows,
        "id bigint, order_id bigint, user_id bigint, product_id bigint, status string, created_at timestamp, "
        "shipped_at timestamp, sale_price decimal(10,2)",
    )


def users(spark, *data):
    return spark.createDataFrame(list(data), "id bigint, country string, traffic_source string")


def catalogue(spark, *data):
    rows = [(i, Decimal(str(c))) for i, c in data]
    return spark.createDataFrame(rows, "id bigint, cost decimal(10,2)").selectExpr("*", "'c' category", "'n' name")


def test_daily_sales_with_null_status_and_no_valid_order(spark):
    oi = items(
        spark,
        (1, 1, 1, "Complete", "2023-01-01", 100),
        (1, 1, 1, "Returned", "2023-01-01", 50),
        (2, 1, 1, None, "2023-01-01", 70),
        (3, 1, 1, "Cancelled", "2023-01-01", 30),
        (4, 1, 1, "Cancelled", "2023-01-02", 30),
    )
    got = sales.daily_sales(oi, catalogue(spark, (1, 10)), users(spark, (1, "BR", "x"))).collect()
    assert [r["day"] for r in got] == [date(2023, 1, 2), date(2023, 1, 1)]
    none, some = got
    assert (none["gmv"], none["cancellation_rate"], none["returns_rate"]) == (0, 0, 0)
    assert (some["gmv"], some["net_revenue"]) == (150, 100)
    assert (some["gross_profit_optimistic"], some["logistic_loss"], some["gross_profit_realistic"]) == (90, 1, 89)
    assert (some["cancellation_rate"], some["returns_rate"]) == (Decimal("33.33"), Decimal("33.33"))


def test_rfm_ties_segments_and_snapshot(spark):
    oi = items(spark, *[(u, u, 1, "Complete", f"2023-01-{u:02d}", u * 10) for u in range(1, 11)],
               (11, 99, 1, "Complete", "2023-03-01", 5))
    got = {r["user_id"]: r for r in customers.customer_rfm_ltv(oi, users(spark, *[(u, "BR", "x") for u in range(1, 11)])).collect()}
    assert len(got) == 10 and got[10]["recency_days"] == 51
    assert (got[10]["rfm_score"], got[10]["customer_segment"]) == ("555", "Champions (VIP)")
    assert (got[1]["rfm_score"], got[1]["customer_segment"]) == ("111", "Hibernating")


def test_cohorts_follow_twelve_months(spark):
    oi = items(spark, (1, 1, 1, "Complete", "2023-01-31", 1), (2, 1, 1, "Complete", "2024-01-01", 1), (3, 1, 1, "Complete", "2024-02-01", 1),
               (4, 2, 1, "Complete", "2023-01-05", 1), (5, 2, 1, "Returned", "2023-02-05", 1))
    got = customers.cohort_retention(oi, users(spark, (1, "BR", "x"), (2, "BR", "x"))).collect()
    assert [(r["month_number"], r["original_users"], r["active_users"], r["retention_rate"]) for r in got] == [
        (0, 2, 2, Decimal("100.00")), (12, 2, 1, Decimal("50.00"))
    ]


def test_channels_without_buyers_come_first(spark):
    oi = items(spark, (1, 1, 1, "Complete", "2023-01-01", 10), (1, 1, 1, "Complete", "2023-01-01", 20))
    orders = oi.select("order_id", "user_id").distinct()
    got = customers.traffic_source_performance(
        users(spark, (1, "BR", "ads"), (2, "BR", "ads"), (3, "BR", "mail")), orders, oi
    ).collect()
    assert [tuple(r) for r in got] == [
        ("mail", 1, 0, Decimal("0.00"), None), ("ads", 2, 1, Decimal("50.00"), Decimal("15.00"))
    ]


def test_product_360_without_sales_or_stock(spark):
    oi = items(spark, (1, 1, 1, "Returned", "2023-01-01", 40), (2, 1, 1, "Processing", "2023-01-01", 60))
    stock = spark.sql("select 1L product_id, timestamp'2023-01-01' created_at, cast(null as timestamp) sold_at")
    got = {r["product_id"]: r for r in products.product_360(catalogue(spark, (1, 10), (2, 10)), oi, stock, date(2023, 1, 11)).collect()}
    assert (got[1]["return_rate_pct"], got[1]["aov"], got[1]["avg_margin_pct"]) == (100, 50, 80)
    assert (got[1]["avg_aging_days"], got[1]["stock_qt"], got[1]["avg_to_shipping_days"]) == (10, 1, None)
    assert (got[2]["aov"], got[2]["avg_aging_days"], got[2]["stock_qt"]) == (None, None, 0)


def events(spark, *data):
    rows = [(i, s, k, ts(t), p, u) for i, (s, k, t, p, u) in enumerate(data, 1)]
    kind = "id bigint, session_id string, event_type string, created_at timestamp, extracted_product_id bigint, user_id bigint"
    return spark.createDataFrame(rows, kind).selectExpr(
        "*", "if(user_id is null, 'Guest', 'Registered') visitor_type", "'web' traffic_source"
    )


def test_a_session_over_new_year_counts_in_both_years(spark):
    ev = events(
        spark,
        ("a", "product", "2022-12-31T23:59:50", 1, 1),
        ("a", "cart", "2023-01-01T00:00:10", None, 1),
        ("b", "home", "2023-05-01T10:00:00", None, None),
        ("b", "purchase", "2023-05-01T10:04:00", None, None),
    )
    got = {r["year"]: r for r in web.sales_funnel(ev).collect()}
    assert (got[2022]["total_sessions"], got[2022]["drop_off"], got[2022]["abandon_cart"]) == (1, 100, None)
    assert (got[2023]["total_sessions"], got[2023]["abandon_cart"], got[2023]["purchased"]) == (2, 100, 50)
    buckets = [tuple(r) for r in web.time_to_purchase(ev).collect()]
    assert buckets == [("0-1 min", 1, 0, Decimal("0.00")), ("1-5 min", 1, 1, Decimal("100.00"))]
    visitors = {r["visitor_type"]: r for r in web.visitor_conversion(ev).collect()}
    assert (visitors["Guest"]["buyers"], visitors["Registered"]["cart_abandonment"]) == (1, 100)


def test_first_orders_and_order_value(spark):
    oi = items(spark, (2, 1, 1, "Complete", "2023-01-01", 10), (1, 1, 1, "Complete", "2023-01-01", 20),
               (1, 1, 1, "Complete", "2023-01-01", 5), (3, 2, 1, "Cancelled", "2023-01-01", 99))
    got = sales.new_vs_recurring(oi).first()
    assert (got["new_sales"], got["recurring_sales"], got["buyers"], got["repeat_buyers"]) == (25, 10, 1, 1)
    assert sales.aov(oi).first()["avg_order_value"] == Decimal("44.67")


def test_rfm_of_empty_tables(spark, tmp_path):
    some = items(spark, (1, 1, 1, "Complete", "2023-01-01", 100))
    nobody = users(spark, (1, "BR", "x")).where("id < 0")
    nobody.write.parquet(f"{tmp_path}/users")
    assert customers.customer_rfm_ltv(some, spark.read.parquet(f"{tmp_path}/users")).collect() == []
    assert customers.customer_rfm_ltv(some, nobody).collect() == []
    assert customers.customer_rfm_ltv(some.limit(0), users(spark, (1, "BR", "x"))).collect() == []
    assert customers.customer_rfm_ltv(items(spark, (1, 1, 1, "Cancelled", "2023-01-01", 9)), users(spark, (1, "BR", "x"))).collect() == []
