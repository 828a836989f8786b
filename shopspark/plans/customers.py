"""Customer metrics: cohorts, recency-frequency-value scores, acquisition channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shopspark.functions.numbers import mean_money, share
from shopspark.operators.quantiles import with_ntiles
from shopspark.plans.common import count_if, count_rows, sold
from shopspark.storage import materialize

# Fixed value: months of life followed per cohort.
COHORT_MONTHS = 12


def cohort_retention(order_items: DataFrame, users: DataFrame, months: int = COHORT_MONTHS) -> DataFrame:
    """Active users per country, first-purchase month and month of life.

    A buyer's active months fit in a small set, so one aggregation by user gives
    both the cohort (its smallest month) and the activity. Every buyer is active
    in month 0, which is therefore the cohort size.
    """
    active = (
        order_items.filter(sold())
        .select("user_id", F.trunc("created_at", "month").alias("month"))
        .groupBy("user_id")
        .agg(F.collect_set("month").alias("months"))
    )
    home = users.select(F.col("id").alias("user_id"), "country").filter(F.col("country").isNotNull())
    life = (
        active.join(home, "user_id")
        .select("country", F.array_min("months").alias("cohort_month"), F.explode("months").alias("month"))
        .withColumn("month_number", F.months_between("month", "cohort_month").cast("int"))
    )
    counted = life.groupBy("country", "cohort_month", "month_number").agg(count_rows("active_users"))
    cohort = W.partitionBy("country", "cohort_month")
    start = F.max(F.when(F.col("month_number") == 0, F.col("active_users"))).over(cohort)
    return (
        counted.withColumn("original_users", start)
        .filter(F.col("month_number") <= months)
        .select(
            "country",
            "cohort_month",
            "original_users",
            "month_number",
            "active_users",
            share(F.col("active_users"), F.col("original_users")).cast("decimal(5,2)").alias("retention_rate"),
        )
        .orderBy("country", "cohort_month", "month_number")
    )


def customer_stats(order_items: DataFrame) -> DataFrame:
    """Last purchase, frequency and value per buyer of kept items."""
    per_order = (
        order_items.filter(sold())
        .groupBy("user_id", "order_id")
        .agg(F.max("created_at").alias("placed_at"), F.sum("sale_price").alias("spend"))
    )
    return per_order.groupBy("user_id").agg(
        F.max("placed_at").alias("last_at"),
        F.count("order_id").alias("frequency_count"),
        F.sum("spend").cast("decimal(20,2)").alias("ltv"),
    )


def segment():
    """Name of a buyer's segment; the first matching line wins."""
    r, f = F.col("r_score"), F.col("f_score")
    # Segment names and their score limits.
    return (
        F.when((r >= 5) & (f >= 5), "Champions (VIP)")
        .when((r >= 4) & (f >= 4), "Loyal Customers")
        .when((r >= 3) & (f >= 3), "Potential Loyalist")
        .when((r <= 2) & (f >= 4), "At Risk (High Value)")
        .when((r <= 2) & (f <= 2), "Hibernating")
        .when((r >= 4) & (f <= 2), "New Users")
        .otherwise("General")
    )


def customer_rfm_ltv(order_items: DataFrame, users: DataFrame) -> DataFrame:
    """Quintile scores and segment per buyer; ties go by user id."""
    # The snapshot is the day after the latest kept item, known buyer or not, so the
    # statistics are stored before buyers are matched. Without items it is null.
    every = materialize(customer_stats(order_items), "customer-stats")
    latest = every.agg(F.max(F.unix_micros("last_at"))).first()[0]
    known = users.select(F.col("id").alias("user_id"))
    stored = materialize(every.join(known, "user_id", "left_semi"), "customer-known")
    snapshot = F.date_add(F.to_date(F.timestamp_micros(F.lit(latest).cast("bigint"))), 1)
    stats = stored.withColumn("recency_days", F.datediff(snapshot, F.to_date("last_at"))).withColumns(
        {
            "_age": -F.col("recency_days"),
            "_cents": F.coalesce((F.col("ltv") * 100).cast("bigint"), F.lit(2**62)),
        }
    )
    scored = with_ntiles(
        stats, {"r_score": "_age", "f_score": "frequency_count", "m_score": "_cents"}, "user_id", 5
    )
    return scored.select(
        "user_id",
        "recency_days",
        "frequency_count",
        F.round("ltv", 2).cast("decimal(20,2)").alias("ltv_value"),
        F.concat(*[F.col(c).cast("string") for c in ("r_score", "f_score", "m_score")]).alias("rfm_score"),
        "r_score",
        "f_score",
        "m_score",
        segment().alias("customer_segment"),
    ).orderBy(F.desc_nulls_first("ltv_value"))


def traffic_source_performance(users: DataFrame, orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Users, orders, conversion and item price per acquisition channel.

    Items fold into their order and orders into their buyer before the join, so
    nothing fans out and no distinct count is left.
    """
    per_order = order_items.groupBy("order_id").agg(
        F.sum("sale_price").alias("spend"), F.count("sale_price").alias("items")
    )
    per_user = (
        orders.select("order_id", "user_id")
        .join(per_order, "order_id", "left")
        .groupBy(F.col("user_id").alias("id"))
        .agg(count_rows("orders"), F.sum("spend").alias("spend"), F.sum("items").alias("items"))
    )
    ticket = mean_money(F.sum("spend"), F.coalesce(F.sum("items"), F.lit(0)))
    return (
        users.select("id", "traffic_source")
        .join(per_user, "id", "left")
        .groupBy("traffic_source")
        .agg(
            count_rows("acquired_users"),
            F.coalesce(F.sum("orders"), F.lit(0)).cast("bigint").alias("total_orders"),
            share(count_if(F.col("orders").isNotNull()), F.count(F.lit(1)))
            .cast("decimal(5,2)")
            .alias("user_conversion_rate"),
            F.round(ticket, 2).cast("decimal(18,2)").alias("avg_ticket"),
        )
        .orderBy(F.desc_nulls_first("avg_ticket"))
    )
