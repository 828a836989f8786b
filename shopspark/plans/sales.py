"""Sales metrics: daily figures, order value, first and repeat purchases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopspark.functions.numbers import mean_money, share
from shopspark.plans.common import CANCELLED, RETURNED, any_of, count_if, count_rows, not_cancelled, sold, total_if

# Fixed value: share of an item's cost lost to return logistics.
RETURN_COST_RATE = "0.10"


def order_sums(order_items: DataFrame, products: DataFrame, users: DataFrame) -> DataFrame:
    """Money and kinds of items per order, day and country; sums and flags, so parts can be folded again."""
    priced = (
        order_items.join(products.select(F.col("id").alias("product_id"), "cost"), "product_id")
        .join(users.select(F.col("id").alias("user_id"), "country"), "user_id")
        .withColumn("day", F.to_date("created_at"))
    )
    returned, cancelled = F.col("status") == RETURNED, F.col("status") == CANCELLED
    return priced.groupBy("day", "country", "order_id").agg(
        total_if(not_cancelled(), "sale_price").alias("gmv"),
        total_if(sold(), "sale_price").alias("net"),
        total_if(sold(), "cost").alias("cost_sold"),
        total_if(returned, "cost").alias("cost_returned"),
        any_of(sold()).alias("has_sold"),
        any_of(cancelled).alias("has_cancelled"),
        any_of(returned).alias("has_returned"),
    )


def fold_order_sums(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Sums of both inputs; an order whose items come in several parts is one row."""
    money, flags = ("gmv", "net", "cost_sold", "cost_returned"), ("has_sold", "has_cancelled", "has_returned")
    kinds = {f.name: f.dataType for f in stored.schema.fields}
    return (
        stored.unionByName(fresh)
        .groupBy("day", "country", "order_id")
        .agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in money], *[F.max(c).alias(c) for c in flags])
    )


def daily_sales(
    order_items: DataFrame, products: DataFrame, users: DataFrame, return_cost_rate: str = RETURN_COST_RATE
) -> DataFrame:
    """Revenue, profit and loss rates per day and country.

    Distinct orders come from a first grouping by order, which also folds the
    money, so no row is multiplied for the four distinct counts.
    """
    return daily_rates(order_sums(order_items, products, users), return_cost_rate)


def daily_rates(per_order: DataFrame, return_cost_rate: str = RETURN_COST_RATE) -> DataFrame:
    """The daily figures from the sums per order."""
    # COUNT(DISTINCT order_id) skips null order ids, hence the extra conditions.
    named = F.col("order_id").isNotNull()
    per_day = per_order.groupBy("day", "country").agg(
        F.sum("gmv").cast("decimal(20,2)").alias("gmv"),
        F.sum("net").cast("decimal(20,2)").alias("net_revenue"),
        F.sum("cost_sold").cast("decimal(20,2)").alias("cost_sold"),
        F.sum("cost_returned").cast("decimal(20,2)").alias("cost_returned"),
        count_if(named).alias("orders"),
        count_if(named & (F.col("has_sold") == 1)).alias("orders_sold"),
        count_if(named & (F.col("has_cancelled") == 1)).alias("orders_cancelled"),
        count_if(named & (F.col("has_returned") == 1)).alias("orders_returned"),
    )
    profit = F.col("net_revenue") - F.col("cost_sold")
    loss = (F.col("cost_returned") * F.lit(return_cost_rate).cast("decimal(6,4)")).cast("decimal(22,4)")

    def rate(orders: str):
        return (
            F.when(F.col("orders_sold") == 0, F.lit(0))
            .otherwise(share(F.col(orders), F.col("orders")))
            .cast("decimal(5,2)")
        )

    return per_day.select(
        "day",
        "country",
        "gmv",
        "net_revenue",
        profit.cast("decimal(21,2)").alias("gross_profit_optimistic"),
        (profit - loss).cast("decimal(24,4)").alias("gross_profit_realistic"),
        loss.alias("logistic_loss"),
        rate("orders_cancelled").alias("cancellation_rate"),
        rate("orders_returned").alias("returns_rate"),
    ).orderBy(F.desc("day"), "country")


def aov(order_items: DataFrame) -> DataFrame:
    """Average spend per order."""
    per_order = order_items.groupBy("order_id").agg(F.sum("sale_price").alias("spend"))
    return per_order.agg(
        count_rows("orders"),
        F.sum("spend").cast("decimal(20,2)").alias("total_sales"),
        F.round(mean_money(F.sum("spend"), F.count("spend")), 2).cast("decimal(18,2)").alias("avg_order_value"),
    )


def new_vs_recurring(order_items: DataFrame) -> DataFrame:
    """Sales split into each buyer's first order and later ones, cancelled items left out.

    The first order is the one with the earliest time, then the lowest id; it is
    kept with ``min_by`` while grouping, so no buyer's orders are collected.
    """
    per_order = (
        order_items.filter(not_cancelled())
        .groupBy("user_id", "order_id")
        .agg(F.sum("sale_price").alias("spend"), F.min("created_at").alias("placed_at"))
    )
    per_user = per_order.groupBy("user_id").agg(
        F.min_by("spend", F.struct("placed_at", "order_id")).alias("first_spend"),
        F.sum("spend").alias("spend"),
        count_rows("orders"),
    )
    first, everything = F.col("new_sales"), F.col("new_sales") + F.col("recurring_sales")
    return per_user.agg(
        F.sum("first_spend").cast("decimal(20,2)").alias("new_sales"),
        F.coalesce(F.sum(F.col("spend") - F.col("first_spend")), F.lit(0)).cast("decimal(20,2)").alias(
            "recurring_sales"
        ),
        count_rows("buyers"),
        count_if(F.col("orders") > 1).alias("repeat_buyers"),
    ).withColumn(
        "new_share", F.round(F.try_divide(first * 100, everything.cast("decimal(22,2)")), 2).cast("decimal(5,2)")
    )
