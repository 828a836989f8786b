"""Product and stock metrics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopspark.functions.numbers import mean_days, mean_money, micros_between, share
from shopspark.plans.common import RETURNED, count_if, count_rows, not_cancelled

# Statuses of items that reached the buyer or are on the way.
DISPATCHED = ("Complete", "Returned", "Shipped")


def _decimal_days(start: str, end: str):
    return micros_between(F.col(end), F.col(start)).cast("decimal(20,0)")


def product_360(
    products: DataFrame, order_items: DataFrame, inventory_items: DataFrame, as_of: date
) -> DataFrame:
    """Sales and stock health of every product; both sides are grouped before the join."""
    sales = (
        order_items.filter(not_cancelled())
        .withColumn("_wait", _decimal_days("created_at", "shipped_at"))
        .groupBy("product_id")
        .agg(
            count_if(F.col("status") == RETURNED).alias("returned"),
            count_if(F.col("status").isin(*DISPATCHED)).alias("dispatched"),
            F.sum("_wait").alias("wait"),
            F.count("_wait").alias("shipped"),
            F.sum("sale_price").alias("sales"),
            F.count("sale_price").alias("priced"),
        )
    )
    stock = (
        inventory_items.filter(F.col("sold_at").isNull())
        .groupBy("product_id")
        .agg(
            F.sum(F.datediff(F.lit(as_of), F.to_date("created_at"))).alias("age_days"),
            F.count("created_at").alias("aged"),
            count_rows("stock_qt"),
        )
    )
    mean_price = mean_money(F.col("sales"), F.col("priced"))
    margin = F.try_divide(
        ((F.col("sales") - F.col("cost") * F.col("priced")) * 100).cast("decimal(24,2)"),
        F.col("sales").cast("decimal(20,2)"),
    )
    mean_age = F.try_divide(F.col("age_days").cast("decimal(18,0)"), F.col("aged").cast("decimal(18,0)"))
    return (
        products.select(F.col("id").alias("product_id"), "category", F.col("name").alias("product_name"), "cost")
        .join(sales, "product_id", "left")
        .join(stock, "product_id", "left")
        .select(
            "product_id",
            "category",
            "product_name",
            share(F.col("returned"), F.col("dispatched")).cast("decimal(5,2)").alias("return_rate_pct"),
            mean_days(F.col("wait"), F.col("shipped")).cast("decimal(12,2)").alias("avg_to_shipping_days"),
            F.round(margin, 2).cast("decimal(18,2)").alias("avg_margin_pct"),
            F.round(mean_price, 2).cast("decimal(18,2)").alias("aov"),
            F.round(mean_age, 2).cast("decimal(12,2)").alias("avg_aging_days"),
            F.coalesce("stock_qt", F.lit(0)).cast("bigint").alias("stock_qt"),
        )
        .orderBy(F.desc_nulls_first("avg_aging_days"))
    )


def stock_aging_before_sale(inventory_items: DataFrame) -> DataFrame:
    """Mean days from entering stock to sale, per warehouse and category."""
    days = F.datediff(F.to_date("sold_at"), F.to_date("created_at"))
    return (
        inventory_items.filter(F.col("sold_at").isNotNull())
        .groupBy("product_distribution_center_id", "product_category")
        .agg(
            count_rows("units_sold"),
            F.round(
                F.try_divide(F.sum(days).cast("decimal(18,0)"), F.count(days).cast("decimal(18,0)")), 2
            ).cast("decimal(12,2)").alias("avg_days_to_sale"),
        )
    )


def shipping_time(order_items: DataFrame, products: DataFrame) -> DataFrame:
    """Mean days from order to dispatch, per warehouse."""
    return (
        order_items.filter(F.col("shipped_at").isNotNull())
        .join(products.select(F.col("id").alias("product_id"), "distribution_center_id"), "product_id")
        .withColumn("_wait", _decimal_days("created_at", "shipped_at"))
        .groupBy("distribution_center_id")
        .agg(
            count_rows("items_shipped"),
            mean_days(F.sum("_wait"), F.count("_wait")).cast("decimal(12,2)").alias("avg_shipping_days"),
        )
    )


def product_margin(order_items: DataFrame, products: DataFrame) -> DataFrame:
    """Margin of items not cancelled, per department and category."""
    return (
        order_items.filter(not_cancelled())
        .join(products.select(F.col("id").alias("product_id"), "cost", "department", "category"), "product_id")
        .groupBy("department", "category")
        .agg(
            count_rows("items"),
            F.sum(F.col("sale_price") - F.col("cost")).cast("decimal(20,2)").alias("margin"),
            F.round(
                mean_money(F.sum(F.col("sale_price") - F.col("cost")), F.count(F.col("sale_price") - F.col("cost"))), 2
            ).cast("decimal(18,2)").alias("avg_margin"),
        )
    )
