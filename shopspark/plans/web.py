"""Web metrics over the clickstream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopspark.functions.numbers import micros_between, share
from shopspark.plans.common import any_of, count_if, count_rows


def _typed(kind: str) -> Column:
    return any_of(F.col("event_type") == kind)


def sales_funnel(events: DataFrame) -> DataFrame:
    """Funnel rates of sessions per year; a session over new year counts in both."""
    sessions = events.groupBy(F.year("created_at").alias("year"), "session_id").agg(
        _typed("cart").alias("cart"),
        _typed("purchase").alias("purchase"),
        any_of(F.col("extracted_product_id").isNotNull()).alias("viewed"),
    )
    return funnel_rates(sessions)


def funnel_rates(sessions: DataFrame) -> DataFrame:
    """Funnel rates per year from the flags cart, purchase and viewed of sessions."""
    cart, bought, viewed = F.col("cart") == 1, F.col("purchase") == 1, F.col("viewed") == 1
    every = F.count(F.lit(1))
    return (
        sessions.groupBy("year")
        .agg(
            every.alias("total_sessions"),
            share(count_if(cart), every).cast("decimal(5,2)").alias("added_cart"),
            share(count_if(bought), every).cast("decimal(5,2)").alias("purchased"),
            share(count_if(cart & ~bought), count_if(cart)).cast("decimal(5,2)").alias("abandon_cart"),
            share(count_if(viewed & ~cart), count_if(viewed)).cast("decimal(5,2)").alias("drop_off"),
        )
        .orderBy("year")
    )


def duration_bucket(micros: Column) -> Column:
    minute = 60_000_000
    # Bucket labels and limits in minutes.
    return (
        F.when(micros < minute, "0-1 min")
        .when(micros < 5 * minute, "1-5 min")
        .when(micros < 10 * minute, "5-10 min")
        .otherwise("10+ min")
    )


def time_to_purchase(events: DataFrame) -> DataFrame:
    """Conversion of sessions by their length."""
    sessions = events.groupBy("session_id").agg(
        micros_between(F.max("created_at"), F.min("created_at")).alias("length"),
        _typed("purchase").alias("purchase"),
    )
    return (
        sessions.groupBy(duration_bucket(F.col("length")).alias("session_duration_bucket"))
        .agg(
            count_rows("total_sessions"),
            F.sum("purchase").cast("bigint").alias("total_sales"),
            share(F.sum("purchase"), F.count(F.lit(1))).cast("decimal(5,2)").alias("conversion_rate"),
            F.min("length").alias("_shortest"),
        )
        .orderBy("_shortest")
        .drop("_shortest")
    )


def visitor_conversion(events: DataFrame) -> DataFrame:
    """Visitors who buy, and visitors who fill a cart and do not, per visitor type.

    A registered visitor is the user; a guest is known by session only.
    """
    registered = F.col("user_id").isNotNull()
    who = F.when(registered, F.col("user_id").cast("string")).otherwise(F.col("session_id"))
    visitors = events.groupBy("visitor_type", who.alias("visitor")).agg(
        _typed("cart").alias("cart"), _typed("purchase").alias("purchase")
    )
    cart, bought = F.col("cart") == 1, F.col("purchase") == 1
    return visitors.groupBy("visitor_type").agg(
        count_rows("visitors"),
        count_if(bought).alias("buyers"),
        share(count_if(bought), F.count(F.lit(1))).cast("decimal(5,2)").alias("conversion_rate"),
        share(count_if(cart & ~bought), count_if(cart)).cast("decimal(5,2)").alias("cart_abandonment"),
    )


def event_traffic_source(events: DataFrame) -> DataFrame:
    """Sessions and conversion per channel of the visit."""
    sessions = events.groupBy("traffic_source", "session_id").agg(
        _typed("purchase").alias("purchase"), count_rows("events")
    )
    return sessions.groupBy("traffic_source").agg(
        count_rows("sessions"),
        F.sum("events").cast("bigint").alias("events"),
        F.sum("purchase").cast("bigint").alias("purchases"),
        share(F.sum("purchase"), F.count(F.lit(1))).cast("decimal(5,2)").alias("conversion_rate"),
    )
