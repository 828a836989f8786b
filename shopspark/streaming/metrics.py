"""Streaming forms of the daily sales and session metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopspark.operators.sessions import DEFAULT_GAP_SECONDS, time_bin
from shopspark.plans.common import any_of, count_rows, not_cancelled, sold, total_if


def daily_sales_stream(order_items: DataFrame, products: DataFrame, users: DataFrame) -> DataFrame:
    """Running sums per day and country; ``order_items`` is a stream, the others are stored.

    Emit in update mode into a keyed merge: state and output hold one row per
    day and country.
    """
    priced = order_items.join(products.select(F.col("id").alias("product_id"), "cost"), "product_id").join(
        users.select(F.col("id").alias("user_id"), "country"), "user_id"
    )
    return (
        priced.groupBy(F.window("created_at", "1 day"), "country")
        .agg(
            total_if(not_cancelled(), "sale_price").cast("decimal(20,2)").alias("gmv"),
            total_if(sold(), "sale_price").cast("decimal(20,2)").alias("net_revenue"),
            total_if(sold(), "cost").cast("decimal(20,2)").alias("cost_sold"),
            count_rows("items"),
        )
        .select(F.to_date("window.start").alias("day"), "country", "gmv", "net_revenue", "cost_sold", "items")
    )


FLAGS = {"has_cart": "click", "has_purchase": "purchase", "has_product_view": "view"}


def click_spans(clicks: DataFrame, user: str = "user_id", ts: str = "ts", gap_seconds: int = DEFAULT_GAP_SECONDS) -> DataFrame:
    """Clicks folded to one row per user and time bin shorter than the gap; clicks without a user or a time have none."""
    known = clicks.where(F.col(user).isNotNull() & F.col(ts).isNotNull())
    return (
        known.groupBy(user, time_bin(ts, gap_seconds).alias("_bin"))
        .agg(
            F.min(ts).alias("started_at"),
            F.max(ts).alias("last_at"),
            count_rows("clicks"),
            *[any_of(F.col("event_type") == kind).alias(flag) for flag, kind in FLAGS.items()],
        )
        .drop("_bin")
    )


def fold_sessions(
    stored: DataFrame, spans: DataFrame, user: str = "user_id", gap_seconds: int = DEFAULT_GAP_SECONDS
) -> DataFrame:
    """Stored sessions and new spans of clicks joined to sessions, however late the clicks are.

    Only users with new clicks are worked on. A late click may lengthen a session or
    join two; the rows of such a user are replaced. ``spans`` is read twice, so pass
    stored rows.
    """
    touched = spans.select(user).distinct()
    parts = stored.join(touched, user, "left_semi").unionByName(spans)
    by_user = Window.partitionBy(user).orderBy("started_at", "last_at")
    reached = F.max(F.unix_micros("last_at")).over(by_user.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.coalesce((F.unix_micros("started_at") - reached >= gap_seconds * 1_000_000).cast("int"), F.lit(1))
    numbered = parts.withColumn("_starts", starts).withColumn("_session", F.sum("_starts").over(by_user))
    joined = numbered.groupBy(user, "_session").agg(
        F.min("started_at").alias("started_at"),
        F.max("last_at").alias("last_at"),
        F.sum("clicks").alias("clicks"),
        *[F.max(flag).alias(flag) for flag in FLAGS],
    )
    return stored.join(touched, user, "left_anti").unionByName(joined.select(*stored.columns))


def open_sessions(sessions: DataFrame, gap_seconds: int = DEFAULT_GAP_SECONDS) -> DataFrame:
    """Add ``is_open``: a click within the gap after the latest of all could still join the session."""
    latest = sessions.agg(F.max(F.unix_micros("last_at"))).first()[0]
    return sessions.withColumn("is_open", F.lit(latest).cast("bigint") - F.unix_micros("last_at") < gap_seconds * 1_000_000)
