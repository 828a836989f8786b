"""Order items joined with the heads of their orders while both arrive as streams.

Either side waits in Spark's join state for the other one. An item belongs to a head of
its order that was placed at most ``within`` before it, so both sides leave the state
when the watermark says that no partner can come any more; an item that then has none
goes out with a reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WITHIN = "2 days"
LATE_BY = "12 hours"
MISSING = "missing order"


def items_with_heads(
    items: DataFrame, heads: DataFrame, within: str = WITHIN, late_by: str = LATE_BY, placed: str = "placed_at"
) -> DataFrame:
    """``items`` (order_id, a time ``placed``, ...) with ``user_id`` and ``head_status`` of their order, and ``reason`` where it is missing."""
    waiting = items.withWatermark(placed, late_by)
    orders = heads.select(
        F.col("order_id").alias("_order"), "user_id", F.col("status").alias("head_status"), F.col("created_at").alias("_created")
    ).withWatermark("_created", late_by)
    same = F.col("order_id") == F.col("_order")
    near = (F.col("_created") <= F.col(placed)) & (F.col(placed) <= F.col("_created") + F.expr(f"interval {within}"))
    joined = waiting.join(orders, same & near, "left_outer")
    reason = F.when(F.col("_order").isNull(), F.lit(MISSING))
    return joined.select(*items.columns, "user_id", "head_status", reason.alias("reason"))
