"""Conditions shared by the metric jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statuses that do not count as revenue.
CANCELLED = "Cancelled"
RETURNED = "Returned"


def sold(status: str = "status") -> Column:
    """Neither cancelled nor returned; a null status is not sold."""
    return ~F.col(status).isin(CANCELLED, RETURNED)


def not_cancelled(status: str = "status") -> Column:
    return F.col(status) != CANCELLED


def count_rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def total_if(condition: Column, value: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0))


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")


def any_of(condition: Column) -> Column:
    """1 when some row of the group meets the condition, else 0."""
    return F.max(F.when(condition, 1).otherwise(0))
