"""Exact ratios on decimals.

Types are chosen so that totals of a whole 100 TB table fit and Spark keeps at
least 14 fractional digits in the quotient; the final rounding is half up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part / whole`` in percent; null when ``whole`` is 0."""
    scaled = (part * F.lit(100)).cast("decimal(18,0)")
    return F.round(F.try_divide(scaled, whole.cast("decimal(18,0)")), digits)


def mean_money(total: Column, count: Column) -> Column:
    """Unrounded mean of money with 18 fractional digits; null when count is 0."""
    return F.try_divide(total.cast("decimal(22,2)"), count.cast("decimal(16,0)"))


def micros_between(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later) - F.unix_micros(earlier)


def mean_days(micros_total: Column, count: Column, digits: int = 2) -> Column:
    """Mean of a summed time span in days."""
    per_day = (count.cast("decimal(18,0)") * F.lit(86_400)).cast("decimal(23,0)")
    seconds = (micros_total.cast("decimal(38,0)") / F.lit(1_000_000).cast("decimal(7,0)"))
    return F.round(F.try_divide(seconds.cast("decimal(28,6)"), per_day), digits)
