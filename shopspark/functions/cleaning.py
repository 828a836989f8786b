"""Column expressions used to clean raw tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(10,2)"


def or_default(value: Column, default: str) -> Column:
    """``value``, or ``default`` where it is null."""
    return F.coalesce(value, F.lit(default))


def clip(value: Column, low: float, high: float) -> Column:
    """``value`` limited to [low, high]; null stays null.

    ``least``/``greatest`` skip nulls, so null is tested first.
    """
    number = value.cast("double")
    return F.when(number.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), number)))


def magnitude(value: Column) -> Column:
    """Money without sign, rounded half up to cents."""
    return F.round(F.abs(value.cast("decimal(20,6)")), 2).cast(MONEY)


def money(value: Column) -> Column:
    """Money as given, in cents."""
    return value.cast("decimal(20,6)").cast(MONEY)


def no_earlier_than(moment: Column, floor: Column) -> Column:
    """``moment`` moved up to ``floor`` when it lies before it.

    A null on either side leaves ``moment`` as it is.
    """
    return F.when(moment < floor, floor).otherwise(moment)


def point(longitude: Column, latitude: Column) -> Column:
    return F.struct(longitude.alias("lon"), latitude.alias("lat"))


def product_of_page(uri: Column) -> Column:
    """Product id in a page address such as ``/product/17``, else null."""
    digits = F.regexp_extract(uri, r"/product/(\d+)", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def type_of_page(uri: Column) -> Column:
    """First path segment of a page address, null for the bare root."""
    segment = F.regexp_extract(uri, r"^/?([^/?#]+)", 1)
    return F.when(segment != "", segment)
