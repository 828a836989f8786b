"""Cleaning and typing of the seven raw tables.

Every table is one projection: a mapping from column name to the expression that
cleans it. Columns are typed from the table's declared schema unless a cleaner
says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopspark.functions.cleaning import (
    clip,
    magnitude,
    money,
    no_earlier_than,
    or_default,
    point,
    product_of_page,
    type_of_page,
)
from shopspark.schemas import TABLES

Cleaner = Callable[[Column], Column]

# What a missing text becomes.
UNKNOWN = "Unknown"
OTHER_GENDER = "Others"
FIRST_STATUS = "Processing"
GUEST = "Guest"
REGISTERED = "Registered"


def _fill(default: str) -> Cleaner:
    return lambda c: or_default(c.cast("string"), default)


def _age(c: Column) -> Column:
    return F.coalesce(F.abs(c), F.lit(0)).cast("smallint")


def _degrees(limit: float) -> Cleaner:
    return lambda c: clip(c, -limit, limit)


def _degrees_or_zero(limit: float) -> Cleaner:
    return lambda c: F.coalesce(clip(c, -limit, limit), F.lit(0.0))


_PLACE = {name: _fill(UNKNOWN) for name in ("city", "state", "country")}

# Money that arrives in cents needs no rounding.
ALREADY_CENTS: dict[Cleaner | None, Cleaner] = {magnitude: F.abs, money: lambda c: c}

CLEANERS: dict[str, dict[str, Cleaner]] = {
    "users": {
        **_PLACE,
        "age": _age,
        "gender": _fill(OTHER_GENDER),
        "latitude": _degrees_or_zero(90),
        "longitude": _degrees_or_zero(180),
        "traffic_source": _fill(UNKNOWN),
    },
    "distribution_centers": {"latitude": _degrees(90), "longitude": _degrees(180)},
    "products": {
        **{name: _fill(UNKNOWN) for name in ("category", "name", "brand", "department", "sku")},
        "cost": magnitude,
        "retail_price": magnitude,
    },
    "inventory_items": {
        **{f"product_{name}": _fill(UNKNOWN) for name in ("category", "name", "brand", "department", "sku")},
        "cost": magnitude,
        "product_retail_price": money,
    },
    "orders": {},
    "order_items": {"status": _fill(FIRST_STATUS), "sale_price": money},
    "events": {
        **{name: _fill(UNKNOWN) for name in ("session_id", "city", "state", "browser", "traffic_source", "event_type")},
    },
}


def repair_lifecycle(df: DataFrame) -> DataFrame:
    """Put an order's dates in order: created, shipped, delivered, returned.

    Each date is compared with the already repaired one before it.
    """
    shipped = no_earlier_than(F.col("shipped_at"), F.col("created_at"))
    delivered = no_earlier_than(F.col("delivered_at"), F.col("shipped_at"))
    returned = no_earlier_than(F.col("returned_at"), F.col("delivered_at"))
    return (
        df.withColumn("shipped_at", shipped)
        .withColumn("delivered_at", delivered)
        .withColumn("returned_at", returned)
    )


def profile_sentence() -> Column:
    """Sentence on a cleaned user: gender, age, place and channel."""
    return F.format_string(
        # Fixed value: the wording of the profile text.
        "User profile: %s, %s years old, located_in %s, %s, %s. Acquired via %s.",
        "gender",
        F.col("age").cast("string"),
        "city",
        "state",
        "country",
        "traffic_source",
    )


def _with_user_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "context_summary": profile_sentence(),
            "user_geom": point(F.col("longitude"), F.col("latitude")),
        }
    )


def _with_center_point(df: DataFrame) -> DataFrame:
    return df.withColumn("distribution_center_geom", point(F.col("longitude"), F.col("latitude")))


def _with_page_columns(df: DataFrame) -> DataFrame:
    """Visitor type and page columns; page columns in the input are kept."""
    product = F.col("extracted_product_id") if "extracted_product_id" in df.columns else product_of_page(F.col("uri"))
    page = F.col("extracted_page_type") if "extracted_page_type" in df.columns else type_of_page(F.col("uri"))
    return df.withColumns(
        {
            "visitor_type": F.when(F.col("user_id").isNull(), GUEST).otherwise(REGISTERED),
            "extracted_product_id": product.cast("bigint"),
            "extracted_page_type": or_default(page, UNKNOWN),
        }
    )


FINISHERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "users": _with_user_columns,
    "distribution_centers": _with_center_point,
    "orders": repair_lifecycle,
    "order_items": repair_lifecycle,
    "events": _with_page_columns,
}


def clean(df: DataFrame, table: str) -> DataFrame:
    """``df`` cleaned and typed as business table ``table``.

    Columns the raw table lacks are left out, unless they are derived.
    """
    spec = TABLES[table]
    cleaners = CLEANERS[table]
    typed = []
    given = dict(df.dtypes)
    for name, kind, _ in spec.columns:
        if name in given:
            cleaner = cleaners.get(name)
            if given[name] == kind:
                cleaner = ALREADY_CENTS.get(cleaner, cleaner)
            value = cleaner(F.col(name)) if cleaner else F.col(name)
            typed.append(value.cast(kind).alias(name))
    out = FINISHERS.get(table, lambda x: x)(df.select(*typed))
    return out.select(*[name for name in spec.names if name in out.columns])
