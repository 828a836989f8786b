"""The contracts of the seven tables, and the stricter warehouse constraints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from shopspark.operators.contracts import Contract, Rule

# Accepted codes.
GENDERS = ("M", "F", "Others")
STATUSES = ("Processing", "Shipped", "Complete", "Returned", "Cancelled")
EVENT_TYPES = ("product", "department", "cart", "purchase", "cancel", "home")


def missing(column: str) -> Rule:
    return lambda df: df[column].isNull()


def below(column: str, bound: int) -> Rule:
    return lambda df: df[column] < bound


def at_most(column: str, bound: int) -> Rule:
    return lambda df: df[column] <= bound


def outside(column: str, low: int, high: int) -> Rule:
    return lambda df: ~df[column].between(low, high)


def not_in(column: str, allowed: tuple[str, ...]) -> Rule:
    return lambda df: ~df[column].isin(*allowed)


def before(column: str, floor: str) -> Rule:
    return lambda df: df[column] < df[floor]


def key(*columns: str) -> tuple[Rule, ...]:
    return tuple((lambda df, c=c: df[c]) for c in columns)


def lower_key(column: str) -> tuple[Rule, ...]:
    return ((lambda df: F.lower(df[column])),)


# The names of the rules.
_COORDINATES = {
    "lat_out_range": outside("latitude", -90, 90),
    "lon_out_range": outside("longitude", -180, 180),
}
_LIFECYCLE = {
    "ship_early_err": before("shipped_at", "created_at"),
    "delivered_early_err": before("delivered_at", "shipped_at"),
    "returned_early_err": before("returned_at", "delivered_at"),
}

CONTRACTS: dict[str, Contract] = {
    contract.table: contract
    for contract in (
        Contract(
            "users",
            rows={
                "id_missing": missing("id"), "created_missing": missing("created_at"),
                "age_invalid": below("age", 0),
                "gender_invalid": not_in("gender", GENDERS),
                **_COORDINATES,
            },
            unique={"id_duplicated": key("id")},
        ),
        Contract(
            "distribution_centers",
            rows={"id_missing": missing("id"), "name_missing": missing("name"), **_COORDINATES},
            unique={"id_duplicated": key("id"), "name_duplicates": lower_key("name")},
        ),
        Contract(
            "products",
            rows={
                "id_missing": missing("id"), "cost_missing": missing("cost"), "price_missing": missing("retail_price"), "sku_missing": missing("sku"),
                "cost_negative": at_most("cost", 0),
                "price_negative": below("retail_price", 0),
            },
            unique={"id_duplicated": key("id"), "sku_duplicated": key("sku")},
        ),
        Contract(
            "inventory_items",
            rows={
                "id_missing": missing("id"), "prod_id_missing": missing("product_id"), "dist_center_missing": missing("product_distribution_center_id"), "created_missing": missing("created_at"), "cost_missing": missing("cost"), "price_missing": missing("product_retail_price"), "category_missing": missing("product_category"), "name_missing": missing("product_name"), "brand_missing": missing("product_brand"), "dept_missing": missing("product_department"), "sku_missing": missing("product_sku"),
                "sold_data_invalid": before("sold_at", "created_at"),
                "cost_negative": below("cost", 0),
                "price_negative": below("product_retail_price", 0),
            },
            unique={"id_duplicated": key("id")},
        ),
        Contract(
            "orders",
            rows={
                "id_missing": missing("order_id"), "user_id_missing": missing("user_id"), "status_missing": missing("status"), "items_missing": missing("num_of_item"), "created_missing": missing("created_at"),
                "status_invalid": not_in("status", STATUSES),
                "items_invalid": at_most("num_of_item", 0),
                **_LIFECYCLE,
            },
            unique={"id_duplicated": key("order_id")},
        ),
        Contract(
            "order_items",
            rows={
                "id_missing": missing("id"), "order_id_missing": missing("order_id"), "user_id_missing": missing("user_id"), "prod_id_missing": missing("product_id"), "inv_id_missing": missing("inventory_item_id"), "created_missing": missing("created_at"),
                "status_invalid": not_in("status", STATUSES),
                "price_negative": below("sale_price", 0),
                **_LIFECYCLE,
            },
            unique={"id_duplicated": key("id")},
        ),
        Contract(
            "events",
            rows={
                "id_missing": missing("id"), "session_missing": missing("session_id"), "created_missing": missing("created_at"),
                "event_type_invalid": not_in("event_type", EVENT_TYPES),
                "seq_invalid": below("sequence_number", 1),
            },
            unique={"pk_duplicated": key("id", "created_at")},
        ),
    )
}


def _required(*columns: str) -> dict[str, Rule]:
    return {f"{c}_required": missing(c) for c in columns}


# Constraints the warehouse puts on stored rows beyond the load contracts.
_STRICT: dict[str, dict[str, Rule]] = {
    "users": {"age_not_positive": at_most("age", 0), "gender_unlisted": not_in("gender", ("M", "F"))},
    "distribution_centers": {},
    "products": _required("category", "name", "brand", "department", "distribution_center_id"),
    "inventory_items": {},
    "orders": {},
    "order_items": {},
    "events": _required("browser", "traffic_source", "visitor_type", "extracted_page_type"),
}


def strict_contract(table: str) -> Contract:
    return CONTRACTS[table].extended(_STRICT[table])


def contract_with(table: str, extra: dict[str, Callable]) -> Contract:
    """A table's contract with user rules added."""
    return CONTRACTS[table].extended(extra)
