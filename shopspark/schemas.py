"""The seven business tables: columns, types, comments, keys and frozen columns.

Ids and counts are 64-bit, since a 100 TB order-item table has more rows than a
32-bit id can number; every value of a 32-bit source keeps its value.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class TableSpec:
    """What a load needs to know about one table.

    ``keys`` identify a row, ``frozen`` columns keep the stored value when a row
    is updated, ``partition_by`` names the layout column of large tables.
    """

    name: str
    comment: str
    columns: tuple[tuple[str, str, str], ...]
    keys: tuple[str, ...] = ("id",)
    frozen: tuple[str, ...] = ()
    derived: tuple[str, ...] = ()
    order_by: tuple[str, ...] = field(default=())

    @property
    def names(self) -> list[str]:
        return [name for name, _, _ in self.columns]

    @property
    def source_names(self) -> list[str]:
        """Columns expected in the raw files (the rest are derived on load)."""
        return [name for name in self.names if name not in self.derived]

    @property
    def schema(self) -> T.StructType:
        fields = [
            T.StructField(name, T.DataType.fromDDL(kind), True, {"comment": comment} if comment else {})
            for name, kind, comment in self.columns
        ]
        return T.StructType(fields)


USERS = TableSpec(
    "users",
    "Registered shoppers with demographics, home location and acquisition channel.",
    (
        ("id", "bigint", "User key."),
        ("age", "smallint", "Age in years, 0 when not known."),
        ("gender", "string", "M, F or Others."),
        ("state", "string", "State or region of residence."),
        ("city", "string", "City of residence."),
        ("country", "string", "Country of residence."),
        ("latitude", "double", "Degrees north, -90 to 90."),
        ("longitude", "double", "Degrees east, -180 to 180."),
        ("traffic_source", "string", "Channel that brought the user."),
        ("created_at", "timestamp", "Sign-up time."),
        ("context_summary", "string", "One-sentence profile used for text search."),
        ("user_geom", "struct<lon:double,lat:double>", "Home point for distance questions."),
    ),
    frozen=("created_at",),
    derived=("context_summary", "user_geom"),
    order_by=("city",),
)

DISTRIBUTION_CENTERS = TableSpec(
    "distribution_centers",
    "Warehouses that ship products.",
    (
        ("id", "bigint", "Warehouse key."),
        ("name", "string", "Warehouse name, unique regardless of case."),
        ("latitude", "double", "Degrees north."),
        ("longitude", "double", "Degrees east."),
        ("distribution_center_geom", "struct<lon:double,lat:double>", "Warehouse point for distance questions."),
    ),
    derived=("distribution_center_geom",),
)

PRODUCTS = TableSpec(
    "products",
    "Catalogue of product models; physical units are in inventory_items.",
    (
        ("id", "bigint", "Product key."),
        ("cost", "decimal(10,2)", "Standard purchase cost."),
        ("category", "string", "Product category."),
        ("name", "string", "Product name."),
        ("brand", "string", "Brand."),
        ("retail_price", "decimal(10,2)", "Suggested selling price."),
        ("department", "string", "Department."),
        ("sku", "string", "Stock-keeping code."),
        ("distribution_center_id", "bigint", "Warehouse that stocks the product."),
    ),
)

INVENTORY_ITEMS = TableSpec(
    "inventory_items",
    "Physical stock, one row per unit.",
    (
        ("id", "bigint", "Unit key."),
        ("product_id", "bigint", "Product of the unit."),
        ("created_at", "timestamp", "Time the unit entered stock."),
        ("sold_at", "timestamp", "Time the unit was sold; null while in stock."),
        ("cost", "decimal(10,2)", "Purchase cost of the unit."),
        ("product_category", "string", "Category of the product."),
        ("product_name", "string", "Name of the product."),
        ("product_brand", "string", "Brand of the product."),
        ("product_retail_price", "decimal(10,2)", "Suggested price of the product."),
        ("product_department", "string", "Department of the product."),
        ("product_sku", "string", "Stock-keeping code of the product."),
        ("product_distribution_center_id", "bigint", "Warehouse holding the unit."),
    ),
    frozen=("created_at", "sold_at"),
    order_by=("product_id",),
)

ORDERS = TableSpec(
    "orders",
    "Order heads with status and delivery dates.",
    (
        ("order_id", "bigint", "Order key."),
        ("user_id", "bigint", "Buyer."),
        ("status", "string", "Processing, Shipped, Complete, Returned or Cancelled."),
        ("created_at", "timestamp", "Time of order."),
        ("returned_at", "timestamp", "Time of return."),
        ("shipped_at", "timestamp", "Time of dispatch."),
        ("delivered_at", "timestamp", "Time of delivery."),
        ("num_of_item", "bigint", "Number of items in the order."),
    ),
    keys=("order_id",),
    frozen=("created_at",),
    order_by=("created_at",),
)

ORDER_ITEMS = TableSpec(
    "order_items",
    "Sales at item level: links an order to the unit sold and the price paid.",
    (
        ("id", "bigint", "Item key."),
        ("order_id", "bigint", "Order of the item."),
        ("user_id", "bigint", "Buyer."),
        ("product_id", "bigint", "Product sold."),
        ("inventory_item_id", "bigint", "Stock unit sold."),
        ("status", "string", "Processing, Shipped, Complete, Returned or Cancelled."),
        ("created_at", "timestamp", "Time of order."),
        ("shipped_at", "timestamp", "Time of dispatch."),
        ("delivered_at", "timestamp", "Time of delivery."),
        ("returned_at", "timestamp", "Time of return."),
        ("sale_price", "decimal(10,2)", "Price paid, after discounts."),
    ),
    frozen=("created_at",),
    order_by=("created_at",),
)

EVENTS = TableSpec(
    "events",
    "Clickstream of the web shop.",
    (
        ("id", "bigint", "Event key."),
        ("user_id", "bigint", "User, null for a guest."),
        ("sequence_number", "bigint", "Position within the session, from 1."),
        ("session_id", "string", "Visit the event belongs to."),
        ("created_at", "timestamp", "Event time."),
        ("ip_address", "string", "Client address."),
        ("city", "string", "City of the client."),
        ("state", "string", "State of the client."),
        ("postal_code", "string", "Postal code of the client."),
        ("browser", "string", "Browser family."),
        ("traffic_source", "string", "Channel that led to the visit."),
        ("uri", "string", "Page address."),
        ("event_type", "string", "product, department, cart, purchase, cancel or home."),
        ("visitor_type", "string", "Guest or Registered."),
        ("extracted_product_id", "bigint", "Product of the page, if it shows one."),
        ("extracted_page_type", "string", "First path segment of the page."),
    ),
    keys=("id", "created_at"),
    derived=("visitor_type", "extracted_product_id", "extracted_page_type"),
    order_by=("session_id", "created_at"),
)

TABLES: dict[str, TableSpec] = {
    spec.name: spec
    for spec in (USERS, DISTRIBUTION_CENTERS, PRODUCTS, INVENTORY_ITEMS, ORDERS, ORDER_ITEMS, EVENTS)
}
