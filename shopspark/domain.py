"""The seven business tables as views over the star-schema test tables.

Each function returns a *raw* table: right columns, not yet cleaned. ``shop``
returns the cleaned ones. Everything is lazy, so a query that skips a column
also skips the join or window that makes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shopspark.operators.sessions import sessionize
from shopspark.operators.transforms import clean
from shopspark.sources.raw import scan
from shopspark.storage import materialize

_DAY = 86_400
_1994 = 757_382_400  # 1994-01-01 00:00:00 UTC


def _plus_days(moment: str, days: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(moment) + days.cast("bigint") * F.lit(_DAY * 1_000_000))


def _degrees(key: str, step: int, span: int, shift: int) -> Column:
    return (F.col(key) * F.lit(step) % F.lit(span)).cast("double") / F.lit(100.0) - F.lit(float(shift))


def raw_users(spark: SparkSession, root: str) -> DataFrame:
    nation = scan(spark, root, "nation")
    region = scan(spark, root, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("c_custkey")
    # Suppliers are users as well; they have no orders.
    others = scan(spark, root, "supplier").select(
        (F.col("s_suppkey") + SUPPLIER_USERS).alias("c_custkey"),
        F.col("s_nationkey").alias("c_nationkey"),
        F.lit("BUILDING").alias("c_mktsegment"),
    )
    return (
        scan(spark, root, "customer")
        .select("c_custkey", "c_nationkey", "c_mktsegment")
        .union(others)
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("id"),
            (F.lit(18) + key % 60).alias("age"),
            F.when(key % 2 == 0, "F").otherwise("M").alias("gender"),
            F.col("r_name").alias("state"),
            F.concat(F.lit("CITY_"), (key % 40).cast("string")).alias("city"),
            F.col("n_name").alias("country"),
            _degrees("c_custkey", 7919, 17001, 85).alias("latitude"),
            _degrees("c_custkey", 104729, 36001, 180).alias("longitude"),
            F.col("c_mktsegment").alias("traffic_source"),
            F.timestamp_seconds(F.lit(_1994) + (key % 365) * F.lit(_DAY)).alias("created_at"),
        )
    )


def raw_distribution_centers(spark: SparkSession, root: str) -> DataFrame:
    return (
        scan(spark, root, "supplier")
        .select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("name"),
            _degrees("s_suppkey", 6151, 17001, 85).alias("latitude"),
            _degrees("s_suppkey", 49157, 36001, 180).alias("longitude"),
        )
    )


def center_span(spark: SparkSession, root: str) -> int:
    """Warehouse numbers that products use; a sixth of them do not exist."""
    return scan(spark, root, "supplier").count() * 12 // 10


def product_columns(part: DataFrame, centers: int) -> DataFrame:
    """Products of warehouses 0 to ``centers`` - 1; those of absent warehouses are orphans."""
    price = F.col("p_retailprice").cast("decimal(18,4)")
    return part.select(
        F.col("p_partkey").alias("id"),
        F.round(price * F.lit("0.55").cast("decimal(2,2)"), 2).cast("decimal(10,2)").alias("cost"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.round(price, 2).cast("decimal(10,2)").alias("retail_price"),
        F.when(F.col("p_size") % 2 == 0, "Women").otherwise("Men").alias("department"),
        F.concat(F.lit("SKU"), F.col("p_partkey").cast("string")).alias("sku"),
        (F.col("p_partkey") % centers).cast("bigint").alias("distribution_center_id"),
    )


def raw_products(spark: SparkSession, root: str) -> DataFrame:
    return product_columns(scan(spark, root, "part"), center_span(spark, root))


def order_heads(spark: SparkSession, root: str) -> DataFrame:
    """Orders without their item roll-up."""
    state, key = F.col("o_orderstatus"), F.col("o_orderkey")
    status = (
        F.when((F.col("o_orderpriority") == "5-LOW") & (key % 2 == 0), "Cancelled")
        .when(state == "P", "Processing")
        .when(state == "O", "Shipped")
        .when(key % 4 == 0, "Returned")
        .otherwise("Complete")
    )
    return (
        scan(spark, root, "orders")
        .select(
            key.alias("order_id"),
            F.col("o_custkey").alias("user_id"),
            status.alias("status"),
            F.col("o_orderdate").alias("created_at"),
        )
    )


def item_columns(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Join order lines with their heads and derive the item's own columns."""
    head = heads.select("order_id", "user_id", F.col("status").alias("_status"), "created_at")
    returned = F.col("_status").isin("Complete", "Returned") & (F.col("l_returnflag") == "R")
    delivered = F.col("_status").isin("Complete", "Returned")
    status = (
        F.when(returned, "Returned")
        .when(F.col("_status") == "Returned", "Complete")
        .otherwise(F.col("_status"))
    )
    quantity = F.col("l_quantity").cast("int")
    # Cents and percent are whole numbers, so the price is exact in integers.
    cents = F.rint(F.col("l_extendedprice") * 100).cast("bigint")
    kept = F.lit(100) - F.rint(F.col("l_discount") * 100).cast("bigint")
    price = F.call_function("div", cents * kept + 50, F.lit(100)).cast("decimal(12,0)") * F.lit("0.01").cast(
        "decimal(2,2)"
    )
    return lines.join(head, F.col("l_orderkey") == F.col("order_id")).withColumns(
        {
            "product_id": F.col("l_partkey"),
            "status": status,
            "shipped_at": F.when(delivered | (F.col("_status") == "Shipped"), F.col("l_shipdate")),
            "delivered_at": F.when(delivered, _plus_days("l_shipdate", quantity % 7 - 2)),
            "returned_at": F.when(returned, _plus_days("l_shipdate", quantity % 11 - 3)),
            "sale_price": price.cast("decimal(10,2)"),
        }
    )


# Item ids are built from order, dispatch day and rank within that day.
_ID_ORDER, _ID_DAY = 10_000_000, 1_000
# First number of the users that suppliers are.
SUPPLIER_USERS = 1_000_000_000_000


def raw_order_items(spark: SparkSession, root: str) -> DataFrame:
    """Order lines with a unique id.

    The rank runs within (order, dispatch day). Lines are dealt by order once, which
    serves the rank, the join with the heads and what is summed by order. The ids
    bound an order: it has fewer than ``_ID_DAY`` lines a day.
    """
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    within_day = W.partitionBy("l_orderkey", "_day").orderBy(
        "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )
    rank = F.row_number().over(within_day)
    full = F.raise_error(F.lit("an order has too many lines of one day for its item ids")).cast("bigint")
    number = F.col("l_orderkey") * _ID_ORDER + F.col("_day") * _ID_DAY
    lines = scan(spark, root, "lineitem").repartition("l_orderkey").withColumn("_day", day).withColumn("_rank", rank)
    lines = lines.withColumn("id", F.when(F.col("_rank") < _ID_DAY, number + F.col("_rank")).otherwise(full)).drop("_rank")
    return item_columns(lines, order_heads(spark, root)).select(
        "id",
        "order_id",
        "user_id",
        "product_id",
        F.col("id").alias("inventory_item_id"),
        "status",
        "created_at",
        "shipped_at",
        "delivered_at",
        "returned_at",
        "sale_price",
    )


def raw_orders(spark: SparkSession, root: str, items: DataFrame | None = None) -> DataFrame:
    """Order heads with the latest item dates and the number of items; ``items`` are the raw items where they are kept."""
    rollup = (
        (raw_order_items(spark, root) if items is None else items)
        .groupBy("order_id")
        .agg(
            F.max("returned_at").alias("returned_at"),
            F.max("shipped_at").alias("shipped_at"),
            F.max("delivered_at").alias("delivered_at"),
            F.count(F.lit(1)).alias("_items"),
        )
    )
    return (
        order_heads(spark, root)
        .join(rollup, "order_id", "left")
        .select(
            "order_id", "user_id", "status", "created_at", "returned_at", "shipped_at", "delivered_at",
            F.coalesce("_items", F.lit(1)).cast("bigint").alias("num_of_item"),
        )
    )


def raw_inventory_items(spark: SparkSession, root: str, items: DataFrame | None = None) -> DataFrame:
    """One unit per order item; every third is still in stock."""
    units = (raw_order_items(spark, root) if items is None else items).select("id", "product_id", "created_at")
    products = raw_products(spark, root)
    renamed = products.select(
        F.col("id").alias("product_id"),
        "cost",
        F.col("category").alias("product_category"),
        F.col("name").alias("product_name"),
        F.col("brand").alias("product_brand"),
        F.col("retail_price").alias("product_retail_price"),
        F.col("department").alias("product_department"),
        F.col("sku").alias("product_sku"),
        F.col("distribution_center_id").cast("bigint").alias("product_distribution_center_id"),
    )
    return units.join(renamed, "product_id").select(
        "id",
        "product_id",
        _plus_days("created_at", -(F.col("id") % 90) - 1).alias("created_at"),
        F.when(F.col("id") % 3 != 0, F.col("created_at")).alias("sold_at"),
        *[c for c in renamed.columns if c != "product_id"],
    )


# How the test click types read as shop events.
EVENT_TYPES = {"view": "product", "click": "cart", "purchase": "purchase", "signup": "home"}


def shop_event_columns(df: DataFrame) -> DataFrame:
    """Business columns of sessionized clicks."""
    kind = F.col("event_type")
    shop_type = F.lit("cancel")
    for source, target in EVENT_TYPES.items():
        shop_type = F.when(kind == source, target).otherwise(shop_type)
    page = F.concat(F.lit("/product/"), F.get_json_object("props", "$.k"))
    uri = (
        F.when(kind == "view", page)
        .when(kind == "click", "/cart")
        .when(kind == "purchase", "/purchase")
        .otherwise("/home")
    )
    return df.select(
        F.col("event_id").alias("id"),
        F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("user_id"),
        "sequence_number",
        "session_id",
        F.col("ts").alias("created_at"),
        F.lit(None).cast("string").alias("ip_address"),
        F.concat(F.lit("CITY_"), (F.col("user_id") % 40).cast("string")).alias("city"),
        F.lit(None).cast("string").alias("state"),
        F.lit(None).cast("string").alias("postal_code"),
        F.concat(F.lit("BROWSER_"), (F.col("event_id") % 4).cast("string")).alias("browser"),
        F.concat(F.lit("SOURCE_"), (F.col("user_id") % 5).cast("string")).alias("traffic_source"),
        uri.alias("uri"),
        shop_type.alias("event_type"),
    )


def raw_events(spark: SparkSession, root: str) -> DataFrame:
    return shop_event_columns(sessionize(scan(spark, root, "events")))


RAW: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "users": raw_users,
    "distribution_centers": raw_distribution_centers,
    "products": raw_products,
    "inventory_items": raw_inventory_items,
    "orders": raw_orders,
    "order_items": raw_order_items,
    "events": raw_events,
}


def raw_tables(spark: SparkSession, root: str) -> Callable[[str], DataFrame]:
    """The raw tables by name, for a job that reads several of them.

    Items, stock and orders are made from the order items, which are derived when the first of
    them is asked for, kept in scratch and read from there by all three, as often as they are read.
    """
    kept: list[DataFrame] = []

    def items() -> DataFrame:
        if not kept:
            derived = raw_order_items(spark, root)
            stored = materialize(derived.drop("inventory_item_id"), "raw-items")
            kept.append(stored.withColumn("inventory_item_id", F.col("id")).select(*derived.columns))
        return kept[0]

    made: dict[str, Callable[[], DataFrame]] = {
        "order_items": items,
        "orders": lambda: raw_orders(spark, root, items()),
        "inventory_items": lambda: raw_inventory_items(spark, root, items()),
    }
    return lambda table: made[table]() if table in made else RAW[table](spark, root)


def shop(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A cleaned business table."""
    return clean(RAW[table](spark, root), table)


# Faults worked into the clean test data, as SQL over the raw columns, so the
# cleaning and the contracts meet nulls, signs, ranges, orphans and bad order.
FAULTS: dict[str, dict[str, str]] = {
    "users": {
        "age": "CASE WHEN id % 13 = 0 THEN NULL WHEN id % 11 = 0 THEN -age ELSE age END",
        "gender": "CASE WHEN id % 17 = 0 THEN 'X' WHEN id % 7 = 0 THEN NULL ELSE gender END",
        "state": "CASE WHEN id % 19 = 0 THEN NULL ELSE state END",
        "city": "CASE WHEN id % 23 = 0 THEN NULL ELSE city END",
        "country": "CASE WHEN id % 29 = 0 THEN NULL ELSE country END",
        "latitude": "CASE WHEN id % 31 = 0 THEN NULL WHEN id % 5 = 0 THEN latitude * 2 ELSE latitude END",
        "longitude": "CASE WHEN id % 37 = 0 THEN NULL WHEN id % 5 = 1 THEN longitude * 2 ELSE longitude END",
        "traffic_source": "CASE WHEN id % 41 = 0 THEN NULL ELSE traffic_source END",
        "created_at": "CASE WHEN id % 43 = 0 THEN NULL ELSE created_at END",
    },
    "distribution_centers": {
        "name": "CASE WHEN id = 4 THEN NULL WHEN id = 5 THEN 'SUPPLIER#000000006' ELSE name END",
        "latitude": "CASE WHEN id = 3 THEN NULL ELSE latitude * 2 END",
        "longitude": "CASE WHEN id = 2 THEN NULL ELSE longitude * 2 END",
    },
    "products": {
        "cost": "CASE WHEN id % 53 = 0 THEN NULL WHEN id % 11 = 0 THEN -cost WHEN id % 59 = 0 THEN 0.00 ELSE cost END",
        "category": "CASE WHEN id % 13 = 0 THEN NULL ELSE category END",
        "name": "CASE WHEN id % 17 = 0 THEN NULL ELSE name END",
        "brand": "CASE WHEN id % 19 = 0 THEN NULL ELSE brand END",
        "retail_price": "CASE WHEN id % 61 = 0 THEN NULL WHEN id % 7 = 0 THEN -retail_price ELSE retail_price END",
        "department": "CASE WHEN id % 23 = 0 THEN NULL ELSE department END",
        "sku": "CASE WHEN id % 67 = 0 THEN NULL ELSE sku END",
    },
    "inventory_items": {
        "sold_at": "CASE WHEN id % 101 = 0 THEN created_at - INTERVAL 1 DAY ELSE sold_at END",
        "cost": "CASE WHEN id % 103 = 0 THEN NULL WHEN id % 11 = 0 THEN -cost ELSE cost END",
        "product_name": "CASE WHEN id % 13 = 0 THEN NULL ELSE product_name END",
        "product_brand": "CASE WHEN id % 17 = 0 THEN NULL ELSE product_brand END",
        "product_retail_price": "CASE WHEN id % 107 = 0 THEN -product_retail_price ELSE product_retail_price END",
        "product_distribution_center_id": (
            "CASE WHEN id % 109 = 0 THEN NULL ELSE product_distribution_center_id END"
        ),
    },
    "orders": {
        "user_id": "CASE WHEN order_id % 83 = 0 THEN NULL ELSE user_id END",
        "status": "CASE WHEN order_id % 89 = 0 THEN NULL WHEN order_id % 97 = 0 THEN 'Lost' ELSE status END",
        "shipped_at": "CASE WHEN order_id % 7 = 0 THEN NULL ELSE shipped_at END",
        "num_of_item": "CASE WHEN order_id % 101 = 0 THEN 0 ELSE num_of_item END",
    },
    "order_items": {
        "user_id": "CASE WHEN order_id % 83 = 0 THEN NULL WHEN order_id % 71 = 0 THEN -user_id - 1 ELSE user_id END",
        "order_id": "CASE WHEN order_id % 79 = 0 THEN -order_id ELSE order_id END",
        "status": "CASE WHEN id % 89 = 0 THEN NULL WHEN id % 97 = 0 THEN 'Lost' ELSE status END",
        "shipped_at": "CASE WHEN id % 7 = 0 THEN NULL ELSE shipped_at END",
        "delivered_at": "CASE WHEN id % 11 = 0 THEN NULL ELSE delivered_at END",
        "sale_price": "CASE WHEN id % 113 = 0 THEN NULL WHEN id % 107 = 0 THEN -sale_price ELSE sale_price END",
    },
    "events": {
        "session_id": "CASE WHEN id % 211 = 0 THEN NULL ELSE session_id END",
        "sequence_number": "CASE WHEN id % 73 = 0 THEN 0 ELSE sequence_number END",
        "city": "CASE WHEN id % 13 = 0 THEN NULL ELSE city END",
        "browser": "CASE WHEN id % 17 = 0 THEN NULL ELSE browser END",
        "event_type": "CASE WHEN id % 79 = 0 THEN NULL ELSE event_type END",
        "uri": "CASE WHEN id % 19 = 0 THEN NULL WHEN id % 23 = 0 THEN '/' ELSE uri END",
    },
}


def with_faults(raw: DataFrame, table: str) -> DataFrame:
    faults = FAULTS[table]
    return raw.select(*[F.expr(faults[c]).alias(c) if c in faults else F.col(c) for c in raw.columns])


def faulty(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A raw business table with the faults above worked in."""
    return with_faults(RAW[table](spark, root), table)
