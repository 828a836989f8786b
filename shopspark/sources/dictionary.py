"""The data dictionary: what every table and column means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shopspark.schemas import TABLES

METRIC_TABLES = {
    "daily_sales": "Revenue, profit and loss rates per day and country.",
    "cohort_retention": "Share of buyers still active, per country, first month and month of life.",
    "customer_rfm_ltv": "Recency, frequency and value scores with a segment per buyer.",
    "product_360": "Sales, margin, returns and stock age per product.",
    "sales_funnel": "Cart, purchase and drop-off rates of sessions per year.",
    "time_to_purchase": "Conversion of sessions by their length.",
    "traffic_source_performance": "Users, orders, conversion and item price per channel.",
    "user_logistics": "Distance from buyer to warehouse per order item.",
    "user_profiles": "Buyer profile text with spend and home point for mixed search.",
    "product_documents": "Product text with filter columns for similarity search.",
    "hotspots": "Users per square map cell.",
}


def data_dictionary(spark: SparkSession) -> DataFrame:
    """(table_name, column_name, type, comment); the column is null for a table's own entry."""
    rows = [(name, None, "table", comment) for name, comment in METRIC_TABLES.items()]
    for spec in TABLES.values():
        rows.append((spec.name, None, "table", spec.comment))
        rows.extend((spec.name, column, kind, comment) for column, kind, comment in spec.columns)
    return spark.createDataFrame(rows, "table_name string, column_name string, type string, comment string")
