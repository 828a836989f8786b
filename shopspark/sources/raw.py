"""Scans of raw Parquet files by table name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shopspark.schemas import TABLES, TableSpec

# Declared types of the star-schema files. Reading the zone-less timestamps as
# ``timestamp`` takes them as UTC without a cast, so time filters still reach
# the Parquet row groups.
STAR_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp"
    ),
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def scan(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A star-schema table with its declared types."""
    return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{root}/{name}.parquet")


def scan_stream(spark: SparkSession, root: str, name: str, **options: str) -> DataFrame:
    """The same table as a file stream."""
    return (
        spark.readStream.schema(STAR_SCHEMAS[name])
        .option("pathGlobFilter", f"{name}.parquet")
        .options(**options)
        .parquet(root)
    )


def read_raw(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A raw business table, cut to the columns the load uses."""
    return allow_listed(spark.read.parquet(f"{root}/{table}.parquet"), TABLES[table])


def allow_listed(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Only the declared columns, with a clear error when one is absent.

    Derived columns are taken when the files carry them.
    """
    absent = [name for name in spec.source_names if name not in df.columns]
    if absent:
        raise ValueError(f"{spec.name}: columns missing from the input: {absent}")
    present = [name for name in spec.names if name in df.columns]
    return df.select(*present)
