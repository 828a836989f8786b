"""Registered queries: each reads the test tables through the business views."""

from __future__ import annotations

import sys
from collections.abc import Callable
from datetime import date, datetime
from functools import reduce
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracles
from shopspark.domain import (
    FAULTS, RAW, center_span, faulty, item_columns, order_heads, product_columns, raw_tables, shop, with_faults,
)
from shopspark.functions.geo import kilometres
from shopspark.operators import embedding, knn, name_index, sketches, vector_codes
from shopspark.operators.contracts import violations
from shopspark.operators.incremental import high_watermark, newer_than, within_lookback
from shopspark.operators.integrity import ForeignKey, keep_valid, mark_drops, orphan_report as orphans_of
from shopspark.operators.merge import MergeSpec, merge, spec_for
from shopspark.operators.positions import with_places
from shopspark.operators.quantiles import with_ntiles
from shopspark.operators.radius import nearest, radius_join
from shopspark.operators.rulebook import CONTRACTS, strict_contract
from shopspark.operators.transforms import clean
from shopspark.plans import changes, customers, products, sales, search, web
from shopspark.plans.load import load_all, open_table
from shopspark.plans.monthly import merge_months
from shopspark.schemas import TABLES
from shopspark.session import configure
from shopspark.sources import zorder
from shopspark.sources.monthly import MonthlyTable
from shopspark.sources.raw import scan, scan_stream
from shopspark.sources.versioned import VersionedTable
from shopspark.storage import materialize, scratch_path
from shopspark.streaming import ingest, joins, metrics, sessions

try:
    from shopspark.llm.queries import QUERIES as TEXT_QUERIES, SQL as TEXT_SQL
except ImportError:  # the subpackage for training text is optional
    TEXT_QUERIES, TEXT_SQL = {}, {}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = date(2002, 1, 1)


def portable(df: DataFrame) -> DataFrame:
    """Types both engines hand to Python alike.

    Decimals show as doubles, times without a zone, the parts of a struct as columns.
    """
    shown = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind == "struct":
            shown += [F.col(f"{field.name}.{part}").alias(f"{field.name}_{part}") for part in field.dataType.names]
        elif kind.startswith("decimal"):
            shown.append(F.col(field.name).cast("double").alias(field.name))
        elif kind == "timestamp":
            shown.append(F.col(field.name).cast("timestamp_ntz").alias(field.name))
        else:
            shown.append(F.col(field.name))
    return df.select(*shown)


def query(run: Query) -> Query:
    """Register a query under its function name."""

    def prepared(spark: SparkSession, root: str) -> DataFrame:
        return portable(run(configure(spark), root))

    QUERIES[run.__name__] = prepared
    return prepared


# --- metrics -------------------------------------------------------------------------------------


@query
def daily_sales(spark, root):
    return sales.daily_sales(shop(spark, root, "order_items"), shop(spark, root, "products"), shop(spark, root, "users"))


@query
def aov(spark, root):
    return sales.aov(shop(spark, root, "order_items"))


@query
def new_vs_recurring(spark, root):
    return sales.new_vs_recurring(shop(spark, root, "order_items"))


@query
def cohort_retention(spark, root):
    return customers.cohort_retention(shop(spark, root, "order_items"), shop(spark, root, "users"))


@query
def customer_rfm_ltv(spark, root):
    return customers.customer_rfm_ltv(shop(spark, root, "order_items"), shop(spark, root, "users"))


@query
def traffic_source_performance(spark, root):
    return customers.traffic_source_performance(
        shop(spark, root, "users"), shop(spark, root, "orders"), shop(spark, root, "order_items")
    )


@query
def product_360(spark, root):
    return products.product_360(
        shop(spark, root, "products"), shop(spark, root, "order_items"), shop(spark, root, "inventory_items"), AS_OF
    )


def placed(run: Query, keys: list[str], *shown: str) -> Query:
    """The order of a metric's rows: each row's key columns and its place in the result."""
    return lambda spark, root: with_places(run(configure(spark), root), keys).select(*shown, "place")


ORDERED = {
    "daily_sales_order": placed(daily_sales, ["day", "country"], "day", "country"),
    "cohort_order": placed(cohort_retention, ["country", "cohort_month", "month_number"], "country", "cohort_month", "month_number"),
    "customer_value_order": placed(customer_rfm_ltv, ["ltv_value"], "user_id", "ltv_value"),
    "stock_age_order": placed(product_360, ["avg_aging_days"], "product_id", "avg_aging_days"),
    "traffic_source_order": placed(traffic_source_performance, ["avg_ticket"], "traffic_source", "avg_ticket"),
}


QUERIES.update(ORDERED)


@query
def buyer_spans(spark, root):
    """Distinct buyers of 30, 90 and 365 days from each month on: exact, and whether the daily sketches come near."""
    items = materialize(shop(spark, root, "order_items").select("user_id", "created_at"), "buyers")
    daily = materialize(sketches.daily_sketches(items, "user_id"), "daily-sketches")
    starts = daily.select(F.trunc("day", "month").alias("start")).distinct()
    spans = starts.withColumn("days", F.explode(F.array(*[F.lit(n) for n in oracles.SPANS])))
    both = sketches.exact_spans(items, "user_id", spans).join(sketches.span_estimates(daily, spans), ["start", "days"])
    near = F.abs(F.col("estimate") - F.col("exact")) <= sketches.BOUND * F.col("exact")
    return both.select("start", "days", F.col("exact").alias("buyers"), near.alias("sketch_near"))


@query
def stock_aging_before_sale(spark, root):
    return products.stock_aging_before_sale(shop(spark, root, "inventory_items"))


@query
def shipping_time(spark, root):
    return products.shipping_time(shop(spark, root, "order_items"), shop(spark, root, "products"))


@query
def product_margin(spark, root):
    return products.product_margin(shop(spark, root, "order_items"), shop(spark, root, "products"))


@query
def sales_funnel(spark, root):
    return web.sales_funnel(shop(spark, root, "events"))


@query
def time_to_purchase(spark, root):
    return web.time_to_purchase(shop(spark, root, "events"))


QUERIES["session_length_order"] = placed(time_to_purchase, ["session_duration_bucket"], "session_duration_bucket")


@query
def visitor_conversion(spark, root):
    return web.visitor_conversion(shop(spark, root, "events"))


@query
def event_traffic_source(spark, root):
    return web.event_traffic_source(shop(spark, root, "events"))


# --- cleaning and contracts ----------------------------------------------------------------------


def cleaned_faults(spark, root, table):
    return clean(faulty(spark, root, table), table)


def register(name: str, run: Query) -> None:
    run.__name__ = name
    query(run)


for _table in FAULTS:
    register(f"clean_{_table}", lambda spark, root, t=_table: cleaned_faults(spark, root, t))
    register(
        f"validate_{_table}", lambda spark, root, t=_table: violations(cleaned_faults(spark, root, t), CONTRACTS[t])
    )


@query
def strict_checks(spark, root):
    """Load contracts and warehouse constraints of all tables in one report."""
    reports = [
        violations(cleaned_faults(spark, root, t), strict_contract(t)).select(
            F.lit(t).alias("table_name"), "rule", "violations"
        )
        for t in FAULTS
    ]
    return reduce(DataFrame.unionByName, reports)


@query
def lifecycle_repair(spark, root):
    return shop(spark, root, "order_items").select("id", "created_at", "shipped_at", "delivered_at", "returned_at")


# --- references ----------------------------------------------------------------------------------


def item_keys(spark, root):
    """Foreign keys of the order items; products are those with a warehouse."""
    return [
        ForeignKey("order_id", order_heads(spark, root), "order_id"),
        ForeignKey("user_id", shop(spark, root, "users")),
        ForeignKey("product_id", keep_valid(shop(spark, root, "products"), [center_key(spark, root)])),
        ForeignKey("inventory_item_id", RAW["order_items"](spark, root)),
    ]


def center_key(spark, root):
    return ForeignKey("distribution_center_id", shop(spark, root, "distribution_centers"))


@query
def orphan_report(spark, root):
    def named(prefix, keys):
        return [ForeignKey(k.column, k.target, k.target_column, f"{prefix}.{k.column}") for k in keys]

    items = faulty(spark, root, "order_items")
    return orphans_of(shop(spark, root, "products"), named("products", [center_key(spark, root)])).unionByName(
        orphans_of(items, named("order_items", item_keys(spark, root)[:3]))
    )


@query
def fk_filter(spark, root):
    kept = keep_valid(shop(spark, root, "products"), [center_key(spark, root)])
    return kept.select("id", "name", "distribution_center_id")


@query
def fk_chain(spark, root):
    kept = keep_valid(faulty(spark, root, "order_items"), item_keys(spark, root))
    return kept.select("id", "order_id", "user_id", "product_id", "inventory_item_id")


@query
def fk_drops(spark, root):
    marked = mark_drops(faulty(spark, root, "order_items"), item_keys(spark, root))
    reason = F.coalesce("dropped_by", F.lit("kept")).alias("dropped_by")
    return marked.groupBy(reason).agg(F.count(F.lit(1)).alias("rows"))


# --- increments and merge ------------------------------------------------------------------------


@query
def watermark_load(spark, root):
    stock = shop(spark, root, "inventory_items").select("id", "product_id", "created_at")
    loaded = stock.filter(F.col("created_at") < F.lit("2000-03-15").cast("timestamp"))
    return newer_than(stock, high_watermark(loaded))


@query
def lookback_load(spark, root):
    return within_lookback(order_heads(spark, root), datetime(2001, 7, 1), 180)


def product_batch(given):
    """A later delivery of half of the products: new keys, changed prices and lost names."""
    return given.filter(F.col("id") % 2 == 0).select(
        F.when(F.col("id") % 5 == 0, -F.col("id") - 1).otherwise(F.col("id")).alias("id"),
        F.when(F.col("id") % 3 != 0, F.col("name")).alias("name"),
        F.when(F.col("id") % 7 == 0, F.col("retail_price") + 1).otherwise(F.col("retail_price")).alias("retail_price"),
        F.concat(F.lit("new "), F.col("brand")).alias("brand"),
        "sku",
    )


def stored_products(spark, root):
    return shop(spark, root, "products").select("id", "name", "retail_price", "brand", "sku")


@query
def upsert_merge(spark, root):
    merged = merge(stored_products(spark, root), product_batch(shop(spark, root, "products")), MergeSpec(frozen=("brand", "sku")))
    return merged.withColumnRenamed("_action", "action")


@query
def upsert_actions(spark, root):
    merged = merge(stored_products(spark, root), product_batch(shop(spark, root, "products")), MergeSpec(frozen=("brand", "sku")))
    return merged.groupBy(F.col("_action").alias("action")).agg(F.count(F.lit(1)).alias("rows"))


@query
def upsert_insert_only(spark, root):
    every = MergeSpec(frozen=("name", "retail_price", "brand", "sku"))
    merged = merge(stored_products(spark, root), product_batch(shop(spark, root, "products")), every)
    return merged.select("id", "brand", F.col("_action").alias("action"))


@query
def order_lookup(spark, root):
    """The items of one order, found in the monthly files by the bloom filters on its number."""
    table = open_table(spark, scratch_path(spark, "monthly"), "order_items")
    merge_months(table, shop(spark, root, "order_items"), MergeSpec(), checked=True)
    found = table.read().where(F.col("order_id") == oracles.LOOKED_UP)
    return found.select("id", "order_id", "product_id", "status", "sale_price")


@query
def daily_by_changes(spark, root):
    """Daily sums of items after two merges, from the sums before and the rows the merges changed."""
    table, keys = open_table(spark, scratch_path(spark, "monthly"), "order_items"), MergeSpec(keys=("id",))
    merge_months(table, shop(spark, root, "order_items"), keys, checked=True)
    sums = materialize(changes.daily_item_sums(table.read()), "daily-sums")
    cancelled = F.when(F.expr("abs(id) div 1000 % 4 = 0"), "Cancelled").otherwise(F.col("status"))
    since = F.col("created_at") >= F.lit(oracles.CANCELLED_SINCE).cast("timestamp")
    for deliver in (
        lambda stored: later_delivery(stored, "order_items"),
        lambda stored: stored.where(since).withColumn("status", cancelled),
    ):
        _, signed = changes.merge_with_changes(table, materialize(deliver(table.read()), "delivery"), keys)
        sums = materialize(changes.fold_daily(sums, signed), "daily-sums")
    return sums


@query
def ntile_distributed(spark, root):
    orders = scan(spark, root, "orders").select(
        "o_orderkey",
        (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint").alias("_cents"),
        F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).alias("_days"),
    )
    tiles = with_ntiles(
        materialize(orders, "orders"), {"price_tile": "_cents", "age_tile": "_days"}, "o_orderkey", 7
    )
    return tiles.select("o_orderkey", "price_tile", "age_tile")


@query
def sessionize(spark, root):
    return RAW["events"](spark, root).select("id", "session_id", "sequence_number")


@query
def run_log(spark, root):
    """The whole load into a fresh place: what each step read, kept and changed."""
    target = scratch_path(spark, "warehouse")
    done = load_all(spark, raw_tables(spark, root), target, datetime(2002, 1, 1), lookback=None)
    return done.frame(spark).select(
        "table_name", "rows_in", "rows_out", "rows_dropped", "inserted", "updated", "unchanged"
    )


@query
def append_parts(spark, root):
    """Users appended to a stored table in two goes."""
    users = shop(spark, root, "users")
    table = VersionedTable(spark, scratch_path(spark, "append"), "users", users.schema)
    for rest in (0, 1):
        table.append(users.where(F.col("id") % 2 == rest))
    return table.read().select("id", "country", "traffic_source")


@query
def month_range(spark, root):
    """Clicks kept by month, read back for a span of days through the months it meets."""
    clicks = shop(spark, root, "events")
    table = open_table(spark, scratch_path(spark, "months"), "events")
    merge_months(table, clicks, spec_for("events", TABLES), checked=True)
    return table.read_between(*oracles.CLICK_SPAN).select("id", "user_id", "created_at", "event_type")


#: Of the three tables with a life cycle: the number by which a delivery deals, and a value that it changes.
DELIVERED = {
    "orders": ("order_id", "num_of_item"),
    "order_items": ("id div 1000", "sale_price"),
    "inventory_items": ("id div 1000", "cost"),
}


def later_delivery(stored, table):
    """A third of the rows since a day: a fifth of them with new keys, a seventh a month later, an eleventh with a new value."""
    (key,), (number, value) = TABLES[table].keys, DELIVERED[table]
    rest = lambda n: F.expr(f"({number}) % {n} = 0")
    given = stored.where((F.col("created_at") >= F.lit(oracles.DELIVERED_SINCE).cast("timestamp")) & rest(3))
    shown = {
        key: F.when(rest(5), -F.col(key) - 1).otherwise(F.col(key)),
        "created_at": F.when(rest(7), F.col("created_at") + F.expr("interval 31 days")).otherwise(F.col("created_at")),
        value: F.when(rest(11), F.col(value) + 1).otherwise(F.col(value)).cast(stored.schema[value].dataType),
    }
    return given.withColumns(shown)


@query
def month_merges(spark, root):
    """A later delivery merged twice into orders, items and stock kept by month: what changes and what is rewritten."""
    target, done = scratch_path(spark, "monthly"), []
    for name in DELIVERED:
        table, keys = open_table(spark, target, name), MergeSpec(keys=TABLES[name].keys)
        merge_months(table, shop(spark, root, name), keys, checked=True)
        delivery = materialize(later_delivery(table.read(), name), "delivery")
        for run in (1, 2):
            found = merge_months(table, delivery, keys)
            counts = [found.actions[action] for action in ("insert", "update", "unchanged")]
            done.append((name, run, *counts, found.moved, len(found.months), found.rows_written, len(table.months())))
    columns = "inserted bigint, updated bigint, unchanged bigint, moved bigint, months bigint, rows_written bigint, months_stored bigint"
    return spark.createDataFrame(done, f"table_name string, run int, {columns}")


@query
def merged_items(spark, root):
    """The items after such a merge."""
    table, keys = open_table(spark, scratch_path(spark, "monthly"), "order_items"), MergeSpec(keys=("id",))
    merge_months(table, shop(spark, root, "order_items"), keys, checked=True)
    merge_months(table, materialize(later_delivery(table.read(), "order_items"), "delivery"), keys)
    return table.read().select("id", "order_id", "created_at", "status", "sale_price")


@query
def load_twice(spark, root):
    """A second load of all tables: every row looked at is found unchanged."""
    target = scratch_path(spark, "warehouse")
    raw = raw_tables(spark, root)
    load = lambda: load_all(spark, raw, target, datetime(2002, 1, 1), lookback=None)
    load()
    return load().frame(spark).select("table_name", "rows_in", "rows_out", "inserted", "updated", "unchanged")


# --- maps, texts and vectors ---------------------------------------------------------------------


@query
def user_logistics(spark, root):
    tables = ("users", "orders", "order_items", "products", "distribution_centers")
    return search.user_logistics(*[shop(spark, root, t) for t in tables])


@query
def hotspots(spark, root):
    return search.hotspots(shop(spark, root, "users"), cell_degrees=5.0)


@query
def hotspots_fine(spark, root):
    return search.hotspots(shop(spark, root, "users"), cell_degrees=0.05)


@query
def within_radius(spark, root):
    users = shop(spark, root, "users").select(F.col("id").alias("user_id"), "latitude", "longitude")
    pairs = radius_join(users, shop(spark, root, "distribution_centers"), 2_500_000.0)
    return pairs.select("user_id", "center_id", kilometres(F.col("distance_m")).alias("distance_km"))


@query
def users_in_circle(spark, root):
    """Users around a place, from points laid out along a Z-order curve."""
    path = scratch_path(spark, "along-curve")
    zorder.write_along_curve(shop(spark, root, "users").select("id", "latitude", "longitude"), path)
    found = zorder.read_circle(spark, path, *oracles.CIRCLE)
    return found.select("id", F.round(F.col("distance_m") / 1000, 3).alias("distance_km"))


@query
def nearest_dc(spark, root):
    found = nearest(shop(spark, root, "users"), shop(spark, root, "distribution_centers"))
    return found.select(
        F.col("id").alias("user_id"), "center_id", F.round(F.col("distance_m") / 1000, 3).alias("distance_km")
    )


@query
def product_documents(spark, root):
    return search.product_documents(shop(spark, root, "products"))


@query
def user_profiles(spark, root):
    profiles = search.user_profiles(shop(spark, root, "users"), shop(spark, root, "order_items"))
    return profiles.withColumn("avg_spend", F.round("avg_spend", 6))


@query
def embed(spark, root):
    """Vectors of the whole documents, shown as their non-zero cells."""
    vectors = embedding.embed(scan(spark, root, "documents").select("doc_id", "text"), "text")
    cells = vectors.select("doc_id", F.posexplode("embedding").alias("cell", "weight"))
    return cells.filter(F.col("weight") != 0).withColumn("weight", F.round(F.col("weight").cast("double"), 5))


def asked(vectors):
    """The queries of the vector searches: every vector whose number is divisible by 20."""
    return vectors.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("id"), "embedding")


@query
def similar(spark, root):
    vectors = scan(spark, root, "embeddings")
    found = knn.similar(vectors, asked(vectors), 10, key="vec_id", query_key="id", skip_self=True)
    return found.withColumn("distance", F.round("distance", 6))


def cell_search(spark, root):
    vectors = scan(spark, root, "embeddings")
    index = knn.build_index(vectors, scratch_path(spark, "vector-cells"), key="vec_id")
    # The test vectors lie nearly evenly on the sphere: nine tenths of the neighbours need most cells.
    probes = -(-len(index.centroids) * 17 // 20)
    return knn.similar_ann(index, asked(vectors), 10, probes=probes, skip_self=True)


@query
def similar_products(spark, root):
    """The products most like the first of them, among those of some brands and prices."""
    docs = search.product_documents(shop(spark, root, "products"))
    low, high = oracles.PRICE_SPAN
    wanted = docs.where(F.col("brand").isin(*oracles.BRANDS) & F.col("retail_price").between(low, high))
    stored = materialize(embedding.embed(wanted, "chunk_text"), "product-vectors")
    first = stored.agg(F.min_by(F.struct("source_id", "embedding"), "source_id").alias("q")).where("q is not null").select("q.*")
    found = knn.similar(stored, first, 10, key="source_id", skip_self=True)
    return found.withColumn("distance", F.round("distance", 5))


@query
def similar_ann(spark, root):
    return cell_search(spark, root).withColumn("distance", F.round("distance", 6))


@query
def similar_ann_recall(spark, root):
    """The share of the exact neighbours that the cell search finds."""
    vectors = scan(spark, root, "embeddings")
    exact = knn.similar(vectors, asked(vectors), 10, key="vec_id", query_key="id", skip_self=True)
    return knn.recall(cell_search(spark, root), exact)


def code_search(spark, root, k=10):
    """Search by codes; the first list is a fifth of the vectors at most."""
    vectors = scan(spark, root, "embeddings")
    index = vector_codes.build_codes(vectors, scratch_path(spark, "vector-codes"), key="vec_id")
    return vector_codes.similar_by_codes(index, asked(vectors), k, skip_self=True)


@query
def similar_codes(spark, root):
    return code_search(spark, root).withColumn("distance", F.round("distance", 6))


@query
def similar_codes_recall(spark, root):
    """The share of the exact neighbours that the search by codes finds."""
    vectors = scan(spark, root, "embeddings")
    exact = knn.similar(vectors, asked(vectors), 10, key="vec_id", query_key="id", skip_self=True)
    return knn.recall(code_search(spark, root), exact)


@query
def hybrid_search(spark, root):
    profiles = search.user_profiles(shop(spark, root, "users"), shop(spark, root, "order_items"))
    found = search.hybrid_search(
        profiles, oracles.QUESTION, oracles.HYBRID_LAT, oracles.HYBRID_LON, oracles.HYBRID_METRES,
        oracles.HYBRID_SPEND, oracles.HYBRID_K,
    )
    return found.withColumn("distance", F.round("distance", 5))


@query
def name_search(spark, root):
    found = search.name_search(shop(spark, root, "products"), oracles.NAME_QUERY, threshold=oracles.NAME_LIMIT)
    return found.select("id", "name", "brand", "category", F.round("score", 6).alias("score"), "contains_text")


@query
def indexed_names(spark, root):
    """Names, brands and categories alike to the name of every twentieth product, through the stored trigram index."""
    products = shop(spark, root, "products")
    index = name_index.build_name_index(products, scratch_path(spark, "names"))
    questions = products.where(F.col("id") % 20 == 0).select(F.col("name").alias("question"))
    found = name_index.alike_texts(index, questions, oracles.NAME_LIMIT)
    return found.withColumn("score", F.round("score", 6))


@query
def ci_match(spark, root):
    """Users per city written in mixed case."""
    mixed = F.when(F.col("id") % 3 == 0, F.lower("city")).otherwise(F.col("city"))
    return search.ci_groups(shop(spark, root, "users").withColumn("city", mixed), "city")


# --- streams -------------------------------------------------------------------------------------


@query
def stream_daily_sales(spark, root):
    lines = scan_stream(spark, root, "lineitem")
    items = clean(item_columns(lines, order_heads(spark, root)), "order_items")
    sums = metrics.daily_sales_stream(items, shop(spark, root, "products"), shop(spark, root, "users"))
    table = MonthlyTable(spark, scratch_path(spark, "stream-sales"), "daily_sales", sums.schema, time="day")
    ingest.upsert_stream(
        sums, table, MergeSpec(keys=("day", "country")), scratch_path(spark, "checkpoint"), mode="update"
    )
    return table.read()


@query
def stream_daily_rates(spark, root):
    """Daily sales with profits and rates from a stream: sums per order are folded, the rates follow from them."""
    shown = shop(spark, root, "products"), shop(spark, root, "users")
    empty = sales.order_sums(shop(spark, root, "order_items").limit(0), *shown)
    table = VersionedTable(spark, scratch_path(spark, "stream-orders"), "order_sums", empty.schema)
    table.replace(empty)
    items = clean(item_columns(scan_stream(spark, root, "lineitem"), order_heads(spark, root)), "order_items")
    fold = lambda stored, batch: sales.fold_order_sums(stored, sales.order_sums(batch, *shown))
    ingest.merge_stream(items, table, fold, scratch_path(spark, "checkpoint"))
    return sales.daily_rates(table.read())


def folded_sessions(spark, root):
    clicks = scan_stream(spark, root, "events").select("user_id", "ts", "event_type")
    empty = metrics.click_spans(scan(spark, root, "events").limit(0))
    table = VersionedTable(spark, scratch_path(spark, "stream-sessions"), "sessions", empty.schema)
    table.replace(empty)
    fold = lambda stored, batch: metrics.fold_sessions(stored, metrics.click_spans(batch))
    ingest.merge_stream(clicks, table, fold, scratch_path(spark, "checkpoint"))
    return table.read()


@query
def stream_sessions(spark, root):
    return metrics.open_sessions(folded_sessions(spark, root))


@query
def stream_funnel(spark, root):
    flags = {"cart": "has_cart", "purchase": "has_purchase", "viewed": "has_product_view"}
    sessions = folded_sessions(spark, root).select(
        F.year("started_at").alias("year"), *[F.col(flag).alias(name) for name, flag in flags.items()]
    )
    return web.funnel_rates(sessions)


@query
def stream_dedup(spark, root):
    """The click stream delivered twice, cut back to one row per (event, time)."""
    twice = scan_stream(spark, root, "events").unionByName(scan_stream(spark, root, "events"))
    once = ingest.without_repeats(twice, ["event_id", "ts"], "ts").select("event_id", "ts", "user_id", "event_type")
    path = scratch_path(spark, "stream-events")
    ingest.append_to(once, path, scratch_path(spark, "checkpoint"))
    return spark.read.schema(once.schema).parquet(path)


def click_deliveries(spark, root):
    """The clicks in three deliveries by time; some of the first days come with the second one."""
    clicks = scan(spark, root, "events").select("event_id", "user_id", "ts", "event_type")
    first, second = (F.lit(day).cast("timestamp") for day in oracles.DELIVERY_DAYS)
    tardy = (F.col("ts") < F.lit(oracles.TARDY_BEFORE).cast("timestamp")) & (F.col("event_id") % oracles.TARDY_EVERY == 0)
    number = F.when((F.col("ts") < first) & ~tardy, 1).when((F.col("ts") < second) | tardy, 2).otherwise(3)
    numbered = materialize(clicks.withColumn("delivery", number), "clicks")
    return [numbered.where(F.col("delivery") == n).drop("delivery") for n in (1, 2, 3)]


def delivered(spark, parts, names, flow):
    """Append one delivery after the other to the folders of the streams; after each, run ``flow`` on from its checkpoint."""
    folders = [scratch_path(spark, f"feed-{name}") for name in names]
    out, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "checkpoint")
    for given in parts:
        for folder, rows in zip(folders, given):
            rows.write.mode("append").parquet(folder)
        streams = [spark.readStream.schema(rows.schema).parquet(folder) for folder, rows in zip(folders, given)]
        result = flow(*streams)
        ingest.append_to(result, out, checkpoint)
    return spark.read.schema(result.schema).parquet(out)


@query
def stream_closed_sessions(spark, root):
    """Sessions in streaming state, written when the watermark has passed them, over three runs of the stream."""
    sessions.fold_locally(spark)
    return delivered(spark, [[part] for part in click_deliveries(spark, root)], ["clicks"], sessions.closed_sessions)


@query
def stream_late_clicks(spark, root):
    """The clicks that came too late for a session."""
    late = delivered(spark, [[part] for part in click_deliveries(spark, root)], ["clicks"], sessions.late_clicks)
    return late.select("event_id", "user_id", "ts")


@query
def stream_item_heads(spark, root):
    """Items and heads of orders from two streams; items of unknown orders go out once their time is over."""
    items = faulty(spark, root, "order_items").select(
        "id", "order_id", (F.col("created_at") + F.expr("make_interval(0, 0, 0, 0, cast(id % 5 + 1 as int), 0, 0)")).alias("placed_at"), "sale_price"
    )
    items, heads = materialize(items, "items"), materialize(order_heads(spark, root), "heads")
    items_day, heads_day = (F.lit(day).cast("timestamp") for day in oracles.ORDER_DAYS)
    parts = [
        [items.where(F.col("placed_at") < items_day), heads.where(F.col("created_at") < heads_day)],
        [items.where(F.col("placed_at") >= items_day), heads.where(F.col("created_at") >= heads_day)],
    ]
    return delivered(spark, parts, ["items", "heads"], joins.items_with_heads)


@query
def stream_upsert(spark, root):
    """A stream of deliveries merged into stored products."""
    stored = stored_products(spark, root)
    table = VersionedTable(spark, scratch_path(spark, "stream-products"), "catalogue", stored.schema)
    table.replace(stored)
    deliveries = product_batch(clean(product_columns(scan_stream(spark, root, "part"), center_span(spark, root)), "products"))
    ingest.upsert_stream(deliveries, table, MergeSpec(frozen=("brand", "sku")), scratch_path(spark, "checkpoint"))
    return table.read()


@query
def stream_quarantine(spark, root):
    """Faulty products from a stream: those of unknown warehouses or that break a row rule."""
    incoming = clean(with_faults(product_columns(scan_stream(spark, root, "part"), center_span(spark, root)), "products"), "products")
    good, bad = scratch_path(spark, "stream-good"), scratch_path(spark, "stream-bad")
    ingest.quarantine_stream(
        incoming, CONTRACTS["products"], [center_key(spark, root)], good, bad, scratch_path(spark, "checkpoint")
    )
    return spark.read.parquet(bad).select("id", F.array_join("failed_rules", ",").alias("failed_rules"))


# --- driver contract -----------------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    return QUERIES["daily_sales"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return {**QUERIES, **TEXT_QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**{name: sql for name, sql in oracles.SQL.items() if name in QUERIES}, **TEXT_SQL}
