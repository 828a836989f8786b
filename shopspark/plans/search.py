"""Search tables and searches: maps, texts, vectors and their mix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopspark.functions.cleaning import point
from shopspark.functions.geo import snap, with_geodesic
from shopspark.functions.text import ALIKE, case_blind, contains, similarity, trigrams
from shopspark.operators.embedding import Encoder, HashedWords, embed, embed_query
from shopspark.operators.knn import similar
from shopspark.operators.radius import within_radius
from shopspark.plans.common import count_rows
from shopspark.sources.dictionary import data_dictionary

# Fixed value: grid size of the map, in degrees.
CELL_DEGREES = 0.05


def user_logistics(
    users: DataFrame,
    orders: DataFrame,
    order_items: DataFrame,
    products: DataFrame,
    centers: DataFrame,
) -> DataFrame:
    """Buyer, warehouse and distance for every order item.

    The distance is computed on the joined row: cheaper than a second shuffle to
    compute it once per pair.
    """
    buyers = users.select(F.col("id").alias("user_id"), F.col("latitude").alias("_ulat"), F.col("longitude").alias("_ulon"))
    places = centers.select(F.col("id").alias("dc_id"), F.col("latitude").alias("_dlat"), F.col("longitude").alias("_dlon"))
    stocked = products.select(F.col("id").alias("product_id"), F.col("distribution_center_id").cast("bigint").alias("dc_id"))
    located = (
        order_items.select("order_id", "product_id")
        .join(stocked.join(places, "dc_id"), "product_id")
        .join(orders.select("order_id", "user_id"), "order_id")
        .join(buyers, "user_id")
    )
    measured = with_geodesic(located, F.col("_ulat"), F.col("_ulon"), F.col("_dlat"), F.col("_dlon"))
    return measured.select(
        "user_id",
        "dc_id",
        point(F.col("_ulon"), F.col("_ulat")).alias("user_geom"),
        point(F.col("_dlon"), F.col("_dlat")).alias("distribution_center_geom"),
        F.round(F.col("distance_m") / 1000, 3).alias("distance_km"),
    )


def hotspots(users: DataFrame, cell_degrees: float = CELL_DEGREES) -> DataFrame:
    """Users and mean age per square map cell; users without a point form one group.

    Cells are counted by their integer number; the coordinates follow from it.
    """
    cells = users.select(
        snap(F.col("longitude"), cell_degrees).alias("cell_x"),
        snap(F.col("latitude"), cell_degrees).alias("cell_y"),
        "age",
    )
    return (
        cells.groupBy("cell_x", "cell_y")
        .agg(count_rows("density"), F.rint(F.avg("age")).cast("int").alias("avg_user_age"))
        .withColumn(
            "grid_geom",
            F.when(
                F.col("cell_x").isNotNull() & F.col("cell_y").isNotNull(),
                point(F.col("cell_x") * F.lit(cell_degrees), F.col("cell_y") * F.lit(cell_degrees)),
            ),
        )
    )


def product_documents(products: DataFrame) -> DataFrame:
    """Search text and filter columns per product."""
    return products.select(
        F.col("id").alias("source_id"),
        F.concat_ws(" ", "brand", "name", "category", "department").alias("chunk_text"),
        "brand",
        "category",
        "department",
        F.col("retail_price").cast("double").alias("retail_price"),
    )


def user_profiles(users: DataFrame, order_items: DataFrame) -> DataFrame:
    """Profile text, mean spend per item and home point per user."""
    spend = order_items.groupBy("user_id").agg(
        (F.sum("sale_price").cast("double") / F.count("sale_price")).alias("avg_spend")
    )
    return (
        users.select(
            F.col("id").alias("user_id"), "city", "country", "latitude", "longitude",
            F.col("context_summary").alias("chunk_text"), "user_geom",
        )
        .join(spend, "user_id", "left")
    )


def hybrid_search(
    profiles: DataFrame,
    text: str,
    latitude: float,
    longitude: float,
    radius_m: float,
    min_spend: float,
    k: int,
    make_encoder: Callable[[], Encoder] = HashedWords,
) -> DataFrame:
    """Users near a place who spend enough, ranked by likeness of their profile to a text.

    Place and spend are filtered first, so only matching texts are encoded.
    ``profiles`` may carry stored vectors in ``embedding``.
    """
    near = within_radius(profiles.filter(F.col("avg_spend") >= min_spend), latitude, longitude, radius_m)
    if "embedding" not in near.columns:
        near = embed(near.select("user_id", "chunk_text"), "chunk_text", make_encoder=make_encoder)
    question = near.sparkSession.createDataFrame([(0, embed_query(text, make_encoder))], "id bigint, embedding array<float>")
    return similar(near, question, k, key="user_id", query_key="id").select(
        F.col("id").alias("user_id"), "distance", "rank"
    )


def name_search(
    products: DataFrame,
    text: str,
    columns: tuple[str, ...] = ("name", "brand", "category"),
    threshold: float = ALIKE,
) -> DataFrame:
    """Products whose name, brand or category is alike to, or contains, a text.

    The query's trigrams are an array inside the expression: one pass, no join.
    """
    wanted = trigrams(F.lit(text))
    # Each column's trigrams are made once, in a projection of their own.
    grams = {f"_grams{i}": trigrams(F.col(c)) for i, c in enumerate(columns)}
    scores = [similarity(F.col(g), wanted) for g in grams]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    inside = contains(F.concat_ws("\n", *columns), text)
    scored = products.withColumns(grams).withColumns({"score": best, "contains_text": inside}).drop(*grams)
    return scored.filter((F.col("score") >= threshold) | F.col("contains_text"))


def ci_match(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose text equals ``value``, upper and lower case alike."""
    return df.filter(case_blind(F.col(column)) == F.lit(value))


def ci_groups(df: DataFrame, column: str) -> DataFrame:
    """Rows per text, upper and lower case alike; shown in lower case."""
    return (
        df.groupBy(case_blind(F.col(column)).alias("_text"))
        .agg(count_rows("rows"), F.min(F.lower(F.col(column))).alias(column))
        .select(column, "rows")
    )


def schema_search(spark, question: str, k: int = 10, make_encoder: Callable[[], Encoder] = HashedWords) -> DataFrame:
    """Entries of the data dictionary ranked by likeness to a question."""
    entries = data_dictionary(spark).withColumn(
        "chunk_text", F.translate(F.concat_ws(" ", "table_name", "column_name", "comment"), "_.,;", "    ")
    )
    numbered = entries.withColumn("id", F.xxhash64("table_name", F.coalesce("column_name", F.lit(""))))
    vectors = embed(numbered, "chunk_text", make_encoder=make_encoder)
    query = spark.createDataFrame([(0, embed_query(question, make_encoder))], "id bigint, embedding array<float>")
    found = similar(vectors, query, k)
    return found.join(numbered, "id").select("rank", "table_name", "column_name", "comment", "distance").orderBy("rank")
