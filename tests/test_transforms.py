from decimal import Decimal

from conftest import ts

from shopspark.operators.transforms import clean, repair_lifecycle


def one(df):
    return df.collect()[0].asDict()


def test_users_are_typed_filled_and_clipped(spark):
    raw = spark.createDataFrame(
        [
            (1, 25, "M", 10.0, 20.0, "SP", ts("2023-01-01")),
            (2, -10, "F", -15.0, -30.0, None, ts("2023-01-01")),
            (3, None, None, 200.0, -200.0, "SP", ts("2023-01-01")),
            (4, 30, "M", None, None, "SP", None),
        ],
        "id int, age int, gender string, latitude double, longitude double, city string, created_at timestamp",
    )
    full = raw.selectExpr("*", "'S' state", "'Brasil' country", "cast(null as string) traffic_source")
    got = {r["id"]: r for r in clean(full, "users").collect()}
    assert [got[i]["age"] for i in (1, 2, 3, 4)] == [25, 10, 0, 30]
    assert got[3]["gender"] == "Others" and got[2]["city"] == "Unknown"
    assert (got[3]["latitude"], got[3]["longitude"]) == (90.0, -180.0)
    assert (got[4]["latitude"], got[4]["longitude"]) == (0.0, 0.0)
    assert got[2]["context_summary"] == (
        "User profile: F, 10 years old, located_in Unknown, S, Brasil. Acquired via Unknown."
    )
    assert got[1]["user_geom"]["lon"] == 20.0 and got[1]["user_geom"]["lat"] == 10.0


def test_centers_keep_null_coordinates(spark):
    raw = spark.createDataFrame(
        [("1", "A", 100.0, -200.0), ("2", "B", None, None)], "id string, name string, latitude double, longitude double"
    )
    first, second = sorted(clean(raw, "distribution_centers").collect())
    assert (first["id"], first["latitude"], first["longitude"]) == (1, 90.0, -180.0)
    assert second["latitude"] is None and second["longitude"] is None


def test_products_lose_signs_and_round_half_up(spark):
    raw = spark.createDataFrame(
        [(1, -50.555, None, None, None, -100.999, None, None, 1)],
        "id int, cost double, category string, name string, brand string, retail_price double, department string, "
        "sku string, distribution_center_id int",
    )
    got = one(clean(raw, "products"))
    assert got["cost"] == Decimal("50.56") and got["retail_price"] == Decimal("101.00")
    assert {got[c] for c in ("category", "name", "brand", "department", "sku")} == {"Unknown"}


def test_inventory_price_keeps_its_sign(spark):
    raw = spark.createDataFrame(
        [("1", "2", "2023-01-01", None, -10.0, "-20.0", "7")],
        "id string, product_id string, created_at string, sold_at string, cost double, product_retail_price string, "
        "product_distribution_center_id string",
    ).selectExpr("*", *[f"cast(null as string) product_{c}" for c in ("category", "name", "brand", "department", "sku")])
    df = clean(raw, "inventory_items")
    got = one(df)
    assert got["cost"] == Decimal("10.00") and got["product_retail_price"] == Decimal("-20.00")
    assert got["product_brand"] == "Unknown" and got["sold_at"] is None
    assert dict(df.dtypes)["sold_at"] == "timestamp" and got["product_distribution_center_id"] == 7


def test_lifecycle_repair_uses_repaired_dates_and_spares_nulls(spark):
    kinds = "id int, created_at timestamp, shipped_at timestamp, delivered_at timestamp, returned_at timestamp"
    day = lambda d: ts(f"2023-01-{d:02d}")
    df = spark.createDataFrame(
        [
            (1, day(5), day(1), day(4), day(4)),
            (2, day(5), None, day(1), day(2)),
            (3, None, day(1), day(2), None),
            (4, day(1), day(3), None, day(2)),
            (5, day(1), day(2), day(3), day(4)),
        ],
        kinds,
    )
    got = {r[0]: tuple(r)[2:] for r in repair_lifecycle(df).collect()}
    assert got[1] == (day(5), day(5), day(5))
    assert got[2] == (None, day(1), day(2))
    assert got[3] == (day(1), day(2), None)
    assert got[4] == (day(3), None, day(2))
    assert got[5] == (day(2), day(3), day(4))


def test_events_know_their_visitor_and_page(spark):
    raw = spark.createDataFrame(
        [
            (1, 10, "/product/17", "s", "product"),
            (2, None, "/cart?x=1", None, None),
            (3, None, "/", "s", "home"),
            (4, None, None, "s", "home"),
        ],
        "id int, user_id int, uri string, session_id string, event_type string",
    ).selectExpr(
        "*", "1 sequence_number", "timestamp'2023-01-01' created_at", "'' ip_address", "cast(null as string) city",
        "'' state", "'' postal_code", "'' browser", "'' traffic_source",
    )
    got = {r["id"]: r for r in clean(raw, "events").collect()}
    assert [got[i]["visitor_type"] for i in (1, 2)] == ["Registered", "Guest"]
    assert [got[i]["extracted_product_id"] for i in (1, 2, 3, 4)] == [17, None, None, None]
    assert [got[i]["extracted_page_type"] for i in (1, 2, 3, 4)] == ["product", "cart", "Unknown", "Unknown"]
    assert got[2]["session_id"] == "Unknown" and got[2]["event_type"] == "Unknown" and got[2]["city"] == "Unknown"


def test_given_page_columns_are_kept(spark):
    raw = spark.sql(
        "select 1 id, 2 user_id, 1 sequence_number, 's' session_id, timestamp'2023-01-01' created_at, 'home' event_type, "
        "'/product/9' uri, 5 extracted_product_id, 'special' extracted_page_type"
    )
    got = one(clean(raw, "events"))
    assert (got["extracted_product_id"], got["extracted_page_type"]) == (5, "special")
