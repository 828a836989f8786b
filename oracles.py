"""DuckDB statements that state the expected result of each registered query."""

from __future__ import annotations

from shopspark.domain import FAULTS

# --- the business tables over the test tables --------------------------------------------------

USERS_RAW = """
users_raw AS (
  SELECT c.c_custkey AS id, 18 + c.c_custkey % 60 AS age,
    CASE WHEN c.c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, r.r_name AS state,
    'CITY_' || (c.c_custkey % 40) AS city, n.n_name AS country,
    (c.c_custkey * 7919 % 17001)::DOUBLE / 100.0::DOUBLE - 85.0::DOUBLE AS latitude,
    (c.c_custkey * 104729 % 36001)::DOUBLE / 100.0::DOUBLE - 180.0::DOUBLE AS longitude,
    c.c_mktsegment AS traffic_source,
    TIMESTAMP '1994-01-01' + to_days((c.c_custkey % 365)::INT) AS created_at
  FROM (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer
        UNION ALL SELECT s_suppkey + 1000000000000, s_nationkey, 'BUILDING' FROM supplier) c
    JOIN nation n ON c.c_nationkey = n.n_nationkey
    JOIN region r ON n.n_regionkey = r.r_regionkey)"""

CENTERS_RAW = """
centers_raw AS (
  SELECT s_suppkey AS id, s_name AS name,
    (s_suppkey * 6151 % 17001)::DOUBLE / 100.0::DOUBLE - 85.0::DOUBLE AS latitude,
    (s_suppkey * 49157 % 36001)::DOUBLE / 100.0::DOUBLE - 180.0::DOUBLE AS longitude
  FROM supplier)"""

PRODUCTS_RAW = """
products_raw AS (
  SELECT p_partkey AS id, round(p_retailprice::DECIMAL(18,4) * 0.55, 2)::DECIMAL(10,2) AS cost, p_type AS category,
    p_name AS name, p_brand AS brand, round(p_retailprice, 2)::DECIMAL(10,2) AS retail_price,
    CASE WHEN p_size % 2 = 0 THEN 'Women' ELSE 'Men' END AS department, 'SKU' || p_partkey AS sku,
    p_partkey % (SELECT count(*) * 12 // 10 FROM supplier) AS distribution_center_id
  FROM part)"""

HEADS = """
heads AS (
  SELECT o_orderkey AS order_id, o_custkey AS user_id,
    CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 2 = 0 THEN 'Cancelled'
      WHEN o_orderstatus = 'P' THEN 'Processing' WHEN o_orderstatus = 'O' THEN 'Shipped'
      WHEN o_orderkey % 4 = 0 THEN 'Returned' ELSE 'Complete' END AS status,
    o_orderdate AS created_at
  FROM orders)"""

ITEMS_RAW = (
    HEADS
    + """,
numbered AS (
  SELECT *, l_orderkey * 10000000 + date_diff('day', DATE '1992-01-01', l_shipdate::DATE) * 1000
    + row_number() OVER (PARTITION BY l_orderkey, l_shipdate::DATE ORDER BY l_shipdate, l_linenumber, l_partkey,
      l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS id
  FROM lineitem),
items_raw AS (
  SELECT l.id, l.l_orderkey AS order_id, o.user_id, l.l_partkey AS product_id, l.id AS inventory_item_id,
    CASE WHEN o.status = 'Cancelled' THEN 'Cancelled'
      WHEN o.status IN ('Complete', 'Returned') AND l.l_returnflag = 'R' THEN 'Returned'
      WHEN o.status = 'Returned' THEN 'Complete' ELSE o.status END AS status,
    o.created_at,
    CASE WHEN o.status IN ('Shipped', 'Complete', 'Returned') THEN l.l_shipdate END AS shipped_at,
    CASE WHEN o.status IN ('Complete', 'Returned')
      THEN l.l_shipdate + to_days((l.l_quantity::INT % 7) - 2) END AS delivered_at,
    CASE WHEN o.status IN ('Complete', 'Returned') AND l.l_returnflag = 'R'
      THEN l.l_shipdate + to_days((l.l_quantity::INT % 11) - 3) END AS returned_at,
    round(l.l_extendedprice::DECIMAL(12,2) * (1 - l.l_discount::DECIMAL(4,2)), 2)::DECIMAL(10,2) AS sale_price
  FROM numbered l JOIN heads o ON l.l_orderkey = o.order_id)"""
)


def repaired(source: str, name: str, others: str) -> str:
    """Lifecycle repair of ``source`` as CTE ``name``, in three steps."""
    return f"""
{name}_s AS (SELECT {others}, created_at, delivered_at, returned_at,
    CASE WHEN shipped_at < created_at THEN created_at ELSE shipped_at END AS shipped_at FROM {source}),
{name}_d AS (SELECT {others}, created_at, shipped_at, returned_at,
    CASE WHEN delivered_at < shipped_at THEN shipped_at ELSE delivered_at END AS delivered_at FROM {name}_s),
{name} AS (SELECT {others}, created_at, shipped_at, delivered_at,
    CASE WHEN returned_at < delivered_at THEN delivered_at ELSE returned_at END AS returned_at FROM {name}_d)"""


ITEM_OTHERS = "id, order_id, user_id, product_id, inventory_item_id, status, sale_price"
ITEMS = ITEMS_RAW + "," + repaired("items_raw", "items", ITEM_OTHERS)

ORDERS_RAW = (
    ITEMS_RAW
    + """,
orders_raw AS (
  SELECT h.order_id, h.user_id, h.status, h.created_at, i.returned_at, i.shipped_at, i.delivered_at,
    coalesce(i.n, 1) AS num_of_item
  FROM heads h LEFT JOIN (SELECT order_id, max(returned_at) AS returned_at, max(shipped_at) AS shipped_at,
      max(delivered_at) AS delivered_at, count(*) AS n FROM items_raw GROUP BY 1) i USING (order_id))"""
)

STOCK_RAW = (
    ITEMS_RAW
    + ","
    + PRODUCTS_RAW
    + """,
stock_raw AS (
  SELECT i.id, i.product_id, i.created_at - to_days((1 + i.id % 90)::INT) AS created_at,
    CASE WHEN i.id % 3 <> 0 THEN i.created_at END AS sold_at, p.cost, p.category AS product_category,
    p.name AS product_name, p.brand AS product_brand, p.retail_price AS product_retail_price,
    p.department AS product_department, p.sku AS product_sku,
    p.distribution_center_id AS product_distribution_center_id
  FROM items_raw i JOIN products_raw p ON i.product_id = p.id)"""
)

EVENTS_RAW = """
marked AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 43200000000 THEN 0 ELSE 1 END AS nw
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered_sessions AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
  AS sn FROM marked),
clicks_raw AS (
  SELECT event_id AS id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id END AS user_id,
    row_number() OVER (PARTITION BY user_id, sn ORDER BY ts, event_id) AS sequence_number,
    user_id || '-' || sn::BIGINT AS session_id, ts AS created_at, NULL::VARCHAR AS ip_address,
    'CITY_' || (user_id % 40) AS city, NULL::VARCHAR AS state, NULL::VARCHAR AS postal_code,
    'BROWSER_' || (event_id % 4) AS browser, 'SOURCE_' || (user_id % 5) AS traffic_source,
    CASE event_type WHEN 'view' THEN '/product/' || json_extract_string(props, '$.k') WHEN 'click' THEN '/cart'
      WHEN 'purchase' THEN '/purchase' ELSE '/home' END AS uri,
    CASE event_type WHEN 'view' THEN 'product' WHEN 'click' THEN 'cart' WHEN 'purchase' THEN 'purchase'
      WHEN 'signup' THEN 'home' ELSE 'cancel' END AS event_type
  FROM numbered_sessions)"""

CLICKS = (
    EVENTS_RAW
    + """,
clicks AS (SELECT *, CASE WHEN user_id IS NULL THEN 'Guest' ELSE 'Registered' END AS visitor_type,
    nullif(regexp_extract(uri, '/product/([0-9]+)', 1), '')::BIGINT AS extracted_product_id FROM clicks_raw)"""
)


# --- exact rounding ------------------------------------------------------------------------------


def half_up(num: str, den: str, digits: int = 2) -> str:
    """``num / den`` of integers, rounded half away from zero; null when den is 0."""
    scale = 10**digits
    n, d = f"(({num})::HUGEINT)", f"(({den})::HUGEINT)"
    return (
        f"(CASE WHEN {d} <> 0 THEN (sign({n}) * ((abs({n}) * {2 * scale} + {d}) // (2 * {d})))::DOUBLE"
        f" / {scale}.0::DOUBLE END)"
    )


def pct(num: str, den: str) -> str:
    return half_up(f"100 * ({num})", den)


def cents(expr: str) -> str:
    """Sum of a money column in cents."""
    return f"(({expr}) * 100)::HUGEINT"


def dollars(expr: str) -> str:
    return f"(({expr})::DOUBLE)"


SOLD = "status NOT IN ('Cancelled', 'Returned')"

SQL: dict[str, str] = {}

# --- sales ---------------------------------------------------------------------------------------

SQL["daily_sales"] = f"""
WITH {ITEMS}, {PRODUCTS_RAW}, {USERS_RAW}, per_order AS (
  -- One row per order, day and country: money by kind, and which kinds of items it has.
  SELECT i.created_at::DATE AS day, u.country, i.order_id,
    sum(CASE WHEN i.status <> 'Cancelled' THEN i.sale_price ELSE 0 END) AS paid,
    sum(CASE WHEN i.{SOLD} THEN i.sale_price ELSE 0 END) AS kept,
    sum(CASE WHEN i.{SOLD} THEN p.cost ELSE 0 END) AS kept_cost,
    sum(CASE WHEN i.status = 'Returned' THEN p.cost ELSE 0 END) AS back_cost,
    bool_or(i.{SOLD}) AS has_sold, bool_or(i.status = 'Cancelled') AS has_cancelled, bool_or(i.status = 'Returned') AS has_returned
  FROM items i, products_raw p, users_raw u WHERE p.id = i.product_id AND u.id = i.user_id GROUP BY ALL),
m AS (
  SELECT day, country, sum(paid) AS gmv, sum(kept) AS net, sum(kept_cost) AS cost_sold, sum(back_cost) AS cost_returned,
    count_if(has_sold) AS n_sold, count_if(has_cancelled) AS n_cancelled, count_if(has_returned) AS n_returned, count(*) AS n
  FROM per_order GROUP BY ALL)
SELECT day, country, {dollars('gmv')} AS gmv, {dollars('net')} AS net_revenue,
  {dollars('net - cost_sold')} AS gross_profit_optimistic,
  {dollars('(net - cost_sold - cost_returned * 0.10)::DECIMAL(24,4)')} AS gross_profit_realistic,
  {dollars('(cost_returned * 0.10)::DECIMAL(22,4)')} AS logistic_loss,
  CASE WHEN n_sold = 0 THEN 0 ELSE {pct('n_cancelled', 'n')} END AS cancellation_rate,
  CASE WHEN n_sold = 0 THEN 0 ELSE {pct('n_returned', 'n')} END AS returns_rate
FROM m"""

SQL["aov"] = f"""
WITH {ITEMS}, o AS (SELECT order_id, sum(sale_price) AS spend FROM items GROUP BY 1)
SELECT count(*) AS orders, {dollars('sum(spend)')} AS total_sales,
  {half_up(cents('sum(spend)'), '100 * count(spend)')} AS avg_order_value FROM o"""

SQL["new_vs_recurring"] = f"""
WITH {ITEMS}, o AS (SELECT user_id, order_id, sum(sale_price) AS spend, min(created_at) AS placed
    FROM items WHERE status <> 'Cancelled' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY placed, order_id) AS rn,
    count(*) OVER (PARTITION BY user_id) AS n FROM o)
SELECT {dollars('sum(spend) FILTER (WHERE rn = 1)')} AS new_sales,
  {dollars('coalesce(sum(spend) FILTER (WHERE rn > 1), 0)')} AS recurring_sales,
  count(*) FILTER (WHERE rn = 1) AS buyers, count(*) FILTER (WHERE rn = 1 AND n > 1) AS repeat_buyers,
  {pct(cents('sum(spend) FILTER (WHERE rn = 1)'), cents('sum(spend)'))} AS new_share
FROM r"""

SPANS = (30, 90, 365)
SQL["buyer_spans"] = f"""WITH {ITEMS}, days AS (SELECT DISTINCT created_at::DATE AS day, user_id FROM items),
spans AS (SELECT DISTINCT date_trunc('month', day)::DATE AS start, unnest({list(SPANS)})::INT AS days FROM days)
SELECT start, days, count(DISTINCT user_id) AS buyers, true AS sketch_near
FROM spans s JOIN days d ON d.day >= s.start AND d.day < s.start + s.days GROUP BY 1, 2"""

# --- customers -----------------------------------------------------------------------------------

SQL["cohort_retention"] = f"""
WITH {ITEMS}, {USERS_RAW}, buyers AS (
  -- Every buyer with the sorted list of months that have a sale; the first is the cohort.
  SELECT any_value(u.country) AS country, list_sort(list(DISTINCT date_trunc('month', i.created_at)::DATE)) AS months
  FROM items i, users_raw u WHERE u.id = i.user_id AND i.{SOLD} GROUP BY u.id),
seen AS (
  SELECT country, months[1] AS cohort_month, date_diff('month', months[1], unnest(months))::INT AS month_number FROM buyers),
counted AS (SELECT country, cohort_month, month_number, count(*) AS active_users FROM seen GROUP BY ALL),
sized AS (
  -- Month 0 of a cohort holds all its buyers.
  SELECT *, max(active_users) FILTER (WHERE month_number = 0) OVER (PARTITION BY country, cohort_month) AS original_users
  FROM counted)
SELECT country, cohort_month, original_users, month_number, active_users,
  {pct('active_users', 'original_users')} AS retention_rate
FROM sized WHERE month_number <= 12"""

SQL["customer_rfm_ltv"] = f"""
WITH {ITEMS}, {USERS_RAW}, orders_of AS (
  -- Orders with a sale; the day after the latest of all is the day of the snapshot.
  SELECT user_id, order_id, max(created_at)::DATE AS placed, sum(sale_price) AS spend
  FROM items WHERE {SOLD} GROUP BY ALL),
dated AS (SELECT *, max(placed) OVER () + 1 AS today FROM orders_of),
buyers AS (
  SELECT user_id, min(today - placed) AS recency_days, count(*) AS frequency_count, sum(spend) AS ltv
  FROM dated WHERE user_id IN (SELECT id FROM users_raw) GROUP BY user_id),
scored AS (
  SELECT *, ntile(5) OVER old AS r_score, ntile(5) OVER often AS f_score, ntile(5) OVER rich AS m_score FROM buyers
  WINDOW old AS (ORDER BY recency_days DESC, user_id), often AS (ORDER BY frequency_count, user_id),
    rich AS (ORDER BY ltv, user_id))
SELECT user_id, recency_days::INT AS recency_days, frequency_count, {dollars('ltv')} AS ltv_value,
  concat(r_score, f_score, m_score) AS rfm_score, r_score::INT AS r_score, f_score::INT AS f_score,
  m_score::INT AS m_score,
  CASE WHEN r_score >= 5 AND f_score >= 5 THEN 'Champions (VIP)'
    WHEN r_score >= 4 AND f_score >= 4 THEN 'Loyal Customers'
    WHEN r_score >= 3 AND f_score >= 3 THEN 'Potential Loyalist'
    WHEN r_score <= 2 AND f_score >= 4 THEN 'At Risk (High Value)'
    WHEN r_score <= 2 AND f_score <= 2 THEN 'Hibernating'
    WHEN r_score >= 4 AND f_score <= 2 THEN 'New Users' ELSE 'General' END AS customer_segment
FROM scored"""

SQL["traffic_source_performance"] = f"""
WITH {ITEMS}, {USERS_RAW}
SELECT u.traffic_source, count(DISTINCT u.id) AS acquired_users, count(DISTINCT o.order_id) AS total_orders,
  {pct('count(DISTINCT o.user_id)', 'count(DISTINCT u.id)')} AS user_conversion_rate,
  {half_up(cents('sum(i.sale_price)'), '100 * count(i.sale_price)')} AS avg_ticket
FROM users_raw u LEFT JOIN heads o ON u.id = o.user_id LEFT JOIN items i ON o.order_id = i.order_id GROUP BY 1"""

# --- products ------------------------------------------------------------------------------------

SQL["product_360"] = f"""
WITH {STOCK_RAW}, {repaired('items_raw', 'items', ITEM_OTHERS)},
sales AS (
  SELECT product_id, count(*) FILTER (WHERE status = 'Returned') AS returned,
    count(*) FILTER (WHERE status IN ('Complete', 'Returned', 'Shipped')) AS dispatched,
    sum(epoch_us(shipped_at) - epoch_us(created_at)) AS wait, count(shipped_at) AS shipped,
    sum(sale_price) AS sales, count(sale_price) AS priced
  FROM items WHERE status <> 'Cancelled' GROUP BY 1),
stock AS (
  SELECT product_id, sum(date_diff('day', created_at::DATE, DATE '2002-01-01')) AS age, count(*) AS stock_qt
  FROM stock_raw WHERE sold_at IS NULL GROUP BY 1)
SELECT p.id AS product_id, p.category, p.name AS product_name,
  {pct('s.returned', 's.dispatched')} AS return_rate_pct,
  {half_up('s.wait', 's.shipped * 86400000000')} AS avg_to_shipping_days,
  {pct(cents('s.sales') + ' - ' + cents('p.cost') + ' * s.priced', cents('s.sales'))} AS avg_margin_pct,
  {half_up(cents('s.sales'), '100 * s.priced')} AS aov,
  {half_up('t.age', 't.stock_qt')} AS avg_aging_days, coalesce(t.stock_qt, 0) AS stock_qt
FROM products_raw p LEFT JOIN sales s ON p.id = s.product_id LEFT JOIN stock t ON p.id = t.product_id"""

SQL["stock_aging_before_sale"] = f"""
WITH {STOCK_RAW}
SELECT product_distribution_center_id, product_category, count(*) AS units_sold,
  {half_up("sum(date_diff('day', created_at::DATE, sold_at::DATE))", 'count(*)')} AS avg_days_to_sale
FROM stock_raw WHERE sold_at IS NOT NULL GROUP BY 1, 2"""

SQL["shipping_time"] = f"""
WITH {ITEMS}, {PRODUCTS_RAW}
SELECT p.distribution_center_id, count(*) AS items_shipped,
  {half_up('sum(epoch_us(i.shipped_at) - epoch_us(i.created_at))', 'count(*) * 86400000000')} AS avg_shipping_days
FROM items i JOIN products_raw p ON i.product_id = p.id WHERE i.shipped_at IS NOT NULL GROUP BY 1"""

SQL["product_margin"] = f"""
WITH {ITEMS}, {PRODUCTS_RAW}
SELECT p.department, p.category, count(*) AS items, {dollars('sum(i.sale_price - p.cost)')} AS margin,
  {half_up(cents('sum(i.sale_price - p.cost)'), '100 * count(*)')} AS avg_margin
FROM items i JOIN products_raw p ON i.product_id = p.id WHERE i.status <> 'Cancelled' GROUP BY 1, 2"""

# --- web -----------------------------------------------------------------------------------------

SQL["sales_funnel"] = f"""
WITH {CLICKS}, f AS (
  SELECT year(created_at) AS year, session_id, bool_or(event_type = 'cart') AS cart,
    bool_or(event_type = 'purchase') AS bought, bool_or(extracted_product_id IS NOT NULL) AS viewed
  FROM clicks GROUP BY 1, 2)
SELECT year::INT AS year, count(*) AS total_sessions, {pct('count(*) FILTER (WHERE cart)', 'count(*)')} AS added_cart,
  {pct('count(*) FILTER (WHERE bought)', 'count(*)')} AS purchased,
  {pct('count(*) FILTER (WHERE cart AND NOT bought)', 'count(*) FILTER (WHERE cart)')} AS abandon_cart,
  {pct('count(*) FILTER (WHERE viewed AND NOT cart)', 'count(*) FILTER (WHERE viewed)')} AS drop_off
FROM f GROUP BY 1"""

SQL["time_to_purchase"] = f"""
WITH {CLICKS}, s AS (
  SELECT session_id, (epoch_us(max(created_at)) - epoch_us(min(created_at))) AS us,
    max((event_type = 'purchase')::INT) AS bought FROM clicks GROUP BY 1)
SELECT CASE WHEN us < 60000000 THEN '0-1 min' WHEN us < 300000000 THEN '1-5 min' WHEN us < 600000000 THEN '5-10 min'
    ELSE '10+ min' END AS session_duration_bucket, count(*) AS total_sessions, sum(bought)::BIGINT AS total_sales,
  {pct('sum(bought)', 'count(*)')} AS conversion_rate
FROM s GROUP BY 1"""

SQL["visitor_conversion"] = f"""
WITH {CLICKS}, v AS (
  SELECT visitor_type, coalesce(user_id::VARCHAR, session_id) AS visitor, bool_or(event_type = 'cart') AS cart,
    bool_or(event_type = 'purchase') AS bought FROM clicks GROUP BY 1, 2)
SELECT visitor_type, count(*) AS visitors, count(*) FILTER (WHERE bought) AS buyers,
  {pct('count(*) FILTER (WHERE bought)', 'count(*)')} AS conversion_rate,
  {pct('count(*) FILTER (WHERE cart AND NOT bought)', 'count(*) FILTER (WHERE cart)')} AS cart_abandonment
FROM v GROUP BY 1"""

SQL["event_traffic_source"] = f"""
WITH {CLICKS}, s AS (
  SELECT traffic_source, session_id, max((event_type = 'purchase')::INT) AS bought, count(*) AS n
  FROM clicks GROUP BY 1, 2)
SELECT traffic_source, count(*) AS sessions, sum(n)::BIGINT AS events, sum(bought)::BIGINT AS purchases,
  {pct('sum(bought)', 'count(*)')} AS conversion_rate FROM s GROUP BY 1"""

# --- cleaning of the faulty tables ---------------------------------------------------------------


def with_faults(source: str, name: str, table: str, columns: str) -> str:
    faults = FAULTS[table]
    picked = ", ".join(f"{faults[c]} AS {c}" if c in faults else c for c in columns.split())
    return f"{name} AS (SELECT {picked} FROM {source})"


USERS_BAD = USERS_RAW + "," + with_faults(
    "users_raw", "users_bad", "users",
    "id age gender state city country latitude longitude traffic_source created_at",
)
USERS_FIXED = (
    USERS_BAD
    + """,
users_filled AS (
  SELECT id, coalesce(abs(age), 0) AS age, coalesce(gender, 'Others') AS gender, coalesce(state, 'Unknown') AS state,
    coalesce(city, 'Unknown') AS city, coalesce(country, 'Unknown') AS country,
    CASE WHEN latitude IS NULL THEN 0.0 WHEN latitude > 90 THEN 90.0 WHEN latitude < -90 THEN -90.0
      ELSE latitude END::DOUBLE AS latitude,
    CASE WHEN longitude IS NULL THEN 0.0 WHEN longitude > 180 THEN 180.0 WHEN longitude < -180 THEN -180.0
      ELSE longitude END::DOUBLE AS longitude,
    coalesce(traffic_source, 'Unknown') AS traffic_source, created_at FROM users_bad),
users AS (SELECT *, 'User profile: ' || gender || ', ' || age || ' years old, located_in ' || city || ', ' || state
    || ', ' || country || '. Acquired via ' || traffic_source || '.' AS context_summary FROM users_filled)"""
)

CENTERS_FIXED = CENTERS_RAW + "," + with_faults(
    "centers_raw", "centers_bad", "distribution_centers", "id name latitude longitude"
) + """,
centers AS (SELECT id, name,
    CASE WHEN latitude > 90 THEN 90.0 WHEN latitude < -90 THEN -90.0 ELSE latitude END::DOUBLE AS latitude,
    CASE WHEN longitude > 180 THEN 180.0 WHEN longitude < -180 THEN -180.0 ELSE longitude END::DOUBLE AS longitude
  FROM centers_bad)"""  # fmt: skip

PRODUCTS_FIXED = PRODUCTS_RAW + "," + with_faults(
    "products_raw", "products_bad", "products",
    "id cost category name brand retail_price department sku distribution_center_id",
) + """,
products AS (SELECT id, abs(cost) AS cost, coalesce(category, 'Unknown') AS category, coalesce(name, 'Unknown') AS name,
    coalesce(brand, 'Unknown') AS brand, abs(retail_price) AS retail_price,
    coalesce(department, 'Unknown') AS department, coalesce(sku, 'Unknown') AS sku, distribution_center_id
  FROM products_bad)"""  # fmt: skip

STOCK_FIXED = STOCK_RAW + "," + with_faults(
    "stock_raw", "stock_bad", "inventory_items",
    "id product_id created_at sold_at cost product_category product_name product_brand product_retail_price "
    "product_department product_sku product_distribution_center_id",
) + """,
stock AS (SELECT id, product_id, created_at, sold_at, abs(cost) AS cost,
    coalesce(product_category, 'Unknown') AS product_category, coalesce(product_name, 'Unknown') AS product_name,
    coalesce(product_brand, 'Unknown') AS product_brand, product_retail_price,
    coalesce(product_department, 'Unknown') AS product_department, coalesce(product_sku, 'Unknown') AS product_sku,
    product_distribution_center_id FROM stock_bad)"""  # fmt: skip

ORDERS_BAD = ORDERS_RAW + "," + with_faults(
    "orders_raw", "orders_bad", "orders",
    "order_id user_id status created_at returned_at shipped_at delivered_at num_of_item",
)
ORDERS_FIXED = ORDERS_BAD + "," + repaired("orders_bad", "orders_fixed", "order_id, user_id, status, num_of_item")

ITEMS_BAD = ITEMS_RAW + "," + with_faults(
    "items_raw", "items_bad", "order_items",
    "id order_id user_id product_id inventory_item_id status created_at shipped_at delivered_at returned_at sale_price",
)
ITEMS_FIXED = (
    ITEMS_BAD
    + ","
    + repaired("items_bad", "items_r", ITEM_OTHERS)
    + ", items_fixed AS (SELECT * REPLACE (coalesce(status, 'Processing') AS status) FROM items_r)"
)

EVENTS_FIXED = EVENTS_RAW + "," + with_faults(
    "clicks_raw", "clicks_bad", "events",
    "id user_id sequence_number session_id created_at ip_address city state postal_code browser traffic_source uri "
    "event_type",
) + """,
events_fixed AS (SELECT id, user_id, sequence_number, coalesce(session_id, 'Unknown') AS session_id, created_at,
    ip_address, coalesce(city, 'Unknown') AS city, coalesce(state, 'Unknown') AS state, postal_code,
    coalesce(browser, 'Unknown') AS browser, coalesce(traffic_source, 'Unknown') AS traffic_source, uri,
    coalesce(event_type, 'Unknown') AS event_type,
    CASE WHEN user_id IS NULL THEN 'Guest' ELSE 'Registered' END AS visitor_type,
    CASE WHEN uri LIKE '/product/%' THEN substr(uri, 10)::BIGINT END AS extracted_product_id,
    CASE WHEN uri IS NULL OR uri = '/' THEN 'Unknown' ELSE split_part(uri, '/', 2) END AS extracted_page_type
  FROM clicks_bad)"""  # fmt: skip

FIXED = {
    "users": (USERS_FIXED, "users"),
    "distribution_centers": (CENTERS_FIXED, "centers"),
    "products": (PRODUCTS_FIXED, "products"),
    "inventory_items": (STOCK_FIXED, "stock"),
    "orders": (ORDERS_FIXED, "orders_fixed"),
    "order_items": (ITEMS_FIXED, "items_fixed"),
    "events": (EVENTS_FIXED, "events_fixed"),
}

# --- orders of results ---------------------------------------------------------------------------

for _name, _of, _shown, _order in (
    ("daily_sales_order", "daily_sales", "day, country", "day DESC NULLS FIRST, country NULLS FIRST"),
    ("cohort_order", "cohort_retention", "country, cohort_month, month_number", "country NULLS FIRST, cohort_month, month_number"),
    ("customer_value_order", "customer_rfm_ltv", "user_id, ltv_value", "ltv_value DESC NULLS FIRST"),
    ("stock_age_order", "product_360", "product_id, avg_aging_days", "avg_aging_days DESC NULLS FIRST"),
    ("traffic_source_order", "traffic_source_performance", "traffic_source, avg_ticket", "avg_ticket DESC NULLS FIRST"),
    ("session_length_order", "time_to_purchase", "session_duration_bucket",
     "list_position(['0-1 min', '1-5 min', '5-10 min', '10+ min'], session_duration_bucket)"),
):
    SQL[_name] = f"SELECT {_shown}, rank() OVER (ORDER BY {_order}) AS place FROM ({SQL[_of]}) AS result"

SQL["clean_users"] = f"""WITH {USERS_FIXED}
SELECT *, longitude AS user_geom_lon, latitude AS user_geom_lat FROM users"""
SQL["clean_distribution_centers"] = f"""WITH {CENTERS_FIXED}
SELECT *, longitude AS distribution_center_geom_lon, latitude AS distribution_center_geom_lat FROM centers"""
SQL["clean_products"] = f"""WITH {PRODUCTS_FIXED}
SELECT * REPLACE (cost::DOUBLE AS cost, retail_price::DOUBLE AS retail_price) FROM products"""
SQL["clean_inventory_items"] = f"""WITH {STOCK_FIXED}
SELECT * REPLACE (cost::DOUBLE AS cost, product_retail_price::DOUBLE AS product_retail_price) FROM stock"""
SQL["clean_orders"] = f"WITH {ORDERS_FIXED} SELECT * FROM orders_fixed"
SQL["clean_order_items"] = f"""WITH {ITEMS_FIXED}
SELECT * REPLACE (sale_price::DOUBLE AS sale_price) FROM items_fixed"""
SQL["clean_events"] = f"WITH {EVENTS_FIXED} SELECT * FROM events_fixed"

SQL["lifecycle_repair"] = f"""WITH {ITEMS}
SELECT id, created_at, shipped_at, delivered_at, returned_at FROM items"""

# --- contracts -----------------------------------------------------------------------------------

LAT_LON = {
    "lat_out_range": "latitude < -90 OR latitude > 90",
    "lon_out_range": "longitude < -180 OR longitude > 180",
}
DATES = {
    "ship_early_err": "shipped_at < created_at",
    "delivered_early_err": "delivered_at < shipped_at",
    "returned_early_err": "returned_at < delivered_at",
}
BAD_STATUS = "status NOT IN ('Processing', 'Shipped', 'Complete', 'Returned', 'Cancelled')"

# rule -> condition of a bad row
ROW_RULES = {
    "users": {
        "id_missing": "id IS NULL", "created_missing": "created_at IS NULL", "age_invalid": "age < 0",
        "gender_invalid": "gender NOT IN ('M', 'F', 'Others')", **LAT_LON,
    },
    "distribution_centers": {"id_missing": "id IS NULL", "name_missing": "name IS NULL", **LAT_LON},
    "products": {
        "id_missing": "id IS NULL", "cost_missing": "cost IS NULL", "cost_negative": "cost <= 0",
        "price_missing": "retail_price IS NULL", "price_negative": "retail_price < 0", "sku_missing": "sku IS NULL",
    },
    "inventory_items": {
        "id_missing": "id IS NULL", "prod_id_missing": "product_id IS NULL",
        "dist_center_missing": "product_distribution_center_id IS NULL", "created_missing": "created_at IS NULL",
        "sold_data_invalid": "sold_at < created_at", "cost_missing": "cost IS NULL", "cost_negative": "cost < 0",
        "price_missing": "product_retail_price IS NULL", "price_negative": "product_retail_price < 0",
        "category_missing": "product_category IS NULL", "name_missing": "product_name IS NULL",
        "brand_missing": "product_brand IS NULL", "dept_missing": "product_department IS NULL",
        "sku_missing": "product_sku IS NULL",
    },
    "orders": {
        "id_missing": "order_id IS NULL", "user_id_missing": "user_id IS NULL", "status_missing": "status IS NULL",
        "status_invalid": BAD_STATUS, "items_missing": "num_of_item IS NULL", "items_invalid": "num_of_item <= 0",
        "created_missing": "created_at IS NULL", **DATES,
    },
    "order_items": {
        "id_missing": "id IS NULL", "order_id_missing": "order_id IS NULL", "user_id_missing": "user_id IS NULL",
        "prod_id_missing": "product_id IS NULL", "inv_id_missing": "inventory_item_id IS NULL",
        "status_invalid": BAD_STATUS, "price_negative": "sale_price < 0", "created_missing": "created_at IS NULL",
        **DATES,
    },
    "events": {
        "id_missing": "id IS NULL", "session_missing": "session_id IS NULL", "created_missing": "created_at IS NULL",
        "event_type_invalid": "event_type NOT IN ('product', 'department', 'cart', 'purchase', 'cancel', 'home')",
        "seq_invalid": "sequence_number < 1",
    },
}
UNIQUE_RULES = {
    "users": {"id_duplicated": "id"},
    "distribution_centers": {"id_duplicated": "id", "name_duplicates": "lower(name)"},
    "products": {"id_duplicated": "id", "sku_duplicated": "sku"},
    "inventory_items": {"id_duplicated": "id"},
    "orders": {"id_duplicated": "order_id"},
    "order_items": {"id_duplicated": "id"},
    "events": {"pk_duplicated": "id::VARCHAR || '_' || created_at::VARCHAR"},
}
STRICT_RULES = {
    "users": {"age_not_positive": "age <= 0", "gender_unlisted": "gender NOT IN ('M', 'F')"},
    "products": {
        f"{c}_required": f"{c} IS NULL" for c in ("category", "name", "brand", "department", "distribution_center_id")
    },
    "events": {
        f"{c}_required": f"{c} IS NULL"
        for c in ("browser", "traffic_source", "visitor_type", "extracted_page_type")
    },
}


def violation_rows(table: str, strict: bool = False) -> str:
    ctes, source = FIXED[table]
    rules = {**ROW_RULES[table], **(STRICT_RULES.get(table, {}) if strict else {})}
    counts = {name: f"count(*) FILTER (WHERE {bad})" for name, bad in rules.items()}
    counts |= {name: f"count(*) - count(DISTINCT {key})" for name, key in UNIQUE_RULES[table].items()}
    label = f"'{table}' AS table_name, " if strict else ""
    parts = [f"SELECT {label}'{name}' AS rule, {count} AS violations FROM {source}" for name, count in counts.items()]
    return f"(WITH {ctes} {' UNION ALL '.join(parts)})"


for _table in FIXED:
    SQL[f"validate_{_table}"] = f"SELECT * FROM {violation_rows(_table)}"
SQL["strict_checks"] = " UNION ALL ".join(f"SELECT * FROM {violation_rows(t, strict=True)}" for t in FIXED)

# --- references ----------------------------------------------------------------------------------

REFERENCE_TABLES = f"{ITEMS_BAD}, {PRODUCTS_RAW}, {CENTERS_RAW}, {USERS_RAW}, kept_products AS (SELECT * FROM products_raw WHERE distribution_center_id IN (SELECT id FROM centers_raw))"


def orphan_rows(label: str, column: str, source: str, target: str, target_column: str) -> str:
    return f"""SELECT '{label}' AS foreign_key, {column} AS missing_id, count(*) AS orphan_rows FROM {source} s
WHERE NOT EXISTS (SELECT 1 FROM {target} t WHERE t.{target_column} = s.{column}) GROUP BY 2"""


SQL["orphan_report"] = f"WITH {REFERENCE_TABLES} " + " UNION ALL ".join(
    [
        orphan_rows("products.distribution_center_id", "distribution_center_id", "products_raw", "centers_raw", "id"),
        orphan_rows("order_items.order_id", "order_id", "items_bad", "heads", "order_id"),
        orphan_rows("order_items.user_id", "user_id", "items_bad", "users_raw", "id"),
        orphan_rows("order_items.product_id", "product_id", "items_bad", "kept_products", "id"),
    ]
)
SQL["fk_filter"] = f"""WITH {PRODUCTS_RAW}, {CENTERS_RAW}
SELECT id, name, distribution_center_id FROM products_raw
WHERE distribution_center_id IN (SELECT id FROM centers_raw)"""
KEEP_ITEM = """order_id IN (SELECT order_id FROM heads) AND user_id IN (SELECT id FROM users_raw)
  AND product_id IN (SELECT id FROM kept_products) AND inventory_item_id IN (SELECT id FROM items_raw)"""
SQL["fk_chain"] = f"""WITH {REFERENCE_TABLES}
SELECT id, order_id, user_id, product_id, inventory_item_id FROM items_bad WHERE {KEEP_ITEM}"""
SQL["fk_drops"] = f"""WITH {REFERENCE_TABLES}
SELECT CASE WHEN order_id IS NULL OR order_id NOT IN (SELECT order_id FROM heads) THEN 'order_id'
    WHEN user_id IS NULL OR user_id NOT IN (SELECT id FROM users_raw) THEN 'user_id'
    WHEN product_id NOT IN (SELECT id FROM kept_products) THEN 'product_id'
    WHEN inventory_item_id NOT IN (SELECT id FROM items_raw) THEN 'inventory_item_id' ELSE 'kept' END AS dropped_by,
  count(*) AS rows FROM items_bad GROUP BY 1"""

# --- increments and merge ------------------------------------------------------------------------

SQL["watermark_load"] = f"""WITH {STOCK_RAW}
SELECT id, product_id, created_at FROM stock_raw WHERE created_at >
  (SELECT max(created_at) FROM stock_raw WHERE created_at < TIMESTAMP '2000-03-15')"""
SQL["lookback_load"] = f"""WITH {HEADS}
SELECT order_id, user_id, status, created_at FROM heads WHERE created_at >= TIMESTAMP '2001-07-01' - INTERVAL 180 DAY"""

MERGE_INPUT = f"""{PRODUCTS_RAW},
batch AS (
  SELECT CASE WHEN id % 5 = 0 THEN -id - 1 ELSE id END AS id,
    cost, category, CASE WHEN id % 3 = 0 THEN NULL ELSE name END AS name, 'new ' || brand AS brand,
    CASE WHEN id % 7 = 0 THEN retail_price + 1 ELSE retail_price END AS retail_price, department, sku,
    distribution_center_id FROM products_raw WHERE id % 2 = 0),
m AS (
  SELECT t.id AS t_id, s.id AS s_id, coalesce(t.id, s.id) AS id,
    CASE WHEN s.id IS NULL THEN 'keep' WHEN t.id IS NULL THEN 'insert'
      WHEN t.name IS DISTINCT FROM s.name OR t.retail_price IS DISTINCT FROM s.retail_price THEN 'update'
      ELSE 'unchanged' END AS action,
    CASE WHEN s.id IS NULL THEN t.name ELSE s.name END AS name,
    CASE WHEN s.id IS NULL THEN t.retail_price ELSE s.retail_price END AS retail_price,
    CASE WHEN t.id IS NULL THEN s.brand ELSE t.brand END AS brand,
    CASE WHEN t.id IS NULL THEN s.sku ELSE t.sku END AS sku
  FROM products_raw t FULL OUTER JOIN batch s ON t.id = s.id)"""
SQL["upsert_merge"] = f"""WITH {MERGE_INPUT}
SELECT id, name, retail_price::DOUBLE AS retail_price, brand, sku, action FROM m"""
SQL["upsert_actions"] = f"WITH {MERGE_INPUT} SELECT action, count(*) AS rows FROM m GROUP BY 1"
SQL["upsert_insert_only"] = f"""WITH {MERGE_INPUT}
SELECT id, brand, CASE WHEN t_id IS NULL THEN 'insert' ELSE 'keep' END AS action FROM m"""

SQL["ntile_distributed"] = """
SELECT o_orderkey, ntile(7) OVER (ORDER BY (o_totalprice::DECIMAL(18,2) * 100)::BIGINT, o_orderkey)::INT AS price_tile,
  ntile(7) OVER (ORDER BY date_diff('day', DATE '1990-01-01', o_orderdate::DATE), o_orderkey)::INT AS age_tile
FROM orders"""

SQL["sessionize"] = f"WITH {EVENTS_RAW} SELECT id, session_id, sequence_number FROM clicks_raw"

LOAD_COUNTS = f"""{STOCK_RAW}, {repaired('items_raw', 'items', ITEM_OTHERS)}, {CENTERS_RAW}, {USERS_RAW},
kept_products AS (SELECT * FROM products_raw WHERE distribution_center_id IN (SELECT id FROM centers_raw)),
kept_stock AS (SELECT * FROM stock_raw WHERE product_distribution_center_id IN (SELECT id FROM centers_raw)),
counts AS (
  SELECT 'distribution_centers' AS table_name, count(*) AS rows_in, count(*) AS rows_out FROM centers_raw
  UNION ALL SELECT 'users', count(*), count(*) FROM users_raw
  UNION ALL SELECT 'products', count(*), (SELECT count(*) FROM kept_products) FROM products_raw
  UNION ALL SELECT 'inventory_items', count(*), (SELECT count(*) FROM kept_stock) FROM stock_raw
  UNION ALL SELECT 'orders', count(*), count(*) FROM heads
  UNION ALL SELECT 'order_items', count(*), count(*) FILTER (WHERE product_id IN (SELECT id FROM kept_products)
    AND inventory_item_id IN (SELECT id FROM kept_stock)) FROM items
  UNION ALL SELECT 'events', count(*), count(*) FROM events)"""
SQL["run_log"] = f"""WITH {LOAD_COUNTS}
SELECT *, rows_in - rows_out AS rows_dropped, rows_out AS inserted, 0 AS updated, 0 AS unchanged FROM counts"""
# Stock is loaded past its high watermark only.
SQL["load_twice"] = f"""WITH {LOAD_COUNTS}
SELECT table_name, rows_in * looked AS rows_in, rows_out * looked AS rows_out, 0 AS inserted, 0 AS updated, rows_out * looked AS unchanged
FROM (SELECT *, (table_name <> 'inventory_items')::INT AS looked FROM counts)"""

DELIVERED_SINCE = "2001-01-01"


def delivery(name: str, source: str, key: str, number: str, value: str) -> str:
    """CTEs of a later delivery ``{name}_d`` matched with the table, ``{name}_j``: its rows with what they were."""
    return f"""
{name}_t AS (SELECT *, {key} AS k, {value} AS v FROM {source}),
{name}_d AS (
  SELECT CASE WHEN ({number}) % 5 = 0 THEN -k - 1 ELSE k END AS k, CASE WHEN ({number}) % 11 = 0 THEN v + 1 ELSE v END AS v,
    CASE WHEN ({number}) % 7 = 0 THEN created_at + INTERVAL 31 DAY ELSE created_at END AS created_at, k AS from_k
  FROM {name}_t WHERE created_at >= TIMESTAMP '{DELIVERED_SINCE}' AND ({number}) % 3 = 0),
{name}_j AS (
  SELECT d.*, t.created_at AS was, t.k IS NULL AS fresh,
    t.k IS NOT NULL AND (t.created_at IS DISTINCT FROM d.created_at OR t.v IS DISTINCT FROM d.v) AS changed
  FROM {name}_d d LEFT JOIN {name}_t t ON t.k = d.k)"""


def month_counts(name: str, label: str) -> str:
    month = "date_trunc('month', {})"
    return f"""
SELECT '{label}' AS table_name, run::INT AS run, CASE run WHEN 1 THEN inserted ELSE 0 END AS inserted,
  CASE run WHEN 1 THEN updated ELSE 0 END AS updated, CASE run WHEN 1 THEN n - inserted - updated ELSE n END AS unchanged,
  CASE run WHEN 1 THEN moved ELSE 0 END AS moved, CASE run WHEN 1 THEN months ELSE 0 END AS months,
  CASE run WHEN 1 THEN rows_written ELSE 0 END AS rows_written, months_stored
FROM (SELECT unnest([1, 2]) AS run), (
  SELECT count(*) FILTER (WHERE fresh) AS inserted, count(*) FILTER (WHERE changed) AS updated, count(*) AS n,
    count(*) FILTER (WHERE changed AND {month.format('was')} <> {month.format('created_at')}) AS moved FROM {name}_j), (
  SELECT count(*) AS months FROM {name}_m), (
  SELECT count(*) FILTER (WHERE month IN (SELECT month FROM {name}_m)) AS rows_written, count(DISTINCT month) AS months_stored FROM {name}_f)"""


def month_ctes(name: str) -> str:
    """``{name}_m``: months that change; ``{name}_f``: months of all rows afterwards."""
    return f"""
{name}_m AS (SELECT date_trunc('month', created_at) AS month FROM {name}_j WHERE fresh OR changed
  UNION SELECT date_trunc('month', was) FROM {name}_j WHERE changed),
{name}_f AS (SELECT date_trunc('month', created_at) AS month FROM {name}_t WHERE k NOT IN (SELECT k FROM {name}_j WHERE changed)
  UNION ALL SELECT date_trunc('month', created_at) FROM {name}_j WHERE fresh OR changed)"""


_MONTHLY = {
    "o": ("orders", "orders_r", "order_id", "order_id", "num_of_item"),
    "i": ("order_items", "items", "id", "id // 1000", "sale_price"),
    "s": ("inventory_items", "stock_raw", "id", "id // 1000", "cost"),
}
_MONTHLY_CTES = ",".join(delivery(n, *given[1:]) + "," + month_ctes(n) for n, given in _MONTHLY.items())
_ORDERS_ROLLED = ORDERS_RAW[len(ITEMS_RAW) :]
SQL["month_merges"] = (
    f"WITH {STOCK_RAW}{_ORDERS_ROLLED}, {repaired('items_raw', 'items', ITEM_OTHERS)}, orders_r AS (SELECT * FROM orders_raw), {_MONTHLY_CTES} "
    + " UNION ALL ".join(month_counts(n, given[0]) for n, given in _MONTHLY.items())
)
SQL["merged_items"] = f"""WITH {ITEMS}, {delivery("i", "items", "id", "id // 1000", "sale_price")}
SELECT t.k AS id, t.order_id, t.created_at, t.status, t.v::DOUBLE AS sale_price FROM i_t t WHERE k NOT IN (SELECT k FROM i_j WHERE changed)
UNION ALL SELECT j.k, t.order_id, j.created_at, t.status, j.v::DOUBLE FROM i_j j JOIN i_t t ON t.k = j.from_k WHERE fresh OR changed"""

LOOKED_UP = 777
SQL["order_lookup"] = f"""WITH {ITEMS}
SELECT id, order_id, product_id, status, sale_price::DOUBLE AS sale_price FROM items WHERE order_id = {LOOKED_UP}"""

CANCELLED_SINCE = "2001-04-01"
SQL["daily_by_changes"] = f"""WITH merged AS ({SQL["merged_items"]}),
final AS (SELECT *, CASE WHEN created_at >= TIMESTAMP '{CANCELLED_SINCE}' AND (abs(id) // 1000) % 4 = 0 THEN 'Cancelled' ELSE status END AS state
  FROM merged)
SELECT created_at::DATE AS day, coalesce(sum(sale_price::DECIMAL(12,2)) FILTER (WHERE state <> 'Cancelled'), 0)::DOUBLE AS gmv,
  coalesce(sum(sale_price::DECIMAL(12,2)) FILTER (WHERE state NOT IN ('Cancelled', 'Returned')), 0)::DOUBLE AS net_revenue, count(*) AS items
FROM final GROUP BY 1"""

# --- maps ----------------------------------------------------------------------------------------


def geodesic(source: str, name: str, lat1: str, lon1: str, lat2: str, lon2: str, rounds: int = 8) -> str:
    """CTEs that add the Vincenty distance in metres (column ``m``) to the rows of ``source``.

    Where the rounds do not settle (nearly opposite points) it is Lambert's closed form.
    """
    f, a = "(1 / 298.257223563::DOUBLE)", "6378137.0::DOUBLE"
    ctes = [
        f"""g0 AS (SELECT *, radians(({lon2}) - ({lon1})) AS gl, radians(({lon2}) - ({lon1})) AS gspan,
    atan((1 - {f}) * tan(radians({lat1}))) AS gu1, atan((1 - {f}) * tan(radians({lat2}))) AS gu2 FROM {source})""",
        """g1 AS (SELECT * REPLACE (gl - 2 * pi() * round_even(gl / (2 * pi()), 0) AS gl,
    gspan - 2 * pi() * round_even(gspan / (2 * pi()), 0) AS gspan) FROM g0)""",
    ]
    last = "g1"
    for i in range(rounds):
        extra = " EXCLUDE (gss, gcs, gs, gsa, gm)" if i else ""
        ctes += [
            f"""h{i} AS (SELECT *{extra}, sqrt(pow(cos(gu2) * sin(gl), 2)
    + pow(cos(gu1) * sin(gu2) - sin(gu1) * cos(gu2) * cos(gl), 2)) AS gss,
    sin(gu1) * sin(gu2) + cos(gu1) * cos(gu2) * cos(gl) AS gcs FROM {last})""",
            f"""i{i} AS (SELECT *, atan2(gss, gcs) AS gs,
    CASE WHEN gss = 0 THEN 0 ELSE cos(gu1) * cos(gu2) * sin(gl) / gss END AS gsa FROM h{i})""",
            f"""j{i} AS (SELECT *, CASE WHEN 1 - gsa * gsa < 1e-15 THEN 0
    ELSE gcs - 2 * sin(gu1) * sin(gu2) / (1 - gsa * gsa) END AS gm,
    {f} / 16 * (1 - gsa * gsa) * (4 + {f} * (4 - 3 * (1 - gsa * gsa))) AS gc FROM i{i})""",
            f"""k{i} AS (SELECT * EXCLUDE (gc) REPLACE (gspan + (1 - gc) * {f} * gsa
    * (gs + gc * gss * (gm + gc * gcs * (2 * gm * gm - 1))) AS gl){", gl AS gbefore" if i == rounds - 1 else ""} FROM j{i})""",
        ]
        last = f"k{i}"
    b = f"({a} * (1 - {f}))"
    ctes += [
        f"g2 AS (SELECT *, (1 - gsa * gsa) * ({a} * {a} - {b} * {b}) / ({b} * {b}) AS gk FROM {last})",
        """g3 AS (SELECT *, 1 + gk / 16384 * (4096 + gk * (-768 + gk * (320 - 175 * gk))) AS ga,
    gk / 1024 * (256 + gk * (-128 + gk * (74 - 47 * gk))) AS gb FROM g2)""",
        f"""g4 AS (SELECT *, 2 * asin(sqrt(least(1.0, pow(sin((gu2 - gu1) / 2), 2)
    + cos(gu1) * cos(gu2) * pow(sin(gspan / 2), 2)))) AS gfar FROM g3)""",
        f"""{name} AS (SELECT *, CASE WHEN NOT abs(gl - gbefore) < 1e-9 THEN {a} * (gfar - {f} / 2 * (
      (gfar - sin(gfar)) * pow(sin((gu1 + gu2) / 2), 2) * pow(cos((gu2 - gu1) / 2), 2) / pow(cos(gfar / 2), 2)
      + (gfar + sin(gfar)) * pow(cos((gu1 + gu2) / 2), 2) * pow(sin((gu2 - gu1) / 2), 2) / pow(sin(gfar / 2), 2)))
    ELSE {b} * ga * (gs - gb * gss * (gm + gb / 4 * (gcs * (2 * gm * gm - 1)
    - gb / 6 * gm * (4 * gss * gss - 3) * (4 * gm * gm - 3)))) END AS m FROM g4)""",
    ]
    return ",\n".join(ctes)


SQL["user_logistics"] = f"""WITH {HEADS}, {PRODUCTS_RAW}, {CENTERS_RAW}, {USERS_RAW}, pairs AS (
  SELECT u.id AS user_id, d.id AS dc_id, u.longitude AS user_geom_lon, u.latitude AS user_geom_lat,
    d.longitude AS distribution_center_geom_lon, d.latitude AS distribution_center_geom_lat
  FROM lineitem l JOIN heads h ON l.l_orderkey = h.order_id JOIN users_raw u ON h.user_id = u.id
    JOIN products_raw p ON l.l_partkey = p.id JOIN centers_raw d ON p.distribution_center_id = d.id),
{geodesic("pairs", "measured", "user_geom_lat", "user_geom_lon", "distribution_center_geom_lat",
          "distribution_center_geom_lon")}
SELECT user_id, dc_id, user_geom_lon, user_geom_lat, distribution_center_geom_lon, distribution_center_geom_lat,
  round(m / 1000, 3) AS distance_km FROM measured"""

for _name, _size in (("hotspots", "5.0"), ("hotspots_fine", "0.05")):
    SQL[_name] = f"""WITH {USERS_RAW}, cells AS (
  SELECT age, round_even(longitude / {_size}::DOUBLE, 0)::BIGINT AS cell_x,
    round_even(latitude / {_size}::DOUBLE, 0)::BIGINT AS cell_y FROM users_raw)
SELECT cell_x, cell_y, count(*) AS density, round_even(avg(age), 0)::INT AS avg_user_age,
  cell_x * {_size}::DOUBLE AS grid_geom_lon, cell_y * {_size}::DOUBLE AS grid_geom_lat FROM cells GROUP BY ALL"""

USER_CENTER_PAIRS = f"""{CENTERS_RAW}, {USERS_RAW}, pairs AS (
  SELECT u.id AS user_id, d.id AS center_id, u.latitude AS ulat, u.longitude AS ulon, d.latitude AS dlat,
    d.longitude AS dlon FROM users_raw u, centers_raw d),
{geodesic("pairs", "measured", "ulat", "ulon", "dlat", "dlon")}"""
SQL["within_radius"] = f"""WITH {USER_CENTER_PAIRS}
SELECT user_id, center_id, round(m / 1000, 3) AS distance_km FROM measured WHERE m <= 2500000"""

# Across the date line.
CIRCLE = (-12.5, 176.0, 3_000_000.0)
SQL["users_in_circle"] = f"""WITH {USERS_RAW},
{geodesic("users_raw", "placed", "latitude", "longitude", f"{CIRCLE[0]}::DOUBLE", f"{CIRCLE[1]}::DOUBLE")}
SELECT id, round(m / 1000, 3) AS distance_km FROM placed WHERE m <= {CIRCLE[2]}"""

SQL["nearest_dc"] = f"""WITH {USER_CENTER_PAIRS}
SELECT user_id, center_id, round(m / 1000, 3) AS distance_km FROM measured
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY m, center_id) = 1"""

# --- texts and vectors ---------------------------------------------------------------------------

SQL["product_documents"] = f"""WITH {PRODUCTS_RAW}
SELECT id AS source_id, concat_ws(' ', brand, name, category, department) AS chunk_text, brand, category, department,
  retail_price::DOUBLE AS retail_price FROM products_raw"""

PROFILE_TEXT = (
    "'User profile: ' || gender || ', ' || age || ' years old, located_in ' || city || ', ' || state || ', ' || country"
    " || '. Acquired via ' || traffic_source || '.'"
)
PROFILES = f"""{ITEMS_RAW}, {USERS_RAW}, spend AS (
  SELECT user_id, sum(sale_price)::DOUBLE / count(sale_price) AS avg_spend FROM items_raw GROUP BY 1),
profiles AS (
  SELECT u.id AS user_id, city, country, latitude, longitude, {PROFILE_TEXT} AS chunk_text,
    longitude AS user_geom_lon, latitude AS user_geom_lat, avg_spend
  FROM users_raw u LEFT JOIN spend s ON u.id = s.user_id)"""
SQL["user_profiles"] = f"""WITH {PROFILES} SELECT * REPLACE (round(avg_spend, 6) AS avg_spend) FROM profiles"""


def hashed_words(source: str, key: str, text: str) -> str:
    """CTEs giving the unit vector of a text as rows (key, cell, weight)."""
    return f"""
words AS (SELECT {key}, lower(unnest(regexp_extract_all({text}, '[A-Za-z0-9]+'))) AS word FROM {source}),
cells AS (SELECT {key}, (('0x' || substr(md5(word), 1, 8))::BIGINT % 384)::INT AS cell, count(*) AS n
  FROM words GROUP BY ALL),
weights AS (SELECT {key}, cell, (n / sqrt(sum(n * n) OVER (PARTITION BY {key})))::DOUBLE AS weight FROM cells)"""


SQL["embed"] = f"""WITH {hashed_words('documents', 'doc_id', 'text')}
SELECT doc_id, cell, round(weight::FLOAT::DOUBLE, 5) AS weight FROM weights"""

SQL["similar"] = """
WITH q AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 20 = 0),
p AS (
  SELECT q.query_id, e.vec_id AS id,
    round(1 - list_cosine_similarity(e.embedding::DOUBLE[], s.embedding::DOUBLE[]), 10) AS distance
  FROM q JOIN embeddings s ON s.vec_id = q.query_id JOIN embeddings e ON e.vec_id <> q.query_id)
SELECT query_id, id, round(distance, 6) AS distance,
  row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank
FROM p QUALIFY rank <= 10"""

QUESTION = "young female shopper from ASIA acquired via FURNITURE"
HYBRID_LAT, HYBRID_LON, HYBRID_METRES, HYBRID_SPEND, HYBRID_K = 10.0, 20.0, 6_000_000.0, 30_000.0, 20
SQL["hybrid_search"] = f"""WITH {PROFILES},
{geodesic("profiles", "placed", "latitude", "longitude", f"{HYBRID_LAT}::DOUBLE", f"{HYBRID_LON}::DOUBLE")},
near AS (
  SELECT user_id, chunk_text FROM placed WHERE avg_spend >= {HYBRID_SPEND} AND m <= {HYBRID_METRES}
  UNION ALL SELECT -1, '{QUESTION}'), {hashed_words('near', 'user_id', 'chunk_text')},
found AS (
  SELECT n.user_id, 1 - coalesce(sum(w.weight * q.weight), 0) AS d
  FROM near n LEFT JOIN weights w ON w.user_id = n.user_id
    LEFT JOIN weights q ON q.user_id = -1 AND q.cell = w.cell
  WHERE n.user_id <> -1 GROUP BY 1)
SELECT user_id, round(d, 5) AS distance, row_number() OVER (ORDER BY round(d, 6), user_id)::INT AS rank
FROM found QUALIFY rank <= {HYBRID_K}"""

NAME_QUERY = "Smal wigdet"
NAME_LIMIT = 0.3


def grams(text: str) -> str:
    return f"""list_distinct(flatten(list_transform(
    list_filter(string_split_regex(lower({text}), '[^a-z0-9]+'), lambda w: w <> ''),
    lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""


def alike(column: str, text: str = f"'{NAME_QUERY}'") -> str:
    a, b = grams(column), grams(text)
    shared = f"length(list_intersect({a}, {b}))"
    return f"({shared}::DOUBLE / (length({a}) + length({b}) - {shared}))"


SQL["name_search"] = f"""WITH {PRODUCTS_RAW}, s AS (
  SELECT id, name, brand, category, greatest({alike('name')}, {alike('brand')}, {alike('category')}) AS score,
    contains(lower(name), lower('{NAME_QUERY}')) OR contains(lower(brand), lower('{NAME_QUERY}'))
      OR contains(lower(category), lower('{NAME_QUERY}')) AS contains_text FROM products_raw)
SELECT id, name, brand, category, round(score, 6) AS score, contains_text FROM s
WHERE score >= {NAME_LIMIT} OR contains_text"""

SQL["indexed_names"] = f"""WITH {PRODUCTS_RAW}, texts AS (
  SELECT field, text, count(*) AS rows FROM (
    SELECT unnest(['name', 'brand', 'category']) AS field, unnest([name, brand, category]) AS text FROM products_raw)
  WHERE text IS NOT NULL GROUP BY ALL),
questions AS (SELECT DISTINCT name AS question FROM products_raw WHERE id % 20 = 0 AND name IS NOT NULL),
scored AS (SELECT question, field, text, rows, {alike('text', 'question')} AS score FROM questions, texts)
SELECT question, field, text, rows, round(score, 6) AS score FROM scored WHERE score >= {NAME_LIMIT}"""

SQL["ci_match"] = f"""WITH {USERS_RAW}
SELECT lower(city) AS city, count(*) AS rows FROM users_raw GROUP BY 1"""

# --- streams -------------------------------------------------------------------------------------

SQL["stream_daily_sales"] = f"""WITH {ITEMS_RAW}, {PRODUCTS_RAW}, {USERS_RAW}
SELECT i.created_at::DATE AS day, u.country,
  {dollars("coalesce(sum(i.sale_price) FILTER (WHERE i.status <> 'Cancelled'), 0)")} AS gmv,
  {dollars(f"coalesce(sum(i.sale_price) FILTER (WHERE i.{SOLD}), 0)")} AS net_revenue,
  {dollars(f"coalesce(sum(p.cost) FILTER (WHERE i.{SOLD}), 0)")} AS cost_sold, count(*) AS items
FROM items_raw i JOIN products_raw p ON i.product_id = p.id JOIN users_raw u ON i.user_id = u.id GROUP BY 1, 2"""

# A session is open while a click within the gap after the last of all clicks could join it.
SQL["stream_sessions"] = f"""WITH {EVENTS_RAW}, s AS (
  SELECT user_id, sn, min(ts) AS started_at, max(ts) AS last_at, count(*) AS clicks,
    max((event_type = 'click')::INT) AS has_cart, max((event_type = 'purchase')::INT) AS has_purchase,
    max((event_type = 'view')::INT) AS has_product_view FROM numbered_sessions WHERE user_id IS NOT NULL GROUP BY 1, 2)
SELECT user_id, started_at, last_at, clicks, has_cart, has_purchase, has_product_view,
  epoch_us((SELECT max(ts) FROM events)) - epoch_us(last_at) < 43200000000 AS is_open FROM s"""

SQL["stream_dedup"] = "SELECT event_id, ts, user_id, event_type FROM events"

SQL["stream_upsert"] = f"""WITH {MERGE_INPUT}
SELECT id, name, retail_price::DOUBLE AS retail_price, brand, sku FROM m"""

_PRODUCT_RULES = ROW_RULES["products"]
SQL["stream_quarantine"] = f"""WITH {PRODUCTS_FIXED}, {CENTERS_RAW}, marked AS (
  SELECT id, concat_ws(',', CASE WHEN distribution_center_id IN (SELECT id FROM centers_raw) THEN NULL
        ELSE 'missing distribution_center_id' END,
      {', '.join(f"CASE WHEN {_PRODUCT_RULES[n]} THEN '{n}' END" for n in (
      'id_missing', 'cost_missing', 'price_missing', 'sku_missing', 'cost_negative', 'price_negative'))}) AS failed_rules
  FROM products)
SELECT * FROM marked WHERE failed_rules <> ''"""

SQL["append_parts"] = f"WITH {USERS_RAW} SELECT id, country, traffic_source FROM users_raw"

CLICK_SPAN = ("2024-01-10 00:00:00", "2024-01-20 12:00:00")
SQL["month_range"] = f"""WITH {CLICKS}
SELECT id, user_id, created_at, event_type FROM clicks
WHERE created_at >= TIMESTAMP '{CLICK_SPAN[0]}' AND created_at < TIMESTAMP '{CLICK_SPAN[1]}'"""

# Deliveries of clicks: limits of the first and the second, and the clicks of the first days that come with the second.
DELIVERY_DAYS = ("2024-01-11", "2024-01-21")
TARDY_BEFORE, TARDY_EVERY = "2024-01-06", 50
TARDY = f"(ts < TIMESTAMP '{TARDY_BEFORE}' AND event_id % {TARDY_EVERY} = 0)"
# Two days after its last click a session is closed; its gap is 12 hours.
SQL["stream_closed_sessions"] = f"""WITH timely AS (SELECT * FROM events WHERE NOT {TARDY}),
{EVENTS_RAW.replace("FROM events WINDOW", "FROM timely WINDOW")}, s AS (
  SELECT user_id, sn, min(ts) AS started_at, max(ts) AS last_at, count(*) AS clicks,
    max((event_type = 'click')::INT) AS has_cart, max((event_type = 'purchase')::INT) AS has_purchase,
    max((event_type = 'view')::INT) AS has_product_view FROM numbered_sessions WHERE user_id IS NOT NULL GROUP BY 1, 2)
SELECT user_id, started_at, last_at, clicks, has_cart, has_purchase, has_product_view FROM s
WHERE last_at + INTERVAL 12 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 2 DAY"""
SQL["stream_late_clicks"] = f"SELECT event_id, user_id, ts FROM events WHERE user_id IS NOT NULL AND {TARDY}"

# The first delivery of items ends a day before that of heads.
ORDER_DAYS = ("1999-01-01", "1999-01-02")
SQL["stream_item_heads"] = f"""WITH {ITEMS_BAD}, given AS (
  SELECT id, order_id, created_at + to_hours((id % 5 + 1)::INT) AS placed_at, sale_price::DOUBLE AS sale_price FROM items_bad)
SELECT i.*, h.user_id, h.status AS head_status, CASE WHEN h.order_id IS NULL THEN 'missing order' END AS reason
FROM given i LEFT JOIN heads h ON h.order_id = i.order_id
WHERE h.order_id IS NOT NULL OR i.placed_at <= (SELECT max(created_at) FROM heads) - INTERVAL 12 HOUR"""

BRANDS, PRICE_SPAN = ("Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#31"), (900.0, 1500.0)
SQL["similar_products"] = f"""WITH {PRODUCTS_RAW}, docs AS (
  SELECT id, concat_ws(' ', brand, name, category, department) AS chunk_text FROM products_raw
  WHERE brand IN {BRANDS} AND retail_price::DOUBLE BETWEEN {PRICE_SPAN[0]} AND {PRICE_SPAN[1]}),
{hashed_words('docs', 'id', 'chunk_text')},
w AS (SELECT id, cell, weight::FLOAT::DOUBLE AS weight FROM weights),
norms AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY id),
q AS (SELECT w.id AS query_id, cell, weight, norm FROM w JOIN norms USING (id) WHERE id = (SELECT min(id) FROM docs)),
p AS (
  SELECT (SELECT min(id) FROM docs) AS query_id, d.id,
    round(1 - coalesce(sum(w.weight * q.weight) / (any_value(n.norm) * any_value(q.norm)), 0), 10) AS far
  FROM docs d LEFT JOIN w ON w.id = d.id LEFT JOIN q ON q.cell = w.cell LEFT JOIN norms n ON n.id = d.id
  WHERE d.id <> (SELECT min(id) FROM docs) GROUP BY d.id)
SELECT query_id, id, round(far, 5) AS distance, row_number() OVER (ORDER BY far, id)::INT AS rank FROM p QUALIFY rank <= 10"""

# The streams end in the same rows as the metrics over whole tables.
SQL["stream_daily_rates"] = SQL["daily_sales"]
SQL["stream_funnel"] = SQL["sales_funnel"]
