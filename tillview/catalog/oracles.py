"""Plain SQL for every query, written from the definitions of the reports."""

from __future__ import annotations

SALES = """
sales AS (
  SELECT o_orderdate AS order_ts, CAST(l_orderkey AS VARCHAR) AS doc_no,
    CAST(o_custkey AS VARCHAR) AS phone, c_name AS customer_name, c_mktsegment AS name_check,
    CASE WHEN c_acctbal < 0 THEN 'invalid' ELSE 'valid' END AS phone_status,
    CAST(l_extendedprice AS DECIMAL(18,4)) AS gross,
    CAST(CAST(l_extendedprice AS DECIMAL(12,2))
      * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(3,2))) AS DECIMAL(18,4)) AS net,
    l_returnflag AS doc_type, p_brand AS brand, r_name AS region, s_name AS store,
    p_type AS product_group, CAST(l_partkey AS VARCHAR) AS product_code,
    CAST(l_quantity AS DECIMAL(18,4)) AS quantity
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

#: The same lines with faults; the expressions see the values as they were.
DIRTY = SALES.replace("sales AS (", "plain AS (", 1) + """,
sales AS (SELECT * REPLACE (
    CASE WHEN CAST(phone AS BIGINT) % 11 = 0 THEN NULL ELSE phone END AS phone,
    CASE WHEN CAST(phone AS BIGINT) % 13 = 0 THEN NULL
      WHEN CAST(doc_no AS BIGINT) % 17 = 0 THEN ' ' || store ELSE store END AS store,
    CASE WHEN CAST(doc_no AS BIGINT) % 7 = 0 THEN NULL
      WHEN CAST(doc_no AS BIGINT) % 19 = 0 THEN region || ' ' ELSE region END AS region,
    CAST(CASE WHEN CAST(doc_no AS BIGINT) % 23 = 0 THEN 0
      WHEN CAST(doc_no AS BIGINT) % 5 = 0 THEN -gross ELSE gross END AS DECIMAL(18,4)) AS gross,
    CAST(CASE WHEN CAST(doc_no AS BIGINT) % 5 = 0 THEN -net ELSE net END AS DECIMAL(18,4)) AS net,
    CASE WHEN CAST(doc_no AS BIGINT) % 3 = 0 THEN NULL
      WHEN CAST(doc_no AS BIGINT) % 2 = 0 THEN customer_name || '*' ELSE customer_name END AS customer_name,
    CASE WHEN CAST(product_code AS BIGINT) % 29 = 0 THEN NULL ELSE product_code END AS product_code)
  FROM plain)"""

EVENTS = """
sales AS (
  SELECT ts AS order_ts, CAST(event_id AS VARCHAR) AS doc_no, CAST(user_id AS VARCHAR) AS phone,
    CAST(NULL AS VARCHAR) AS customer_name, event_type AS name_check,
    CAST(NULL AS VARCHAR) AS phone_status, CAST(value AS DECIMAL(18,4)) AS gross,
    CAST(value AS DECIMAL(18,4)) AS net, event_type AS store
  FROM events
)"""

SUMS = (
    "CAST(coalesce(sum(gross), 0) AS DOUBLE) AS gross, CAST(coalesce(sum(net), 0) AS DOUBLE) AS net, "
    "count(DISTINCT doc_no) AS orders, count(DISTINCT phone) AS customers"
)
FROM_RATIO = "CASE WHEN gross > 0 THEN (1 - net / gross) * 100 ELSE 0.0::DOUBLE END AS discount_pct"
FROM_DIFFERENCE = "CASE WHEN gross > 0 THEN (gross - net) / gross * 100 ELSE 0.0::DOUBLE END AS discount_pct"
ANY_SIGN = "CASE WHEN gross <> 0 THEN 100 * (1 - net / gross) ELSE 0.0::DOUBLE END AS discount_pct"


def week(start: int) -> str:
    """First day of the row's week; Monday is 0."""
    return f"CAST(order_ts AS DATE) - CAST((isodow(order_ts) - 1 - {start} + 7) % 7 AS INTEGER)"


def week_name(day: str) -> str:
    return f"'Tuần ' || lpad(CAST(weekofyear({day}) AS VARCHAR), 2, '0') || '/' || CAST(isoyear({day}) AS VARCHAR)"


STARTS = {
    "day": "CAST(order_ts AS DATE)",
    "week": week(0),
    "week_sun": week(6),
    "month": "CAST(date_trunc('month', order_ts) AS DATE)",
    "quarter": "CAST(date_trunc('quarter', order_ts) AS DATE)",
    "year": "CAST(date_trunc('year', order_ts) AS DATE)",
}
STEPS = {"day": "1 DAY", "month": "1 MONTH", "quarter": "3 MONTH", "year": "1 YEAR"}
LABELS = {
    "day": "strftime(start, '%Y-%m-%d')",
    "week": week_name("start"),
    "month": "strftime(start, '%Y-%m')",
    "quarter": "strftime(start, '%Y') || 'Q' || CAST(quarter(start) AS VARCHAR)",
    "year": "strftime(start, '%Y')",
}
PERIOD_LABELS = LABELS | {"quarter": "'Q' || CAST(quarter(start) AS VARCHAR) || ' ' || strftime(start, '%Y')"}
KEYS = {
    "day": "CAST(year(start) AS INTEGER) AS year, start AS key",
    "week": "CAST(isoyear(start) AS INTEGER) AS year, CAST(weekofyear(start) AS INTEGER) AS key",
    "month": "CAST(year(start) AS INTEGER) AS year, CAST(month(start) AS INTEGER) AS key",
    "quarter": "CAST(year(start) AS INTEGER) AS year, CAST(quarter(start) AS INTEGER) AS key",
}


def trend(cut: str, where: str = "true") -> str:
    grain = cut.split("_")[0]
    grouped = f"grouped AS (SELECT {STARTS[cut]} AS start, {SUMS} FROM sales WHERE {where} GROUP BY 1)"
    if grain == "week":
        filled = "filled AS (SELECT * FROM grouped)"
        end = "start"
    else:
        step = STEPS[grain]
        filled = f"""
spine AS (SELECT CAST(unnest(generate_series(
  (SELECT min(start) FROM grouped), (SELECT max(start) FROM grouped), INTERVAL {step})) AS DATE) AS start),
filled AS (SELECT spine.start, coalesce(gross, 0) AS gross, coalesce(net, 0) AS net,
  coalesce(orders, 0) AS orders, coalesce(customers, 0) AS customers
  FROM spine LEFT JOIN grouped ON spine.start = grouped.start)"""
        end = f"CAST(start + INTERVAL {step} - INTERVAL 1 DAY AS DATE)"
    return f"""WITH {SALES}, {grouped}, {filled},
lagged AS (SELECT *, lag(net) OVER (ORDER BY start) AS prev_net FROM filled)
SELECT {end} AS period, {LABELS[grain]} AS label, gross, net, orders, customers, {FROM_RATIO}, prev_net,
  CASE WHEN prev_net > 0 THEN (net - prev_net) / prev_net * 100 ELSE 0.0::DOUBLE END AS growth_pct
FROM lagged ORDER BY period"""


def region_trend(cut: str) -> str:
    return f"""WITH {SALES}, grouped AS (
  SELECT {STARTS[cut]} AS start, region, {SUMS} FROM sales GROUP BY 1, 2)
SELECT start AS period, {LABELS[cut]} AS label, region, gross, net, orders, customers, {FROM_DIFFERENCE}
FROM grouped ORDER BY period, net DESC, region"""


def compared(names: tuple[str, ...], partition: str = "") -> str:
    window = f"OVER ({partition} ORDER BY start)"
    return ", ".join(f"lag({n}) {window} AS prev_{n}" for n in names)


def changes(names: tuple[str, ...]) -> str:
    return ", ".join(
        f"prev_{n}, CASE WHEN prev_{n} <> 0 THEN ({n} - prev_{n}) / CAST(prev_{n} AS DOUBLE) * 100 END "
        f"AS {n}_change_pct"
        for n in names
    )


ALL_FOUR = ("gross", "net", "customers", "orders")


def revenue(cut: str) -> str:
    return f"""WITH {SALES}, grouped AS (SELECT {STARTS[cut]} AS start, {SUMS} FROM sales GROUP BY 1),
lagged AS (SELECT *, {compared(ALL_FOUR)} FROM grouped)
SELECT {PERIOD_LABELS[cut]} AS period, {KEYS[cut]}, gross, net, customers, orders, {ANY_SIGN},
  {changes(ALL_FOUR)}
FROM lagged ORDER BY start"""


def regions_of(cut: str, chosen: str) -> str:
    return f"""WITH {SALES}, grouped AS (
  SELECT region, {STARTS[cut]} AS start, {SUMS} FROM sales WHERE region IS NOT NULL GROUP BY 1, 2),
lagged AS (SELECT *, {compared(ALL_FOUR, "PARTITION BY region")} FROM grouped)
SELECT {PERIOD_LABELS[cut]} AS period, {KEYS[cut]}, region, gross, net, customers, orders, {ANY_SIGN},
  {changes(ALL_FOUR)}
FROM lagged WHERE {chosen} ORDER BY net DESC, region"""


def stores_of(cut: str, chosen: str, order: str) -> str:
    grain = cut.split("_")[0]
    return f"""WITH {SALES}, grouped AS (
  SELECT store, {STARTS[cut]} AS start, CAST(sum(gross) AS DOUBLE) AS gross, CAST(sum(net) AS DOUBLE) AS net
  FROM sales WHERE store IS NOT NULL GROUP BY 1, 2),
lagged AS (SELECT *, lag(net) OVER (PARTITION BY store ORDER BY start) AS prev FROM grouped),
keyed AS (SELECT *, {PERIOD_LABELS[grain]} AS period, {KEYS[grain]} FROM lagged)
SELECT period, year, key, store, gross, net, {ANY_SIGN}, prev,
  CASE WHEN prev <> 0 THEN (net - prev) / prev * 100 END AS change_pct
FROM keyed WHERE {chosen} ORDER BY net {order}, store LIMIT 10"""


def products(orders: str, where: str = "true") -> str:
    return f"""WITH {SALES}
SELECT product_code, CAST(sum(gross) AS DOUBLE) AS gross, CAST(sum(net) AS DOUBLE) AS net,
  {orders} AS orders, count(DISTINCT phone) AS customers
FROM sales WHERE {where} GROUP BY product_code ORDER BY net DESC, product_code"""


def clean(*columns: str) -> str:
    return " AND ".join(f"{c} IS NOT NULL AND {c} = trim({c})" for c in columns)


TOTALS_OF_ALL = f"SELECT *, {FROM_RATIO} FROM (SELECT {SUMS} FROM sales WHERE "
DIMENSIONS = ("doc_type", "brand", "region", "store")
ROWS = (
    "order_ts, doc_no, phone, customer_name, name_check, phone_status, gross, net, doc_type, brand, "
    "region, store, product_group, product_code, quantity"
)


def customers(
    source: str,
    keys: str,
    tags: str,
    vip: int = 3_000_000,
    inactive: int = 90,
    min_net: int = 0,
    where: str = "true",
) -> str:
    """The customer list as a chain of CTEs ending in ``listed``."""
    known = " AND ".join(f"{k.strip()} IS NOT NULL" for k in keys.split(","))

    def first(name: str) -> str:
        return (
            f"first({name} ORDER BY order_ts, doc_no, {name}) "
            f"FILTER (WHERE {name} IS NOT NULL) AS {name}"
        )

    return f"""WITH {source}, grouped AS (
  SELECT {keys}, {first("customer_name")}, {first("name_check")},
    coalesce(sum(gross), 0) AS gross, coalesce(sum(net), 0) AS net, count(DISTINCT doc_no) AS orders,
    min(order_ts) AS first_order, max(order_ts) AS last_order, {first("phone_status")}
  FROM sales WHERE {known} GROUP BY {keys}),
idle AS (SELECT *, CASE WHEN gross > 0 THEN round_even(
    (CAST(gross AS DOUBLE) - CAST(net AS DOUBLE)) / CAST(gross AS DOUBLE) * 100 * 100, 0) / 100
    ELSE 0.0::DOUBLE END AS discount_pct,
  CAST(floor((epoch_us((SELECT max(order_ts) FROM sales)) - epoch_us(last_order)) / 86400000000) AS INTEGER)
    AS days_inactive
  FROM grouped WHERE net >= {min_net}),
tagged AS (SELECT *, CASE WHEN days_inactive >= {inactive} THEN 'KH Inactive'
  WHEN net >= {vip} THEN 'KH VIP' ELSE 'Khách hàng' END AS tag FROM idle),
listed AS (SELECT *, CASE WHEN tag = 'KH Inactive' THEN days_inactive END AS days_without_order
  FROM tagged WHERE tag IN ({tags}) AND {where})"""


REGULAR = "'Khách hàng'"
EVERY_TAG = "'KH Inactive', 'KH VIP', 'Khách hàng'"
AS_DOUBLE = "* REPLACE (CAST(gross AS DOUBLE) AS gross, CAST(net AS DOUBLE) AS net)"
BOTH_CHECKS = clean("phone_status", "name_check")
MEAN_DISCOUNT = "CAST(sum(CAST(round_even(discount_pct * 100, 0) AS BIGINT)) AS DOUBLE) / count(*) / 100"


def pareto(percent: int, top: bool) -> str:
    n = f"greatest(1, CAST(floor(count(*) OVER (PARTITION BY store) * {percent} / 100.0) AS BIGINT))"
    kept = "rank <= n" if top else "rank > size - n"
    return f"""WITH {SALES}, base AS (
  SELECT store, phone, sum(gross) AS g, sum(net) AS t, count(DISTINCT doc_no) AS orders
  FROM sales WHERE store IS NOT NULL AND phone IS NOT NULL GROUP BY store, phone),
shares AS (SELECT *, CAST(g AS DOUBLE) AS gross, CAST(t AS DOUBLE) AS net,
  CAST(sum(t) OVER (PARTITION BY store) AS DOUBLE) AS store_net FROM base),
points AS (SELECT *, CASE WHEN store_net <> 0
  THEN CAST(round_even(net / store_net * 100 * 100, 0) AS BIGINT) ELSE 0 END AS points FROM shares),
ranked AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY t DESC, phone) AS rank,
  count(*) OVER (PARTITION BY store) AS size, {n} AS n,
  CAST(sum(points) OVER (PARTITION BY store ORDER BY t DESC, phone ROWS UNBOUNDED PRECEDING) AS BIGINT) AS reached
  FROM points)
SELECT store, phone, gross, net, CASE WHEN gross <> 0
  THEN round_even((gross - net) / gross * 100 * 100, 0) / 100 END AS discount_pct,
  orders, points / 100.0::DOUBLE AS contribution_pct, reached / 100.0::DOUBLE AS cum_pct
FROM ranked WHERE {kept} ORDER BY store, rank"""


def cohorts(months: int) -> str:
    spans = range(1, months + 1)
    counted = ", ".join(
        f"CAST(printf('%.2f', count(DISTINCT CASE WHEN index BETWEEN 1 AND {m} THEN phone END) "
        f"/ CAST(count(DISTINCT phone) AS DOUBLE) * 100) AS DOUBLE) AS after_{m}"
        for m in spans
    )
    weighed = ", ".join(
        f"round_even(CAST(sum(CAST(round_even(after_{m} * 100, 0) AS BIGINT) * customers) AS DOUBLE) "
        f"/ CAST(sum(customers) AS DOUBLE), 0) / 100 AS after_{m}"
        for m in spans
    )
    return f"""WITH {SALES}, months AS (
  SELECT phone, date_trunc('month', order_ts) AS month,
    min(date_trunc('month', order_ts)) OVER (PARTITION BY phone) AS first FROM sales WHERE phone IS NOT NULL),
indexed AS (SELECT *, (year(month) - year(first)) * 12 + month(month) - month(first) AS index FROM months),
cohorts AS (SELECT strftime(first, '%Y-%m') AS first_month, count(DISTINCT phone) AS customers, {counted}
  FROM indexed GROUP BY first)
SELECT *, 'cohort' AS row_kind FROM cohorts
UNION ALL
SELECT 'Grand Total', CAST(sum(customers) AS BIGINT), {weighed}, 'total' FROM cohorts
ORDER BY row_kind, first_month"""


def first_dates(where: str) -> str:
    return f"""WITH {SALES},
first_dates AS (SELECT phone, min(order_ts) AS first_date FROM sales WHERE phone IS NOT NULL GROUP BY phone),
chosen AS (SELECT * FROM sales WHERE {where} AND {clean(*DIMENSIONS)}),
typed AS (SELECT chosen.phone, first_date, CASE WHEN first_date >= TIMESTAMP '1995-07-01'
  THEN 'KH mới' ELSE 'KH quay lại' END AS customer_type
  FROM chosen LEFT JOIN first_dates ON chosen.phone = first_dates.phone)"""


def whole(value: str) -> str:
    return f"coalesce(format('{{:,.0f}}', CAST({value} AS DOUBLE)), '')"


def signed(value: str) -> str:
    return f"CASE WHEN {value} > 0 THEN '+' ELSE '' END || {percent(value)} AS {value}"


def percent(value: str) -> str:
    return f"coalesce(format('{{:,.2f}}%', {value}), '')"


ONE_YEAR = "order_ts BETWEEN TIMESTAMP '1995-07-01' AND TIMESTAMP '1996-06-30'"

ORACLES: dict[str, str] = {
    "kpis": f"WITH {SALES} {TOTALS_OF_ALL} true)",
    "kpis_filtered": f"""WITH {SALES} {TOTALS_OF_ALL} {clean(*DIMENSIONS)}
  AND order_ts <= (SELECT date_trunc('day', max(order_ts)) FROM sales))""",
    "kpis_stored": f"""WITH {SALES} {TOTALS_OF_ALL} {clean(*DIMENSIONS)}
  AND order_ts BETWEEN TIMESTAMP '1995-03-05 00:00:00' AND TIMESTAMP '1996-07-20 00:00:00')""",
    "kpis_bitmap": f"WITH {SALES} {TOTALS_OF_ALL} true)",
    "kpis_bitmap_days": f"""WITH {SALES} {TOTALS_OF_ALL}
  CAST(order_ts AS DATE) BETWEEN DATE '1995-03-05' AND DATE '1996-07-20')""",
    "trend_month_bitmap": trend("month"),
    "trend_week_bitmap": trend("week_sun"),
    "trend_day": trend("day"),
    "trend_week_sun": trend("week_sun"),
    "trend_month": trend("month"),
    "trend_quarter": trend("quarter"),
    "trend_year": trend("year"),
    "trend_day_gaps": trend("day", f"brand = 'Brand#11' AND {clean(*DIMENSIONS)}"),
    "trend_display": f"""SELECT strftime(period, '%Y-%m-%d') AS period, label, {whole("gross")} AS gross,
  {whole("net")} AS net, {whole("orders")} AS orders, {whole("customers")} AS customers,
  {percent("discount_pct")} AS discount_pct, {whole("prev_net")} AS prev_net,
  CASE WHEN growth_pct > 0 THEN '+' ELSE '' END || {percent("growth_pct")} AS growth_pct
FROM ({trend("quarter")})""",
    "region_time": region_trend("month"),
    "region_time_week": region_trend("week"),
    "store_summary": f"""WITH {SALES}, grouped AS (SELECT store, {SUMS} FROM sales GROUP BY store)
SELECT *, {FROM_DIFFERENCE} FROM grouped ORDER BY net DESC, store""",
    "number_display": f"""WITH {SALES}, grouped AS (SELECT store, {SUMS} FROM sales GROUP BY store),
rated AS (SELECT *, {FROM_DIFFERENCE} FROM grouped)
SELECT store, format('{{:,.3f}}', net) AS net, format('{{:,.2f}}', discount_pct) AS discount FROM rated""",
    "product_summary": products("CAST(sum(quantity) AS DOUBLE)"),
    "product_summary_no_quantity": products("count(DISTINCT doc_no)"),
    "product_summary_groups": products(
        "CAST(sum(quantity) AS DOUBLE)", "product_group IN ('PROMO', 'SMALL')"
    ),
    "revenue_day": revenue("day"),
    "revenue_week": revenue("week"),
    "revenue_month": revenue("month"),
    "revenue_quarter": revenue("quarter"),
    "revenue_series": f"""WITH {SALES}, grouped AS (
  SELECT {STARTS["month"]} AS start, {SUMS} FROM sales GROUP BY 1)
SELECT {LABELS["month"]} AS period, {KEYS["month"]}, 'gross' AS series, gross AS value FROM grouped
UNION ALL
SELECT {LABELS["month"]} AS period, {KEYS["month"]}, 'net' AS series, net AS value FROM grouped""",
    "periods": f"""WITH {SALES}, starts AS (SELECT DISTINCT {STARTS["week_sun"]} AS start FROM sales)
SELECT {LABELS["week"]} AS period, {KEYS["week"]}, start = (SELECT max(start) FROM starts) AS is_default
FROM starts ORDER BY start""",
    "time_keys": f"""WITH {SALES}, starts AS (SELECT {STARTS["week_sun"]} AS start FROM sales)
SELECT {KEYS["week"]}, count(*) AS lines FROM starts GROUP BY 1, 2""",
    "region_period": regions_of("month", "start = (SELECT max(start) FROM grouped)"),
    "region_period_chosen": regions_of("quarter", "start = DATE '1998-04-01'"),
    "top_stores": stores_of("month", "start = (SELECT max(start) FROM grouped)", "DESC"),
    "bottom_stores": stores_of("week_sun", "year = 1999 AND key = 20", "ASC"),
    "filter_all": f"""WITH {SALES} SELECT {ROWS} FROM sales
WHERE {clean(*DIMENSIONS, "phone_status", "name_check")}
  AND order_ts <= (SELECT date_trunc('day', max(order_ts)) FROM sales)""",
    "filter_cascade": f"""WITH {SALES} SELECT {ROWS} FROM sales
WHERE {clean("doc_type", "store", "name_check")} AND brand IN ('Brand#11', 'Brand#23')
  AND region IN ('ASIA', 'EUROPE') AND phone_status = 'valid'
  AND order_ts BETWEEN TIMESTAMP '1996-02-01' AND TIMESTAMP '2000-01-31'""",
    "options_region": f"""WITH {SALES} SELECT DISTINCT trim(region) AS value FROM sales
WHERE brand = 'Brand#11' AND region IS NOT NULL ORDER BY value""",
    "options_store": f"""WITH {SALES} SELECT DISTINCT trim(store) AS value FROM sales
WHERE {clean("brand")} AND region IN ('ASIA', 'AFRICA') AND store IS NOT NULL ORDER BY value""",
    "selection_brand": f"""WITH {SALES} SELECT DISTINCT trim(brand) AS value FROM sales
WHERE trim(brand) IN ('Brand#11', 'Brand#12') ORDER BY value""",
    "date_bounds": f"""WITH {SALES}
SELECT CAST(min(order_ts) AS DATE) AS start, CAST(max(order_ts) AS DATE) AS "end" FROM sales""",
    "events_end_bound": f"""WITH {EVENTS} {TOTALS_OF_ALL}
  order_ts >= TIMESTAMP '2024-01-05' AND order_ts <= TIMESTAMP '2024-01-20')""",
    "events_whole_end_day": f"""WITH {EVENTS} {TOTALS_OF_ALL}
  order_ts >= TIMESTAMP '2024-01-05' AND order_ts < TIMESTAMP '2024-01-21')""",
    "events_customers": f"""{customers(EVENTS, "phone, store", EVERY_TAG, vip=1500, inactive=3, where=clean("name_check"))}
SELECT {AS_DOUBLE} FROM listed ORDER BY net DESC, phone, store""",
    "read_stacked": """SELECT CAST(year(order_ts) AS INTEGER) AS year, count(*) AS lines,
  CAST(sum(gross) AS DOUBLE) AS gross, count(DISTINCT phone) AS phones, count(DISTINCT o_custkey) AS customers
FROM (SELECT ts AS order_ts, CAST(value AS DECIMAL(28,4)) AS gross, user_id AS phone,
    CAST(NULL AS BIGINT) AS o_custkey FROM events
  UNION ALL SELECT o_orderdate, CAST(o_totalprice AS DECIMAL(28,4)), NULL, o_custkey FROM orders)
GROUP BY 1""",
    "read_lines": """SELECT l_returnflag AS doc_type,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS gross,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS quantity,
  count(DISTINCT l_orderkey) AS orders, min(l_shipdate) AS first_ts,
  CAST(sum(l_linenumber) AS BIGINT) AS line_numbers
FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY l_returnflag""",
    "coerced": f"""WITH {SALES}
SELECT doc_type, count(*) AS lines, count(*) FILTER (WHERE quantity <= 40) AS with_gross,
  count(*) FILTER (WHERE quantity >= 5) AS with_net,
  CAST(sum(gross) FILTER (WHERE quantity <= 40) AS DOUBLE) AS gross,
  CAST(sum(net) FILTER (WHERE quantity >= 5) AS DOUBLE) AS net, min(order_ts) AS first_ts
FROM sales WHERE doc_type <> 'A' GROUP BY doc_type""",
    "first_purchase": f"""WITH {SALES}
SELECT phone, min(order_ts) AS first_date FROM sales WHERE phone IS NOT NULL GROUP BY phone""",
    "first_purchase_rows": f"""WITH {SALES},
first_dates AS (SELECT phone, min(order_ts) AS first_date FROM sales WHERE phone IS NOT NULL GROUP BY phone)
SELECT sales.phone, order_ts, doc_no, first_date
FROM sales LEFT JOIN first_dates ON sales.phone = first_dates.phone
WHERE order_ts BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-12-31'""",
    "customer_types": f"{first_dates(ONE_YEAR)} SELECT DISTINCT phone, first_date, customer_type FROM typed",
    "new_vs_returning": f"""{first_dates(ONE_YEAR)}
SELECT customer_type, count(DISTINCT phone) AS customers FROM typed GROUP BY customer_type ORDER BY 1""",
    "customers_by_store": f"""{customers(SALES, "phone, store", REGULAR, where=BOTH_CHECKS)}
SELECT {AS_DOUBLE} FROM listed ORDER BY net DESC, phone, store""",
    "customers_merged": f"""{customers(SALES, "phone", EVERY_TAG,
        where=f"phone_status = 'valid' AND {clean('name_check')}")}
SELECT {AS_DOUBLE} FROM listed ORDER BY net DESC, phone""",
    "customers_inactive": f"""{customers(SALES, "phone", "'KH Inactive'", vip=300_000_000, inactive=180,
        min_net=1_000_000, where=f"name_check IN ('BUILDING', 'MACHINERY') AND {clean('phone_status')}")}
SELECT {AS_DOUBLE} FROM listed ORDER BY days_without_order NULLS LAST, phone""",
    "customers_total": f"""{customers(SALES, "phone, store", REGULAR, where=BOTH_CHECKS)},
summed AS (SELECT CAST(sum(gross) AS DOUBLE) AS gross, CAST(sum(net) AS DOUBLE) AS net,
  CAST(sum(orders) AS BIGINT) AS orders, {MEAN_DISCOUNT} AS discount_pct FROM listed)
SELECT {AS_DOUBLE}, 'customer' AS row_kind FROM listed
UNION ALL BY NAME
SELECT 'TỔNG' AS phone, '' AS store, '' AS customer_name, '' AS name_check, gross, net, orders,
  '' AS phone_status, discount_pct, '' AS tag, 'total' AS row_kind FROM summed""",
    "customer_count": f"""{customers(SALES, "phone, store", REGULAR, where=BOTH_CHECKS)}
SELECT count(DISTINCT phone) AS customers FROM listed""",
    "export_format": f"""{customers(SALES, "phone", EVERY_TAG, where=BOTH_CHECKS)}
SELECT phone, customer_name, tag, {whole("gross")} AS gross, {whole("net")} AS net,
  {percent("discount_pct")} AS discount_pct, {whole("orders")} AS orders,
  {whole("days_without_order")} AS days_without_order, strftime(last_order, '%Y-%m-%d') AS last_order
FROM listed
UNION ALL
SELECT 'TỔNG', '', '', {whole("sum(gross)")}, {whole("sum(net)")}, {percent(MEAN_DISCOUNT)},
  {whole("sum(orders)")}, '', NULL FROM listed""",
    "pareto_top": pareto(20, top=True),
    "pareto_bottom": pareto(35, top=False),
    "cohort_retention": cohorts(7),
    "cohort_retention_year": cohorts(12),
}

ORACLES |= {
    "pareto_stores": pareto(20, top=True).replace(
        "WHERE store IS NOT NULL AND", "WHERE store IN ('Supplier#000000001', 'Supplier#000000007') AND"
    ),
    "revenue_display": f"""SELECT period, year, key,
  {", ".join(f"{whole(n)} AS {n}" for n in ALL_FOUR)}, {percent("discount_pct")} AS discount_pct,
  {", ".join(f"{whole(f'prev_{n}')} AS prev_{n}, {signed(f'{n}_change_pct')}" for n in ALL_FOUR)}
FROM ({revenue("quarter")})""",
    "pareto_display": f"""SELECT store, phone,
  {", ".join(f"{whole(n)} AS {n}" for n in ("gross", "net", "orders"))},
  {", ".join(f"{percent(n)} AS {n}" for n in ("discount_pct", "contribution_pct", "cum_pct"))}
FROM ({pareto(20, top=True)})""",
}

ORACLES |= {
    f"{dirty}_dirty": ORACLES[name].replace(SALES, DIRTY)
    for dirty, name in (
        ("filter_all", "filter_all"),
        ("new_vs_returning", "new_vs_returning"),
        ("customers", "customers_by_store"),
        ("pareto", "pareto_top"),
        ("cohort", "cohort_retention"),
        ("kpis_bitmap", "kpis_bitmap"),
    )
}
ORACLES["product_summary_dirty"] = products("CAST(sum(quantity) AS DOUBLE)").replace(
    SALES, DIRTY
)

LINES_BY_TYPE = """SELECT l_returnflag AS doc_type,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(28,4))) AS DOUBLE) AS gross, count(DISTINCT l_orderkey) AS orders
FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY l_returnflag"""

ORACLES |= {
    "read_skipping": LINES_BY_TYPE,
    "source_kept": LINES_BY_TYPE,
    "export_csv": ORACLES["store_summary"],
}
