"""One query per report and operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillview.catalog.tables import dirty_sales, event_sales, sales_table
from tillview.functions.display import display, number_text
from tillview.functions.timekeys import add_time_key
from tillview.operators.filters import (
    apply_filters,
    date_bounds,
    date_range,
    option_values,
    resolve_selection,
)
from tillview.plans.cohort import cohort_retention
from tillview.plans.customers import (
    customer_count,
    customer_display,
    customer_list,
    customer_list_with_total,
    customer_types,
    first_purchase,
    join_first_purchase,
    new_vs_returning,
)
from tillview.plans.daily import count_days, kpis_of_days, trend_of_days
from tillview.plans.overview import kpis, product_summary, region_time, store_summary, time_trend
from tillview.plans.pareto import pareto_customers, pareto_display
from tillview.plans.revenue import (
    periods,
    region_period,
    revenue_display,
    revenue_series,
    revenue_summary,
    top_bottom_stores,
)
from tillview.schema import (
    REVENUE_DIMENSIONS,
    CohortParams,
    CustomerParams,
    Filters,
    ParetoParams,
    Period,
    ProductParams,
)
from tillview.sinks.export import write_report
from tillview.sources.reader import choose_source, normalize, read_sales
from tillview.sources.staging import new_folder
from tillview.sources.store import open_sales, save_sales

Query = Callable[[SparkSession, str], DataFrame]

TOTALS = "order_ts gross net doc_no phone"
CUSTOMERS = TOTALS + " store customer_name name_check phone_status"
VIP = 3_000_000
ONE_BRAND = Filters(brand=("Brand#11",))


def on_sales(report: Callable[[DataFrame], DataFrame], columns: str | None = None) -> Query:
    return lambda spark, sf_dir: report(sales_table(spark, sf_dir, columns))


def on_events(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: report(event_sales(spark, sf_dir))


def on_dirty(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: report(dirty_sales(spark, sf_dir))


def read_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and events read as one table: both dated under one name, other columns their own."""
    names = {"order_ts": "ts", "doc_no": "event_id", "gross": "value", "phone": "user_id"}
    events, orders = f"{sf_dir}/events.parquet", f"{sf_dir}/orders.parquet"
    both = read_sales(spark, [orders, events], names)
    dated = read_sales(spark, [events, orders], names | {"order_ts": "o_orderdate", "gross": "o_totalprice"})
    stacked = both.unionByName(dated, allowMissingColumns=True)
    return stacked.groupBy(F.year("order_ts").alias("year")).agg(
        F.count("*").alias("lines"),
        F.sum("gross").cast("double").alias("gross"),
        F.count_distinct("phone").alias("phones"),
        F.count_distinct("o_custkey").alias("customers"),
    )


def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line table read as sales dated by shipping, totalled per document type."""
    names = {
        "order_ts": "l_shipdate",
        "doc_no": "l_orderkey",
        "gross": "l_extendedprice",
        "doc_type": "l_returnflag",
        "product_code": "l_partkey",
        "quantity": "l_quantity",
    }
    sales = read_sales(spark, f"{sf_dir}/lineitem.parquet", names)
    return sales.groupBy("doc_type").agg(
        F.sum("gross").cast("double").alias("gross"),
        F.sum("quantity").cast("double").alias("quantity"),
        F.count_distinct("doc_no").alias("orders"),
        F.min("order_ts").alias("first_ts"),
        F.sum(F.col("l_linenumber")).alias("line_numbers"),
    )


def _lines_by_type(sales: DataFrame) -> DataFrame:
    return sales.groupBy("doc_type").agg(
        F.sum("gross").cast("double").alias("gross"), F.count_distinct("doc_no").alias("orders")
    )


LINE_NAMES = {"order_ts": "l_shipdate", "doc_no": "l_orderkey", "gross": "l_extendedprice", "doc_type": "l_returnflag"}


def read_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line table, with an input that does not exist left out."""
    paths = [f"{sf_dir}/no such table.parquet", f"{sf_dir}/lineitem.parquet"]
    return _lines_by_type(read_sales(spark, paths, LINE_NAMES, skip_corrupt=True))


def source_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new source without valid rows does not replace the line table."""
    lines = read_sales(spark, f"{sf_dir}/lineitem.parquet", LINE_NAMES)
    undated = normalize(
        spark.read.parquet(f"{sf_dir}/lineitem.parquet"), LINE_NAMES | {"order_ts": "l_returnflag", "doc_type": "l_linestatus"}
    )
    return _lines_by_type(choose_source(undated, lines))


def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store table written as CSV and read back."""
    path = new_folder(spark, "export")
    write_report(store_summary(sales_table(spark, sf_dir, TOTALS + " store")), path, "csv")
    kinds = "store string, gross double, net double, orders bigint, customers bigint, discount_pct double"
    return spark.read.option("header", "true").schema(kinds).csv(path)


def coerced(sales: DataFrame) -> DataFrame:
    """Text columns under the input's names, some of them bad, brought to types."""
    raw = sales.select(
        F.when(F.col("doc_type") == "A", F.lit("unknown"))
        .otherwise(F.date_format("order_ts", "yyyy-MM-dd HH:mm:ss"))
        .alias("Ngày"),
        F.when(F.col("quantity") > 40, F.lit("1,000"))
        .otherwise(F.concat(F.lit(" "), F.col("gross").cast("string"), F.lit(" ")))
        .alias("Tổng_Gross"),
        F.when(F.col("quantity") < 5, F.lit("nan")).otherwise(F.col("net").cast("string")).alias("Tổng_Net"),
        F.col("doc_no").cast("long").alias("Số_CT"),
        F.col("phone").alias("Số_điện_thoại"),
        F.col("doc_type").alias("LoaiCT"),
    )
    typed = normalize(raw)
    return typed.groupBy("doc_type").agg(
        F.count("*").alias("lines"),
        F.count("gross").alias("with_gross"),
        F.count("net").alias("with_net"),
        F.sum("gross").cast("double").alias("gross"),
        F.sum("net").cast("double").alias("net"),
        F.min("order_ts").alias("first_ts"),
    )


def trend_display(sales: DataFrame) -> DataFrame:
    return display(
        time_trend(sales, Period("quarter")),
        integers=["gross", "net", "orders", "customers", "prev_net"],
        percents=["discount_pct"],
        signed_percents=["growth_pct"],
        dates=["period"],
    )


def number_display(sales: DataFrame) -> DataFrame:
    return store_summary(sales).select(
        "store", number_text(F.col("net"), 3).alias("net"), number_text(F.col("discount_pct")).alias("discount")
    )


def time_keys(sales: DataFrame) -> DataFrame:
    keyed = add_time_key(sales, Period("week", 6))
    return keyed.groupBy("year", "key").agg(F.count("*").alias("lines"))


def first_purchase_rows(sales: DataFrame) -> DataFrame:
    rows = date_range(sales, date(1998, 1, 1), date(1998, 12, 31))
    return join_first_purchase(rows, first_purchase(sales))


STORED = Filters(start=date(1995, 3, 5), end=date(1996, 7, 20))


def kpis_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPIs of a period from a copy partitioned by month, of which other months are not read."""
    folder = new_folder(spark, "sales-copy")
    save_sales(sales_table(spark, sf_dir, TOTALS + " doc_type brand region store"), folder)
    return kpis(apply_filters(open_sales(spark, folder, STORED.start, STORED.end), STORED))


QUERIES: dict[str, Query] = {
    "kpis": on_sales(kpis, TOTALS),
    "kpis_filtered": on_sales(
        lambda s: kpis(apply_filters(s)), TOTALS + " doc_type brand region store"
    ),
    "kpis_stored": kpis_stored,
    "kpis_bitmap": on_sales(lambda s: kpis_of_days(count_days(s)), TOTALS),
    "kpis_bitmap_days": on_sales(
        lambda s: kpis_of_days(count_days(s), date(1995, 3, 5), date(1996, 7, 20)), TOTALS
    ),
    "trend_month_bitmap": on_sales(lambda s: trend_of_days(count_days(s), Period("month")), TOTALS),
    "trend_week_bitmap": on_sales(lambda s: trend_of_days(count_days(s), Period("week", 6)), TOTALS),
    "kpis_bitmap_dirty": on_dirty(lambda s: kpis_of_days(count_days(s))),
    "trend_day": on_sales(lambda s: time_trend(s, Period("day")), TOTALS),
    "trend_week_sun": on_sales(lambda s: time_trend(s, Period("week", 6)), TOTALS),
    "trend_month": on_sales(lambda s: time_trend(s, Period("month")), TOTALS),
    "trend_quarter": on_sales(lambda s: time_trend(s, Period("quarter")), TOTALS),
    "trend_year": on_sales(lambda s: time_trend(s, Period("year")), TOTALS),
    "trend_day_gaps": on_sales(
        lambda s: time_trend(apply_filters(s, ONE_BRAND), Period("day")),
        TOTALS + " doc_type brand region store",
    ),
    "trend_display": on_sales(trend_display, TOTALS),
    "region_time": on_sales(lambda s: region_time(s, Period("month")), TOTALS + " region"),
    "region_time_week": on_sales(lambda s: region_time(s, Period("week")), TOTALS + " region"),
    "store_summary": on_sales(store_summary, TOTALS + " store"),
    "number_display": on_sales(number_display, TOTALS + " store"),
    "product_summary": on_sales(product_summary, TOTALS + " product_code quantity"),
    "product_summary_no_quantity": on_sales(product_summary, TOTALS + " product_code"),
    "product_summary_groups": on_sales(
        lambda s: product_summary(s, ProductParams(product_group=("PROMO", "SMALL"))),
        TOTALS + " product_code product_group quantity",
    ),
    "revenue_day": on_sales(lambda s: revenue_summary(s, Period("day")), TOTALS),
    "revenue_week": on_sales(lambda s: revenue_summary(s, Period("week")), TOTALS),
    "revenue_month": on_sales(lambda s: revenue_summary(s, Period("month")), TOTALS),
    "revenue_quarter": on_sales(lambda s: revenue_summary(s, Period("quarter")), TOTALS),
    "revenue_series": on_sales(lambda s: revenue_series(s, Period("month")), "order_ts gross net"),
    "periods": on_sales(lambda s: periods(s, Period("week", 6)), "order_ts"),
    "time_keys": on_sales(time_keys, "order_ts"),
    "region_period": on_sales(lambda s: region_period(s, Period("month")), TOTALS + " region"),
    "region_period_chosen": on_sales(
        lambda s: region_period(s, Period("quarter"), 1998, 2), TOTALS + " region"
    ),
    "top_stores": on_sales(lambda s: top_bottom_stores(s, Period("month")), "order_ts gross net store"),
    "bottom_stores": on_sales(
        lambda s: top_bottom_stores(s, Period("week", 6), top=False, year=1999, key=20),
        "order_ts gross net store",
    ),
    "filter_all": on_sales(lambda s: apply_filters(s, Filters(dimensions=REVENUE_DIMENSIONS))),
    "filter_cascade": on_sales(
        lambda s: apply_filters(
            s,
            Filters(
                start=date(1996, 2, 1),
                end=date(2000, 1, 31),
                brand=("Brand#11", "Brand#23", "none such"),
                region=("ASIA", " EUROPE "),
                store=("none such",),
                phone_status=("valid",),
                dimensions=REVENUE_DIMENSIONS,
            ),
        )
    ),
    "options_region": on_sales(
        lambda s: option_values(s, "region", {"brand": ("Brand#11",)}), "brand region"
    ),
    "options_store": on_sales(
        lambda s: option_values(s, "store", {"brand": (), "region": ("ASIA", "AFRICA")}),
        "brand region store",
    ),
    "selection_brand": on_sales(
        lambda s: resolve_selection(s, "brand", (" Brand#11", "Brand#12", "none such")), "brand"
    ),
    "date_bounds": on_sales(date_bounds, "order_ts"),
    "events_end_bound": on_events(
        lambda s: kpis(date_range(s, date(2024, 1, 5), date(2024, 1, 20)))
    ),
    "events_whole_end_day": on_events(
        lambda s: kpis(date_range(s, date(2024, 1, 5), date(2024, 1, 20), end_inclusive_day=True))
    ),
    "events_customers": on_events(
        lambda s: customer_list(s, CustomerParams(inactive_days=3, vip_net=1500, show_inactive=True, show_vip=True))
    ),
    "read_lines": read_lines,
    "read_stacked": read_stacked,
    "read_skipping": read_skipping,
    "source_kept": source_kept,
    "export_csv": export_csv,
    "coerced": on_sales(coerced, TOTALS + " doc_type quantity"),
    "first_purchase": on_sales(first_purchase, "order_ts phone"),
    "first_purchase_rows": on_sales(first_purchase_rows, "order_ts phone doc_no"),
    "customer_types": on_sales(
        lambda s: customer_types(s, Filters(start=date(1995, 7, 1), end=date(1996, 6, 30))),
        "order_ts phone doc_type brand region store",
    ),
    "new_vs_returning": on_sales(
        lambda s: new_vs_returning(s, Filters(start=date(1995, 7, 1), end=date(1996, 6, 30))),
        "order_ts phone doc_type brand region store",
    ),
    "customers_by_store": on_sales(
        lambda s: customer_list(s, CustomerParams(vip_net=VIP)), CUSTOMERS
    ),
    "customers_merged": on_sales(
        lambda s: customer_list(
            s,
            CustomerParams(
                per_store=False, vip_net=VIP, show_inactive=True, show_vip=True, phone_status=("valid",)
            ),
        ),
        CUSTOMERS,
    ),
    "customers_inactive": on_sales(
        lambda s: customer_list(
            s,
            CustomerParams(
                per_store=False,
                inactive_days=180,
                min_net=1_000_000,
                show_inactive=True,
                show_regular=False,
                name_check=("BUILDING", "MACHINERY"),
                sort_by="days_without_order",
                ascending=True,
            ),
        ),
        CUSTOMERS,
    ),
    "customers_total": on_sales(
        lambda s: customer_list_with_total(s, CustomerParams(vip_net=VIP)), CUSTOMERS
    ),
    "customer_count": on_sales(
        lambda s: customer_count(customer_list(s, CustomerParams(vip_net=VIP))), CUSTOMERS
    ),
    "export_format": on_sales(
        lambda s: customer_display(
            customer_list_with_total(
                s, CustomerParams(per_store=False, vip_net=VIP, show_inactive=True, show_vip=True)
            ),
            per_store=False,
        ),
        CUSTOMERS,
    ),
    "pareto_top": on_sales(pareto_customers, "gross net doc_no phone store"),
    "pareto_bottom": on_sales(
        lambda s: pareto_customers(s, ParetoParams(percent=35, top=False)),
        "gross net doc_no phone store",
    ),
    "cohort_retention": on_sales(cohort_retention, "order_ts phone"),
    "cohort_retention_year": on_sales(
        lambda s: cohort_retention(s, CohortParams(months=12)), "order_ts phone"
    ),
    "pareto_stores": on_sales(
        lambda s: pareto_customers(s, ParetoParams(stores=("Supplier#000000001", "Supplier#000000007"))),
        "gross net doc_no phone store",
    ),
    "filter_all_dirty": on_dirty(lambda s: apply_filters(s, Filters(dimensions=REVENUE_DIMENSIONS))),
    "new_vs_returning_dirty": on_dirty(
        lambda s: new_vs_returning(s, Filters(start=date(1995, 7, 1), end=date(1996, 6, 30)))
    ),
    "customers_dirty": on_dirty(lambda s: customer_list(s, CustomerParams(vip_net=VIP))),
    "pareto_dirty": on_dirty(pareto_customers),
    "cohort_dirty": on_dirty(cohort_retention),
    "product_summary_dirty": on_dirty(product_summary),
    "revenue_display": on_sales(lambda s: revenue_display(revenue_summary(s, Period("quarter"))), TOTALS),
    "pareto_display": on_sales(lambda s: pareto_display(pareto_customers(s)), "gross net doc_no phone store"),
}
