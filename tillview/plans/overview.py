"""Overview reports: KPIs, trend over time, regions, stores and products."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillview.functions.metrics import (
    discount_from_difference,
    discount_from_ratio,
    distinct,
    growth_or_zero,
    money,
    sales_totals,
)
from tillview.functions.timekeys import period_end, period_step, time_label
from tillview.operators.periods import by_period
from tillview.schema import Period, ProductParams, require


def kpis(sales: DataFrame) -> DataFrame:
    """Gross, net, orders, customers and discount of all rows; absent columns count 0."""
    have = set(sales.columns)
    totals = sales.agg(
        money("gross") if "gross" in have else F.max(F.lit(0.0)).alias("gross"),
        money("net") if "net" in have else F.max(F.lit(0.0)).alias("net"),
        distinct("doc_no", "orders") if "doc_no" in have else F.max(F.lit(0)).cast("long").alias("orders"),
        distinct("phone", "customers")
        if "phone" in have
        else F.max(F.lit(0)).cast("long").alias("customers"),
    )
    return totals.withColumn("discount_pct", discount_from_ratio(F.col("gross"), F.col("net")))


def _fill_gaps(periods: DataFrame, period: Period) -> DataFrame:
    """Insert the empty periods between the first and the last one, with zeros.

    Each period yields itself and the empty ones up to its successor, so the
    sales are read once and nothing is joined.
    """
    step = period_step(period)
    following = F.lead("start").over(Window.orderBy("start"))
    until = F.coalesce((F.col("following") - step).cast("date"), F.col("start"))
    slots = periods.withColumn("following", following).withColumn(
        "slot", F.explode(F.sequence("start", until, step))
    )
    own = F.col("slot") == F.col("start")
    values = [
        F.when(own, F.col(n)).otherwise(F.lit(0)).cast(kind).alias(n)
        for n, kind in (("gross", "double"), ("net", "double"), ("orders", "long"), ("customers", "long"))
    ]
    return slots.select(F.col("slot").alias("start"), *values)


def time_trend(sales: DataFrame, period: Period = Period()) -> DataFrame:
    """Totals per period with growth of net over the period before.

    Days, months, quarters and years without sales appear with zeros and are
    labelled by their last day; weeks appear only when they have sales and are
    labelled by their first day. The windows see one row per period.
    """
    require(sales, "gross", "net", "doc_no", "phone")
    return trend_of_totals(by_period(sales, period, [], sales_totals()), period)


def trend_of_totals(trend: DataFrame, period: Period) -> DataFrame:
    """``time_trend`` from start, gross, net, orders and customers of the periods with sales."""
    if period.grain != "week":
        trend = _fill_gaps(trend, period)
    trend = trend.withColumn("prev_net", F.lag("net").over(Window.orderBy("start")))
    return trend.select(
        period_end(F.col("start"), period).alias("period"),
        time_label(F.col("start"), period).alias("label"),
        "gross",
        "net",
        "orders",
        "customers",
        discount_from_ratio(F.col("gross"), F.col("net")).alias("discount_pct"),
        "prev_net",
        growth_or_zero(F.col("net"), F.col("prev_net")).alias("growth_pct"),
    ).orderBy("period")


def region_time(sales: DataFrame, period: Period = Period()) -> DataFrame:
    """Totals per period and region, by time and then net, largest first."""
    require(sales, "region", "gross", "net", "doc_no", "phone")
    rows = by_period(sales, period, ["region"], sales_totals())
    return rows.select(
        F.col("start").alias("period"),
        time_label(F.col("start"), period).alias("label"),
        "region",
        "gross",
        "net",
        "orders",
        "customers",
        discount_from_difference(F.col("gross"), F.col("net")).alias("discount_pct"),
    ).orderBy("period", F.col("net").desc(), "region")


def store_summary(sales: DataFrame) -> DataFrame:
    """Totals per store, by net, largest first."""
    require(sales, "store", "gross", "net", "doc_no", "phone")
    stores = sales.groupBy("store").agg(*sales_totals())
    return stores.withColumn("discount_pct", discount_from_difference(F.col("gross"), F.col("net"))).orderBy(
        F.col("net").desc(), "store"
    )


def product_summary(sales: DataFrame, params: ProductParams = ProductParams()) -> DataFrame:
    """Totals per product code, by net, largest first.

    ``orders`` is the quantity sold when the table has quantities, else the
    number of documents.
    """
    require(sales, "product_code", "gross", "net", "phone")
    for name in ("product_group", "product_code"):
        chosen = getattr(params, name)
        if chosen and name in sales.columns:
            sales = sales.filter(F.col(name).isin(list(chosen)))
    if "quantity" in sales.columns:
        orders = money("quantity").alias("orders")
    else:
        require(sales, "doc_no")
        orders = distinct("doc_no", "orders")
    products = sales.groupBy("product_code").agg(
        money("gross"), money("net"), orders, distinct("phone", "customers")
    )
    return products.orderBy(F.col("net").desc(), "product_code")
