"""Revenue reports: totals per period, regions and best or worst stores of a period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillview.functions.display import display
from tillview.functions.metrics import discount_any_sign, money, sales_totals
from tillview.functions.timekeys import period_start
from tillview.operators.periods import (
    by_period,
    choose_period,
    compare_with_previous,
    period_columns,
)
from tillview.schema import Period, require

COMPARED = ("gross", "net", "customers", "orders")


def _with_discount(df: DataFrame) -> DataFrame:
    return df.withColumn("discount_pct", discount_any_sign(F.col("gross"), F.col("net")))


def _comparison_columns(names) -> list[str]:
    return [c for n in names for c in (f"prev_{n}", f"{n}_change_pct")]


def revenue_summary(sales: DataFrame, period: Period = Period()) -> DataFrame:
    """Totals per period with sales, each compared with the one before.

    The ungrouped window sees one row per period.
    """
    require(sales, "gross", "net", "doc_no", "phone")
    rows = _with_discount(by_period(sales, period, [], sales_totals()))
    compared = compare_with_previous(rows, COMPARED, Window.orderBy("start"))
    return compared.orderBy("start").select(
        *period_columns(period),
        "gross",
        "net",
        "customers",
        "orders",
        "discount_pct",
        *_comparison_columns(COMPARED),
    )


def revenue_series(sales: DataFrame, period: Period = Period()) -> DataFrame:
    """Gross and net per period in long form, for a line chart."""
    require(sales, "gross", "net")
    rows = by_period(sales, period, [], [money("gross"), money("net")])
    return (
        rows.orderBy("start")
        .select(*period_columns(period), "gross", "net")
        .unpivot(["period", "year", "key"], ["gross", "net"], "series", "value")
    )


def periods(sales: DataFrame, period: Period = Period()) -> DataFrame:
    """Periods with sales, sorted; the last one is the default choice."""
    starts = sales.select(period_start(F.col("order_ts"), period).alias("start")).distinct()
    last = F.lead("start").over(Window.orderBy("start")).isNull()
    return (
        starts.withColumn("is_default", last)
        .orderBy("start")
        .select(*period_columns(period), "is_default")
    )


def region_period(
    sales: DataFrame, period: Period = Period(), year: int | None = None, key=None
) -> DataFrame:
    """Regions in one period, each compared with its own previous period.

    The default is the latest period of all rows; rows without a region are
    then left out. A narrow pass finds the period before the chosen one in each
    region; sums and distinct counts see the rows of these two only. The periods
    found are one row per region, as the report is, and are broadcast: matched in a
    shuffle, all rows of a region would meet in one task.
    """
    require(sales, "region", "gross", "net", "doc_no", "phone")
    rows, chosen = choose_period(sales, period, year, key)
    rows = rows.filter(F.col("region").isNotNull())
    start = period_start(F.col("order_ts"), period).alias("start")
    by_region = Window.partitionBy("region").orderBy("start")
    starts = (
        rows.select("region", start)
        .distinct()
        .withColumn("before", F.lag("start").over(by_region))
        .filter(chosen)
        .select("region", F.col("start").alias("this"), "before")
    )
    of_both = rows.join(F.broadcast(starts), "region").filter(start.isin(F.col("this"), F.col("before")))
    totals = by_period(of_both, period, ["region", "this"], sales_totals())
    compared = compare_with_previous(_with_discount(totals), COMPARED, by_region)
    return (
        compared.filter(F.col("start") == F.col("this"))
        .orderBy(F.col("net").desc(), "region")
        .select(
            *period_columns(period),
            "region",
            "gross",
            "net",
            "customers",
            "orders",
            "discount_pct",
            *_comparison_columns(COMPARED),
        )
    )


def top_bottom_stores(
    sales: DataFrame,
    period: Period = Period(),
    top: bool = True,
    year: int | None = None,
    key=None,
    n: int = 10,
) -> DataFrame:
    """The ``n`` stores with the most or least net in one period.

    Without a full choice of period the latest one is taken. A store has one row
    per period in the window.
    """
    require(sales, "store", "gross", "net")
    rows, chosen = choose_period(sales.filter(F.col("store").isNotNull()), period, year, key)
    rows = by_period(rows, period, ["store"], [money("gross"), money("net")])
    window = Window.partitionBy("store").orderBy("start")
    compared = compare_with_previous(_with_discount(rows), ["net"], window)
    by_net = F.col("net").desc() if top else F.col("net").asc()
    return (
        compared.filter(chosen)
        .orderBy(by_net, "store")
        .limit(n)
        .select(
            *period_columns(period),
            "store",
            "gross",
            "net",
            "discount_pct",
            F.col("prev_net").alias("prev"),
            F.col("net_change_pct").alias("change_pct"),
        )
    )


def revenue_display(table: DataFrame) -> DataFrame:
    """Text form of the revenue, region and store tables: whole numbers, percents, signed changes."""
    changes = [c for c in table.columns if c.endswith("change_pct")]
    return display(
        table,
        integers=["gross", "net", "customers", "orders", "prev", *(f"prev_{n}" for n in COMPARED)],
        percents=["discount_pct"],
        signed_percents=changes,
    )
