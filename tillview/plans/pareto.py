"""Best or worst customers of each store by their share of its net."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillview.functions.display import display
from tillview.functions.metrics import (
    discount_unguarded,
    distinct,
    hundredths,
    round_scaled,
    total,
)
from tillview.operators.running import block_sums, ordered_blocks
from tillview.schema import ParetoParams, require
from tillview.sources.staging import stage


def _by_net() -> list[Column]:
    return [F.col("net").desc(), F.col("phone")]


def _points(store_net: Column) -> Column:
    """Contribution in hundredths of a percent, 0 where the store nets 0."""
    share = F.try_divide(F.col("net").cast("double"), store_net.cast("double")) * 100
    return F.coalesce(hundredths(share), F.lit(0).cast("long"))


def _slice(rows: Column, params: ParetoParams) -> tuple[Column, Column]:
    """Ranks kept of ``rows`` customers: above the first value, up to the second."""
    chosen = F.greatest(F.lit(1), F.floor(rows * params.percent / 100))
    return (F.lit(0), chosen) if params.top else (rows - chosen, rows)


def _rank(customers: DataFrame, params: ParetoParams, blocks: int | None) -> DataFrame:
    """Rank and accumulate, carried from block to block.

    The order needs no total, so customers are ranged as they are; a store's total is summed
    over its blocks. Blocks outside every slice are dropped before their rows are moved.
    """
    ranked = ordered_blocks(customers, "store", _by_net(), blocks)
    nets = block_sums(ranked, "store", {"net": F.sum("net")})
    stores = nets.select("block", "store", F.col("net_total").alias("store_net"))
    points = _points(F.col("store_net"))
    valued = ranked.select("block", "store", "net").join(stores, ["block", "store"]).withColumn("points", points)
    sums = block_sums(valued, "store", {"rows": F.count("*"), "points": F.sum("points")})
    first, last = _slice(F.col("rows_total"), params)
    touched = (
        sums.withColumns({"first": first, "last": last})
        .filter("rows_before < last AND rows_before + rows > first")
        .select("block", "store", "rows_before", "points_before", "first", "last")
        .join(stores, ["block", "store"])
    )
    inside = Window.partitionBy("block", "store").orderBy(*_by_net())
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranked.join(touched, ["block", "store"])
        .withColumn("points", points)
        .drop("store_net")
        .repartitionByRange("block")
        .withColumns(
            {
                "rank": F.row_number().over(inside) + F.col("rows_before"),
                "reached": F.sum("points").over(running) + F.col("points_before"),
            }
        )
        .filter("rank > first AND rank <= last")
        .orderBy("block", "store", *_by_net())
    )


def pareto_customers(
    sales: DataFrame, params: ParetoParams = ParetoParams(), blocks: int | None = None
) -> DataFrame:
    """Per store the top or bottom share of customers, with cumulative contribution.

    Customers are ranked by net, largest first, and ties by phone. Contribution
    is rounded to hundredths of a percent before it is accumulated over the full
    ranking; as integers, these sums are exact in any order. No store is held in
    one task: ranks and sums are carried over blocks of customers, ``blocks`` of
    them or as many as the session has shuffle partitions. Customers and blocks
    are written down, for their bounds come from a sample; so calling this runs
    jobs.
    """
    require(sales, "store", "phone", "gross", "net", "doc_no")
    if params.stores:
        sales = sales.filter(F.col("store").isin(list(params.stores)))
    customers = (
        sales.filter(F.col("store").isNotNull() & F.col("phone").isNotNull())
        .groupBy("store", "phone")
        .agg(total("gross").alias("gross"), total("net").alias("net"), distinct("doc_no", "orders"))
    )
    ranked = _rank(stage(customers, "pareto"), params, blocks)
    gross, net = F.col("gross").cast("double"), F.col("net").cast("double")
    return ranked.select(
        "store",
        "phone",
        gross.alias("gross"),
        net.alias("net"),
        round_scaled(discount_unguarded(gross, net)).alias("discount_pct"),
        "orders",
        (F.col("points") / 100).alias("contribution_pct"),
        (F.col("reached") / 100).alias("cum_pct"),
    )


def pareto_display(table: DataFrame) -> DataFrame:
    """Text form of the Pareto table."""
    return display(
        table, integers=["gross", "net", "orders"], percents=["discount_pct", "contribution_pct", "cum_pct"]
    )
