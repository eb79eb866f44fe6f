"""Cumulative monthly retention of customer cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillview.functions.display import display
from tillview.functions.metrics import hundredths, round_exact
from tillview.schema import GRAND_TOTAL_LABEL, CohortParams, require


def customer_cohorts(sales: DataFrame) -> DataFrame:
    """Per phone its first month and the distance in months to its next active one."""
    require(sales, "phone")
    day = F.col("order_ts")
    months = (
        sales.filter(F.col("phone").isNotNull())
        .select("phone", (F.year(day) * 12 + F.month(day) - 1).alias("month"))
        .distinct()
    )
    in_order = Window.partitionBy("phone").orderBy("month")
    steps = months.select(
        F.col("month").alias("first_month"),
        F.row_number().over(in_order).alias("n"),
        (F.lead("month").over(in_order) - F.col("month")).alias("returned_after"),
    )
    return steps.filter("n = 1").drop("n")


def cohort_retention(sales: DataFrame, params: CohortParams = CohortParams()) -> DataFrame:
    """Share of each first-month cohort that came back within 1 to n months.

    A customer came back within m months exactly when the first return did, so
    one aggregate serves all columns. The grand total weighs the rounded shares
    by cohort size; it is formed from the few cohort rows, in integers.
    """
    spans = range(1, params.months + 1)
    size = F.col("customers")
    cohorts = (
        customer_cohorts(sales)
        .groupBy("first_month")
        .agg(
            F.count("*").alias("customers"),
            *(F.count_if(F.col("returned_after") <= m).alias(f"n{m}") for m in spans),
        )
    )
    month = F.format_string(
        "%04d-%02d", F.floor(F.col("first_month") / 12).cast("int"), F.col("first_month") % 12 + 1
    )
    rounded = cohorts.select(
        F.explode(F.array(month, F.lit(GRAND_TOTAL_LABEL))).alias("first_month"),
        "customers",
        *(hundredths(round_exact(F.col(f"n{m}") / size * 100)).alias(f"h{m}") for m in spans),
    )
    result = rounded.groupBy("first_month").agg(
        F.sum("customers").alias("customers"),
        *((F.rint(F.sum(F.col(f"h{m}") * size) / F.sum(size)) / 100).alias(f"after_{m}") for m in spans),
    )
    kind = F.when(F.col("first_month") == GRAND_TOTAL_LABEL, F.lit("total")).otherwise(F.lit("cohort"))
    return result.withColumn("row_kind", kind).orderBy("row_kind", "first_month")


def cohort_display(table: DataFrame) -> DataFrame:
    """Text form of the retention table."""
    shares = [c for c in table.columns if c.startswith("after_")]
    return display(table, integers=["customers"], percents=shares)
