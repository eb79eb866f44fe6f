"""Sums, distinct counts, rates and rounding shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(name: str) -> Column:
    """Exact sum; a group of nulls sums to zero."""
    return F.coalesce(F.sum(name), F.lit(0))


def money(name: str) -> Column:
    """Sum as DOUBLE, cast once at the end so the order of rows cannot matter."""
    return total(name).cast("double").alias(name)


def distinct(name: str, alias: str) -> Column:
    return F.count_distinct(F.col(name)).alias(alias)


def sales_totals() -> list[Column]:
    """Gross, net, orders and customers of a group."""
    return [money("gross"), money("net"), distinct("doc_no", "orders"), distinct("phone", "customers")]


def discount_from_ratio(gross: Column, net: Column) -> Column:
    """(1 - net/gross)*100 where gross is positive, else 0."""
    return F.when(gross > 0, (1 - F.try_divide(net, gross)) * 100).otherwise(F.lit(0.0))


def discount_from_difference(gross: Column, net: Column) -> Column:
    """(gross - net)/gross*100 where gross is positive, else 0."""
    return F.when(gross > 0, F.try_divide(gross - net, gross) * 100).otherwise(F.lit(0.0))


def discount_any_sign(gross: Column, net: Column) -> Column:
    """100*(1 - net/gross), 0 only where gross is 0."""
    return F.when(gross != 0, 100 * (1 - F.try_divide(net, gross))).otherwise(F.lit(0.0))


def discount_unguarded(gross: Column, net: Column) -> Column:
    """(gross - net)/gross*100, null where gross is 0."""
    return F.try_divide(gross - net, gross) * 100


def growth_or_zero(now: Column, before: Column) -> Column:
    """Growth in percent; 0 when there is no positive value before."""
    return F.when(before > 0, F.try_divide(now - before, before) * 100).otherwise(F.lit(0.0))


def change_or_null(now: Column, before: Column) -> Column:
    """Change in percent; null when the value before is missing or 0."""
    return F.when(before != 0, F.try_divide(now - before, before) * 100)


def hundredths(col: Column) -> Column:
    """``col`` in hundredths, rounded half to even on the scaled double."""
    return F.rint(col * 100).cast("long")


def round_scaled(col: Column) -> Column:
    """Two decimals by scaling, rounding half to even and scaling back."""
    return F.rint(col * 100) / 100


def round_exact(col: Column) -> Column:
    """Two decimals by the exact binary value of the double, ties to even."""
    return F.replace(F.format_number(col, 2), F.lit(","), F.lit("")).cast("double")
