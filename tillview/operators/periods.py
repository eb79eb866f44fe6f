"""Sales per period, period choice and comparison with the period before."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, time

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tillview.functions.metrics import change_or_null
from tillview.functions.timekeys import (
    chosen_start,
    key_of,
    next_start,
    period_label,
    period_start,
    year_of,
)
from tillview.operators.filters import timestamp_literal
from tillview.schema import Period


def by_period(df: DataFrame, period: Period, by: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregate per period and the columns ``by``; the period is a DATE named ``start``."""
    start = period_start(F.col("order_ts"), period).alias("start")
    return df.groupBy(*by, start).agg(*aggregates)


def period_columns(period: Period) -> list[Column]:
    """Label, year and key of a row's ``start``."""
    start = F.col("start")
    return [
        period_label(start, period).alias("period"),
        year_of(start, period).alias("year"),
        key_of(start, period).alias("key"),
    ]


def latest_start(df: DataFrame, period: Period) -> Column:
    """Start of the latest period as a scalar subquery: one narrow scan, one row."""
    latest = df.agg(period_start(F.max("order_ts"), period).alias("latest"))
    return latest.scalar()


def choose_period(df: DataFrame, period: Period, year: int | None, key) -> tuple[DataFrame, Column]:
    """Rows a report for one period needs, and the condition that picks its output.

    The comparison looks back only, so rows after the chosen period are never
    read. Without a full choice the latest period of ``df`` is taken.
    """
    try:
        start = chosen_start(period, year, key)
    except ValueError:
        return df, F.lit(False)
    if start is None:
        return df, F.col("start") == latest_start(df, period)
    end = datetime.combine(next_start(start, period), time())
    return df.filter(F.col("order_ts") < timestamp_literal(end)), F.col("start") == F.lit(start)


def compare_with_previous(df: DataFrame, names: Sequence[str], window: WindowSpec) -> DataFrame:
    """Add ``prev_x`` and ``x_change_pct`` from the row before in ``window``."""
    previous = {f"prev_{n}": F.lag(n).over(window) for n in names}
    changes = {f"{n}_change_pct": change_or_null(F.col(n), F.col(f"prev_{n}")) for n in names}
    return df.withColumns(previous).withColumns(changes)
