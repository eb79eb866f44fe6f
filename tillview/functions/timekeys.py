"""Period keys and labels.

A period is held as one DATE, its first day, while rows are grouped and
sorted. Year, key and label are derived from it once the rows are few.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillview.schema import WEEK_WORD, Period


def week_anchor(col: Column, week_start: int = 0) -> Column:
    """First day of the week of ``col`` when weeks begin on ``week_start``."""
    day = col.cast("date")
    return F.date_sub(day, F.pmod(F.weekday(day) - F.lit(week_start), F.lit(7)))


def iso_year(day: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), day).cast("int")


def two_digits(col: Column) -> Column:
    return F.lpad(col.cast("string"), 2, "0")


def week_label(anchor: Column) -> Column:
    """``Tuần WW/YYYY`` with the ISO week and ISO year of the anchor."""
    return F.concat(
        F.lit(WEEK_WORD + " "),
        two_digits(F.weekofyear(anchor)),
        F.lit("/"),
        iso_year(anchor).cast("string"),
    )


def period_start(col: Column, period: Period) -> Column:
    """First day of the period that holds ``col``."""
    if period.grain == "day":
        return col.cast("date")
    if period.grain == "week":
        return week_anchor(col, period.week_start)
    return F.trunc(col.cast("date"), period.grain)


def period_end(start: Column, period: Period) -> Column:
    """Date that labels a period in a trend: its last day, or the week's anchor."""
    if period.grain == "month":
        return F.last_day(start)
    if period.grain == "quarter":
        return F.last_day(F.add_months(start, 2))
    if period.grain == "year":
        return F.make_date(F.year(start), F.lit(12), F.lit(31))
    return start


def period_step(period: Period) -> Column:
    """Distance from one period to the next, for filling gaps."""
    steps = {"day": "1 day", "month": "1 month", "quarter": "3 months", "year": "1 year"}
    return F.expr(f"interval {steps[period.grain]}")


def time_label(start: Column, period: Period) -> Column:
    """``YYYY-MM-DD``, week label, ``YYYY-MM``, ``YYYYQn`` or ``YYYY``."""
    year = F.year(start).cast("string")
    if period.grain == "day":
        return F.date_format(start, "yyyy-MM-dd")
    if period.grain == "week":
        return week_label(start)
    if period.grain == "month":
        return F.date_format(start, "yyyy-MM")
    if period.grain == "quarter":
        return F.concat(year, F.lit("Q"), F.quarter(start).cast("string"))
    return year


def year_of(start: Column, period: Period) -> Column:
    return iso_year(start) if period.grain == "week" else F.year(start)


def key_of(start: Column, period: Period) -> Column:
    """Key within the year: ISO week, month or quarter; the date itself for days."""
    if period.grain == "day":
        return start
    if period.grain == "week":
        return F.weekofyear(start)
    if period.grain == "month":
        return F.month(start)
    if period.grain == "quarter":
        return F.quarter(start)
    raise ValueError("yearly periods have no key within the year")


def period_label(start: Column, period: Period) -> Column:
    """As ``time_label``, but ``Qn YYYY`` for quarters."""
    if period.grain == "quarter":
        return F.concat(
            F.lit("Q"), F.quarter(start).cast("string"), F.lit(" "), F.year(start).cast("string")
        )
    return time_label(start, period)


def add_time_key(df: DataFrame, period: Period) -> DataFrame:
    """Add ``year`` and ``key`` of the row's period."""
    start = period_start(F.col("order_ts"), period)
    return df.withColumns({"year": year_of(start, period), "key": key_of(start, period)})


def chosen_start(period: Period, year: int | None, key) -> date | None:
    """First day of the period a caller names, or None for the latest one.

    A day is named by its key alone; every other grain needs both parts.
    Raises ValueError when there is no such period.
    """
    if period.grain == "day":
        return date.fromisoformat(key) if isinstance(key, str) else key
    if year is None or key is None:
        return None
    if period.grain == "week":
        return date.fromisocalendar(year, key, 1) + timedelta(days=period.week_start)
    if period.grain == "month":
        return date(year, key, 1)
    if period.grain == "quarter":
        return date(year, 3 * key - 2, 1)
    raise ValueError("yearly periods have no key within the year")


def next_start(start: date, period: Period) -> date:
    """First day after the period that begins on ``start``."""
    if period.grain == "day":
        return start + timedelta(days=1)
    if period.grain == "week":
        return start + timedelta(days=7)
    months = {"month": 1, "quarter": 3}[period.grain]
    index = start.year * 12 + start.month - 1 + months
    return date(index // 12, index % 12 + 1, 1)
