"""Row selection: date range, dimension filters and their options."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from datetime import date, datetime, timedelta
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillview.functions.text import is_option, strip
from tillview.schema import ALL, PARENTS, POSITION, Filters, require


def timestamp_literal(day: date | datetime) -> Column:
    """A literal without time zone, so comparisons reach the parquet reader."""
    return F.lit(day.isoformat(" ") if isinstance(day, datetime) else f"{day.isoformat()} 00:00:00").cast(
        "timestamp_ntz"
    )


def in_date_range(lo: date | None, hi: date | None, end_inclusive_day: bool = False) -> Column:
    """Rows from midnight of ``lo`` to midnight of ``hi``, both included.

    Later times on the end date fall outside unless ``end_inclusive_day``.
    """
    when = F.col("order_ts")
    condition = F.lit(True)
    if lo is not None:
        condition = condition & (when >= timestamp_literal(lo))
    if hi is not None and end_inclusive_day:
        condition = condition & (when < timestamp_literal(hi + timedelta(days=1)))
    elif hi is not None:
        condition = condition & (when <= timestamp_literal(hi))
    return condition


def date_range(
    df: DataFrame, lo: date | None, hi: date | None, end_inclusive_day: bool = False
) -> DataFrame:
    return df.filter(in_date_range(lo, hi, end_inclusive_day))


def date_bounds(df: DataFrame) -> DataFrame:
    """First and last calendar date of the data, one row."""
    return df.agg(
        F.min("order_ts").cast("date").alias("start"), F.max("order_ts").cast("date").alias("end")
    )


def selected_values(values: Sequence[str]) -> list[str]:
    """Trimmed choice; empty when it stands for "All"."""
    trimmed = sorted({v.strip() for v in values})
    return [] if ALL in trimmed else trimmed


def matches(name: str, values: Sequence[str]) -> Column:
    """Rows of a resolved choice: one of the values, or any option for "All"."""
    chosen = selected_values(values)
    return F.col(name).isin(chosen) if chosen else is_option(F.col(name))


def _check_parents(df: DataFrame, dimensions: Sequence[str]) -> None:
    for child in dimensions:
        if child in df.columns:
            require(df, *PARENTS.get(child, ()))


def filter_condition(df: DataFrame, filters: Filters) -> Column:
    """The resolved filters as one condition on the row alone."""
    _check_parents(df, filters.dimensions)
    condition = in_date_range(filters.start, filters.end, filters.end_inclusive_day)
    for name in filters.dimensions:
        if name in df.columns:
            condition = condition & matches(name, getattr(filters, name))
    return condition


def resolve_filters(df: DataFrame, filters: Filters, with_start: bool = True) -> Filters:
    """Fill in default dates and drop choices that are not among the options.

    A choice of which nothing is left stands for "All". Options of a dimension
    depend on what its parents resolved to, so each is looked up under every
    outcome its parents may have; all of it is one aggregate with one row, whose
    size is bounded by the caller's lists. Without choices and with both dates
    given there is nothing to look up and no job runs. A missing start excludes no
    row; ``with_start=False`` leaves it open for callers that need no date.
    """
    _check_parents(df, filters.dimensions)
    wanted = {}
    for name in filters.dimensions:
        chosen = selected_values(getattr(filters, name))
        if chosen and name in df.columns:
            wanted[name] = chosen
    lookups = []
    if filters.start is None and with_start:
        lookups.append(F.min("order_ts").cast("date").alias("start"))
    if filters.end is None:
        lookups.append(F.max("order_ts").cast("date").alias("end"))

    def outcomes(parent: str) -> list[bool]:
        return [True, False] if parent in wanted else [False]

    def label(name: str, kept: Sequence[bool]) -> str:
        return "_".join([name, *(str(int(k)) for k in kept)])

    for name, chosen in wanted.items():
        parents = PARENTS.get(name, ())
        value = strip(F.col(name))
        for kept in product(*(outcomes(p) for p in parents)):
            found = value.isin(chosen)
            for parent, is_kept in zip(parents, kept):
                found = found & matches(parent, wanted[parent] if is_kept else ())
            lookups.append(F.collect_set(F.when(found, value)).alias(label(name, kept)))
    if not lookups:
        return filters

    row = df.agg(*lookups).first()
    resolved: dict[str, tuple[str, ...]] = {}
    for name in ("doc_type", "brand", "region", "store", "phone_status", "name_check"):
        if name in wanted:
            kept = [bool(resolved.get(p)) for p in PARENTS.get(name, ())]
            resolved[name] = tuple(sorted(row[label(name, kept)]))
        elif name in filters.dimensions:
            resolved[name] = ()
    dates = {n: row[n] for n in ("start", "end") if n in row and getattr(filters, n) is None}
    return replace(filters, **resolved, **dates)


def apply_filters(df: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Rows inside the date range whose dimensions are all selected."""
    resolved = resolve_filters(df, filters, with_start=False)
    return df.filter(filter_condition(df, resolved))


def filtered_rows(df: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """The selected rows with all the columns of their input, as a raw view."""
    return apply_filters(df, filters).drop(POSITION)


def option_values(
    df: DataFrame, name: str, parents: Mapping[str, Sequence[str]] | None = None, trimmed: bool = True
) -> DataFrame:
    """Distinct values offered for a column, sorted, under its chosen parents."""
    require(df, name, *(parents or {}))
    rows = df
    for parent, values in (parents or {}).items():
        rows = rows.filter(matches(parent, values))
    value = strip(F.col(name)) if trimmed else F.col(name)
    return (
        rows.filter(F.col(name).isNotNull()).select(value.alias("value")).distinct().orderBy("value")
    )


def resolve_selection(
    df: DataFrame, name: str, values: Sequence[str], parents: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """The options among ``values``, or every option when none is left.

    What is looked up is bounded by ``values``.
    """
    options = option_values(df, name, parents)
    chosen = selected_values(values)
    kept = options.filter(F.col("value").isin(chosen))
    return options if not chosen or kept.isEmpty() else kept
