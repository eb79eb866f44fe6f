"""Text forms of numbers and dates, for exports and small report outputs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def integer_text(col: Column) -> Column:
    """Thousands-separated whole number; null gives an empty string."""
    return F.coalesce(F.format_number(col.cast("double"), 0), F.lit(""))


def number_text(col: Column, decimals: int = 2) -> Column:
    """Thousands-separated number; null gives an empty string."""
    return F.coalesce(F.format_number(col.cast("double"), decimals), F.lit(""))


def percent_text(col: Column, decimals: int = 2, signed: bool = False) -> Column:
    """Percent, with a leading plus for positive values when ``signed``."""
    value = col.cast("double")
    text = F.concat(F.format_number(value, decimals), F.lit("%"))
    if signed:
        text = F.when(value > 0, F.concat(F.lit("+"), text)).otherwise(text)
    return F.coalesce(text, F.lit(""))


def date_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def display(
    df: DataFrame,
    integers: Iterable[str] = (),
    percents: Iterable[str] = (),
    signed_percents: Iterable[str] = (),
    dates: Iterable[str] = (),
) -> DataFrame:
    """Replace the named columns by their text form; absent names are ignored."""
    texts = {c: integer_text(F.col(c)) for c in integers}
    texts.update({c: percent_text(F.col(c)) for c in percents})
    texts.update({c: percent_text(F.col(c), signed=True) for c in signed_percents})
    texts.update({c: date_text(F.col(c)) for c in dates})
    return df.withColumns({c: e for c, e in texts.items() if c in df.columns})
