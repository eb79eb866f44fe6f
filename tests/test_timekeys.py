from datetime import date

import pytest
from pyspark.sql import functions as F
from rows import sales, values

from tillview.functions.timekeys import (
    add_time_key,
    chosen_start,
    next_start,
    period_end,
    period_label,
    period_start,
    time_label,
    week_anchor,
)
from tillview.schema import GRAINS, WEEKDAYS, Period

DAYS = ["2024-01-05", "2024-01-07", "2024-01-13", "2024-01-14", "2024-04-01", "2024-12-30", "2021-01-01"]


@pytest.fixture(scope="module")
def days(spark):
    return sales(spark, [(d,) for d in DAYS], "order_ts")


def labels(days, make, period):
    start = period_start(F.col("order_ts"), period)
    return values(days.select(make(start, period).alias("x")), "x")


@pytest.mark.parametrize("start", range(7))
def test_week_anchor(days, start):
    got = values(days.select(week_anchor(F.col("order_ts"), start).alias("a")), "a")
    for text, anchor in zip(DAYS, got):
        day = date.fromisoformat(text)
        assert anchor.weekday() == start and 0 <= (day - anchor).days < 7


def test_sunday_weeks(days):
    period = Period("week", WEEKDAYS["Chủ nhật"])
    got = dict(zip(DAYS, labels(days, time_label, period)))
    assert got["2024-01-07"] == got["2024-01-13"] == "Tuần 01/2024"
    assert got["2024-01-14"] == "Tuần 02/2024"
    assert got["2024-01-05"] == "Tuần 52/2023"


def test_labels(days):
    assert labels(days, time_label, Period("day"))[0] == "2024-01-05"
    assert labels(days, time_label, Period("month"))[4] == "2024-04"
    assert labels(days, time_label, Period("quarter"))[4] == "2024Q2"
    assert labels(days, period_label, Period("quarter"))[4] == "Q2 2024"
    assert labels(days, time_label, Period("year"))[6] == "2021"
    assert labels(days, period_label, Period("week"))[5:] == ["Tuần 01/2025", "Tuần 53/2020"]


def test_period_ends(days):
    assert labels(days, period_end, Period("month"))[4] == date(2024, 4, 30)
    assert labels(days, period_end, Period("quarter"))[4] == date(2024, 6, 30)
    assert labels(days, period_end, Period("year"))[4] == date(2024, 12, 31)
    assert labels(days, period_end, Period("week"))[0] == date(2024, 1, 1)


@pytest.mark.parametrize("grain", GRAINS[:4])
@pytest.mark.parametrize("week_start", [0, 6, 3])
def test_chosen_start_inverts_the_key(days, grain, week_start):
    period = Period(grain, week_start)
    keyed = add_time_key(days, period).select(
        "year", "key", period_start(F.col("order_ts"), period).alias("start")
    )
    for row in keyed.collect():
        assert chosen_start(period, row.year, row.key) == row.start
        assert next_start(row.start, period) > row.start


def test_unusual_choices():
    assert chosen_start(Period("month"), 2024, None) is None
    assert chosen_start(Period("month"), None, 3) is None
    assert chosen_start(Period("day"), None, "2024-01-05") == date(2024, 1, 5)
    with pytest.raises(ValueError):
        chosen_start(Period("month"), 2024, 13)
    with pytest.raises(ValueError):
        Period("hour")
    with pytest.raises(ValueError):
        Period("week", 7)
