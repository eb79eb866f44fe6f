from datetime import date

import pytest
from rows import sales, values

from tillview.plans.revenue import (
    periods,
    region_period,
    revenue_series,
    revenue_summary,
    top_bottom_stores,
)
from tillview.schema import Period

BASE = ("order_ts", "gross", "net", "doc_no", "phone")
ROWS = [
    ("2024-01-05", 0, 0, "d1", "p1"),
    ("2024-02-05", -10, -5, "d2", "p1"),
    ("2024-04-05", 10, 20, "d3", "p1"),
    ("2024-05-05", 20, 10, "d4", "p2"),
    ("2024-05-06", 20, 20, "d5", "p3"),
]


def test_comparison_with_the_previous_existing_period(spark):
    got = revenue_summary(sales(spark, ROWS, *BASE), Period("month")).collect()
    assert [r.period for r in got] == ["2024-01", "2024-02", "2024-04", "2024-05"]
    assert [r.prev_net for r in got] == [None, 0, -5, 20]
    assert [r.net_change_pct for r in got] == [None, None, -500, 50]
    assert [r.customers_change_pct for r in got] == [None, 0, 0, 100]
    assert [r.discount_pct for r in got] == [0, 50, -100, 25]


def test_day_key_is_a_date(spark):
    got = revenue_summary(sales(spark, ROWS, *BASE), Period("day")).collect()
    assert got[0].key == date(2024, 1, 5) and got[0].year == 2024


def test_series_and_periods(spark):
    df = sales(spark, ROWS, *BASE)
    series = values(revenue_series(df, Period("quarter")), "period", "series", "value")
    assert series == [("Q1 2024", "gross", -10), ("Q1 2024", "net", -5), ("Q2 2024", "gross", 50), ("Q2 2024", "net", 50)]
    assert values(periods(df, Period("quarter")), "period", "is_default") == [("Q1 2024", False), ("Q2 2024", True)]


REGIONS = [
    ("2024-01-05", 10, 10, "d1", "p1", "N"),
    ("2024-02-05", 10, 5, "d2", "p1", "N"),
    ("2024-02-06", 10, 7, "d3", "p2", "S"),
    ("2024-03-06", 10, 9, "d4", "p2", None),
]


def test_regions_of_a_period(spark):
    df = sales(spark, REGIONS, *BASE, "region")
    chosen = region_period(df, Period("month"), 2024, 2)
    assert values(chosen, "region", "prev_net", "net_change_pct") == [("S", None, None), ("N", 10, -50)]
    assert region_period(df, Period("month")).collect() == []
    known = df.filter("region is not null")
    assert values(region_period(known, Period("month"), 2024), "region") == ["S", "N"]
    assert region_period(df, Period("month"), 2024, 13).collect() == []


@pytest.fixture
def stores(spark):
    rows = [("2024-01-05", 10, i, f"s{i:02}") for i in range(12)]
    rows += [("2024-02-05", 10, i // 2, f"s{i:02}") for i in range(12)]
    return sales(spark, [*rows, ("2024-03-05", 1, 1, None)], "order_ts", "gross", "net", "store")


def test_top_and_bottom_stores(stores):
    top = top_bottom_stores(stores, Period("month"))
    assert values(top, "store")[:4] == ["s10", "s11", "s08", "s09"] and top.count() == 10
    bottom = top_bottom_stores(stores, Period("month"), top=False)
    assert values(bottom, "store", "prev", "change_pct")[:3] == [("s00", 0, None), ("s01", 1, -100), ("s02", 2, -50)]
    chosen = top_bottom_stores(stores, Period("month"), year=2024, key=1)
    assert values(chosen, "store", "prev")[0] == ("s11", None)
    assert values(top_bottom_stores(stores, Period("month"), year=2024), "period")[0] == "2024-02"
    assert values(top_bottom_stores(stores, Period("day"), key=date(2024, 1, 5)), "store")[0] == "s11"
