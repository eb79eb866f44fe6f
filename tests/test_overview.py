from datetime import date

import pytest
from rows import sales, values

from tillview.plans.daily import count_days, kpis_of_days, trend_of_days
from tillview.plans.overview import kpis, product_summary, region_time, store_summary, time_trend
from tillview.schema import Period, ProductParams

BASE = ("order_ts", "gross", "net", "doc_no", "phone")
GAPS = [
    ("2024-01-05 09:00:00", 10, 8, "d1", "p1"),
    ("2024-01-07", 10, 9, "d2", "p1"),
    ("2024-04-01", 20, 20, "d3", "p2"),
    ("2024-12-30", 30, 15, "d4", None),
]


@pytest.mark.parametrize("grain, rows", [("day", 361), ("month", 12), ("quarter", 4), ("year", 1)])
def test_empty_periods_are_filled(spark, grain, rows):
    got = time_trend(sales(spark, GAPS, *BASE), Period(grain)).collect()
    assert len(got) == rows
    assert sum(r.net for r in got) == 52 and sum(r.gross for r in got) == 70
    assert all(r.net == r.orders == r.customers == 0 for r in got if r.gross == 0)
    assert [r.prev_net for r in got] == [None, *(r.net for r in got)][:-1]


def test_month_trend_values(spark):
    got = {r.label: r for r in time_trend(sales(spark, GAPS, *BASE), Period("month")).collect()}
    january, february, april = got["2024-01"], got["2024-02"], got["2024-04"]
    assert (january.period, january.orders, january.customers) == (date(2024, 1, 31), 2, 1)
    assert january.discount_pct == pytest.approx(15) and january.growth_pct == 0
    assert (february.growth_pct, february.discount_pct) == (-100, 0)
    assert (april.growth_pct, april.prev_net) == (0, 0)
    assert got["2024-12"].customers == 0


def test_weeks_are_not_filled(spark):
    df = sales(spark, GAPS, *BASE)
    monday = values(time_trend(df, Period("week")), "label", "period")
    assert monday == [
        ("Tuần 01/2024", date(2024, 1, 1)),
        ("Tuần 14/2024", date(2024, 4, 1)),
        ("Tuần 01/2025", date(2024, 12, 30)),
    ]
    sunday = values(time_trend(df, Period("week", 6)), "period")
    assert sunday == [date(2023, 12, 31), date(2024, 1, 7), date(2024, 3, 31), date(2024, 12, 29)]


def test_growth_needs_a_positive_previous_value(spark):
    rows = [("2024-01-01", 0, 0), ("2024-02-01", 10, -5), ("2024-03-01", -4, 6), ("2024-04-01", 8, 9)]
    df = sales(spark, [(*r, "d", "p") for r in rows], *BASE)
    got = time_trend(df, Period("month")).collect()
    assert [r.growth_pct for r in got] == [0, 0, 0, 50]
    assert [r.discount_pct for r in got] == [0, pytest.approx(150), 0, pytest.approx(-12.5)]


def test_kpis_equal_trend_totals_and_allow_absent_columns(spark):
    df = sales(spark, GAPS, *BASE)
    row = kpis(df).first()
    assert (row.gross, row.net, row.orders, row.customers) == (70, 52, 4, 2)
    assert row.discount_pct == pytest.approx((1 - 52 / 70) * 100)
    bare = kpis(df.select("order_ts", "gross")).first()
    assert (bare.gross, bare.net, bare.orders, bare.customers) == (70, 0, 0, 0)
    assert kpis(df.filter("false")).first().gross == 0


def test_region_time_sorts_weeks_by_time(spark):
    rows = [
        ("2024-12-27", 1, 1, "a", "p", "N"),
        ("2024-12-30", 1, 2, "b", "p", None),
        ("2024-12-30", 1, 3, "c", "p", "S"),
    ]
    got = values(region_time(sales(spark, rows, *BASE, "region"), Period("week")), "label", "region")
    assert got == [("Tuần 52/2024", "N"), ("Tuần 01/2025", "S"), ("Tuần 01/2025", None)]


def test_store_ties_are_ordered_by_name(spark):
    rows = [("2024-01-01", 5, 5, "d", "p", s) for s in ("b", "a", None)]
    df = sales(spark, [*rows, ("2024-01-01", 9, 9, "d", "p", "z")], *BASE, "store")
    assert values(store_summary(df), "store") == ["z", None, "a", "b"]


def test_products(spark):
    rows = [
        ("2024-01-01", 5, 5, "d1", "p1", "x", "g1", 2),
        ("2024-01-01", 5, 5, "d1", "p2", "x", "g1", 3),
        ("2024-01-01", 1, 1, "d2", "p2", None, "g2", None),
    ]
    df = sales(spark, rows, *BASE, "product_code", "product_group", "quantity")
    assert values(product_summary(df), "product_code", "orders", "customers") == [("x", 5, 2), (None, 0, 1)]
    assert values(product_summary(df.drop("quantity")), "orders") == [1, 1]
    assert values(product_summary(df, ProductParams(product_group=("g2",))), "product_code") == [None]
    assert values(product_summary(df, ProductParams(product_code=("x",))), "product_code") == ["x"]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="store"):
        store_summary(sales(spark, GAPS, *BASE))


def test_session_time_zone_does_not_matter(spark):
    rows = [("2024-03-10 02:30:00", 1, 1, "a", "p"), ("2024-03-31 23:59:59", 2, 2, "b", "p")]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = values(time_trend(sales(spark, rows, *BASE), Period("day")), "label", "net")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert len(got) == 22 and got[0] == ("2024-03-10", 1) and got[-1] == ("2024-03-31", 2)


def test_floating_point_amounts(spark):
    df = sales(spark, GAPS, *BASE)
    floats = df.withColumns({c: df[c].cast("double") for c in ("gross", "net")})
    assert kpis(floats).collect() == kpis(df).collect()
    assert time_trend(floats, Period("month")).collect() == time_trend(df, Period("month")).collect()


def test_days_merge_to_any_period(spark):
    """Distinct counts of every grain and range from the same stored days, empty ones and no days included."""
    rows = [(f"2024-0{1 + i % 5}-{1 + i % 28:02} 10:00:00", i % 7, i % 5, f"d{i % 40}", f"p{i % 13}" if i % 3 else None) for i in range(200)]
    df = sales(spark, rows, "order_ts", "gross", "net", "doc_no", "phone")
    days = count_days(df)
    assert kpis_of_days(days).collect() == kpis(df).collect()
    some = df.where("order_ts >= timestamp_ntz'2024-02-03' AND order_ts < timestamp_ntz'2024-04-02'")
    assert kpis_of_days(days, date(2024, 2, 3), date(2024, 4, 1)).collect() == kpis(some).collect()
    for period in (Period("day"), Period("week", 6), Period("month"), Period("quarter"), Period("year")):
        assert trend_of_days(days, period).collect() == time_trend(df, period).collect()
    nothing = count_days(df.limit(0))
    assert kpis_of_days(nothing).collect() == kpis(df.limit(0)).collect()
    assert trend_of_days(nothing).collect() == []


def test_bitmaps_expand_nothing_and_do_not_read_sales(spark):
    df = sales(spark, [("2024-01-05", 1, 1, "d", "p")], "order_ts", "gross", "net", "doc_no", "phone")
    text = trend_of_days(count_days(df))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in text and "bitmap_or_agg" in text and "doc_no" not in text and "phone" not in text
