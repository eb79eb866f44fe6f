from datetime import date

import pytest
from rows import sales, values

from tillview.operators.filters import (
    apply_filters,
    date_bounds,
    date_range,
    filtered_rows,
    option_values,
    resolve_filters,
    resolve_selection,
)
from tillview.schema import REVENUE_DIMENSIONS, Filters

DIRTY = [None, " A", "A", "A ", "　B", "B", "", "\x1cC", "C\x85", " "]


def test_all_keeps_present_trimmed_values(spark):
    df = sales(spark, [("2024-01-05", v) for v in DIRTY], "order_ts", "brand")
    options = {v.strip() for v in DIRTY if v is not None}
    assert values(option_values(df, "brand"), "value") == sorted(options)
    assert sorted(values(apply_filters(df), "brand")) == sorted(
        v for v in DIRTY if v is not None and v in options
    )


def test_options_can_stay_untrimmed(spark):
    df = sales(spark, [("2024-01-05", v) for v in ("b ", "a", None)], "order_ts", "store")
    assert values(option_values(df, "store", trimmed=False), "value") == ["a", "b "]


def test_end_of_day(spark):
    df = sales(
        spark,
        [("2024-01-04 23:59:59",), ("2024-01-05",), ("2024-01-06",), ("2024-01-06 10:00:00",), ("2024-01-07",)],
        "order_ts",
    )
    lo, hi = date(2024, 1, 5), date(2024, 1, 6)
    assert [t.day for t in values(date_range(df, lo, hi), "order_ts")] == [5, 6]
    assert [t.day for t in values(date_range(df, lo, hi, end_inclusive_day=True), "order_ts")] == [5, 6, 6]
    assert values(date_bounds(df), "start", "end") == [(date(2024, 1, 4), date(2024, 1, 7))]


def test_default_end_is_midnight_of_the_last_day(spark):
    df = sales(spark, [("2024-01-05 08:00:00",), ("2024-01-06",), ("2024-01-06 10:00:00",)], "order_ts")
    assert len(apply_filters(df).collect()) == 2


CASCADE = [
    ("2024-01-05", "A", "North", "S1"),
    ("2024-01-05", "A", "South", "S2"),
    ("2024-01-05", "B", "East", "S3"),
    ("2024-01-05", "B", " East", "S4"),
]


@pytest.mark.parametrize(
    "filters, stores",
    [
        (Filters(), ["S1", "S2", "S3"]),
        (Filters(brand=("A",)), ["S1", "S2"]),
        (Filters(brand=("A", "All")), ["S1", "S2", "S3"]),
        (Filters(brand=("Z",)), ["S1", "S2", "S3"]),
        (Filters(brand=("A",), region=("East",)), ["S1", "S2"]),
        (Filters(brand=("A",), region=("East", " South ")), ["S2"]),
        (Filters(brand=("B",), region=("East",), store=("S1",)), ["S3"]),
        (Filters(brand=("Z",), region=("North",), store=("S1", "S2")), ["S1"]),
        (Filters(store=("S4",)), ["S1", "S2", "S3"]),
    ],
)
def test_cascade(spark, filters, stores):
    df = sales(spark, CASCADE, "order_ts", "brand", "region", "store")
    assert sorted(values(apply_filters(df, filters), "store")) == stores


def test_resolve_needs_no_job_when_nothing_is_open(spark):
    df = sales(spark, CASCADE, "order_ts", "brand", "region", "store")
    filters = Filters(start=date(2024, 1, 1), end=date(2024, 1, 31))
    assert resolve_filters(df, filters) is filters


def test_selection(spark):
    df = sales(spark, CASCADE, "order_ts", "brand", "region", "store")
    assert values(resolve_selection(df, "region", ("East", "West")), "value") == ["East"]
    assert values(resolve_selection(df, "region", ("East",), {"brand": ("A",)}), "value") == ["North", "South"]
    assert values(resolve_selection(df, "region", ("All",), {"brand": ("A",)}), "value") == ["North", "South"]


def test_parent_must_exist(spark):
    df = sales(spark, [("2024-01-05", "North")], "order_ts", "region")
    with pytest.raises(ValueError, match="brand"):
        apply_filters(df)


def test_absent_columns_are_not_filtered(spark):
    df = sales(spark, [("2024-01-05", "x", "ok")], "order_ts", "doc_type", "phone_status")
    assert filtered_rows(df).columns == df.columns
    assert apply_filters(df, Filters(phone_status=("bad",), dimensions=REVENUE_DIMENSIONS)).count() == 1
