from datetime import date, datetime

import pytest
from rows import sales, values

from tillview.plans import customers
from tillview.plans.customers import (
    build_customers,
    customer_columns,
    customer_count,
    customer_display,
    customer_list,
    customer_list_with_total,
    customer_types,
    first_purchase,
    join_first_purchase,
    new_vs_returning,
)
from tillview.schema import CustomerParams, Filters
from tillview.sources.reader import read_sales
from tillview.sources.staging import stage

BASE = (
    "order_ts", "gross", "net", "doc_no", "phone", "store", "customer_name", "name_check", "phone_status",
)
EVERYONE = CustomerParams(per_store=False, show_inactive=True, show_vip=True, vip_net=100)


def row(ts, net, doc, phone, store="s", name="n", check="ok", status="valid", gross=None):
    return (ts, net if gross is None else gross, net, doc, phone, store, name, check, status)


def table(spark, rows):
    return sales(spark, rows, *BASE)


def test_days_are_whole_24_hours(spark):
    df = table(spark, [row("2024-01-01 01:00:00", 1, "a", "p1"), row("2024-01-03 00:00:00", 1, "b", None)])
    got = build_customers(df).collect()
    assert [(r.phone, r.days_inactive) for r in got] == [("p1", 1)]


def test_first_present_value(spark):
    df = table(
        spark,
        [
            row("2024-01-01", 1, "a", "p1", name=None, check="late", status=None),
            row("2024-01-02", 1, "b", "p1", name="second", check="later"),
            row("2024-01-03", 1, "c", "p1", name="third", status="invalid"),
        ],
    )
    got = build_customers(df).first()
    assert (got.customer_name, got.name_check, got.phone_status) == ("second", "late", "valid")
    assert (got.orders, got.first_order, got.last_order) == (3, datetime(2024, 1, 1), datetime(2024, 1, 3))


def test_first_present_value_follows_files(spark, tmp_path):
    path = str(tmp_path / "sales")
    rows = [row("2024-01-03", 1, "c", "p1", name=None), row("2024-01-02", 1, "b", "p1", name="file first"),
            row("2024-01-01", 1, "a", "p1", name="time first")]
    table(spark, rows).coalesce(1).write.parquet(path)
    assert build_customers(read_sales(spark, path)).first().customer_name == "file first"


def test_tags(spark):
    rows = [
        row("2024-06-30", 1, "a", "regular"),
        row("2024-06-30", 100, "b", "vip"),
        row("2024-01-01", 500, "c", "gone"),
        row("2024-06-30", -1, "d", "negative"),
        row("2024-06-30", 50, "e", None),
    ]
    got = customer_list(table(spark, rows), EVERYONE).collect()
    assert [(r.phone, r.tag, r.days_without_order) for r in got] == [
        ("gone", "KH Inactive", 181),
        ("vip", "KH VIP", None),
        ("regular", "Khách hàng", None),
    ]
    shown = CustomerParams(per_store=False, vip_net=100, show_vip=True, show_regular=False)
    assert values(customer_list(table(spark, rows), shown), "phone") == ["vip"]
    nothing = CustomerParams(per_store=False, show_regular=False)
    assert customer_list(table(spark, rows), nothing).count() == 3


def test_discount_and_stores(spark):
    rows = [row("2024-01-01", 2, "a", "p", "s1", gross=3), row("2024-01-01", 1, "b", "p", "s2", gross=0),
            row("2024-01-01", 1, "b", "p", None)]
    got = customer_list(table(spark, rows)).collect()
    assert [(r.store, r.discount_pct) for r in got] == [("s1", 33.33), ("s2", 0)]
    assert customer_count(customer_list(table(spark, rows))).first().customers == 1


STATUS = [
    row("2024-01-01", 5, "a", "p1", status="valid", check="x"),
    row("2024-01-01", 4, "b", "p2", status=" valid", check="x"),
    row("2024-01-01", 3, "c", "p3", status=None, check="y"),
    row("2024-01-01", 2, "d", "p4", status="invalid", check=None),
]


@pytest.mark.parametrize(
    "choice, phones",
    [
        ({}, ["p1"]),
        ({"phone_status": ("invalid",)}, []),
        ({"phone_status": ("none such",)}, ["p1"]),
        ({"phone_status": ("valid", "invalid"), "name_check": ("x", "none such")}, ["p1"]),
        ({"name_check": ("y",)}, []),
    ],
)
def test_list_filters(spark, choice, phones):
    assert values(customer_list(table(spark, STATUS), CustomerParams(**choice)), "phone") == phones


def test_no_options_means_no_filter(spark):
    rows = [row("2024-01-01", 5, "a", "p1", status=None, check=None)]
    assert customer_list(table(spark, rows)).count() == 1
    assert customer_list(table(spark, rows), CustomerParams(phone_status=("valid",))).count() == 1


def test_sorting_puts_missing_values_last(spark):
    rows = [row("2024-06-30", 1, "a", "p1"), row("2024-01-01", 1, "b", "p2"), row("2024-02-01", 1, "c", "p3")]
    for ascending, phones in ((True, ["p3", "p2", "p1"]), (False, ["p2", "p3", "p1"])):
        params = CustomerParams(per_store=False, show_inactive=True, sort_by="days_without_order", ascending=ascending)
        assert values(customer_list(table(spark, rows), params), "phone") == phones


def test_total_row(spark):
    rows = [row("2024-01-01", 75, "a", "p1", gross=100), row("2024-01-01", 5, "b", "p2", gross=10)]
    listed = customer_list_with_total(table(spark, rows), EVERYONE)
    total = listed.collect()[-1]
    assert (total.row_kind, total.phone, total.customer_name, total.last_order) == ("total", "TỔNG", "", None)
    assert (total.gross, total.net, total.orders, total.discount_pct) == (110, 80, 2, 37.5)
    shown = customer_display(listed, per_store=False)
    assert shown.columns == customer_columns(per_store=False)
    assert values(shown, "phone", "net", "discount_pct", "days_without_order", "last_order") == [
        ("p1", "75", "25.00%", "", "2024-01-01"),
        ("p2", "5", "50.00%", "", "2024-01-01"),
        ("TỔNG", "80", "37.50%", "", None),
    ]


def test_new_and_returning(spark):
    rows = [
        row("2024-01-01", 1, "a", "old"),
        row("2024-02-05", 1, "b", "old"),
        row("2024-02-01", 1, "c", "new"),
        row("2024-03-05", 1, "d", "later"),
        row("2024-02-05", 1, "e", None),
    ]
    df = table(spark, rows).drop("store", "phone_status")
    filters = Filters(start=date(2024, 2, 1), end=date(2024, 2, 29))
    assert values(new_vs_returning(df, filters), "customer_type", "customers") == [("KH mới", 1), ("KH quay lại", 1)]
    types = {r.phone: (r.first_date, r.customer_type) for r in customer_types(df, filters).collect()}
    assert types == {
        "old": (datetime(2024, 1, 1), "KH quay lại"),
        "new": (datetime(2024, 2, 1), "KH mới"),
        None: (None, "KH quay lại"),
    }
    only_unknown = Filters(start=date(2024, 2, 2), end=date(2024, 2, 4))
    assert new_vs_returning(df, only_unknown).collect() == []
    unknown = df.filter("phone is null")
    assert values(new_vs_returning(unknown), "customer_type", "customers") == [("KH quay lại", 0)]
    joined = join_first_purchase(df, first_purchase(df))
    assert joined.count() == 5
    assert joined.filter("phone = 'old' and first_date = timestamp_ntz'2024-01-01'").count() == 2
    assert joined.filter("phone is null and first_date is null").count() == 1


def test_orders_and_first_values_over_texts_that_differ_within_a_document(spark):
    """A document counts once however its texts vary; lines without one count for amounts only."""
    rows = [
        row("2024-01-02", 1, "a", "p", name="late", check=None),
        row("2024-01-01", 2, "a", "p", name=None, check="b", status=None),
        row("2024-01-01", 4, "a", "p", name="m", check="a", status="invalid"),
        row("2024-01-01", 8, None, "p", name=None, check="0", status=None),
        row("2024-01-03", 16, None, "p", name="z"),
        row("2024-01-03", 16, "b", "p", name="z"),
    ]
    got = build_customers(table(spark, rows)).first()
    assert (got.orders, float(got.net)) == (2, 47.0)
    assert (got.customer_name, got.name_check, got.phone_status) == ("m", "0", "invalid")


def test_lines_and_customers_move_once_each(spark, monkeypatch):
    """Documents are complete where their lines meet, so they are not dealt out again."""
    written = []
    monkeypatch.setattr(customers, "stage", lambda df, label: written.append(df) or stage(df, label))
    lines = table(spark, [row("2024-01-01", 1, str(i), "p") for i in range(5)])
    assert customer_list(lines, EVERYONE).count() == 1
    text = written[0]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert text.count("hashpartitioning") == 2
