import pytest
from rows import sales, values

from tillview.plans.cohort import cohort_retention, customer_cohorts
from tillview.schema import CohortParams

ROWS = [
    ("2024-01-05", "once"),
    ("2024-01-06", "once"),
    ("2024-01-31 23:00:00", "next"),
    ("2024-02-01", "next"),
    ("2024-01-05", "third"),
    ("2024-04-05", "third"),
    ("2024-05-05", "third"),
    ("2024-03-05", "late"),
    ("2025-01-05", "late"),
    ("2024-01-01", None),
]


def test_retention(spark):
    df = sales(spark, ROWS, "order_ts", "phone")
    got = cohort_retention(df, CohortParams(months=12)).collect()
    assert [(r.first_month, r.customers, r.row_kind) for r in got] == [
        ("2024-01", 3, "cohort"),
        ("2024-03", 1, "cohort"),
        ("Grand Total", 4, "total"),
    ]
    first, march, total = got
    assert [first[f"after_{m}"] for m in range(1, 5)] == [33.33, 33.33, 66.67, 66.67]
    assert [march[f"after_{m}"] for m in (1, 9, 10, 12)] == [0, 0, 100, 100]
    assert [total[f"after_{m}"] for m in (1, 3, 10)] == [25, 50, 75]


def test_retention_never_falls(spark):
    df = sales(spark, ROWS, "order_ts", "phone")
    for row in cohort_retention(df).collect():
        shares = [row[f"after_{m}"] for m in range(1, 8)]
        assert shares == sorted(shares)


def test_no_customers(spark):
    assert cohort_retention(sales(spark, ROWS[-1:], "order_ts", "phone")).collect() == []


@pytest.mark.parametrize("phone, after", [("once", None), ("next", 1), ("third", 3), ("late", 10)])
def test_first_return(spark, phone, after):
    df = sales(spark, [r for r in ROWS if r[1] == phone], "order_ts", "phone")
    assert values(customer_cohorts(df), "returned_after") == [after]
