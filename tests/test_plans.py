"""What the plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from tillview.catalog.queries import QUERIES
from tillview.catalog.tables import sales_table
from tillview.operators.filters import filter_condition, resolve_filters
from tillview.plans import customers
from tillview.plans.customers import customer_types, first_purchase, join_first_purchase
from tillview.plans.overview import kpis, store_summary, time_trend
from tillview.plans.pareto import pareto_customers
from tillview.plans.revenue import region_period, top_bottom_stores
from tillview.schema import Filters, Period
from tillview.sources.reader import read_sales
from tillview.sources.staging import stage

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The sales table written once, as a user would have it."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    path = str(tmp_path_factory.mktemp("sales") / "sales")
    sales_table(spark, SF_DIR).write.parquet(path)
    return spark.read.parquet(path)


PERIOD_ROWS = ("trend", "revenue", "periods")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_no_cross_join_and_windows_are_grouped(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text
    first_terms = [m.split(",")[0] for m in re.findall(r"windowspecdefinition\((.*?)\)", text)]
    ungrouped = [t for t in first_terms if " ASC" in t or " DESC" in t or "specifiedwindowframe" in t]
    assert not ungrouped or name.startswith(PERIOD_ROWS)


def test_date_bounds_and_columns_reach_the_scan(stored):
    filters = resolve_filters(stored, Filters(brand=("Brand#11",)))
    text = plan(kpis(stored.filter(filter_condition(stored, filters))))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "GreaterThanOrEqual(order_ts" in pushed and "LessThanOrEqual(order_ts" in pushed
    assert "EqualTo(brand,Brand#11)" in pushed
    schema = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
    assert "quantity" not in schema and "product_code" not in schema


def test_trend_reads_sales_once(stored):
    assert plan(time_trend(stored, Period("day"))).count("FileScan") == 1


def test_customer_types_joins_nothing(stored):
    text = plan(customer_types(stored))
    assert "Join" not in text and text.count("FileScan") == 1


def test_a_chosen_period_bounds_the_scan(stored):
    text = plan(region_period(stored, Period("quarter"), 1998, 2))
    assert "LessThan(order_ts,1998-07-01T00:00" in text


def test_top_stores_keep_only_the_best(stored):
    assert "TakeOrderedAndProject" in plan(top_bottom_stores(stored, Period("month")))


@pytest.mark.parametrize("columns", ["order_ts phone doc_no gross", "phone"])
def test_rows_of_a_busy_phone_are_spread(spark, columns):
    """A third of the rows on one phone and a third on none: no task gets either, equal rows or not."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        lines = sales_table(spark, "/root/testdata/sf0.01", "order_ts phone doc_no gross").repartition(8)
        third = F.crc32("doc_no") % 3
        every = lines.withColumn(
            "phone", F.when(third == 0, F.lit("hot")).when(third == 1, F.col("phone"))
        ).cache()
        first, rows = first_purchase(every), every.select(*columns.split())
        joined = join_first_purchase(rows, first).cache()
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 0.2 * rows.count()
        plain = rows.join(first, "phone", "left").select(joined.columns)
        assert joined.exceptAll(plain).count() == plain.exceptAll(joined).count() == 0
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_the_customer_list_reads_lines_once(spark, stored, monkeypatch):
    """Lines are read to write the customers down; list, facts and total read those."""
    written = []

    def noted(df, label):
        written.append(plan(df))
        return stage(df, label)

    monkeypatch.setattr(customers, "stage", noted)
    params = customers.CustomerParams(phone_status=("valid",), name_check=("BUILDING",))
    source = stored.inputFiles()[0].rsplit("/", 1)[0]
    for report in (customers.customer_list, customers.customer_list_with_total):
        written.clear()
        listed = report(stored, params)
        assert [text.count("FileScan") for text in written] == [1]
        assert all(source not in file for file in listed.inputFiles())


def test_lines_of_customers_are_not_sorted(stored):
    """Texts are keys of the first aggregate, which hashes; only documents are sorted for first values."""
    lines = plan(customers._documents(stored, ["phone", "store"]))
    assert "SortAggregate" not in lines and "min_by" not in lines and lines.count("HashAggregate") == 2


def test_region_period_counts_two_periods(stored):
    text = plan(region_period(stored, Period("month")))
    lines = text.splitlines()
    expand = next(i for i, line in enumerate(lines) if "Expand" in line)
    assert any("Join" in line for line in lines[expand:])  # rows are picked before they are expanded


def test_distinct_counts_are_shuffled_by_value(stored):
    """A hot store or phone is spread by the values counted, not held by one task."""
    by_store = plan(store_summary(stored))
    assert re.search(r"hashpartitioning\(store#\d+, (doc_no|phone)#\d+, (doc_no|phone)#\d+, gid#\d+", by_store)
    by_customer = plan(customers._documents(stored, ["phone", "store"]))
    assert re.search(r"hashpartitioning\(phone#\d+, store#\d+, doc_no#\d+", by_customer)


def test_a_report_on_read_files_joins_nothing(spark, tmp_path):
    stored = sales_table(spark, SF_DIR)
    stored.write.parquet(str(tmp_path / "lines"))
    text = plan(kpis(read_sales(spark, str(tmp_path / "lines"), positions=False)))
    assert "Join" not in text and "_metadata" not in text and "file_path" not in text


def test_pareto_holds_no_store_in_one_task(stored):
    text = plan(pareto_customers(stored))
    assert "rangepartitioning(block" in text
    assert not re.search(r"windowspecdefinition\(store#\d+, net", text)


def test_rows_of_a_file_are_not_gathered(spark, tmp_path):
    """The list of files is broadcast whatever its estimated size, so no task gets all rows of a file."""
    path = str(tmp_path / "lines")
    sales_table(spark, SF_DIR).coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        read = read_sales(spark, path)
        text = plan(read)
        assert "SortMergeJoin" not in text and "hashpartitioning(__path" not in text
        assert read.select("source_position.row").distinct().count() == read.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_of_a_region_are_not_gathered(spark, stored):
    """The periods of the regions are broadcast whatever their estimated size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(region_period(stored, Period("month")))
        assert "SortMergeJoin" not in text and "ShuffledHashJoin" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
