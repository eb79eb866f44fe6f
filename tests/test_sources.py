import datetime as dt
import logging

import pytest
from rows import sales, values

from tillview.catalog.tables import sales_table
from tillview.operators.filters import filtered_rows
from tillview.schema import POSITION, Filters
from tillview.sinks.export import write_report
from tillview.sources import files, session
from tillview.sources.reader import choose_source, normalize, read_sales
from tillview.sources.staging import check_shared, drop_staged, shared_folder, stage


def raw(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_bad_values(spark):
    df = raw(
        spark,
        [
            ("2024-01-05", "1,000", "1"),
            ("2024-01-05 10:00:00", " 12 ", "2.5"),
            ("2024-01-06", "nan", ""),
            (None, "5", "5"),
            ("yesterday", "5", "5"),
        ],
        "`Ngày` string, `Tổng_Gross` string, `Tổng_Net` string",
    )
    got = [(r.order_ts, r.gross and float(r.gross), r.net and float(r.net)) for r in normalize(df).collect()]
    assert got == [
        (dt.datetime(2024, 1, 5), None, 1.0),
        (dt.datetime(2024, 1, 5, 10), 12.0, 2.5),
        (dt.datetime(2024, 1, 6), None, None),
    ]


def test_large_amounts_stay_and_larger_ones_are_an_error(spark):
    rows = [("2024-01-05", "100000000000000"), ("2024-01-05", "1e15"), ("2024-01-05", "-123456789012345678901234.5")]
    typed = normalize(raw(spark, rows, "`Ngày` string, `Tổng_Net` string"))
    assert [str(v) for v in values(typed, "net")] == [
        "100000000000000.0000",
        "1000000000000000.0000",
        "-123456789012345678901234.5000",
    ]
    assert typed.agg({"net": "sum"}).first()[0] == sum(values(typed, "net"))
    for amount in ("1e24", "Infinity"):
        beyond = normalize(raw(spark, [("2024-01-05", amount)], "`Ngày` string, `Tổng_Net` string"))
        with pytest.raises(Exception, match="no amount of this size"):
            beyond.collect()
    wide = normalize(raw(spark, [("2024-01-05", 1e15)], "`Ngày` string, `Tổng_Net` double"))
    assert [float(v) for v in values(wide, "net")] == [1e15]


def test_double_money_has_no_nan(spark):
    df = raw(spark, [("2024-01-05", "NaN"), ("2024-01-05", "1.5")], "`Ngày` string, `Tổng_Net` string")
    typed = normalize(df, money="double")
    assert dict(typed.dtypes)["net"] == "double"
    assert values(typed, "net") == [None, 1.5]


def test_dimensions_become_text_and_other_columns_stay(spark):
    df = raw(spark, [("2024-01-05", 7, 1)], "`Ngày` string, `Brand` int, extra int")
    typed = normalize(df)
    assert dict(typed.dtypes) == {"order_ts": "timestamp_ntz", "brand": "string", "extra": "int"}


def test_date_column_is_required(spark):
    with pytest.raises(ValueError, match="no date column"):
        normalize(raw(spark, [(1,)], "x int"))


def test_typed_columns_pass_through(spark, tmp_path):
    path = str(tmp_path / "typed")
    sales(spark, [("2024-01-05", 1)], "order_ts", "net").write.parquet(path)
    plan = (
        normalize(spark.read.parquet(path))
        .filter("order_ts >= timestamp_ntz'2024-01-01'")
        ._jdf.queryExecution()
        .executedPlan()
        .toString()
    )
    assert "GreaterThanOrEqual(order_ts" in plan


@pytest.fixture
def two_files(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    raw(spark, [("2024-01-05", "A", 2.0, 1)], "`Ngày` string, `Brand` string, `Số_lượng` double, note int").write.parquet(one)
    raw(spark, [("2024-01-06", 5.0, "x")], "`Ngày` string, `Tổng_Net` double, note string").write.parquet(two)
    return one, two


def test_inputs_are_stacked_by_name(spark, two_files):
    df = read_sales(spark, list(two_files)).orderBy("order_ts")
    assert values(df, "brand", "note") == [("A", "1"), (None, "x")]
    assert [(r.quantity and float(r.quantity), r.net and float(r.net)) for r in df.collect()] == [
        (2.0, None),
        (None, 5.0),
    ]
    assert [r[POSITION]["input"] for r in df.collect()] == [0, 1]


def test_unreadable_input(spark, two_files, tmp_path, caplog):
    broken = tmp_path / "broken.parquet"
    broken.write_bytes(b"not parquet")
    with pytest.raises(Exception):
        read_sales(spark, [two_files[0], str(broken)]).collect()
    with caplog.at_level(logging.WARNING):
        df = read_sales(spark, [two_files[0], str(broken), str(tmp_path / "none")], skip_corrupt=True)
        assert df.count() == 1
    assert "cannot read" in caplog.text
    with pytest.raises(ValueError, match="none of the inputs"):
        read_sales(spark, [str(broken)], skip_corrupt=True)


def test_columns_are_merged_over_the_files_of_a_folder(spark, tmp_path, caplog):
    folder = tmp_path / "folder"
    raw(spark, [("2024-01-05", "A")], "`Ngày` string, `Brand` string").coalesce(1).write.parquet(str(folder / "a"))
    raw(spark, [("2024-01-06", 5.0)], "`Ngày` string, `Tổng_Net` double").coalesce(1).write.parquet(str(folder / "b"))
    raw(spark, [("2024-01-07", 7)], "`Ngày` string, `Brand` int").coalesce(1).write.parquet(str(folder / "c"))
    raw(spark, [(1, 2)], "x int, y int").coalesce(1).write.parquet(str(folder / "d"))
    (folder / "e.parquet").write_bytes(b"PAR1 broken PAR1")
    with caplog.at_level(logging.WARNING):
        rows = read_sales(spark, str(folder), skip_corrupt=True).orderBy("order_ts").collect()
    assert [(r.order_ts.day, r.brand, r.net and float(r.net)) for r in rows] == [(5, "A", None), (6, None, 5.0), (7, "7", None)]
    assert [(r[POSITION]["input"], r[POSITION]["file"], r[POSITION]["row"]) for r in rows] == [(0, 0, 0), (0, 1, 0), (0, 2, 0)]
    assert caplog.text.count("cannot read") == 1 and "e.parquet" in caplog.text
    with pytest.raises(Exception):
        read_sales(spark, str(folder))


def test_many_broken_files_cost_no_more_jobs(spark, tmp_path, monkeypatch):
    """Broken files are told from others by one job, not one by one; those without rows lend their columns."""
    folder = tmp_path / "folder"
    raw(spark, [("2024-01-05", "A")], "`Ngày` string, `Brand` string").coalesce(1).write.parquet(str(folder / "a"))
    raw(spark, [], "`Ngày` string, note string").coalesce(1).write.parquet(str(folder / "b"))
    for i in range(40):
        (folder / f"x{i}.parquet").write_bytes(b"PAR1 broken PAR1")
    calls = []
    merged = files._merged
    monkeypatch.setattr(files, "_merged", lambda *a: calls.append(a) or merged(*a))
    df = read_sales(spark, str(folder), skip_corrupt=True)
    assert values(df, "brand") == ["A"] and "note" in df.columns and len(calls) == 1


def test_a_local_folder_is_refused_on_a_cluster():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            check_shared("file:/tmp/spark-warehouse/_staging", master)
        check_shared("hdfs://host/warehouse/_staging", master)
    check_shared("file:/tmp/spark-warehouse/_staging", "local[8]")


def test_an_input_without_dates_adds_no_rows(spark, two_files, tmp_path, caplog):
    bad = str(tmp_path / "undated")
    raw(spark, [("A", "x")], "region string, store string").write.parquet(bad)
    with caplog.at_level(logging.WARNING):
        df = read_sales(spark, [bad, two_files[0]])
        assert df.count() == 1
        assert {r[POSITION]["input"] for r in df.collect()} <= {0, 1}
    with pytest.raises(ValueError, match="date column"):
        read_sales(spark, bad)


def test_plans_grow_with_schemas_not_files(spark, tmp_path):
    for i in range(12):
        kind = "int" if i % 2 else "string"
        raw(spark, [("2024-01-05", i if i % 2 else "x")], f"`Ngày` string, `Brand` {kind}").coalesce(1).write.parquet(
            str(tmp_path / "many" / f"{i:02}")
        )
    df = read_sales(spark, str(tmp_path / "many"))
    assert df.count() == 12
    assert df._jdf.queryExecution().optimizedPlan().toString().count("parquet") <= 2
    assert [r[POSITION]["file"] for r in df.orderBy(f"{POSITION}.file").collect()] == list(range(12))


def test_folders_may_name_columns(spark, two_files, tmp_path):
    rows = raw(spark, [("2024-01-05", "A"), ("2024-01-06", "B B")], "`Ngày` string, Brand string")
    rows.write.partitionBy("Brand").parquet(str(tmp_path / "parts"))
    df = read_sales(spark, [two_files[0], str(tmp_path / "parts")])
    got = sorted((r[POSITION]["input"], r.brand) for r in df.collect())
    assert got == [(0, "A"), (1, "A"), (1, "B B")]


def test_raw_rows_can_be_exported(spark, two_files, tmp_path):
    rows = filtered_rows(read_sales(spark, two_files[0]), Filters(dimensions=()))
    assert POSITION not in rows.columns
    write_report(rows, str(tmp_path / "csv"), "csv")
    write_report(read_sales(spark, two_files[0]), str(tmp_path / "more"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 1


def test_persist(spark, two_files):
    df = read_sales(spark, two_files[0], persist=True)
    assert df.storageLevel.useMemory and df.storageLevel.useDisk
    df.unpersist()


def test_choose_source(spark):
    old = sales(spark, [("2024-01-05",)], "order_ts")
    new = sales(spark, [("2024-01-06",)], "order_ts")
    assert choose_source(new, old) is new
    assert choose_source(new.filter("false"), old) is old


def test_stage_uses_the_shared_folder(spark):
    before = spark.sparkContext.getCheckpointDir()
    df = stage(sales(spark, [("2024-01-05", 1)], "order_ts", "net"), "t")
    assert df.count() == 1
    root = spark.conf.get("spark.checkpoint.dir", None) or before or spark.conf.get("spark.sql.warehouse.dir")
    own = shared_folder(spark).removeprefix("file:")
    assert own.startswith(root.removeprefix("file:")) and own in df.inputFiles()[0]
    assert spark.sparkContext.getCheckpointDir() == before
    drop_staged(spark)
    with pytest.raises(Exception):
        df.collect()


def test_shuffles_grow_with_the_input(spark, two_files, monkeypatch):
    """Partitions follow the size of what is read; they are raised, never lowered, and merged when small."""
    monkeypatch.setattr(session, "PARTITION_BYTES", 100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        size = session.input_bytes(spark, list(two_files))
        counts = read_sales(spark, list(two_files)).groupBy("note").count()
        plan = counts._jdf.queryExecution().executedPlan().toString()
        assert size > 900 and f", {size // 100})" in plan
        session.widen_shuffles(spark, 900)
        assert spark.conf.get(session.INITIAL_PARTITIONS) == str(size // 100)
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
        spark.conf.unset(session.INITIAL_PARTITIONS)
        monkeypatch.setattr(session, "PARTITION_BYTES", 10_000)
        totals = sales_table(spark, "/root/testdata/sf0.01", "doc_no store").groupBy("doc_no").count()
        tables = [f"/root/testdata/sf0.01/{name}.parquet" for name in ("lineitem", "supplier")]
        plan = totals._jdf.queryExecution().executedPlan().toString()
        assert f", {session.input_bytes(spark, tables) // 10_000})" in plan
    finally:
        spark.conf.unset(session.INITIAL_PARTITIONS)
