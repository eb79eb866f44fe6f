import datetime as dt

import pytest
from rows import sales, values

from tillview.schema import POSITION
from tillview.sources import store
from tillview.sources.store import MONTH, open_sales, save_sales, stored_sales

ROWS = [(f"2024-{1 + i % 6:02}-{1 + i % 28:02} 10:00:00", i, f"s{i % 3}") for i in range(60)]


def lines(spark, rows=ROWS):
    return sales(spark, rows, "order_ts", "net", "store")


def test_only_months_asked_for_are_read(spark, tmp_path):
    folder = str(tmp_path / "copies")
    save_sales(lines(spark), folder)
    df = open_sales(spark, folder, dt.date(2024, 2, 20), dt.date(2024, 3, 2))
    assert sorted({r.order_ts.month for r in df.collect()}) == [2, 3] and df.columns == ["order_ts", "net", "store"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert f"{MONTH}#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    every = open_sales(spark, folder)
    assert every.exceptAll(lines(spark)).count() == lines(spark).exceptAll(every).count() == 0
    with pytest.raises(ValueError, match="no copy"):
        open_sales(spark, str(tmp_path / "none"))


def test_a_copy_serves_until_its_inputs_change(spark, tmp_path, monkeypatch):
    source, folder = str(tmp_path / "in"), str(tmp_path / "copies")
    lines(spark).coalesce(1).write.parquet(source)
    first = stored_sales(spark, source, folder)
    assert first.count() == 60 and POSITION in first.columns
    with monkeypatch.context() as patched:
        patched.setattr(store, "read_sales", lambda *a, **k: pytest.fail("loaded again"))
        assert stored_sales(spark, source, folder, dt.date(2024, 5, 1)).count() == 20
    lines(spark, [("2024-07-01 00:00:00", 1, "s")]).coalesce(1).write.mode("append").parquet(source)
    assert stored_sales(spark, source, folder).count() == 61
    assert len(values(first, "net")) == 60  # the copy opened before is still there


def test_a_copy_without_manifest_is_not_opened(spark, tmp_path):
    folder = tmp_path / "copies"
    lines(spark).write.parquet(str(folder / "copy-broken"))
    with pytest.raises(ValueError, match="no copy"):
        open_sales(spark, str(folder))
