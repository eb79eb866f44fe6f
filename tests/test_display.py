import pytest
from pyspark.sql import functions as F
from rows import values

from tillview.functions.display import date_text, display, integer_text, number_text, percent_text
from tillview.functions.metrics import round_exact, round_scaled
from tillview.functions.text import WHITESPACE
from tillview.sinks.export import write_report

NUMBERS = [1.015, 2.675, 0.125, 0.375, 0.5, 1.5, 2.5, 1234567.891, -1234.5, 0.0, 33.333333]


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate([*NUMBERS, None])], "i int, x double").orderBy("i")


def test_rounding(numbers):
    exact = values(numbers.select(round_exact(F.col("x")).alias("x")), "x")
    scaled = values(numbers.select(round_scaled(F.col("x")).alias("x")), "x")
    assert exact == [round(v, 2) for v in NUMBERS] + [None]
    assert exact[:4] == [1.01, 2.67, 0.12, 0.38]
    assert scaled[:4] == [1.01, 2.68, 0.12, 0.38]


def test_texts(numbers):
    assert values(numbers.select(integer_text(F.col("x")).alias("t")), "t") == [f"{v:,.0f}" for v in NUMBERS] + [""]
    assert values(numbers.select(number_text(F.col("x"), 3).alias("t")), "t") == [f"{v:,.3f}" for v in NUMBERS] + [""]
    signed = values(numbers.select(percent_text(F.col("x"), signed=True).alias("t")), "t")
    assert signed == [("+" if v > 0 else "") + f"{v:,.2f}%" for v in NUMBERS] + [""]


def test_display_ignores_absent_columns(spark):
    df = spark.sql("select 1234.5D a, timestamp_ntz'2024-01-05 10:00:00' t")
    shown = display(df, integers=["a", "b"], percents=["c"], dates=["t"])
    assert values(shown, "a", "t") == [("1,234", "2024-01-05")]
    assert values(df.select(date_text(F.lit(None).cast("date")).alias("d")), "d") == [None]


def test_whitespace_is_what_strip_removes():
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_write_report(spark, tmp_path, fmt):
    df = spark.createDataFrame([("a,b", "1"), ('say "x"', ""), (None, "3")], "name string, n string")
    path = str(tmp_path / fmt)
    write_report(df, path, fmt)
    reader = spark.read.option("header", "true").option("escape", "\\") if fmt == "csv" else spark.read
    back = reader.format(fmt).load(path)
    assert back.columns == ["name", "n"]
    assert back.count() == 3
    with pytest.raises(ValueError):
        write_report(df, path, "xlsx")
