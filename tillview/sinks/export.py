"""Writing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillview.schema import POSITION


def write_report(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Write a report as CSV with a header, or as parquet.

    Executors write their own part files, which together keep the row order. The
    position of rows in their input is not part of a report.
    """
    writer = df.drop(POSITION).write.mode(mode)
    if fmt == "csv":
        writer.option("header", "true").option("emptyValue", "").csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError("fmt must be 'csv' or 'parquet'")
