"""A sorted copy of loaded sales, partitioned by month, that later sessions open instead of loading again.

A copy is written into a folder of its own. Its manifest is written last and names that folder and
the files it came from (number, and a checksum of paths, sizes and times of change), so a copy whose writing
broke is never opened, and one whose inputs have changed is written anew. Rows are ranged by month, store
and time: a busy month spans many files, and each file holds few stores.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillview.schema import require
from tillview.sources.reader import read_sales

MONTH = "order_month"


def save_sales(sales: DataFrame, folder: str, source: str = "") -> None:
    """Write a copy of ``sales`` below ``folder`` and its manifest; copies there before stay readable."""
    require(sales, "store")
    copy = f"{folder.rstrip('/')}/copy-{uuid.uuid4().hex}"
    month = F.date_format("order_ts", "yyyy-MM").alias(MONTH)
    rows = sales.select("*", month).repartitionByRange(MONTH, "store", "order_ts")
    rows.sortWithinPartitions(MONTH, "store", "order_ts").write.partitionBy(MONTH).parquet(copy)
    manifest = sales.sparkSession.range(1).select(
        F.lit(copy).alias("copy"),
        F.lit(source).alias("source"),
        F.lit(sales.schema.json()).alias("columns"),
        F.current_timestamp().alias("written"),
    )
    manifest.write.mode("append").parquet(f"{folder.rstrip('/')}/manifest")


def _manifest(spark: SparkSession, folder: str, source: str | None) -> tuple[str, str] | None:
    """Folder and columns of the latest copy, of this source if one is named."""
    try:
        found = spark.read.parquet(f"{folder.rstrip('/')}/manifest")
    except AnalysisException:
        return None
    if source is not None:
        found = found.where(F.col("source") == source)
    row = found.orderBy(F.desc("written")).select("copy", "columns").first()
    return tuple(row) if row else None


def open_sales(spark: SparkSession, folder: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """The latest copy below ``folder``; only months that touch ``start`` to ``end`` are listed for reading.

    The bounds are of months: reports filter by time themselves.
    """
    found = _manifest(spark, folder, None)
    if found is None:
        raise ValueError(f"no copy of sales below {folder}")
    return _opened(spark, *found, start, end)


def _opened(spark: SparkSession, copy: str, columns: str, start: date | None, end: date | None) -> DataFrame:
    schema = StructType.fromJson(json.loads(columns))
    rows = spark.read.schema(StructType([*schema]).add(MONTH, "string")).parquet(copy)
    if start is not None:
        rows = rows.where(F.col(MONTH) >= f"{start:%Y-%m}")
    if end is not None:
        rows = rows.where(F.col(MONTH) <= f"{end:%Y-%m}")
    return rows.select(*schema.names)


def source_of(spark: SparkSession, paths: str | Sequence[str]) -> str:
    """Number and checksum of the files of some inputs, whose contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    facts = listed.agg(F.count("*"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    return f"{facts[0]}:{facts[1]}"


def stored_sales(
    spark: SparkSession,
    paths: str | Sequence[str],
    folder: str,
    start: date | None = None,
    end: date | None = None,
    **options,
) -> DataFrame:
    """``read_sales`` through a copy below ``folder``, written first if there is none of the inputs as they are now."""
    source = source_of(spark, paths)
    found = _manifest(spark, folder, source)
    if found is None:
        save_sales(read_sales(spark, paths, **options), folder, source)
        found = _manifest(spark, folder, source)
    return _opened(spark, *found, start, end)
