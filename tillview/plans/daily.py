"""Totals of any period from stored days: exact distinct counts by bitmaps.

``count_days`` reads the sales once and writes down, per day, gross and net, and which documents
and phones it saw. Each distinct value gets a number; a day's set is held as bitmaps of 32,768
neighbouring numbers each. Days then merge to any period by OR, so a period's distinct count is
the number of bits set: no value is shuffled again, and no row is expanded per count.

Numbers are dense within the partition that gave them, so bitmaps fill up; a bitmap takes 4 KB at
most, and a day as many as there are numbers it saw, divided by what one holds, if they are close.
A hot phone, or rows without one, are combined by document and day before they move.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillview.functions.metrics import discount_from_ratio, money, total
from tillview.functions.timekeys import period_start
from tillview.plans.overview import trend_of_totals
from tillview.schema import Period, require
from tillview.sources.staging import stage

KINDS = {"orders": "doc_no", "customers": "phone"}


@dataclass(frozen=True)
class DailyCounts:
    """``sums``: day, gross and net. ``members``: day, kind, bucket and bits of what it saw."""

    sums: DataFrame
    members: DataFrame


def _members(pairs: DataFrame, kind: str) -> DataFrame:
    """Bitmaps per day of one kind. Numbers are written down with their days before they are used."""
    value = KINDS[kind]
    days = pairs.where(F.col(value).isNotNull()).select(value, "day").distinct()
    seen = days.groupBy(value).agg(F.collect_list("day").alias("days"))
    numbered = seen.select((F.monotonically_increasing_id() + 1).alias("number"), "days")
    marks = stage(numbered, f"daily-{kind}").select("number", F.explode("days").alias("day"))
    return marks.groupBy("day", F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    ).select("day", F.lit(kind).alias("kind"), "bucket", "bits")


def count_days(sales: DataFrame) -> DailyCounts:
    """What ``kpis_of_days`` and ``trend_of_days`` need, from one pass over the sales."""
    require(sales, "gross", "net", *KINDS.values())
    day = F.col("order_ts").cast("date").alias("day")
    documents = sales.groupBy(day, *KINDS.values()).agg(total("gross").alias("gross"), total("net").alias("net"))
    documents = stage(documents, "daily-documents")
    sums = stage(documents.groupBy("day").agg(*(total(c).alias(c) for c in ("gross", "net"))), "daily-sums")
    members = _members(documents, "orders").unionByName(_members(documents, "customers"))
    return DailyCounts(sums, stage(members, "daily-members"))


def _between(start: date | None, end: date | None) -> Column:
    kept = F.lit(True)
    if start is not None:
        kept &= F.col("day") >= F.lit(start)
    if end is not None:
        kept &= F.col("day") <= F.lit(end)
    return kept


def _counted(members: DataFrame, by: list[Column]) -> DataFrame:
    """Distinct documents and phones: bitmaps of a period merge by OR, bits set are counted."""
    merged = members.groupBy(*by, "kind", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    names = [c for c in merged.columns if c not in ("kind", "bucket", "bits")]
    bits = F.bitmap_count("bits")
    return merged.groupBy(*names).agg(
        *(F.coalesce(F.sum(F.when(F.col("kind") == kind, bits)), F.lit(0)).alias(kind) for kind in KINDS)
    )


def kpis_of_days(days: DailyCounts, start: date | None = None, end: date | None = None) -> DataFrame:
    """``kpis`` of whole days from ``start`` to ``end``, both included."""
    sums = days.sums.where(_between(start, end)).agg(money("gross"), money("net"))
    counts = _counted(days.members.where(_between(start, end)), [])
    both = sums.select("*", *(counts.select(kind).scalar().alias(kind) for kind in KINDS))
    return both.withColumn("discount_pct", discount_from_ratio(F.col("gross"), F.col("net")))


def totals_of_days(days: DailyCounts, period: Period = Period()) -> DataFrame:
    """Start, gross, net, orders and customers per period with sales."""
    start = period_start(F.col("day"), period).alias("start")
    sums = days.sums.groupBy(start).agg(money("gross"), money("net"))
    return sums.join(_counted(days.members, [start]), "start", "left").fillna(0, list(KINDS))


def trend_of_days(days: DailyCounts, period: Period = Period()) -> DataFrame:
    """``time_trend`` from stored days."""
    return trend_of_totals(totals_of_days(days, period), period)
