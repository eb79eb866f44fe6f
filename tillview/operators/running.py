"""Ranks and running sums within groups of any size.

A plain window over a group puts the whole group in one task. Here the rows are
range-partitioned by group and order into blocks of similar size, so a large
group spans many blocks. What lies before a block is a sum over the few rows
that describe blocks; inside a block a plain window finishes the job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillview.sources.staging import stage


def ordered_blocks(
    df: DataFrame, group: str, order: Sequence[Column], blocks: int | None = None
) -> DataFrame:
    """Stage ``df`` with a ``block`` number that grows with the order in each group.

    Block bounds come from sampling, so the numbers are written down once and
    read back by every later step.
    """
    keys = [F.col(group), *order]
    ranged = df.repartitionByRange(blocks, *keys) if blocks else df.repartitionByRange(*keys)
    return stage(ranged.withColumn("block", F.spark_partition_id()), f"blocks-{group}")


def block_sums(df: DataFrame, group: str, amounts: Mapping[str, Column]) -> DataFrame:
    """Per block and group: ``x``, ``x_before`` and ``x_total`` of each amount.

    One row per block and group; a group has at most as many rows as there are
    blocks, so the windows are small. The result is staged: it is read more than
    once, and its true size then decides how it is joined.
    """
    sums = df.groupBy("block", group).agg(*(e.alias(n) for n, e in amounts.items()))
    whole = Window.partitionBy(group)
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return stage(
        sums.withColumns(
            {f"{n}_before": F.coalesce(F.sum(n).over(before), F.lit(0)) for n in amounts}
            | {f"{n}_total": F.sum(n).over(whole) for n in amounts}
        ),
        f"block-sums-{group}",
    )
