"""Lookups in which one key may hold a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def look_up(
    rows: DataFrame, facts: DataFrame, key: str, how: str = "left", counts: DataFrame | None = None
) -> DataFrame:
    """Join ``facts``, one row per ``key``, to ``rows``; no task gets all rows of a hot key.

    A key is hot if it holds more rows than an even share of a shuffle partition, so there are
    no more hot keys than partitions, and their facts are broadcast. Rows without a key find
    nothing and meet no join. Rows of all other keys meet in a shuffle join. ``rows`` is read
    once per part, so it should be a table or staged; ``counts`` may bring the number of rows of
    every key, as ``key`` and ``count``. Finding the hot keys runs a job.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if counts is None:
        counts = rows.where(F.col(key).isNotNull()).groupBy(key).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = [r[0] for r in counts.where(F.col("count") > max(1, total // partitions)).select(key).collect()]
    found = [c for c in facts.columns if c != key]
    order = [*rows.columns, *found]
    present = rows.where(F.col(key).isNotNull())
    parts = []
    if hot:
        is_hot = F.col(key).isin(hot)
        parts.append(present.where(is_hot).join(F.broadcast(facts.where(is_hot)), key, how))
        present = present.where(~is_hot)
    parts.append(present.join(facts, key, how))
    if how == "left":
        nothing = {c: F.lit(None).cast(facts.schema[c].dataType) for c in found}
        parts.append(rows.where(F.col(key).isNull()).withColumns(nothing))
    return reduce(lambda a, b: a.unionByName(b), (p.select(order) for p in parts))
