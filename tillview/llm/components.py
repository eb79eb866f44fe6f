"""Connected components by alternating large and small stars, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillview.operators.lookup import look_up
from tillview.sources.staging import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a > b.

    Large: each node links its larger neighbours to the least of itself and its neighbours.
    Small: each node links itself and its smaller neighbours to the least of them.
    """
    if large:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
    else:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    nearest = both.groupBy("node").agg(F.min("other").alias("other"), F.count("*").alias("count"))
    least = nearest.select("node", F.least("node", "other").alias("least"), "count")
    least = stage(least, "components-least")
    rows = both.where("other > node") if large else both
    joined = look_up(rows, least.select("node", "least"), "node", "inner", least.select("node", "count"))
    out = joined.select(F.col("other").alias("a"), F.col("least").alias("b"))
    if not large:
        out = out.unionByName(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node but the roots.

    ``edges`` has longs ``a`` and ``b``; loops, repetitions and either order are fine. Every round
    writes its edges, so a lost executor costs one round at most; rounds grow with the logarithm
    of the number of nodes, and no component meets in one task.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stage(now, "components")
    before = None
    while True:
        facts = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        # stars only: no node is linked twice, and no link ends where another begins
        if facts[0] == 0 or tuple(facts) == before:
            break
        before = tuple(facts)
        now = stage(_star(stage(_star(now, True), "components-large"), False), "components")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
