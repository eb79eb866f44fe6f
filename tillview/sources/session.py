"""Session settings the reports rely on, for local runs and tests."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Bytes of input, as stored, for each of the partitions that shuffles start with.
PARTITION_BYTES = 4 << 20
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session. On a cluster, use the session the cluster provides."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tillview")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Size of the files below ``paths``, whose contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return listed.agg(F.sum("length")).first()[0] or 0


def widen_shuffles(spark: SparkSession, size: int) -> None:
    """Let shuffles start with partitions in proportion to an input of ``size`` bytes.

    With a fixed number the part of one task grows with the input. Adaptive execution merges
    partitions that turn out small. The number is raised, never lowered, and holds for the session;
    ``spark.sql.shuffle.partitions`` is left alone and counts where it is larger, or where
    adaptive execution or its merging is off.
    """
    wanted = size // PARTITION_BYTES
    have = spark.conf.get(INITIAL_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions")
    if wanted > int(have):
        spark.conf.set(INITIAL_PARTITIONS, str(wanted))
