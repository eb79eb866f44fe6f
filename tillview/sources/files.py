"""Which parquet files an input has, and which schemas these have."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql.types import StructType

log = logging.getLogger(__name__)


def reason(error: Exception) -> str:
    """The first line of an error that tells more than that there was one."""
    lines = [line.strip() for line in str(error).splitlines() if line.strip()]
    return lines[1 if len(lines) > 1 and lines[0].endswith(".parquet.") else 0]


@dataclass(frozen=True)
class FileGroup:
    """Files that can be read together, and all their columns."""

    files: tuple[str, ...]
    schema: StructType
    base: str | None = None


def _reader(spark: SparkSession, base: str | None) -> DataFrameReader:
    """``base`` is the input whose folders, such as ``brand=A``, name further columns."""
    return spark.read.option("basePath", base) if base else spark.read


def list_files(spark: SparkSession, path: str) -> list[tuple[str, str, int]]:
    """Data files of an input in order: how to read each, what its rows call it, and its size.

    Contents are not read; the driver holds the names, as it does in any read.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return sorted(tuple(r) for r in listed.select("path", "_metadata.file_path", "length").collect())


def _merged(spark: SparkSession, files: list[str], base: str | None) -> StructType:
    """The columns of all files: their footers are read by a distributed job."""
    return _reader(spark, base).option("mergeSchema", "true").parquet(*files).schema


def _types(schema: StructType) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in schema}


def _with_rows(spark: SparkSession, files: list[str], base: str | None) -> list[str]:
    """Files whose footer can be read and says that there are rows: one job over all footers.

    No column is read. Spark's own reader opens the files in tasks and passes over broken ones.
    """
    reader = _reader(spark, base).schema("__none int").option("ignoreCorruptFiles", "true")
    named = reader.parquet(*files).select("_metadata.file_path").distinct()
    found = {row[0] for row in named.collect()}
    return [file for file in files if _row_name(spark, file) in found]


def _row_name(spark: SparkSession, file: str) -> str:
    """What rows call a file that is read as ``file``."""
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).toUri().toString()


def _readable(spark: SparkSession, files: list[str], skip_corrupt: bool, base: str | None) -> list[FileGroup]:
    """Groups of files whose schemas merge, broken ones left out on request.

    Files are sorted into broken ones and others by one job, whatever the number of either.
    Those without rows only lend their columns.
    """
    if not files or not skip_corrupt:
        return _merging(spark, files, base)
    full = _with_rows(spark, files, base)
    rest = sorted(set(files) - set(full))
    groups = _merging(spark, full, base)
    if rest:
        for file in rest:
            log.warning("cannot read %s, or it has no rows", file)
        try:
            option = _reader(spark, base).option("mergeSchema", "true").option("ignoreCorruptFiles", "true")
            groups.append(FileGroup((), option.parquet(*rest).schema, base))
        except (PySparkException, Py4JJavaError) as error:
            log.info("no columns from files without rows: %s", reason(error))
    return groups


def _merging(spark: SparkSession, files: list[str], base: str | None) -> list[FileGroup]:
    """Groups of files whose schemas merge. What does not merge is halved until it does.

    One job serves all files unless some disagree on a type; each of those costs as many more
    jobs as the number of files can be halved.
    """
    if not files:
        return []
    try:
        return [FileGroup(tuple(files), _merged(spark, files, base), base)]
    except (PySparkException, Py4JJavaError):
        if len(files) == 1:
            raise
        half = len(files) // 2
        return [group for part in (files[:half], files[half:]) for group in _merging(spark, part, base)]


def file_groups(
    spark: SparkSession, files: list[str], skip_corrupt: bool, base: str | None = None
) -> list[FileGroup]:
    """As few groups as the types of columns allow, so plans grow with schemas, not with files."""
    groups: list[FileGroup] = []
    for found in _readable(spark, files, skip_corrupt, base):
        own = _types(found.schema)
        for i, group in enumerate(groups):
            have = _types(group.schema)
            if all(have.get(name, kind) == kind for name, kind in own.items()):
                new = [f for f in found.schema if f.name not in have]
                groups[i] = FileGroup(group.files + found.files, StructType([*group.schema, *new]), base)
                break
        else:
            groups.append(found)
    return groups


def read_group(spark: SparkSession, group: FileGroup) -> DataFrame:
    """The rows of a group; a file that breaks half way fails the task, which is tried again."""
    if not group.files:
        return spark.createDataFrame([], group.schema)
    reader = _reader(spark, group.base).schema(group.schema)
    return reader.option("ignoreCorruptFiles", "false").parquet(*group.files)
