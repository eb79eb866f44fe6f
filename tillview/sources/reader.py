"""Reading sales tables and bringing them to the canonical columns."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType

from tillview.schema import MONEY_COLUMNS, MONEY_PRECISION, MONEY_SCALE, MONEY_TYPE, POSITION, SOURCE_NAMES
from tillview.sources.files import file_groups, list_files, read_group, reason
from tillview.sources.session import widen_shuffles

log = logging.getLogger(__name__)


def _exact(kind: DataType) -> bool:
    """Decimals that hold no more than the type of amounts does."""
    room = MONEY_PRECISION - MONEY_SCALE
    return isinstance(kind, DecimalType) and kind.scale <= MONEY_SCALE and kind.precision - kind.scale <= room


def _typed(df: DataFrame, source: str, canonical: str, money: str) -> Column:
    """The source column in its canonical type, bad values null.

    A column that already has the type, or a narrower decimal, is passed through
    untouched, so filters on it still reach the parquet reader. A number too large
    for the type of amounts is an error, never a null.
    """
    col = F.col(f"`{source}`")
    have = df.schema[source].dataType.simpleString()
    if canonical == "order_ts":
        want = "timestamp_ntz"
    elif canonical in MONEY_COLUMNS:
        want = MONEY_TYPE if money == "decimal" else "double"
    else:
        want = "string"
    if want == MONEY_TYPE and _exact(df.schema[source].dataType):
        return col.alias(canonical)
    if have != want:
        typed = col.cast(want) if want == "string" else col.try_cast(want)
        if want == MONEY_TYPE:
            number = col.try_cast("double")
            lost = typed.isNull() & number.isNotNull() & ~F.isnan(number)
            message = F.concat(F.lit(f"{source}: no amount of this size can be held: "), col.cast("string"))
            typed = F.when(lost, F.raise_error(message)).otherwise(typed)
        col = typed
    if want == "double":
        col = F.nanvl(col, F.lit(None).cast("double"))
    return col.alias(canonical)


def normalize(df: DataFrame, names: dict[str, str] = SOURCE_NAMES, money: str = "decimal") -> DataFrame:
    """Canonical names and types; rows without a valid date are dropped.

    A column is found under its source name or its canonical one. Columns the
    input lacks stay absent, and reports that need them say so. Other columns
    are kept as they are. ``money="double"`` keeps amounts as floating point.
    """
    if money not in ("decimal", "double"):
        raise ValueError("money must be 'decimal' or 'double'")
    found = {}
    for canonical, source in names.items():
        if source in df.columns:
            found[canonical] = source
        elif canonical in df.columns:
            found[canonical] = canonical
    if "order_ts" not in found:
        raise ValueError(f"no date column: expected {names['order_ts']!r} or 'order_ts'")
    taken = set(found.values()) | set(found)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in taken]
    typed = [_typed(df, source, canonical, money) for canonical, source in found.items()]
    return df.select(*typed, *kept).filter(F.col("order_ts").isNotNull())


def _with_position(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """Adds the place of each row: number of the input, of the file in it, and of the row in that.

    The list of files, which the driver holds anyway, is broadcast: matched by path in a shuffle,
    all rows of a file would meet in one task.
    """
    numbered = rows.withColumns({"__path": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
    position = F.struct("input", "file", F.col("__row").alias("row"))
    return (
        numbered.join(F.broadcast(numbers), "__path", "left")
        .withColumn(POSITION, position)
        .drop("__path", "__row", "input", "file")
    )


def _stack(tables: Sequence[DataFrame]) -> DataFrame:
    """Stack by column name; an extra column whose type differs becomes text."""
    types: dict[str, set[str]] = {}
    for table in tables:
        for name, kind in table.dtypes:
            types.setdefault(name, set()).add(kind)
    mixed = {name for name, kinds in types.items() if len(kinds) > 1}
    same = [
        t.withColumns({c: F.col(f"`{c}`").cast("string") for c in t.columns if c in mixed})
        for t in tables
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), same)


def read_sales(
    spark: SparkSession,
    paths: str | Sequence[str],
    names: dict[str, str] = SOURCE_NAMES,
    money: str = "decimal",
    skip_corrupt: bool = False,
    persist: bool = False,
    positions: bool = True,
) -> DataFrame:
    """Sales from one or many parquet inputs, stacked by column name.

    Columns are merged by name over all files of all inputs; folders such as ``brand=A``
    are columns too. ``skip_corrupt`` leaves out,
    as a whole and with a warning each, files whose footer cannot be read and inputs that
    do not exist; files that break later fail the query. Files without a date column add
    no rows, with a warning. ``persist`` keeps the table on the executors for reuse by all
    reports. The driver lists the files; their footers are read by a distributed job. Without
    ``positions`` rows do not know their place, which only the customer list asks for (it then
    takes first values by time), and no row is joined with its file. Shuffles of the session get
    partitions in proportion to the inputs.
    """
    inputs = [paths] if isinstance(paths, str) else list(paths)
    places: dict[str, tuple[str, int, int]] = {}
    size = 0
    plain: list[str] = []
    foldered: dict[str, list[str]] = {}
    for ordinal, path in enumerate(inputs):
        try:
            listed = list_files(spark, path)
        except PySparkException as error:
            if not skip_corrupt:
                raise
            log.warning("cannot read %s: %s", path, reason(error))
            continue
        new = [(n, file, name) for n, (file, name, _) in enumerate(listed) if file not in places]
        size += sum(length for file, _, length in listed if file not in places)
        places |= {file: (name, ordinal, n) for n, file, name in new}
        own = plain
        if any("=" in file.rsplit("/", 2)[-2] for _, file, _ in new):
            own = foldered.setdefault(path, [])
        own += [file for _, file, _ in new]
    widen_shuffles(spark, size)
    numbers = spark.createDataFrame(list(places.values()), "__path string, input int, file int")
    groups = file_groups(spark, plain, skip_corrupt)
    for path, files in foldered.items():
        groups += file_groups(spark, files, skip_corrupt, path)
    if not groups:
        raise ValueError("none of the inputs could be read")
    tables = []
    for group in groups:
        if {names["order_ts"], "order_ts"} & set(group.schema.names):
            rows = read_group(spark, group)
            tables.append(normalize(_with_position(rows, numbers) if positions else rows, names, money))
        else:
            log.warning("no date column, so no rows, in %s", ", ".join(group.files))
    if not tables:
        raise ValueError(f"no input has a date column: expected {names['order_ts']!r} or 'order_ts'")
    sales = _stack(tables)
    return sales.persist(StorageLevel.MEMORY_AND_DISK) if persist else sales


def choose_source(new: DataFrame, fallback: DataFrame) -> DataFrame:
    """The new table, or the previous one when the new one has no valid rows."""
    return fallback if new.isEmpty() else new
