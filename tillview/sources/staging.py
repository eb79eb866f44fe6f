"""Tables written once so that several readers do not repeat their work."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, as a full URI.

    Where that is unset, it lies below the warehouse. A warehouse on a local disk, the default, is
    refused unless the master is local too: executors would not share it.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staging"
        check_shared(_qualified(spark, root), context.master)
    folder = f"{_qualified(spark, root)}/{context.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_drop_at_exit, folder)
    return folder


def check_shared(uri: str, master: str) -> None:
    """Raises if a folder of this URI is one that executors of this master do not share."""
    if uri.startswith("file:") and master.split("[")[0] != "local":
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; {uri} is local to each machine")


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, which all processes then agree on."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(place).toString().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet under the shared folder and read it back.

    The result has no lineage: losing an executor afterwards costs a re-read. The table goes
    with ``drop_staged``, or when Python ends.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete what this application has staged. Frames that read it can no longer run."""
    folder = shared_folder(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _drop_at_exit(folder: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None and folder in _folders:
        if folder.endswith(spark.sparkContext.applicationId):
            drop_staged(spark)
