"""Training-data pipeline over ``documents``: each stage's rows are written and read as the next one's."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillview.llm.bpe import round_trip
from tillview.llm.decontaminate import find_contaminated
from tillview.llm.disclosure import sanitise
from tillview.llm.near_duplicates import near_duplicates
from tillview.llm.quality import good_documents
from tillview.sources.staging import stage

KEY = "doc_id"
ROW = "__row"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _without(docs: DataFrame, gone: DataFrame, key: str = KEY) -> DataFrame:
    """Documents whose id is not among ``gone``; a null id is an id like any other."""
    named = gone.select(F.col(key).alias("__gone")).distinct()
    return docs.join(named, F.col(key).eqNullSafe(F.col("__gone")), "left_anti")


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """Documents and a column that tells rows apart: the id, or a number where ids are missing or repeat."""
    rows, ids = docs.agg(F.count("*"), F.countDistinct(KEY)).first()
    if rows == ids:
        return docs, KEY
    return stage(docs.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows"), ROW


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, row by row."""
    return good_documents(docs, _table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of every group of near duplicates.

    Where ids are missing or repeat, every row is a document of its own and rows are numbered.
    """
    docs, key = _numbered(docs)
    classes = near_duplicates(docs, key=key)
    return _without(docs, classes.where(F.col(key) != F.col("class_id")), key).drop(ROW)


def keep_unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, row by row."""
    docs, key = _numbered(docs)
    return _without(docs, find_contaminated(docs, _table(spark, sf_dir, "benchmark"), key), key).drop(ROW)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and terms that reveal it taken out; n_chars follows the text."""
    clean = sanitise(docs)
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their digest, and that of the bytes they decode to."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_tokens=True)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_unseen),
    ("personal_data", without_personal_data),
    ("tokens", encoded),
]

#: No stage but the filters on its results can be said in SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
