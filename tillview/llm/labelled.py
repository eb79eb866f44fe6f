"""Documents joined with their labels, and the fold a document belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; a missing id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def one_label(labels: DataFrame, key: str, label: str) -> DataFrame:
    """One row per labelled id, column ``label``: 1 if any of its labels is 1.

    Missing ids and missing labels are left out.
    """
    return (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("label_key"))
        .agg(F.max((F.col(label) > 0).cast("int")).alias("label"))
    )
