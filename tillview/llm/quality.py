"""Quality: regularised quadratic discriminant over document statistics.

Each text becomes a vector of ``STATISTICS``. Both classes get a mean and a covariance that is
shrunk towards the pooled covariance and towards the identity; the score is the logistic of
the difference of their log densities, computed with Cholesky factors made once on the driver.

Fitting: every labelled row counts (no sample). Tasks add up moments, and one row of sums per
class reaches the driver, whatever the size of the corpus. Labels meet statistics, never texts.

Edge cases: null texts count as empty; repeated ids keep one row each; an empty text gets a
score like any other. Without both classes the score is the label mean (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tillview.llm.arrays import SPACE_BYTES, prefix_hash, range_hash, runs, slices, windows
from tillview.llm.labelled import one_label, remainder
from tillview.sources.staging import stage

STATISTICS = (
    "bytes", "words", "word_bytes", "lower", "upper", "digit", "stop", "odd", "line_words", "line_stops",
    "distinct_words", "top_word", "repeats", "distinct_trigrams", "wordless", "odd_ends",
)

#: Statistics beside the columns of a document, whatever their names.
MEASURED = "__statistics"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[*chars]] = True
    return out


LOWER = _table(b"abcdefghijklmnopqrstuvwxyz")
UPPER = _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT = _table(b"0123456789")
STOP = _table(b".,;:?'\"()-")
LETTER = LOWER | UPPER
LETTER[128:] = True
ODD = ~(LETTER | DIGIT | STOP | SPACE_BYTES)


def _logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def _distinct(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the number of distinct values and the count of the most frequent one."""
    if not len(values):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(v)))
    most = np.zeros(n)
    np.maximum.at(most, r[first], counts)
    return np.bincount(r[first], minlength=n).astype(float), most


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of ``STATISTICS`` for each text."""
    n, size = len(at) - 1, np.diff(at).astype(float)

    def share(member: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(member, out=sums[1:])
        return (sums[at[1:]] - sums[at[:-1]]).astype(float)

    starts, ends, rows = runs(~SPACE_BYTES[data], at)
    hashes = range_hash(prefix_hash(data), starts, ends)
    count = np.bincount(rows, minlength=n).astype(float)
    letters = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(LETTER[data], out=letters[1:])
    wordless = np.bincount(rows[letters[ends] == letters[starts]], minlength=n).astype(float)
    odd_ends = np.bincount(rows[ODD[data[ends - 1]]], minlength=n).astype(float) if len(ends) else np.zeros(n)
    same = np.zeros(len(rows), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    distinct, top = _distinct(hashes, rows, n)
    trigrams, first = windows(hashes, rows, 3)
    distinct_three, _ = _distinct(trigrams, rows[first], n)
    three = np.maximum(count - 2, 0)
    lines = share(data == 10) + 1
    stops = share(STOP[data])
    lower, upper = share(LOWER[data]), share(UPPER[data])
    return np.column_stack([
        np.log1p(size), np.log1p(count), np.log1p(share(~SPACE_BYTES[data]) / np.maximum(count, 1)),
        _logit(lower, size), _logit(upper, lower + upper), _logit(share(DIGIT[data]), size),
        _logit(stops, size), _logit(share(ODD[data]), size), np.log1p(count / lines), np.log1p(stops / lines),
        _logit(distinct, count), _logit(top, count), _logit(np.bincount(rows[same], minlength=n), count),
        _logit(distinct_three, three), _logit(wordless, count), _logit(odd_ends, count),
    ])


def _lists(column: pa.Array) -> pa.Array:
    """A list of ``STATISTICS`` for each text of a column."""
    found = [statistics(data, at) for _, data, at in slices(column)]
    rows = np.concatenate(found) if found else np.zeros((0, len(STATISTICS)))
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS), pa.array(rows.ravel()))


def _rows(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def with_statistics(
    documents: DataFrame, text: str = "text", keep: tuple[str, ...] = (), name: str = "statistics"
) -> DataFrame:
    """The columns ``keep`` of every document and its statistics; the text only if it is kept."""
    schema = documents.select(*keep).schema.add(name, ArrayType(DoubleType()))
    columns = list(dict.fromkeys([*keep, text]))
    place = columns.index(text)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], _lists(batch.column(place))], [*keep, name])

    return documents.select(*columns).mapInArrow(compute, schema)


@dataclass(frozen=True)
class Discriminant:
    """Means and inverse Cholesky factors of both classes, in standardised coordinates."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    whiten: tuple[np.ndarray, np.ndarray]
    offset: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        far = [(((z - m) @ w.T) ** 2).sum(axis=1) for m, w in zip(self.means, self.whiten, strict=True)]
        return 1 / (1 + np.exp(-np.clip((far[0] - far[1]) / 2 + self.offset, -50, 50)))


@dataclass(frozen=True)
class Constant:
    """What is left when only one class, or none, has labels."""

    value: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def fit(labelled: DataFrame, pooled: float = 0.1, ridge: float = 0.02) -> Discriminant | Constant:
    """Fit on ``statistics`` and ``label``; ``pooled`` and ``ridge`` are the shrinkage weights."""
    d = len(STATISTICS)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = _rows(batch.column(0))
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for label in (0, 1):
                own = x[y == label]
                total[label] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_pydict(
            {
                "label": pa.array(np.repeat([0, 1], total.shape[1]).astype(np.int32)),
                "place": pa.array(np.tile(np.arange(total.shape[1], dtype=np.int32), 2)),
                "value": pa.array(total.ravel()),
            }
        )

    sums = (
        labelled.select("statistics", "label")
        .mapInArrow(add_up, "label int, place int, value double")
        .groupBy("label", "place")
        .agg(F.sum("value").alias("value"))
    )
    total = np.zeros((2, 1 + d + d * d))
    for label, place, value in sums.collect():  # a fixed number of rows
        total[label, place] = value
    counts = total[:, 0]
    if not counts.all():
        return Constant(float(counts[1] / counts.sum()) if counts.sum() else 0.5)
    means = total[:, 1 : 1 + d] / counts[:, None]
    spread = [total[c, 1 + d :].reshape(d, d) / counts[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    centre = total[:, 1 : 1 + d].sum(axis=0) / counts.sum()
    within = (counts[0] * spread[0] + counts[1] * spread[1]) / counts.sum()
    scale = np.sqrt(np.maximum(np.diag(within), 1e-6))
    within = within / np.outer(scale, scale)
    whiten, logdet = [], []
    for c in (0, 1):
        own = (1 - pooled) * spread[c] / np.outer(scale, scale) + pooled * within
        own = (1 - ridge) * own + ridge * np.eye(d)
        factor = np.linalg.cholesky((own + own.T) / 2)
        whiten.append(np.linalg.inv(factor))
        logdet.append(2 * np.log(np.diag(factor)).sum())
    offset = (logdet[0] - logdet[1]) / 2 + np.log(counts[1] / counts[0])
    at = tuple((means[c] - centre) / scale for c in (0, 1))
    return Discriminant(centre, scale, at, tuple(whiten), float(offset))


def _learn(rows: DataFrame, labels: DataFrame, fold: Column, key: str, label: str) -> Discriminant | Constant:
    """Fit on the labelled ones among ``rows`` (``key`` and ``statistics``) outside ``fold``."""
    known = rows.select(key, "statistics").where(~fold)
    return fit(known.join(one_label(labels, key, label), F.col(key) == F.col("label_key")))


def score_quality(
    documents: DataFrame,
    labels: DataFrame,
    folds: int = 4,
    held_out: int = 2,
    threshold: float = 0.7,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``key``, the columns ``keep``, held_out, score and predicted of every document.

    Learns from labelled documents outside fold ``held_out`` only. The statistics are written
    once, so that texts are read once for fitting and scoring.
    """
    rows = stage(with_statistics(documents, text, (key, *keep)), "quality")
    fold = remainder(key, folds) == held_out
    model = _learn(rows, labels, fold, key, label)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_rows(batch.column(len(keep) + 2)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                [key, *keep, "held_out", "score", "predicted"],
            )

    schema = documents.select(key, *keep).schema.add("held_out", "boolean").add("score", "double").add("predicted", "integer")
    return rows.select(key, *keep, fold.alias("held_out"), "statistics").mapInArrow(apply, schema)


def good_documents(
    documents: DataFrame,
    labels: DataFrame,
    folds: int = 4,
    held_out: int = 2,
    threshold: float = 0.7,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> DataFrame:
    """The rows of ``documents`` that ``score_quality`` predicts 1 for, with all their columns.

    Each row is written once with its statistics and kept or left out where it lies, so texts
    are neither shuffled nor sorted.
    """

    rows = stage(with_statistics(documents, text, tuple(documents.columns), MEASURED), "quality")
    model = _learn(rows.select(key, F.col(MEASURED).alias("statistics")), labels, remainder(key, folds) == held_out, key, label)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = pa.array(model.score(_rows(batch.column(batch.num_columns - 1))) >= threshold)
            yield pa.RecordBatch.from_arrays([c.filter(kept) for c in batch.columns[:-1]], batch.schema.names[:-1])

    return rows.mapInArrow(good, documents.schema)
