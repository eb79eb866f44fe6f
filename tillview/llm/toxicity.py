"""Toxicity: class-conditional Kneser-Ney models over words.

A toxic and an ordinary model give every word a probability after the word before it:
discounted counts of the pair, then the class's continuation counts of the word, then the
word's share of the whole corpus, which both classes share. Rare words therefore say little
about the class. Words and pairs are told apart by 64-bit hashes; every pair and every word
that was counted stays in the model, those seen once included.

The shared level counts the words of all documents, in a table that is grouped and joined and
never leaves the executors. The class levels are fitted on a sample: labelled rows in the order
of a hash of their id, at most ``LABELLED_ROWS`` of them with texts of at most
``LABELLED_BYTES`` bytes together; texts above a 64th of that come last. These two numbers bound
what is broadcast: ids and labels, and a ratio for each word, word before and pair of the
sample (fewer than half as many of each as bytes).

A text's evidence is the length-normalised difference of its log-likelihoods; of its strong words
(more than ``STRONG`` nats by continuation counts, the level that pairs back off to) the mean and
the sum of what exceeds that; and its length. Pairs seen once carry large ratios of either sign, so
strong ones among them say little. A logistic function of these, fitted on a quarter of the
sample that the counts leave out, turns them into a score.
Texts are never shuffled.

Edge cases: null texts count as empty and get the score of no evidence; repeated ids keep one
row each. Without both classes among the labels the score is their mean (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillview.llm.arrays import BASE, mix, slices, words
from tillview.llm.labelled import one_label, remainder
from tillview.sources.staging import stage

LABELLED_ROWS = 1_000_000
LABELLED_BYTES = 1 << 26
STRONG = 2.5
CALIBRATION_FOLDS = 4
CLASSES = ("ordinary", "toxic")

#: What stands before the first word of a text.
START = 0
FLUSH_WORDS = 1 << 20
SAMPLE_BUCKETS = 1 << 12


def _many(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def word_keys(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, row count, and row, hash and hash of the word before of every word."""
    for row, data, at in slices(pc.utf8_lower(column)):
        _, _, rows, hashes = words(data, at)
        word = hashes.view(np.int64)
        history = np.full(len(word), START, dtype=np.int64)
        if len(word):
            history[1:] = np.where(rows[1:] == rows[:-1], word[:-1], START)
        yield row, len(at) - 1, rows, word, history


def pair_keys(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(history.view(np.uint64) * np.uint64(BASE) + word.view(np.uint64))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one task: rows of (history, word, ordinary, toxic, corpus).

    Words of the corpus are rows too, with themselves as history and no class counts.
    """
    every: list[np.ndarray] = []
    known: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if every:
            word, counts = np.unique(np.concatenate(every), return_counts=True)
            yield _rows(word, word, 0 * counts, 0 * counts, counts)
        if known:
            history, word, label = (np.concatenate(part) for part in zip(*known, strict=True))
            _, first, which = np.unique(pair_keys(history, word), return_index=True, return_inverse=True)
            both = np.bincount(which)
            toxic = np.bincount(which, weights=label).astype(np.int64)
            yield _rows(history[first], word[first], both - toxic, toxic, 0 * both)

    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for row, count, rows, word, history in word_keys(batch.column(0)):
            every.append(word)
            own = label[row : row + count][rows]
            counted = own >= 0
            if counted.any():
                known.append((history[counted], word[counted], own[counted]))
            held += len(word)
            if held >= FLUSH_WORDS:
                yield from flush()
                every, known, held = [], [], 0
    yield from flush()


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x.astype(np.int64)) for x in columns], ["history", "word", *CLASSES, "corpus"]
    )


def count_words(texts: DataFrame) -> DataFrame:
    """Counts of every pair by class and of every word of the corpus, from (text, class or -1).

    With each pair stand the sums and numbers of pairs of its history: all rows of a history meet
    in one shuffle, already summed by task. There are at most as many as the sample has words.
    """
    found = texts.mapInArrow(_count_words, "history long, word long, ordinary long, toxic long, corpus long")
    summed = (
        found.repartition("history")
        .groupBy("history", "word")
        .agg(*(F.sum(c).alias(c) for c in (*CLASSES, "corpus")))
    )
    same = Window.partitionBy("history")
    of_history = {f"{c}_sum": F.sum(c).over(same) for c in CLASSES}
    of_history |= {f"{c}_pairs": _many(F.col(c) > 0).over(same) for c in CLASSES}
    return summed.withColumns(of_history)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        history, word = (batch.column(i).to_numpy() for i in range(2))
        key = pa.array(pair_keys(history, word).view(np.int64))
        yield pa.RecordBatch.from_arrays([key, batch.column(2)], ["key", "ratio"])


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of sorted keys, NaN for others."""
    one, which = np.unique(wanted, return_inverse=True)
    place = np.minimum(np.searchsorted(keys, one), len(keys) - 1)
    return np.where(keys[place] == one, values[place], np.nan)[which]


@dataclass(frozen=True)
class Model:
    """Log ratios toxic to ordinary of words, of backoff weights of words before and of pairs, by
    sorted keys; and that of a word the sample lacks, which is the same for all."""

    word_keys: np.ndarray
    word: np.ndarray
    history_keys: np.ndarray
    history: np.ndarray
    pair_keys: np.ndarray
    pair: np.ndarray
    unseen: float

    def ratios(self, word: np.ndarray, history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratios of words after the word before them, and of words by continuation counts alone."""
        if not len(word):
            return np.zeros(0), np.zeros(0)
        pair = _find(self.pair_keys, self.pair, pair_keys(history, word))
        alone = np.nan_to_num(_find(self.word_keys, self.word, word), nan=self.unseen)
        back = np.nan_to_num(_find(self.history_keys, self.history, history), nan=0.0)
        return np.where(np.isnan(pair), alone + back, pair), alone


def _discount(once: float, twice: float) -> float:
    return once / (once + 2 * twice) if once else 0.5


def _columns(df: DataFrame) -> dict[str, np.ndarray]:
    table = df.toArrow()
    return {name: table[name].to_numpy() for name in table.column_names}


def _totals(df: DataFrame, *more: Column) -> dict[str, float]:
    """Sums of both classes, and how many rows have 1, 2 and any."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CLASSES]
    ones = [_many(F.col(c) == k).alias(f"{c}_{k}") for c in CLASSES for k in (1, 2)]
    return df.agg(*sums, *ones, *(_many(F.col(c) > 0).alias(f"{c}_any") for c in CLASSES), *more).first().asDict()


def fit(counts: DataFrame) -> Model | None:
    """The model of summed ``counts``; None if a class has no words.

    Driver and broadcasts: some numbers for each word, word before and pair of the sample, which
    its bytes bound.
    """
    pairs = counts.where("ordinary + toxic > 0")
    of_pairs = _totals(pairs)
    if not all(of_pairs[c] for c in CLASSES):
        return None
    by_word = stage(
        counts.groupBy("word").agg(F.sum("corpus").alias("corpus"), *(_many(F.col(c) > 0).alias(c) for c in CLASSES)),
        "toxicity-words",
    )
    of_words = _totals(by_word, F.sum("corpus").alias("corpus"), F.count("*").alias("types"))
    share = (F.col("corpus") + 0.5) / (of_words["corpus"] + 0.5 * of_words["types"])
    alone, back, both, unseen = [], [], [], []
    for c in CLASSES:
        d = _discount(of_words[f"{c}_1"], of_words[f"{c}_2"])
        rest = d * of_words[f"{c}_any"] / of_words[c]
        unseen.append(rest)
        alone.append((F.greatest(F.col(c) - d, F.lit(0.0)) / of_words[c] + rest * share).alias(f"{c}_alone"))
        d = _discount(of_pairs[f"{c}_1"], of_pairs[f"{c}_2"])
        sums = F.col(f"{c}_sum")
        back.append(F.when(sums > 0, d * F.col(f"{c}_pairs") / sums).otherwise(1.0))
        both.append(F.greatest(F.col(c) - d, F.lit(0.0)) / F.greatest(sums, F.lit(1)) + back[-1] * F.col(f"{c}_alone"))
    of_word = by_word.where("ordinary + toxic > 0").select("word", *alone)
    of_pair = pairs.join(F.broadcast(of_word), "word")

    def ratio(over: Column, under: Column) -> Column:
        return F.log(over / under).cast("float").alias("ratio")

    pair = _columns(of_pair.select("history", "word", ratio(both[1], both[0])).mapInArrow(_keyed, "key long, ratio float"))
    word = _columns(of_word.select("word", ratio(F.col("toxic_alone"), F.col("ordinary_alone"))))
    history = _columns(pairs.groupBy("history").agg(F.first(ratio(back[1], back[0])).alias("ratio")))
    parts = [(word["word"], word["ratio"]), (history["history"], history["ratio"])]
    parts.append((pair["key"].view(np.uint64), pair["ratio"]))
    ordered = [x[order] for keys, values in parts for order in [np.argsort(keys)] for x in (keys, values)]
    return Model(*ordered, float(np.log(unseen[1] / unseen[0])))


def with_evidence(documents: DataFrame, model: Model, keep: list[str], text: str) -> DataFrame:
    """The columns ``keep`` of every document, and n, total and strong: words and log ratios."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = documents.select(*keep).schema
    for name in ("n", "total", "strong"):
        schema = schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total, strong = (np.zeros(len(batch)) for _ in range(3))
            for row, count, rows, word, history in word_keys(batch.column(len(keep))):
                ratios, alone = shared.value.ratios(word, history)
                to = slice(row, row + count)
                n[to] = np.bincount(rows, minlength=count)
                total[to] = np.bincount(rows, weights=ratios, minlength=count)
                strong[to] = np.bincount(rows, weights=np.maximum(alone - STRONG, 0), minlength=count)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], *map(pa.array, (n, total, strong))], [*keep, "n", "total", "strong"]
            )

    return documents.select(*keep, text).mapInArrow(run, schema)


def evidence() -> list[Column]:
    n = F.greatest(F.col("n"), F.lit(1.0))
    return [F.col("total") / n, F.col("strong") / n, F.log1p("strong"), F.log1p("n")]


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights of a ridge logistic regression, the intercept first, for ``x`` as it is."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + ridge * len(y) * w
        curve = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * len(y) * np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    return np.concatenate([[w[0] - (w[1:] * centre / scale).sum()], w[1:] / scale])


def sample_labels(
    documents: DataFrame, known: DataFrame, rows: int, size: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Labels of the rows to fit on: in hash order, at most ``rows``, their texts at most ``size`` bytes.

    Whole buckets of hashes are taken while they fit, of which there are ``SAMPLE_BUCKETS``. Texts
    of more than a 64th of ``size`` come after all others. Ids without a document go.
    """
    total = known.count()
    if total > rows:
        share = int(rows / total * 0.99 * (1 << 30))
        known = known.where(F.pmod(F.xxhash64("label_key"), F.lit(1 << 30)) < share)
    sizes = (
        documents.select(key, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("label_bytes"))
        .join(F.broadcast(known), F.col(key) == F.col("label_key"))
        .groupBy("label_key", "label")
        .agg(F.sum("label_bytes").alias("label_bytes"))
    )
    sizes = stage(sizes, "toxicity-sizes")
    bucket = [
        (F.col("label_bytes") > size // 64).alias("label_long"),
        F.pmod(F.xxhash64("label_key"), F.lit(SAMPLE_BUCKETS)).alias("label_bucket"),
    ]
    buckets = sizes.groupBy(*bucket).agg(F.sum("label_bytes").alias("label_bytes"))
    order = Window.orderBy("label_long", "label_bucket").rowsBetween(Window.unboundedPreceding, 0)
    upto = buckets.withColumn("label_upto", F.sum("label_bytes").over(order))
    kept = upto.where(F.col("label_upto") <= size).select("label_long", "label_bucket")
    return (
        sizes.select("label_key", "label", *bucket)
        .join(F.broadcast(kept), ["label_long", "label_bucket"])
        .select("label_key", "label")
    )


def score_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    folds: int = 5,
    held_out: int = 0,
    threshold: float = 0.5,
    labelled_rows: int = LABELLED_ROWS,
    labelled_bytes: int = LABELLED_BYTES,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> DataFrame:
    """``key``, held_out, score and predicted of every document.

    Learns from labelled documents outside fold ``held_out`` only.
    """
    known = one_label(labels, key, label).where(remainder("label_key", folds) != held_out)
    known = stage(sample_labels(documents, known, labelled_rows, labelled_bytes, key, text), "toxicity-labels")
    out = [F.col(key), (remainder(key, folds) == held_out).alias("held_out")]
    joined = documents.select(key, text).join(F.broadcast(known), F.col(key) == F.col("label_key"), "left")
    aside = F.pmod(F.xxhash64(key, F.lit("calibrate")), F.lit(CALIBRATION_FOLDS)) == 0
    parts = joined.select(
        key, text, "label", F.when(F.col("label").isNotNull() & ~aside, F.col("label")).otherwise(-1).alias("counted")
    )
    counts = stage(count_words(parts.select(text, "counted")), "toxicity-counts")
    model = fit(counts)
    if model is None:
        mean = known.agg(F.avg("label")).first()[0]
        score = F.lit(0.5 if mean is None else float(mean))
        return documents.select(*out, score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
    rows = stage(
        with_evidence(parts.select(key, "label", "counted", text), model, [key, "label", "counted"], text), "toxicity"
    )
    names = [f"x{i}" for i in range(4)]
    fitted = rows.where("label is not null").select(
        "label", "counted", *(c.alias(x) for c, x in zip(evidence(), names, strict=True))
    )
    sample = _columns(fitted.where("counted < 0"))
    if len(set(sample["label"].tolist())) < 2:
        sample = _columns(fitted)
    weights = calibrate(np.column_stack([sample[x] for x in names]), sample["label"])
    linear = F.lit(float(weights[0]))
    for weight, column in zip(weights[1:], evidence(), strict=True):
        linear = linear + float(weight) * column
    score = 1 / (1 + F.exp(-linear))
    return rows.select(*out, score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
