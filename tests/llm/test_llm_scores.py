"""Classifiers: accuracy on held-out rows, folds, and independence of everything but the text."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import table
from pyspark.sql import functions as F

from tillview.llm import quality, toxicity
from tillview.llm.labelled import one_label

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in table(spark, "labels", FOLDER).collect()}


def _accuracy(rows, labels, name):
    known = [(r.predicted, labels[r.doc_id][name]) for r in rows if r.held_out and r.doc_id in labels]
    return np.mean([p == y for p, y in known]), known


def test_quality_of_held_out_rows(spark, labels):
    rows = quality.score_quality(table(spark, "documents", FOLDER), table(spark, "labels", FOLDER)).collect()
    accuracy, _ = _accuracy(rows, labels, "quality")
    assert accuracy > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_toxicity_of_held_out_rows(spark, labels):
    docs, known = table(spark, "documents", FOLDER), table(spark, "labels", FOLDER)
    rows = toxicity.score_toxicity(docs, known).collect()
    accuracy, pairs = _accuracy(rows, labels, "toxic")
    assert accuracy > 0.93
    assert sum(p for p, y in pairs if y) > 0.6 * sum(y for _, y in pairs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    # labels of the held-out fold change nothing
    flipped = known.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)


def test_labels_of_one_id_are_one(spark):
    rows = [(1, 0), (1, 1), (2, 0), (2, None), (None, 1), (3, None)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    assert sorted(tuple(r) for r in one_label(labels, "doc_id", "toxic").collect()) == [(1, 1), (2, 0)]


def test_discriminant_is_the_log_density_difference(spark):
    rng = np.random.default_rng(0)
    d = len(quality.STATISTICS)
    x = np.vstack([rng.normal(0, 1, (300, d)), rng.normal(0.7, 2, (200, d))])
    y = np.repeat([0, 1], [300, 200])
    rows = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y, strict=True)], "statistics array<double>, label int")
    model = quality.fit(rows, pooled=0.0, ridge=0.0)

    def density(c):
        own = x[y == c]
        cov = np.cov(own.T, bias=True)
        z = x - own.mean(axis=0)
        return -0.5 * (z * np.linalg.solve(cov, z.T).T).sum(axis=1) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(len(own))

    want = 1 / (1 + np.exp(-np.clip(density(1) - density(0), -50, 50)))
    assert np.allclose(model.score(x), want, atol=1e-8)


def _plain_ratios(texts):
    """Log ratios of every word in its place, by dictionaries; labels None for texts that only the corpus counts."""
    cut = [(re.findall(r"[0-9_a-z]+", text.lower()), label) for text, label in texts]
    corpus = Counter(w for found, _ in cut for w in found)
    pairs = [Counter(), Counter()]
    for found, label in cut:
        if label is not None:
            pairs[label].update(zip([None, *found], found))

    def probability(history, word, of):
        def discount(values):
            values = list(values)
            once, twice = values.count(1), values.count(2)
            return once / (once + 2 * twice) if once else 0.5

        types = Counter(w for _, w in of)
        d = discount(types.values())
        share = (corpus[word] + 0.5) / (sum(corpus.values()) + 0.5 * len(corpus))
        p = (max(types[word] - d, 0) + d * len(types) * share) / len(of)
        after = [n for (h, _), n in of.items() if h == history]
        if not after:
            return p
        d = discount(of.values())
        return (max(of[history, word] - d, 0) + d * len(after) * p) / sum(after)

    return [
        [math.log(probability(h, w, pairs[1]) / probability(h, w, pairs[0])) for h, w in zip([None, *found], found)]
        for found, _ in cut
    ]


def test_ratios_against_plain_kneser_ney(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = 1 / np.arange(1, 61)
    texts = []
    for i in range(60):
        label = [0, 1, None][i % 3]
        tilt = weights[::-1] if label == 1 else weights
        found = rng.choice(vocabulary, size=rng.integers(0, 25), p=(weights + tilt) / (weights + tilt).sum())
        texts.append((" ".join([*found, f"Once{i}"]), label))
    df = spark.createDataFrame([(t, -1 if y is None else y) for t, y in texts], "text string, counted int")
    model = toxicity.fit(toxicity.count_words(df.repartition(3)))
    singles = [w for t, _ in texts for w in t.split()].count("Once1")
    assert singles == 1
    batch = pa.array([t for t, _ in texts])
    for _, _, rows, word, history in toxicity.word_keys(batch):
        got, _ = model.ratios(word, history)
    want = _plain_ratios(texts)
    assert np.allclose(got, np.concatenate(want), atol=1e-5)
    assert [int(n) for n in np.bincount(rows, minlength=len(texts))] == [len(x) for x in want]


def test_sample_of_labels_keeps_its_bounds(spark):
    docs = spark.createDataFrame([(i, "x" * (5000 if i == 7 else 10)) for i in range(100)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(120)], "label_key long, label int")
    all_rows = toxicity.sample_labels(docs, known, 1000, 6000).collect()
    assert sorted(r.label_key for r in all_rows) == list(range(100))
    some = {r.label_key for r in toxicity.sample_labels(docs, known, 1000, 640).collect()}
    assert 60 <= len(some) <= 64 and 7 not in some  # whole buckets of hashes
    again = {r.label_key for r in toxicity.sample_labels(docs.repartition(5), known, 1000, 640).collect()}
    assert some == again
