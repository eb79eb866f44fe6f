"""Whitening against a plain eigendecomposition."""

import numpy as np
import pytest
from llm_rows import CLASHES, table
from pyspark.sql import functions as F

from tillview.llm import whitening


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def check(df, tolerance=1e-9):
    """Whitened rows by component against eigenvectors of the distinct integer vectors' covariance."""
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding is not None]
    x = np.floor(256 * np.array([v for _, v in rows], dtype=np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    covariance = np.cov(fit.T.astype(float), bias=True).reshape(x.shape[1], -1)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    want = (x - sums / n) @ axes
    found = whitening.whiten(df).collect()
    place = {i: k for k, (i, _) in enumerate(rows)}
    count = min(4, x.shape[1])
    assert len(found) == count * len(rows)
    for k in range(count):
        own = [r for r in found if r.component == k + 1]
        at = [place[r.vec_id] for r in own]
        assert all(r.n == n and r.deviation == int(((n * x[p] - sums) ** 2).sum()) for r, p in zip(own, at, strict=True))
        assert all(r.explained == pytest.approx(values[k] / max(covariance.trace(), 1e-300), rel=1e-9, abs=1e-12) for r in own)
        if values[k] > 1e-9:
            got, expected = np.array([r.whitened for r in own]), want[at, k] / np.sqrt(values[k])
            assert np.abs(got * np.sign(got @ expected) - expected).max() < tolerance
            assert all(r.identity_error <= 1e-8 for r in own)
        else:
            assert all(r.whitened is None for r in own)


def test_given_vectors(spark):
    check(table(spark, "embeddings"))


def test_copies_count_once_and_extra_columns(spark):
    df = table(spark, "embeddings").where("vec_id < 60")
    copies = df.unionByName(df.where("vec_id % 3 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000))
    check(copies)
    clashing = df.withColumns({c: F.lit(c) for c in (*CLASHES, "x", "v", "component", "deviation", "whitened", "explained")})
    assert sorted(map(tuple, whitening.whiten(clashing).select("vec_id", "component", "n").collect())) == sorted(
        map(tuple, whitening.whiten(df).select("vec_id", "component", "n").collect())
    )


def test_dependent_dimensions_and_equal_variances(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 2)).astype(np.float32)
    flat = np.column_stack([base, base[:, :1], np.zeros((200, 3), dtype=np.float32)])
    check(vectors(spark, [(i, v.tolist()) for i, v in enumerate(flat)]))
    signs = np.array([[s * (j == k) for j in range(5)] for k in range(5) for s in (-1.0, 1.0)])
    found = whitening.whiten(vectors(spark, [(i, v.tolist()) for i, v in enumerate(signs)])).collect()
    assert len(found) == 40 and all(r.explained == pytest.approx(0.2) and r.identity_error < 1e-9 for r in found)


@pytest.mark.parametrize("rows", [1, 2, 5])
def test_few_rows(spark, rows):
    rng = np.random.default_rng(rows)
    check(vectors(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(rows, 6)))]))


def test_short_vectors(spark):
    rng = np.random.default_rng(4)
    for size in (1, 3):
        check(vectors(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, size)))]))


def test_unusable_rows_and_ids(spark):
    good = [(i, [float(i), float(i * i % 7), 1.0]) for i in range(20)] + [(None, [3.0, 1.0, 0.5]), (4, [2.0, -0.0, 0.0])]
    bad = [(50, None), (51, []), (52, [1.0, None, 0.0]), (53, [float("nan"), 1.0, 0.0]), (54, [float("-inf"), 1.0, 0.0]), (55, [1.0])]
    found = whitening.whiten(vectors(spark, good + bad)).collect()
    assert sorted(r.vec_id if r.vec_id is not None else -1 for r in found if r.component == 1) == sorted(
        i if i is not None else -1 for i, _ in good
    )
    assert whitening.whiten(vectors(spark, bad[:5])).collect() == []
    assert whitening.whiten(vectors(spark, [])).collect() == []


def test_deviations_beyond_a_long_are_null():
    x = np.array([[1 << 40, 0], [1, 2]], dtype=np.int64)
    assert whitening._deviations(x, 1 << 10, [5, 6]) == [None, (1024 - 5) ** 2 + (2048 - 6) ** 2]


def test_bidiagonal_form():
    """The right vectors are orthogonal and the values those of the matrix, from any start."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=(300, 12)) * np.geomspace(1, 1e-5, 12)

    def product(q, before):
        y = a @ q
        return float(y @ y), (a @ before).T @ y, a.T @ y

    want = np.linalg.svd(a, compute_uv=False)
    for seed in range(4):
        values, axes = whitening.bidiagonalise(product, 12, float((a**2).sum()), 12, seed)
        assert np.allclose(values, want, rtol=1e-6, atol=0) and np.allclose(axes @ axes.T, np.eye(12), atol=1e-10)
