"""Nearest neighbours by multi-index hashing."""

import numpy as np
import pytest
from llm_rows import table
from pyspark.sql import functions as F

from tillview.llm import hamming


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(rows, queries, k):
    """Nearest ids and scores of each query among equal-length rows, all of them candidates."""
    out = {}
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    for i, v in queries:
        score = x @ np.array(v, dtype=np.float32).astype(float)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_recall_and_scores_on_given_vectors(spark):
    df = table(spark, "embeddings", "/root/testdata/sf0.1")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    queries = [r for r in rows if r[0] % 20 == 0]
    want = brute(rows, queries, 20)
    found = hamming.search(df, df.where(F.col("vec_id") % 20 == 0), 20).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    exact = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows}
    for q, own in got.items():
        assert len(own) == 20 and q not in {i for i, _ in own}
        assert own == sorted(own, key=lambda t: (-t[1], t[0]))
        assert all(abs(s - exact[q] @ exact[i]) < 1e-12 for i, s in own)


def test_blocks_change_nothing(spark, monkeypatch):
    df = table(spark, "embeddings").limit(300)
    queries = df.where(F.col("vec_id") % 20 == 0)
    once = sorted(map(tuple, hamming.search(df, queries, 5).collect()))
    monkeypatch.setattr(hamming, "BLOCK_ROWS", 40)
    monkeypatch.setattr(hamming, "QUERY_BLOCK_ROWS", 4)
    assert sorted(map(tuple, hamming.search(df, queries, 5).collect())) == once


def test_ties_copies_and_unusable_vectors(spark):
    good = [(i, [1.0, 0.0, 0.0]) for i in range(40)] + [(40, [0.0, 2.0, 0.0]), (41, [0.5, 0.5, 0.0]), (7, [1.0, 0.0, 0.0])]
    bad = [
        (50, None), (51, []), (52, [0.0, 0.0, 0.0]), (53, [1.0, None, 0.0]), (54, [float("nan"), 1.0, 0.0]),
        (55, [float("inf"), 1.0, 0.0]), (56, [1.0, 1.0]), (None, [1.0, 0.0, 0.0]),
    ]
    df = vectors(spark, good + bad)
    rows = hamming.search(df, df.where("vec_id in (0, 40, 41, 50, 52, 53, 54, 55)"), 3).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got[0] == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)]
    assert set(got) <= {0, 40, 41}


def test_fewer_candidates_than_asked_for(spark):
    df = vectors(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.1]), (2, [1.1, 2.0])])
    rows = hamming.search(df, df.where("vec_id = 0"), 20).collect()
    assert sorted(r.vec_id for r in rows) == [1, 2]
    assert hamming.search(vectors(spark, []), vectors(spark, []), 20).collect() == []


def test_pigeonhole_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 16, (500, 4)).astype(np.uint16)
    queries = codes[:20] ^ (1 << rng.integers(0, 16, (20, 4))).astype(np.uint16)
    far = hamming.distances(queries, codes)
    index = hamming.BlockIndex(codes)
    for radius in (0, 3, 4, 9, 30, 64):
        for i, query in enumerate(queries):
            rows, apart = index.within(query, radius)
            assert rows.tolist() == np.flatnonzero(far[i] <= radius).tolist() and (apart == far[i][rows]).all()


def test_probing_spares_most_rows_of_tight_groups():
    """Rows whose buckets are not probed are neither compared nor multiplied; on grouped vectors that is most."""
    x = np.array([v for _, v in skewed(6000, 110, 90)])
    codes = hamming.learn(np.random.default_rng(1).permutation(x), float(np.linalg.norm(x, axis=1).max()), 20)
    index, asked = hamming.BlockIndex(codes.substrings(x)), codes.query_substrings(x)
    met = [len(index.probe(asked[i], codes.radius)) for i in range(1000, 1100)]
    ranked = [len(hamming._reached(index, asked[i], codes, 21)) for i in range(1000, 1100)]
    assert np.mean(met) < 0.35 * len(x) and np.mean(ranked) < 0.1 * len(x)


def test_clashing_columns_and_repeated_ids(spark):
    rows = [(i % 9, [float(i), float(i * i % 5), 1.0 + i % 3]) for i in range(18)]
    df = vectors(spark, rows)
    names = ("id", "v", "ids", "block", "part", "asks", "score", "query_id", "rank")
    plain = hamming.search(df, df.where("vec_id < 3"), 4).collect()
    clashing = df.withColumns({name: F.lit(name) for name in names})
    assert sorted(map(tuple, plain)) == sorted(map(tuple, hamming.search(clashing, clashing.where("vec_id < 3"), 4).collect()))
    best = {}
    for i, v in rows[:3]:
        for j, w in rows:
            if i != j:
                best.setdefault(i, {})[j] = max(best.get(i, {}).get(j, -np.inf), float(np.dot(v, w)))
    assert {r.query_id for r in plain} == {0, 1, 2} and all(r.vec_id != r.query_id for r in plain)


@pytest.mark.parametrize("n", [1, 2, 30])
def test_learning_from_few_vectors(n):
    codes = hamming.learn(np.random.default_rng(2).normal(size=(n, 5)), 3.0, 20)
    assert codes.substrings(np.ones((1, 5))).shape == (1, 1)


def skewed(n, groups, outliers, seed=3):
    """Most rows in tight groups of near copies, some on their own."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 64))
    x = centres[rng.integers(0, groups, n)] + 0.02 * rng.normal(size=(n, 64))
    x[:outliers] = rng.normal(size=(outliers, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_queries_far_from_tight_groups_find_all_they_ask_for(spark):
    rows = skewed(6000, 110, 90)
    df = vectors(spark, rows)
    queries = rows[:60] + rows[1000:1020]
    want = brute(rows, queries, 20)
    got = {}
    for r in hamming.search(df, df.where("vec_id < 60 or vec_id between 1000 and 1019"), 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert {q: len(own) for q, own in got.items()} == {q: 20 for q in want}
    hits = {q: len(got[q] & {i for i, _ in want[q]}) / 20 for q in want}
    assert np.mean([hits[q] for q in range(60)]) >= 0.9
    assert np.mean([hits[q] for q in range(1000, 1020)]) >= 0.9


@pytest.mark.parametrize("n", [2, 10, 15, 20, 25])
def test_small_tables_lose_no_rows(spark, n):
    rng = np.random.default_rng(n)
    df = vectors(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 32)))])
    counts = hamming.search(df, df, 20).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in counts} == {i: min(20, n - 1) for i in range(n)}
