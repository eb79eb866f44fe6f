"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors are centred, rotated and cut to signs: principal axes and an iterative rotation that
keeps the signs close to the values, both learned on at most ``SAMPLE_ROWS`` vectors picked by a
hash of their id. Inner products of vectors of any length become angles by one more component,
which fills every vector up to the largest length. Codes split into substrings, and every block
of candidates has an index of each substring. A code within radius r of a query has a substring
within r / substrings of the query's (pigeonhole), so those buckets are probed; only rows found in
them have their codes compared, and only those within r their exact inner products taken, in double
precision. The first
radius is learned too: for vectors of the sample, the least that reaches ``RECALL`` of their true
neighbours among the sample. A query is probed again with a larger radius, up to all bits, until
its radius exceeds the distance of its own k-th nearest code by ``slack``. That is what true
neighbours lie beyond it in the sample, learned apart for dense and for sparse places, so that
tight groups do not set the reach of queries far from everything.

Equal vectors are one candidate with their smallest ids, as many as can be asked for, so a
vector that a third of all rows share costs one candidate. Queries meet all candidates in blocks
of bounded size (a stated query set against all rows); each block returns its best per query,
and the best of all blocks are merged without bringing a query's candidates together.

Edge cases: vectors that are null, empty, zero, of another length than most, or hold null or
non-finite components take no part; rows with equal ids are kept apart as far as their vectors
differ; ties go to smaller ids; fewer candidates than asked for are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillview.sources.staging import stage

SAMPLE_ROWS = 8192
SAMPLE_QUERIES = 512
RECALL = 0.97
SUBSTRING_BITS = 16
MOST_BITS = 128
BLOCK_ROWS = 8192
QUERY_BLOCK_ROWS = 2048
PROBE_ROWS = 128
STRATA = 8
STRATUM_QUERIES = 64
GROWTH = 4

ONES = np.array([bin(i).count("1") for i in range(1 << SUBSTRING_BITS)], dtype=np.uint8)


@dataclass(frozen=True)
class Codes:
    """The learned map from vectors to substrings of their codes, the first radius and the slack."""

    centre: np.ndarray
    axes: np.ndarray
    longest: float
    radius: int
    slack: int = 0

    def substrings(self, x: np.ndarray) -> np.ndarray:
        return self._pack(_fill(x, self.longest))

    def query_substrings(self, x: np.ndarray) -> np.ndarray:
        """Queries have length one and nothing to fill, as only their direction matters."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return self._pack(np.column_stack([unit, np.zeros(len(x))]))

    def _pack(self, filled: np.ndarray) -> np.ndarray:
        return np.packbits((filled - self.centre) @ self.axes > 0, axis=1, bitorder="little").view("<u2")


def _fill(x: np.ndarray, longest: float) -> np.ndarray:
    scaled = x / longest
    return np.column_stack([scaled, np.sqrt(np.maximum(1 - (scaled**2).sum(axis=1), 0))])


def distances(queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hamming distances of all pairs, from substrings."""
    out = np.zeros((len(queries), len(codes)), dtype=np.uint8)
    for k in range(codes.shape[1]):
        out += ONES[queries[:, k, None] ^ codes[None, :, k]]
    return out


def learn(sample: np.ndarray, longest: float, k: int, rounds: int = 30, seed: int = 1) -> Codes:
    """Fit axes, rotation and radius on a bounded sample; about as many bits as components."""
    filled = _fill(sample, longest)
    bits = min(MOST_BITS, max(1, sample.shape[1] // SUBSTRING_BITS) * SUBSTRING_BITS)
    centre = filled.mean(axis=0)
    _, vectors = np.linalg.eigh(np.cov((filled - centre).T) if len(sample) > 1 else np.eye(filled.shape[1]))
    rng = np.random.default_rng(seed)
    axes = vectors[:, ::-1][:, :bits]
    if axes.shape[1] < bits:  # fewer components than bits: more directions at random
        axes = np.column_stack([axes, rng.standard_normal((filled.shape[1], bits - axes.shape[1]))])
    z = (filled - centre) @ axes
    rotation = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.sign(z @ rotation).T @ z)
        rotation = (u @ v).T
    codes = Codes(centre, axes @ rotation, longest, bits)
    own, asked = codes.substrings(sample), codes.query_substrings(sample)
    k = min(k, max(1, len(sample) - 1))
    reach = np.concatenate(
        [
            np.partition(distances(asked[i : i + PROBE_ROWS], own), k - 1, axis=1)[:, k - 1]
            for i in range(0, len(sample), PROBE_ROWS)
        ]
    ).astype(int)

    def beyond(places: np.ndarray) -> np.ndarray:
        """Distances of the true neighbours of some vectors of the sample."""
        scores = sample[places] @ sample.T
        scores[np.arange(len(places)), places] = -np.inf
        top = np.argsort(-scores, axis=1)[:, :k]
        return np.take_along_axis(distances(asked[places], own), top, axis=1).astype(int)

    radius = int(np.ceil(np.quantile(beyond(np.arange(len(sample))[:SAMPLE_QUERIES]), RECALL)))
    slack = 0
    for some in _strata(reach):
        slack = max(slack, int(np.ceil(np.quantile(beyond(some) - reach[some, None], RECALL))))
    return Codes(centre, axes @ rotation, longest, radius, slack)


def _strata(reach: np.ndarray) -> list[np.ndarray]:
    """Places from the densest to the sparsest eighth of the sample, and the sparsest of all."""
    order = np.argsort(reach, kind="stable")
    eighths = [part for part in np.array_split(order, STRATA) if len(part)]
    return [part[:: -(-len(part) // STRATUM_QUERIES)] for part in eighths] + [order[-STRATUM_QUERIES:]]


#: Buckets that hold a larger share of a block are marked row by row, others by their lists.
FEW = 1 / 8


class BlockIndex:
    """Buckets of every substring of a block of codes, and the rows of each bucket."""

    def __init__(self, codes: np.ndarray):
        self.packed = _packed(codes)
        self.parts = []
        for k in range(codes.shape[1]):
            values, bucket = np.unique(codes[:, k], return_inverse=True)
            rows = np.argsort(bucket, kind="stable")
            self.parts.append((values, bucket, np.searchsorted(bucket[rows], np.arange(len(values) + 1)), rows))

    def probe(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows in some bucket whose value is within the pigeonhole's share of the query's, in order."""
        share = radius // len(self.parts)
        met = np.zeros(len(self.packed), dtype=bool)
        for k, (values, bucket, starts, rows) in enumerate(self.parts):
            close = ONES[values ^ query[k]] <= share
            near = np.flatnonzero(close)
            if (starts[near + 1] - starts[near]).sum() > FEW * len(met):
                met |= close[bucket]
            else:
                for first, end in zip(starts[near].tolist(), starts[near + 1].tolist(), strict=True):
                    met[rows[first:end]] = True
        return np.flatnonzero(met)

    def within(self, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose code lies within ``radius`` of the query's, and how far. Only rows met are compared."""
        met, far = self.distances(query, radius)
        kept = far <= radius
        return met[kept], far[kept]

    def distances(self, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows met when probing for ``radius``, and how far their codes are, some farther than that."""
        met = self.probe(query, radius)
        far = np.bitwise_count(self.packed[met] ^ _packed(query[None, :])).sum(axis=1, dtype=np.int64)
        return met, far


def _packed(codes: np.ndarray) -> np.ndarray:
    """Substrings of 16 bits by fours in words of 64."""
    wide = np.zeros((len(codes), -(-codes.shape[1] // 4) * 4), dtype="<u2")
    wide[:, : codes.shape[1]] = codes
    return wide.view("<u8")


def _reached(index: BlockIndex, query: np.ndarray, codes: Codes, k: int) -> np.ndarray:
    """Rows of a block to rank for a query.

    The radius grows by steps until it covers the k-th code of those met by the slack, or all bits. The k-th of the rows
    met is no nearer than the k-th of all, so a second probe is enough once k are met.
    """
    bits = SUBSTRING_BITS * len(index.parts)
    radius = codes.radius
    while True:
        met, far = index.distances(query, radius)
        if radius < bits and len(met) < min(k, len(index.packed)):
            radius = min(bits, radius + GROWTH)
            continue
        most = int(np.partition(far, k - 1)[k - 1]) + codes.slack if len(far) >= k else bits
        if min(most, bits) <= radius:
            return met[far <= radius]
        radius = min(bits, radius - (radius - most) // GROWTH * GROWTH)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by score, then by smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))][:k]
    return np.lexsort((ids, -scores))[:k]


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is present, of some length other than zero, and finite throughout."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ok & F.exists(vector, lambda x: x != 0))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(
    rows: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, ``key`` and score of the ``k`` nearest rows of every query, other than its own id."""
    spark = rows.sparkSession
    classes = stage(_classes(_prepared(rows, key, vector), k + 1), "hamming-classes")
    lengths = classes.groupBy(F.size("v").alias("n")).agg(
        F.count("*").alias("rows"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")
    )
    shape = lengths.orderBy(F.desc("rows"), F.desc("n")).first()
    if shape is None:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    classes = classes.where(F.size("v") == shape["n"])
    sample = classes.orderBy(F.xxhash64(F.col("ids")[0])).limit(SAMPLE_ROWS).select("v").toArrow()["v"]
    codes = spark.sparkContext.broadcast(learn(_matrix(sample), float(np.sqrt(shape["longest"])), k))

    asked = stage(_prepared(queries, key, vector).where(F.size("v") == shape["n"]).distinct(), "hamming-queries")
    blocks = max(1, -(-shape["rows"] // BLOCK_ROWS))
    parts = max(1, -(-asked.count() // QUERY_BLOCK_ROWS))

    def every(n: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    candidates = classes.select(
        F.lit(False).alias("asks"),
        F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(blocks)).alias("block"),
        every(parts).alias("part"),
        "ids",
        "v",
    )
    askers = asked.select(
        F.lit(True).alias("asks"),
        every(blocks).alias("block"),
        F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"),
        F.array("id").alias("ids"),
        "v",
    )

    def one_block(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        q, x = _matrix(table["v"].filter(pa.array(asks))), _matrix(table["v"].filter(pa.array(~asks)))
        ids = table["ids"].to_pylist()
        own = [i[0] for i, a in zip(ids, asks, strict=True) if a]
        ids = [i for i, a in zip(ids, asks, strict=True) if not a]
        found = list(_search_block(codes.value, own, q, ids, x, k)) if len(q) and len(x) else []
        query, member, score = zip(*found, strict=True) if found else ((), (), ())
        return pa.table(
            {
                "query_id": pa.array(query, pa.int64()),
                "vec_id": pa.array(member, pa.int64()),
                "score": pa.array(score, pa.float64()),
            }
        )

    found = (
        candidates.unionByName(askers)
        .groupBy("block", "part")
        .applyInArrow(one_block, "query_id long, vec_id long, score double")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
    )
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(key), "score")


def _prepared(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Usable rows as id and v."""
    some = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return usable(some, "v").where("id is not null")


def _classes(rows: DataFrame, most: int) -> DataFrame:
    """One row per different vector, with its ``most`` smallest ids in order.

    Spark drops the other ids of a vector before the shuffle.
    """
    by_vector = Window.partitionBy("v").orderBy("id")
    few = rows.distinct().withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= most)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _search_block(
    codes: Codes, own: list[int], q: np.ndarray, ids: list[list[int]], x: np.ndarray, k: int
) -> Iterator[tuple[int, int, float]]:
    """The best of one block for each query: id of the query, id of the row, inner product."""
    first = np.array([i[0] for i in ids])
    index, asked = BlockIndex(codes.substrings(x)), codes.query_substrings(q)
    for i in range(len(q)):
        # one more than k, as the query itself may be among them
        place = _reached(index, asked[i], codes, k + 1)
        scores = x[place] @ q[i]
        best = place[_best(scores, first[place], k + 1)]
        found = [
            (-float(np.dot(x[j], q[i])), member) for j in best.tolist() for member in ids[j] if member != own[i]
        ]
        for score, member in sorted(found)[:k]:
            yield own[i], member, -score
