"""Jaccard join on word shingles: MinHash banding, then exact verification.

A document is the set of its shingles of five words in lower case; one with fewer words is one
shingle. Documents with equal sets are one node. Each of ``TREES`` bands hashes a prefix of as many
min-hashes; nodes that share one are candidates. All prefixes have the length, ``DEEPEST`` at most,
at which a pair of the least similarity meets in some band with probability ``TARGET``. (A forest
would keep tries and shorten prefixes by what they hold; here one depth serves all data.)

Nodes joined by shared prefixes form candidate groups. All pairs within a group are verified
exactly, from overlaps of their sets, so a pair that no trie found counts as well if its group
holds both. Groups of more than ``BLOCK`` nodes are verified block against block, in as many
tasks as there are pairs of blocks; a task returns one row per node (its links there and the
root of its local component), never the pairs. Classes are connected components of the links.

The first pass over the texts returns one small row per document; the sets of nodes in groups
come from a second pass, in which a bit table of fixed size drops most others.

Edge cases: null, empty and wordless texts link to nothing and are classes of their own; repeated
ids keep one row each; a null id is a document like any other (but cannot name its class: it is
the least id that is not null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tillview.llm.arrays import mix, slices, windows, words
from tillview.llm.bits import bit_table
from tillview.llm.components import components
from tillview.operators.lookup import look_up
from tillview.sources.staging import stage

SHINGLE_WORDS = 5
SIMILARITY = 0.8
TREES, DEEPEST, TARGET = 40, 8, 0.99999
BLOCK = 1024
PATTERN_ROWS = 2048
#: Texts are handled by slices of so many bytes, so that arrays of shingles stay small.
SLICE = 1 << 18


def prefix_depth(similarity: float, trees: int = TREES, deepest: int = DEEPEST, target: float = TARGET) -> int:
    """The longest prefix that lets a pair of this similarity meet with probability ``target``."""
    depth = deepest
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < target:
        depth -= 1
    return depth


def shingle_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of texts in lower case, in order within each text, and their bounds."""
    _, _, rows, hashes = words(data, at)
    n = len(at) - 1
    bounds = np.searchsorted(rows, np.arange(n + 1))
    shingles, first = windows(hashes, rows, SHINGLE_WORDS)
    owner = rows[first]
    short = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < SHINGLE_WORDS))
    if len(short):
        whole = np.array([_whole(hashes[bounds[i] : bounds[i + 1]]) for i in short.tolist()], dtype=np.uint64)
        shingles, owner = np.concatenate([shingles, whole]), np.concatenate([owner, short])
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    if len(shingles):
        new = np.ones(len(shingles), dtype=bool)
        new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
        shingles, owner = shingles[new], owner[new]
    return shingles, np.searchsorted(owner, np.arange(n + 1))


def _whole(hashes: np.ndarray) -> int:
    out = np.uint64(len(hashes))
    for h in hashes:
        out = mix(np.array([out]) * np.uint64(31) + h)[0]
    return int(out)


def _sum_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def set_keys(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    return mix(_sum_by(mix(shingles), bounds) + np.diff(bounds).astype(np.uint64))


def prefixes(shingles: np.ndarray, bounds: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Row per nonempty set: for each tree, a hash of the tree and the first ``depth`` min-hashes."""
    filled = bounds[:-1][np.diff(bounds) > 0]
    out = np.zeros((len(filled), trees), dtype=np.uint64)
    rng = np.random.default_rng(5)
    for tree in range(trees):
        label = np.full(len(filled), tree + 1, dtype=np.uint64)
        for _ in range(depth):
            a, b = rng.integers(1, 1 << 63, 2, dtype=np.uint64)
            if len(filled):
                least = np.minimum.reduceat(shingles * (a | np.uint64(1)) + b, filled)
                label = mix(label * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, tree] = label
    return out


def _own(keys: np.ndarray, ids: pa.Array) -> np.ndarray:
    """A hash of a set and the document that holds it."""
    return mix(keys ^ mix(ids.to_numpy(zero_copy_only=False).view(np.uint64)))


def sketch(documents: DataFrame, key: str, text: str, depth: int) -> DataFrame:
    """key, node (null without words), own and prefixes of every document."""
    schema = documents.select(key).schema.add("node", LongType()).add("own", LongType())
    schema = schema.add("prefixes", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, at in slices(pc.utf8_lower(batch.column(2)), SLICE):
                n = len(at) - 1
                shingles, bounds = shingle_sets(data, at)
                empty = np.diff(bounds) == 0
                keys = set_keys(shingles, bounds)
                found = prefixes(shingles, bounds, TREES, depth)
                sizes = np.where(empty, 0, TREES)
                lists = pa.ListArray.from_arrays(
                    np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(found.ravel().view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, n),
                        pa.array(keys.view(np.int64), mask=empty),
                        pa.array(_own(keys, batch.column(1).slice(row, n)).view(np.int64)),
                        lists,
                    ],
                    schema.names,
                )

    return documents.select(key, F.xxhash64(key), text).mapInArrow(run, schema)


def sets_of(documents: DataFrame, own: DataFrame, key: str, text: str) -> DataFrame:
    """own and shingles of the documents that ``own`` names (and of few others)."""
    shared = documents.sparkSession.sparkContext.broadcast(bit_table(own, "own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, at in slices(pc.utf8_lower(batch.column(1)), SLICE):
                shingles, bounds = shingle_sets(data, at)
                named = _own(set_keys(shingles, bounds), batch.column(0).slice(row, len(at) - 1))
                some = shared.value.may_hold(named)
                if len(some):
                    own = [shingles[bounds[i] : bounds[i + 1]] for i in some.tolist()]
                    lists = pa.ListArray.from_arrays(
                        np.cumsum([0, *map(len, own)]).astype(np.int32), pa.array(np.concatenate(own).view(np.int64))
                    )
                    yield pa.RecordBatch.from_arrays([pa.array(named[some].view(np.int64)), lists], ["own", "shingles"])

    return documents.select(F.xxhash64(key), text).mapInArrow(run, "own long, shingles array<long>")


def overlaps(shingles: np.ndarray, member: np.ndarray, n: int) -> np.ndarray:
    """How many shingles each pair of ``n`` sets shares, the sizes on the diagonal.

    Shingles that the same sets hold count together; products of matrices do the rest.
    """
    order = np.argsort(shingles, kind="stable")
    shingles, member = shingles[order], member[order]
    first = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]]))
    counts = np.diff(np.append(first, len(shingles)))
    sizes = np.bincount(member, minlength=n)
    shared = np.repeat(counts > 1, counts)
    member, counts = member[shared], counts[counts > 1]
    out = np.zeros((n, n), dtype=np.float64)
    if len(counts):
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        marks = mix(np.arange(1, n + 1, dtype=np.uint64))
        pattern = np.add.reduceat(marks[member], starts)
        _, one, weight = np.unique(pattern, return_index=True, return_counts=True)
        kind = np.float32 if weight.sum() < 1 << 24 else np.float64  # counts stay exact
        for begin in range(0, len(one), PATTERN_ROWS):
            some = one[begin : begin + PATTERN_ROWS]
            held = np.zeros((len(some), n), dtype=kind)
            taken = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(counts[some])[:-1]]), counts[some])
            held[np.repeat(np.arange(len(some)), counts[some]), member[taken + np.arange(len(taken))]] = 1
            out += held.T @ (held * weight[begin : begin + PATTERN_ROWS, None].astype(kind))
    np.fill_diagonal(out, sizes)
    return out


def _roots(linked: np.ndarray) -> np.ndarray:
    """Least member of each member's component."""
    root = np.arange(len(linked))
    while True:
        least = np.where(linked, root[None, :], len(root)).min(axis=1)
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def verify(table: pa.Table, similarity: float) -> pa.Table:
    """Links of the nodes of one group, or of one block with another: node, links, root."""
    node = table["node"].to_numpy()
    node, one = np.unique(node, return_index=True)
    lists = table["shingles"].combine_chunks().take(pa.array(one))
    copies, block = table["copies"].to_numpy()[one], table["block"].to_numpy()[one]
    lengths = np.diff(lists.offsets.to_numpy())
    shingles = lists.flatten().to_numpy().view(np.uint64)
    shared = overlaps(shingles, np.repeat(np.arange(len(node)), lengths), len(node))
    sizes = np.diag(shared)
    linked = shared >= similarity * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
    np.fill_diagonal(linked, False)
    if table["i"][0].as_py() != table["j"][0].as_py():
        linked &= block[:, None] != block[None, :]
    return pa.table({"node": node, "links": (linked * copies[None, :]).sum(axis=1), "root": node[_roots(linked)]})


def near_duplicates(
    documents: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, class_id and n_links of every document.

    class_id is the least id of the class; n_links the number of other documents with at least
    this similarity, copies included.
    """
    id_type = documents.schema[key].dataType.simpleString()
    rows = stage(sketch(documents, key, text, prefix_depth(similarity)), "near-sketch")
    nodes = stage(
        rows.where("node is not null")
        .groupBy("node")
        .agg(
            F.min(F.struct(key, "own")).alias("first"),
            F.min(key).alias("least_id"),
            F.count("*").alias("copies"),
            F.any_value("prefixes").alias("prefixes"),
        )
        .select("node", "least_id", "first.own", "copies", "prefixes"),
        "near-nodes",
    )
    members = nodes.select("node", F.explode("prefixes").alias("prefix"))
    shared = members.groupBy("prefix").agg(F.min("node").alias("least"), F.count("*").alias("count"))
    shared = stage(shared.where("count > 1"), "near-prefixes")
    met = look_up(members, shared.select("prefix", "least"), "prefix", "inner", shared.select("prefix", "count"))
    groups = components(met.select(F.col("node").alias("a"), F.col("least").alias("b")))
    groups = stage(groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()), "near-groups")
    sizes = stage(groups.groupBy("root").agg(F.count("*").alias("count")), "near-sizes")
    blocked = look_up(groups, sizes.withColumnRenamed("count", "size"), "root", "inner", sizes).withColumn(
        "blocks", F.ceil(F.col("size") / BLOCK).cast("int")
    )
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    blocked = stage(blocked.join(nodes.select("node", "own", "copies"), "node"), "near-blocks")
    sets = sets_of(documents, blocked.select("own"), key, text)
    placed = blocked.join(sets, "own").select(
        "root", "node", "copies", "block", "shingles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
    )
    placed = placed.select(
        "root", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "node", "copies", "block", "shingles"
    )
    found = stage(
        placed.groupBy("root", "i", "j").applyInArrow(
            lambda table: verify(table, similarity), "node long, links long, root long"
        ),
        "near-links",
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    facts = (
        nodes.select("node", "least_id", "copies")
        .join(links, "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    facts = stage(facts, "near-facts")
    class_sizes = facts.groupBy("root").agg(F.min("least_id").alias("class_id"), F.count("*").alias("count"))
    class_sizes = stage(class_sizes, "near-classes")
    named = look_up(
        facts, class_sizes.select("root", "class_id"), "root", "inner", class_sizes.select("root", "count")
    )
    named = named.select(
        "node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies"
    )
    named = stage(named, "near-named")
    out = look_up(
        rows.select(key, "node"),
        named.drop("copies"),
        "node",
        counts=named.select("node", F.col("copies").alias("count")),
    )
    return out.select(
        key,
        F.when(F.col("node").isNull(), F.col(key)).otherwise(F.col("class_id")).cast(id_type).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
