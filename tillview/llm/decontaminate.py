"""Benchmark decontamination: spaced seeds, then verification that tolerates substitutions.

A seed hashes the words of a window at fixed offsets and ignores the others, so that a changed
word at an ignored place does not hide a copy. The three masks together hit every stretch of
``WINDOW`` words of which at least ``SAME`` are equal. They miss some changes of items of
``SHORT`` sizes, which leave them fewer places, so these items have four masks more; together
they hit whatever changes ``need`` allows. Seeds of documents meet seeds of the
benchmark in a join; a fixed-size bit table of the benchmark's seeds lets documents drop seeds
that cannot meet any before the join (it may keep some in vain, never lose one).

A hit fixes an alignment. A document is contaminated if, within ``WINDOW`` words of the hit,
``WINDOW`` aligned words in a row have at least ``SAME`` equal ones. Of items shorter than
``WINDOW`` words four fifths must be equal; items shorter than a mask must occur as they are;
items of fewer than ``LEAST`` words prove nothing and are left out.

Stretches of words around hits are verified once per different stretch, however many documents
hold a copy. Edge cases: null and empty texts contain nothing; rows that share an id, or have
none, count as one document; a null item_id is not listed, but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from tillview.llm.arrays import BASE, mix, slices, words
from tillview.llm.bits import BitTable, bit_table
from tillview.operators.lookup import look_up
from tillview.sources.staging import stage

WINDOW, SAME = 16, 13
LEAST = 5
#: Word offsets that count.
MASKS = ((0, 3, 4, 6, 7, 8), (0, 1, 2, 3, 6, 8), (0, 1, 5, 6, 7, 8))
SPAN = 9
#: Sizes of items of which the masks miss some allowed changes, and further masks for these.
SHORT = (9, 10, 11, 12, 15)
SHORT_MASKS = ((0, 1, 2, 3, 5, 6), (0, 3, 4, 5, 6, 7), (0, 1, 3, 4, 5, 8), (0, 1, 2, 3, 5, 7))


def need(size: int) -> int:
    """Equal words that prove an item of ``size`` words, within ``WINDOW`` words if it is longer."""
    return SAME if size >= WINDOW else -(-4 * size // 5) if size >= SPAN else size


def masks_of(size: int) -> tuple[tuple[int, ...], ...]:
    """Masks whose seeds stand for an item of ``size`` words."""
    if size < SPAN:
        return (tuple(range(size)),)
    return MASKS + SHORT_MASKS if size in SHORT else MASKS


def seeds(hashes: np.ndarray, rows: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every window; windows do not cross rows."""
    span = mask[-1] + 1
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    salt = sum(1 << k for k in mask)
    out = np.full(n, salt, dtype=np.uint64)
    for k in mask:
        out = out * np.uint64(BASE) + hashes[k : k + n]
    first = np.flatnonzero(rows[:n] == rows[span - 1 :])
    return mix(out[first]), first


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _lists(values: pa.Array, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *sizes]).astype(np.int32), values)


def benchmark_words(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """One row per different item: item_key, item_id (the smallest) and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, at in slices(pc.utf8_lower(batch.column(1))):
                _, _, rows, hashes = words(data, at)
                count = len(at) - 1
                bounds = np.searchsorted(rows, np.arange(count + 1))
                keys = [_item_key(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()),
                        batch.column(0).slice(row, count),
                        _lists(_long(hashes), np.diff(bounds).tolist()),
                    ],
                    ["item_key", "item_id", "words"],
                )

    item_type = benchmark.schema[item].dataType.simpleString()
    found = benchmark.select(item, text).mapInArrow(run, f"item_key long, item_id {item_type}, words array<long>")
    return (
        found.where(F.size("words") >= LEAST)
        .groupBy("item_key")
        .agg(F.min("item_id").alias("item_id"), F.first("words").alias("words"))
    )


def _item_key(hashes: np.ndarray) -> int:
    """A hash of a sequence of words."""
    n = len(hashes)
    place = mix(np.arange(1, n + 1, dtype=np.uint64))
    return int(mix(np.array([(hashes * (place | np.uint64(1))).sum(dtype=np.uint64) + np.uint64(n)])).view(np.int64)[0])


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """Rows (seed, item_key, at): all windows of all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = np.array(own, dtype=np.int64).view(np.uint64)
                for mask in masks_of(len(hashes)):
                    found, first = seeds(hashes, np.zeros(len(hashes), dtype=np.int64), mask)
                    yield pa.RecordBatch.from_arrays(
                        [_long(found), pa.array(np.full(len(found), key)), pa.array(first.astype(np.int32))],
                        ["seed", "item_key", "at"],
                    )

    return items.select("item_key", "words").mapInArrow(run, "seed long, item_key long, at int").distinct()


def document_stretches(
    documents: DataFrame, table: BitTable, lengths: list[int], key: str, text: str
) -> DataFrame:
    """Words around seeds that may meet items of ``lengths``: key, stretch, words, seeds, places."""
    shared = documents.sparkSession.sparkContext.broadcast(table)
    masks = sorted({mask for n in lengths for mask in masks_of(n)})
    schema = documents.select(key).schema.add("stretch", LongType()).add("words", ArrayType(LongType()))
    schema = schema.add("seeds", ArrayType(LongType())).add("places", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, at in slices(pc.utf8_lower(batch.column(1))):
                _, _, rows, hashes = words(data, at)
                all_seeds, all_first, all_ends = [], [], []
                for mask in masks:
                    found, first = seeds(hashes, rows, mask)
                    near = shared.value.may_hold(found)
                    all_seeds.append(found[near])
                    all_first.append(first[near])
                    all_ends.append(first[near] + mask[-1] + 1)
                if not any(map(len, all_seeds)):
                    continue
                found, first, ends = map(np.concatenate, (all_seeds, all_first, all_ends))
                order = np.argsort(first, kind="stable")
                found, first, ends = found[order], first[order], ends[order]
                bounds = np.searchsorted(rows, np.arange(len(at)))
                owner = rows[first]
                begin = np.maximum(first - WINDOW, bounds[owner])
                end = np.minimum(ends + WINDOW, bounds[owner + 1])
                reach = np.maximum.accumulate(end)
                cut = np.concatenate([[True], (begin[1:] >= reach[:-1]) | (owner[1:] != owner[:-1])])
                groups = np.flatnonzero(cut)
                stop = np.append(groups[1:], len(found))
                a, b = begin[groups], reach[stop - 1]
                sizes = b - a
                inside = np.repeat(a - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                counts = (stop - groups).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row + owner[groups])),
                        pa.array([_item_key(hashes[x:y]) for x, y in zip(a, b, strict=True)], pa.int64()),
                        _lists(_long(hashes[inside]), sizes.tolist()),
                        _lists(_long(found), counts),
                        _lists(pa.array((first - np.repeat(a, counts)).astype(np.int32)), counts),
                    ],
                    schema.names,
                )

    return documents.select(key, text).mapInArrow(run, schema)


def find_contaminated(
    documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key`` and items, the sorted item ids, of every contaminated document, one row each."""
    items = stage(benchmark_words(benchmark), "decontaminate-items")
    table = stage(benchmark_seeds(items), "decontaminate-seeds")
    # sizes from WINDOW upwards have the same masks, so these are few
    sizes = items.select(F.least(F.size("words"), F.lit(WINDOW))).distinct()
    lengths = [r[0] for r in sizes.collect()]
    found = stage(
        document_stretches(documents, bit_table(table, "seed"), sorted(lengths), key, text), "decontaminate-stretches"
    )
    once = found.groupBy("stretch").agg(
        F.first("words").alias("words"), F.first("seeds").alias("seeds"), F.first("places").alias("places")
    )
    once = stage(once, "decontaminate-once")
    aligned = (
        once.select("stretch", F.explode(F.arrays_zip("seeds", "places")).alias("hit"))
        .select("stretch", F.col("hit.seeds").alias("seed"), F.col("hit.places").alias("place"))
        .join(table, "seed")
        .select("stretch", "item_key", (F.col("place") - F.col("at")).alias("shift"))
        .distinct()
    )
    pairs = aligned.join(once.select("stretch", "words"), "stretch").join(
        items.select("item_key", "item_id", F.col("words").alias("item")), "item_key"
    )
    same = F.expr(
        "transform(item, (w, i) -> if(i + shift < 0 or i + shift >= size(words), false, "
        "coalesce(get(words, cast(i + shift as int)) = w, false)))"
    )
    window = f"least({WINDOW}, size(item))"
    least = f"element_at(array({', '.join(str(need(n)) for n in range(1, WINDOW + 1))}), {window})"
    proof = F.expr(
        f"exists(sequence(1, size(same) - {window} + 1), "
        f"s -> size(filter(slice(same, s, {window}), x -> x)) >= {least})"
    )
    proven = (
        pairs.withColumn("same", same).where(proof).groupBy("stretch").agg(F.collect_set("item_id").alias("own"))
    )
    rows = look_up(found.select(key, "stretch"), proven, "stretch", "inner")
    return rows.groupBy(key).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("own")))).alias("items"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, contaminated, n_items and items of every document."""
    found = find_contaminated(documents, benchmark, key, text).select(F.col(key).alias("found_key"), "items")
    return (
        documents.select(key)
        .join(found, F.col(key).eqNullSafe(F.col("found_key")), "left")
        .select(
            key,
            F.col("items").isNotNull().alias("contaminated"),
            F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).alias("n_items"),
            F.coalesce("items", F.array().cast(found.schema["items"].dataType)).alias("items"),
        )
    )
