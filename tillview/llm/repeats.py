"""Suffix-array dedup: longest-previous-factor arrays over the places that can repeat.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier, in a document of
smaller id or earlier in the same one. Whether a string of that length recurs is what the longest
previous factor (LPF) of its suffix tells: among suffixes in order, the nearest ones before and
after that start earlier (previous and next smaller position) share the longest earlier match.

A suffix array of all texts would move every byte many times. Anchors say where to look: every
window of ``LENGTH`` bytes has one, the least hash among its ``GRAM``-byte strings, and equal
windows have equal anchors at equal places. The windows of one anchor lie in a row and make its
context. So

1. anchors whose string occurs once cannot repeat: a count per string drops them;
2. contexts that are equal as a whole are one class, whose first stays to be looked at and whose
   others are repeats altogether (a hot passage costs one context);
3. first contexts that share an anchor string are dealt out in bundles of whole strings; a bundle
   gets the suffix order, the LCP and the LPF of its windows. Strings with more contexts than a
   bundle holds are dealt out further, by the hash of every window, so that no task gets them all;
4. what is found is cut out of the documents concerned; the others never move.

The texts are read once to count, once to list occurrences, once to fetch first contexts and once
to cut, and only positions and contexts are shuffled. Bit tables of fixed size keep most of what is not
needed from being sent; they may send too much, never too little.

Edge cases: null texts are empty; a null id comes first; rows that share an id are ordered by
text, and rows equal in both are one document, whose result each of them gets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from tillview.llm.arrays import INVERSE, _power, flat, mix, prefix_hash, range_hash, runs, slices
from tillview.llm.bits import BitTable, bit_table
from tillview.operators.lookup import look_up
from tillview.sources.staging import stage

LENGTH = 100
GRAM = 24
BUNDLE = 4096
SLICE = 1 << 18


@dataclass(frozen=True)
class Anchors:
    """Anchors of a slice of texts: string, place, and first and last window of each context."""

    gram: np.ndarray
    place: np.ndarray
    first: np.ndarray
    last: np.ndarray
    context: np.ndarray


def anchors(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Anchors:
    """Every window of ``length`` bytes within a text belongs to exactly one context."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return Anchors(none.view(np.uint64), none, none, none, none.view(np.uint64))
    sums = prefix_hash(data)
    grams = mix((sums[gram:] - sums[:-gram]) * _power(INVERSE, len(data) - gram + 1))
    # the hash above, the place below: the least is the leftmost of equal ones
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    reach, width = 1, length - gram + 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    window = np.arange(len(place))
    inside = np.zeros(len(place), dtype=bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= length:
            inside[a : b - length + 1] = True
    window, place = window[inside], place[inside]
    new = np.ones(len(window), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
    begin = np.flatnonzero(new)
    first = window[begin]
    last = window[np.append(begin[1:], len(window)) - 1] if len(begin) else first
    place = place[begin]
    context = mix(range_hash(sums, first, last + length) ^ (place - first).astype(np.uint64))
    return Anchors(grams[place], place, first, last, context)


# Documents in order


@dataclass(frozen=True)
class Numbered:
    """Documents with their place in the order: columns doc, id, text and copies.

    A position is ``doc << bits`` plus an offset in the text.
    """

    rows: DataFrame
    bits: int


def number(documents: DataFrame, key: str, text: str) -> Numbered:
    """Ids serve as they are if they are different integers, and ranks of (id, text) else."""
    body = F.coalesce(F.col(text), F.lit(""))
    facts = documents.agg(
        F.count("*"), F.countDistinct(key), F.min(key), F.max(key), F.max(F.octet_length(body))
    ).first()
    count, distinct, low, high, longest = facts
    bits = max(1, int(longest or 0).bit_length())
    plain = documents.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    if plain and count == distinct and (count == 0 or (high - low).bit_length() + bits <= 62):
        doc = F.col(key).cast("long") - (low or 0)
        return Numbered(
            documents.select(doc.alias("doc"), F.col(key).alias("id"), body.alias("text"), F.lit(1).cast("long").alias("copies")), bits
        )
    once = documents.select(F.col(key).alias("id"), body.alias("text")).groupBy("id", "text").agg(F.count("*").alias("copies"))
    ordered = once.orderBy(F.asc_nulls_first("id"), "text").withColumn("place", F.monotonically_increasing_id())
    ordered = stage(ordered.withColumn("part", F.shiftright("place", 33)), "repeats-numbered")
    sizes = sorted(tuple(r) for r in ordered.groupBy("part").count().collect())  # a row per partition
    before, starts = 0, []
    for part, size in sizes:
        starts.append((part, before))
        before += size
    spark = documents.sparkSession
    offsets = spark.createDataFrame(starts, "part long, before long")
    doc = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    rows = ordered.join(F.broadcast(offsets), "part").select(doc.alias("doc"), "id", "text", "copies")
    return Numbered(rows, bits)


# Passes over the texts


def _each(column: pa.Array, docs: np.ndarray, bits: int, length: int):
    """Slices with their anchors and the positions of these."""
    for row, data, at in slices(column, SLICE):
        found = anchors(data, at, length)
        if len(found.place):
            owner = np.searchsorted(at, found.place, side="right") - 1
            yield data, found, (docs[row + owner] << bits) + (found.place - at[owner])


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def count_grams(numbered: Numbered, length: int) -> DataFrame:
    """gram and count of every anchor string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, at in slices(batch.column(0), SLICE):
                yield pa.RecordBatch.from_arrays([_signed(anchors(data, at, length).gram)], ["gram"])

    return numbered.rows.select("text").mapInArrow(run, "gram long").groupBy("gram").count()


def occurrences(numbered: Numbered, repeated: BitTable, length: int) -> DataFrame:
    """gram, context, position, before (windows before the anchor) and windows, of repeated strings."""
    shared = numbered.rows.sparkSession.sparkContext.broadcast(repeated)
    bits = numbered.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy()
            for _, found, position in _each(batch.column(1), docs, bits, length):
                some = shared.value.may_hold(found.gram)
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(found.gram[some]),
                        _signed(found.context[some]),
                        pa.array(position[some]),
                        pa.array((found.place - found.first)[some].astype(np.int32)),
                        pa.array((found.last - found.first + 1)[some].astype(np.int32)),
                    ],
                    ["gram", "context", "position", "before", "windows"],
                )

    return numbered.rows.select("doc", "text").mapInArrow(
        run, "gram long, context long, position long, before int, windows int"
    )


def _named(gram: np.ndarray, position: np.ndarray) -> np.ndarray:
    return mix(gram ^ mix(position.view(np.uint64)))


def name_occurrences(wanted: DataFrame) -> DataFrame:
    """Adds name, a hash of gram and position, by the same rule as the tasks use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, position = (batch.column(k).to_numpy() for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, _signed(_named(gram.view(np.uint64), position))], ["gram", "position", "size", "name"]
            )

    return wanted.select("gram", "position", "size").mapInArrow(
        run, "gram long, position long, size long, name long"
    )


def contexts(numbered: Numbered, names: BitTable, length: int) -> DataFrame:
    """name, start (position of the first window) and bytes of the contexts asked for (and of few others)."""
    shared = numbered.rows.sparkSession.sparkContext.broadcast(names)
    bits = numbered.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy()
            for data, found, position in _each(batch.column(1), docs, bits, length):
                name = _named(found.gram, position)
                some = shared.value.may_hold(name)
                if len(some):
                    start = position[some] - (found.place - found.first)[some]
                    bounds = zip(found.first[some].tolist(), (found.last[some] + length).tolist(), strict=True)
                    own = [data[a:b].tobytes() for a, b in bounds]
                    yield pa.RecordBatch.from_arrays(
                        [_signed(name[some]), pa.array(start), pa.array(own, pa.binary())], ["name", "start", "bytes"]
                    )

    return numbered.rows.select("doc", "text").mapInArrow(run, "name long, start long, bytes binary")


# Suffix order


def _equal_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes of different words are equal."""
    differ = a ^ b
    return sum(((differ >> np.uint64(8 * k)) == 0).astype(np.int64) for k in range(8))


def suffix_order(data: np.ndarray, starts: np.ndarray, position: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first ``length`` bytes, then position, and the LCP of neighbours.

    ``lcp[i]`` is that of the suffixes at ``order[i - 1]`` and ``order[i]``, ``lcp[0]`` is 0. Eight
    bytes are compared at a time, and only suffixes that were equal so far are compared further.
    """
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    n = len(starts)
    order, lcp = np.arange(n), np.zeros(n, dtype=np.int64)
    places, group = np.arange(n), np.zeros(n, dtype=np.int64)  # of the suffixes still to be told apart
    for k in range(0, length, 8):
        some = order[places]
        word = eight[np.minimum(starts[some] + k, len(data))].view(">u8").ravel().astype(np.uint64)
        if length - k < 8:
            rest = np.uint64(8 * (8 - length + k))
            word = word >> rest << rest
        sub = np.lexsort((word, group))
        word, some = word[sub], some[sub]
        order[places] = some
        same = group[1:] == group[:-1]
        apart = np.flatnonzero(same & (word[1:] != word[:-1])) + 1
        lcp[places[apart]] = k + _equal_bytes(word[apart], word[apart - 1])
        same[apart - 1] = False  # neighbours that are equal so far
        tied = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        group = np.cumsum(np.concatenate([[True], ~same]))[tied]
        places = places[tied]
        if not len(places):
            return order, lcp
    sub = np.lexsort((position[order[places]], group))
    order[places] = order[places][sub]
    lcp[places[1:][group[1:] == group[:-1]]] = length
    return order, np.minimum(lcp, length)


def _smaller_before(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """LCP of each suffix with the nearest one before it that has a smaller position (0 if none).

    Pointers jump over larger positions: what lies between a suffix and its pointer is larger.
    """
    n = len(position)
    pointer = np.arange(-1, n - 1)
    shared = lcp.copy()
    todo = np.flatnonzero((pointer >= 0) & (shared > 0))
    while len(todo):
        todo = todo[position[pointer[todo]] > position[todo]]
        over = pointer[todo]
        shared[todo] = np.minimum(shared[todo], shared[over])
        pointer[todo] = pointer[over]
        ended = (pointer[todo] < 0) | (shared[todo] == 0)
        shared[todo[ended]] = 0
        pointer[todo[ended]] = -1
        todo = todo[~ended]
    return shared


def longest_previous(data: np.ndarray, starts: np.ndarray, position: np.ndarray, length: int) -> np.ndarray:
    """LPF of every suffix, up to ``length``: its longest prefix that also starts at a smaller position."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    order, lcp = suffix_order(data, starts, position, length)
    ordered = position[order]
    before = _smaller_before(ordered, lcp)
    back = np.concatenate([[0], lcp[1:][::-1]])
    after = _smaller_before(ordered[::-1].copy(), back)[::-1]
    out = np.zeros(len(starts), dtype=np.int64)
    out[order] = np.maximum(before, after)
    return out


def _intervals(start: np.ndarray, windows: np.ndarray, covered: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs of covered windows of each context, as start and size in bytes."""
    owner = np.repeat(np.arange(len(windows)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    hit = np.flatnonzero(covered)
    if not len(hit):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64())], ["start", "size"])
    cut = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])])
    begin = hit[cut]
    end = hit[np.append(np.flatnonzero(cut)[1:], len(hit)) - 1]
    return pa.RecordBatch.from_arrays(
        [pa.array(start[owner[begin]] + offset[begin]), pa.array(end - begin + length)], ["start", "size"]
    )


def repeats_in_bundle(table: pa.Table, length: int) -> pa.Table:
    """Start and size of the repeats in the contexts of one bundle."""
    data, at = flat(table["bytes"].combine_chunks())
    start, windows = table["start"].to_numpy(), np.diff(at) - length + 1
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    position = np.repeat(start, windows) + offset
    lpf = longest_previous(data, np.repeat(at[:-1], windows) + offset, position, length)
    return pa.Table.from_batches([_intervals(start, windows, lpf >= length, length)])


def window_hashes(rows: DataFrame, length: int) -> DataFrame:
    """window (a hash) and start of every window of the contexts of hot strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, at in slices(batch.column(1), SLICE):
                windows = np.diff(at) - length + 1
                offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
                first = np.repeat(at[:-1], windows) + offset
                start = batch.column(0).to_numpy()[row : row + len(windows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(range_hash(prefix_hash(data), first, first + length)),
                        pa.array(np.repeat(start, windows) + offset),
                    ],
                    ["window", "start"],
                )

    return rows.select("start", "bytes").mapInArrow(run, "window long, start long")


# The whole


def find_repeats(numbered: Numbered, length: int = LENGTH) -> DataFrame:
    """start (a position) and size of pieces that cover all repeated windows; pieces may overlap."""
    grams = stage(count_grams(numbered, length).where("count > 1").select("gram"), "repeats-grams")
    found = stage(occurrences(numbered, bit_table(grams, "gram"), length), "repeats-occurrences")
    found = found.withColumn("class", F.xxhash64("gram", "context"))
    classes = stage(
        found.groupBy("gram", "context", "class").agg(F.min("position").alias("earliest"), F.count("*").alias("count")),
        "repeats-classes",
    )
    # 1. later members of a class are repeats as a whole
    several = classes.where("count > 1")
    later = look_up(
        found.select("class", "position", "before", "windows"),
        several.select("class", "earliest"),
        "class",
        "inner",
        several.select("class", "count"),
    ).where("position > earliest")
    whole = later.select(
        (F.col("position") - F.col("before")).alias("start"), (F.col("windows") + length - 1).cast("long").alias("size")
    )
    # 2. first members of classes that share a string
    sizes = stage(classes.groupBy("gram").agg(F.count("*").alias("count")).where("count > 1"), "repeats-sizes")
    wanted = look_up(
        classes.select("gram", F.col("earliest").alias("position")),
        sizes.select("gram", F.col("count").alias("size")),
        "gram",
        "inner",
        sizes,
    )
    wanted = stage(name_occurrences(wanted), "repeats-wanted")
    firsts = stage(
        contexts(numbered, bit_table(wanted, "name"), length).join(wanted, "name").select("gram", "size", "start", "bytes"),
        "repeats-contexts",
    )
    cold = firsts.where(F.col("size") <= BUNDLE)
    bundles = max(1, -(-4 * cold.count() // BUNDLE))
    in_bundles = (
        cold.select(F.pmod(F.xxhash64("gram"), F.lit(bundles)).alias("bundle"), "start", "bytes")
        .groupBy("bundle")
        .applyInArrow(lambda table: repeats_in_bundle(table, length), "start long, size long")
    )
    hot = stage(window_hashes(firsts.where(F.col("size") > BUNDLE), length), "repeats-windows")
    earliest = hot.groupBy("window").agg(F.min("start").alias("earliest"), F.count("*").alias("count"))
    earliest = stage(earliest.where("count > 1"), "repeats-earliest")
    of_hot = look_up(
        hot, earliest.select("window", "earliest"), "window", "inner", earliest.select("window", "count")
    ).where("start > earliest")
    return whole.unionByName(in_bundles).unionByName(of_hot.select("start", F.lit(length).cast("long").alias("size")))


def cut_repeats(
    documents: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", keep_bytes: bool = False
) -> DataFrame:
    """``key``, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    With ``keep_bytes`` also kept, the remaining bytes (which need not be whole characters).
    """
    numbered = number(documents, key, text)
    pieces = find_repeats(numbered, length)
    mask = (1 << numbered.bits) - 1
    by_doc = stage(
        pieces.select(
            F.shiftright("start", numbered.bits).alias("doc"),
            F.struct(F.col("start").bitwiseAND(F.lit(mask)).alias("at"), "size").alias("piece"),
        )
        .groupBy("doc")
        .agg(F.collect_set("piece").alias("pieces"))
        .select("doc", F.col("pieces.at").alias("begins"), F.col("pieces.size").alias("sizes")),
        "repeats-pieces",
    )
    concerned = numbered.rows.sparkSession.sparkContext.broadcast(bit_table(by_doc.select(F.xxhash64("doc").alias("h")), "h"))
    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes
    schema = documents.select(key).schema
    for name in names[1:4]:
        schema = schema.add(name, LongType())
    schema = schema.add("kept_sha256", StringType())
    if keep_bytes:
        schema = schema.add("kept", "binary")

    def results(some: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Results of id, text, copies, begins and sizes."""
        for row, data, at in slices(some.column(1)):
            part = some.slice(row, len(at) - 1)
            found = _cut(data, at, part.column(3), part.column(4))
            once = pa.RecordBatch.from_arrays([part.column(0), *found[: len(names) - 1]], names)
            copies = part.column(2).to_numpy()
            several = np.repeat(np.arange(len(copies)), copies)
            yield once if len(several) == len(copies) else once.take(pa.array(several))

    def is_near(batch: pa.RecordBatch) -> np.ndarray:
        near = np.zeros(len(batch), dtype=bool)
        near[concerned.value.may_hold(batch.column(0).to_numpy().view(np.uint64))] = True
        return near

    def only_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.filter(pa.array(is_near(batch)))
            yield pa.RecordBatch.from_arrays(near.columns[1:], ["doc", "id", "text", "copies"])

    def cut_far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = batch.filter(pa.array(~is_near(batch)))
            none = pa.nulls(len(far), pa.list_(pa.int64()))
            yield from results(pa.RecordBatch.from_arrays([*far.columns[2:], none, none], far.schema.names[2:] + ["b", "s"]))

    def cut_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from results(batch)

    rows = numbered.rows.select(F.xxhash64("doc"), "doc", "id", "text", "copies")
    id_type = documents.schema[key].dataType.simpleString()
    near = rows.mapInArrow(only_near, f"doc long, id {id_type}, text string, copies long").join(by_doc, "doc", "left")
    near = near.select("id", "text", "copies", "begins", "sizes").mapInArrow(cut_near, schema)
    return near.unionByName(rows.mapInArrow(cut_far, schema))


def _cut(data: np.ndarray, at: np.ndarray, begins: pa.ListArray, sizes: pa.ListArray) -> list[pa.Array]:
    """Lengths, removed bytes, removed runs, digest and rest of texts less their pieces."""
    counts = begins.value_lengths().fill_null(0).to_numpy()
    begin = begins.flatten().to_numpy() + np.repeat(at[:-1], counts)
    end = begin + sizes.flatten().to_numpy()
    edge = np.bincount(begin, minlength=len(data) + 1) - np.bincount(end, minlength=len(data) + 1)
    gone = np.cumsum(edge[:-1]) > 0
    removed = np.concatenate([[0], np.cumsum(gone)])
    _, _, rows = runs(gone, at)
    bounds = at - removed[at]
    rest = data[~gone].tobytes()
    own = [rest[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return [
        pa.array(np.diff(at)),
        pa.array(np.diff(removed[at])),
        pa.array(np.bincount(rows, minlength=len(at) - 1)),
        pa.array([hashlib.sha256(x).hexdigest() for x in own], pa.string()),
        pa.array(own, pa.binary()),
    ]
