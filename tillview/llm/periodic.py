"""Runs of periodic words, by Lyndon arrays from phase one of a suffix sorter, and texts without their repeats.

A text is a sequence of words between ASCII spaces, tabs and line ends. A run is a stretch whose
smallest period is q and that no neighbouring word extends; ``find_runs`` reports those of at least
``EXPONENT`` periods and ``LEAST`` words.

Phase one of Baier's suffix sorter groups suffixes by a common prefix, which grows until it is the
longest Lyndon word that begins there. Groups are taken from the greatest to the least; each suffix
of a group looks for the nearest one to its left that lies in a lesser group (by paths compressed
past all that were taken), and those found move to a new group right above their old one, their
prefix longer by as many copies of the taken group's as suffixes found them. The same with the
order of words reversed gives the other Lyndon array. Every run holds a Lyndon root under one of
the two orders that is the longest Lyndon word at its start; so each such word is extended to
both sides by longest common extensions (binary search over prefix hashes, all words of a text
at once), which gives the run, and the run is compared word by word before it counts.

Words are cut out first that no reported run can hold: inside a run of at least four periods and
six words every three neighbouring words recur twice more in the text. What remains between cuts
is sorted apart; extensions look at the whole text again.

A word is dropped if some run holds it after the first period. Texts are independent of each
other: tasks see whole rows of a batch, in slices, and nothing is shuffled.

Edge cases: a null or empty text has no words, no runs and an empty rest; repeated rows and ids,
null ids and other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tillview.llm.arrays import mix, slices

EXPONENT = 4
LEAST = 6
GRAM = 3

#: One word, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"

#: Prefix hashes are polynomials modulo a prime of 31 bits, for two bases at once.
PRIME = (1 << 31) - 1
BASES = (1_000_003, 998_244_353)

_powers: dict[int, np.ndarray] = {}


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that begins at each place: phase one, greatest group first.

    Groups form a list in ascending order. A group that is taken is final, as what moves later
    comes from lesser groups and stays below it.
    """
    n = len(ranks)
    members: list[list[int]] = []
    length: list[int] = []
    group = [0] * n
    by_rank: dict[int, list[int]] = {}
    for i, rank in enumerate(ranks):
        by_rank.setdefault(rank, []).append(i)
    for rank in sorted(by_rank):
        for i in by_rank[rank]:
            group[i] = len(members)
        members.append(by_rank[rank])
        length.append(1)
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    # free[i + 1] leads to the nearest place not after i that was not taken, counted from 1; 0 is none
    free = list(range(n + 1))
    out = [1] * n
    now = len(members) - 1
    while now >= 0:
        size = length[now]
        taken = [i for i in members[now] if group[i] == now]
        for i in taken:
            out[i] = size
            free[i + 1] = i
        found: dict[int, int] = {}
        for i in taken:
            place = i
            while free[place] != place:
                free[place] = place = free[free[place]]
            if place:
                found[place - 1] = found.get(place - 1, 0) + 1
        split: dict[tuple[int, int], list[int]] = {}
        for j, times in found.items():
            split.setdefault((times, group[j]), []).append(j)
        # more copies sort higher: they go in first, and fewer slip in between them and the old group
        for (times, old), moved in sorted(split.items(), reverse=True):
            number, upper = len(members), above[old]
            members.append(moved)
            length.append(length[old] + times * size)
            below.append(old)
            above.append(upper)
            below[upper] = above[old] = number
            for j in moved:
                group[j] = number
        now = below[now]
    return out


def _power(base: int, n: int) -> np.ndarray:
    """``base**i`` modulo the prime for ``i < n``."""
    have = _powers.get(base, np.ones(1, dtype=np.int64))
    while len(have) < n:
        have = np.concatenate([have, have * (int(have[-1]) * base % PRIME) % PRIME])
    _powers[base] = have[: 1 << 20]
    return have[:n]


class Extensions:
    """Longest common extensions of a text's words, by hashes of their prefixes."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.sums, self.powers = [], []
        for k, base in enumerate(BASES):
            power = _power(base, self.n + 1)
            value = (mix(ids.astype(np.uint64) + np.uint64(k + 1)) >> np.uint64(34)).astype(np.int64)
            sums = np.zeros(self.n + 1, dtype=np.int64)
            np.cumsum(value * power[:-1] % PRIME, out=sums[1:])
            self.sums.append(sums % PRIME)
            self.powers.append(power)

    def _same(self, start: np.ndarray, end: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Whether ``[start, end)`` equals the words ``shift`` further on."""
        same = np.ones(len(start), dtype=bool)
        for sums, power in zip(self.sums, self.powers, strict=True):
            here = (sums[end] - sums[start]) % PRIME * power[shift] % PRIME
            same &= here == (sums[end + shift] - sums[start + shift]) % PRIME
        return same

    def _longest(self, most: np.ndarray, holds) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = holds(middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low

    def right(self, at: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """How many words from ``at`` on equal those ``shift`` further on."""
        return self._longest(self.n - at - shift, lambda m: self._same(at, at + m, shift))

    def left(self, at: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """How many words before ``at`` equal those ``shift`` further on."""
        return self._longest(at.copy(), lambda m: self._same(at - m, at, shift))


def crowded(ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Words of texts that a reported run may hold: those in a triple that is in its text three times.

    Unequal triples may count as one, which only lets more pass.
    """
    near = np.zeros(len(ids), dtype=bool)
    starts = np.flatnonzero(owner[: -GRAM + 1] == owner[GRAM - 1 :]) if len(ids) >= GRAM else near.nonzero()[0]
    if len(starts):
        key = mix(owner[starts].astype(np.uint64))
        for k in range(GRAM):
            key = mix(key * np.uint64(31) + ids[starts + k].astype(np.uint64))
        _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
        often = starts[counts[which] >= EXPONENT - 1]
        for k in range(GRAM):
            near[often + k] = True
    return near


def text_runs(ids: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Rows of start, length and period by start, then period, of a text's words; ``near`` are those in question."""
    edge = np.diff(np.concatenate([[0], near.astype(np.int8), [0]]))
    candidates = []
    for first, end in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        if end - first < LEAST:
            continue
        piece = ids[first:end].tolist()
        for order in (piece, [-rank for rank in piece]):
            period = np.array(lyndon_lengths(order))
            some = np.flatnonzero(period * EXPONENT <= len(piece))
            candidates.append(np.column_stack([some + first, period[some]]))
    if not candidates:
        return np.zeros((0, 3), dtype=np.int64)
    at, period = np.unique(np.concatenate(candidates), axis=0).T
    words = Extensions(ids)
    fits = at + period < len(ids)
    at, period = at[fits], period[fits]
    end = at + period + words.right(at, period)
    start = at - words.left(at, period)
    long = end - start >= np.maximum(LEAST, EXPONENT * period)
    found = np.unique(np.column_stack([start, end - start, period])[long], axis=0)
    exact = [(ids[s : s + n - q] == ids[s + q : s + n]).all() for s, n, q in found.tolist()]
    found = found[np.array(exact, dtype=bool)]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _repeated(runs: np.ndarray, n: int) -> np.ndarray:
    """Words that some run holds after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def _slice_runs(texts: list[bytes]) -> tuple[list[np.ndarray], list[bytes]]:
    """Runs of each text, and each without the repeats."""
    words = [text.split() for text in texts]
    known: dict[bytes, int] = {}
    number = known.setdefault
    ids = np.array([number(w, len(known)) for own in words for w in own], dtype=np.int64)
    bounds = np.cumsum([0, *map(len, words)])
    near = crowded(ids, np.repeat(np.arange(len(texts)), np.diff(bounds)))
    runs, rest = [], []
    for own, first, end in zip(words, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        runs.append(text_runs(ids[first:end], near[first:end]))
        if len(runs[-1]):
            own = [own[i] for i in np.flatnonzero(~_repeated(runs[-1], len(own))).tolist()]
        rest.append(b" ".join(own))
    return runs, rest


def find_runs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, runs (start, length and period, by start, then period) and collapsed of every document."""
    runs_type = ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))
    schema = documents.select(key).schema.add("runs", runs_type).add("collapsed", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, at in slices(batch.column(1)):
                raw = data.tobytes()
                runs, rest = _slice_runs([raw[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
                every = np.concatenate(runs)
                parts = [pa.array(every[:, i]) for i in range(3)]
                lists = pa.ListArray.from_arrays(
                    np.cumsum([0, *map(len, runs)]).astype(np.int32),
                    pa.StructArray.from_arrays(parts, ["start", "length", "period"]),
                )
                kept = pa.array(rest, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(runs)), lists, kept], schema.names)

    return documents.select(key, text).mapInArrow(run, schema)


def made_periodic(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and text, some texts periodic from some word on, as a checksum of the id says; a null id is empty text."""
    checksum = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    rest = F.floor(checksum / 10).cast("long")
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))

    def repeated(own: Column) -> Column:
        n = F.size(own)
        start = rest % n
        period = 1 + F.floor((n - start) / (3 + rest % 8))

        def word(w: Column, i: Column) -> Column:
            return F.when(i < start, w).otherwise(F.get(own, (start + (i - start) % period).cast("int")))

        return F.when(n > 0, F.array_join(F.transform(own, word), " ")).otherwise("")

    edited = F.transform(F.array(words), repeated)[0]
    return documents.select(key, F.when(checksum % 10 == 0, edited).otherwise(F.col(text)).alias(text))


def run_digest(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_runs, the longest run and digests of all runs and of the collapsed text, after ``made_periodic``."""
    found = find_runs(made_periodic(documents, key, text), key, text)
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), -r["start"], -r["period"]))
    best = F.array_max(ranked)
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", best).select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best")["col2"]).alias("start"),
        F.col("best")["length"].alias("length"),
        (-F.col("best")["col3"]).alias("period"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    return found.withColumn("exponent_milli", F.floor(1000 * F.col("length") / F.col("period")).cast("long"))
