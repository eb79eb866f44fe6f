"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

**Pieces.** Code points become classes through one array. Where pieces begin is what a small
automaton says, which is not run character by character: every class is a function from states
to states, functions compose associatively, and the functions that can arise form a small
monoid whose products are a table. A scan with that table in blocks, all blocks abreast, gives
the state before every character at a fixed number of array operations; no regular expression
is used. White space alone needs to look one character ahead: of a run before other text the
last character goes to what follows if it is a space, and stands alone otherwise.

**Merging.** Pieces are looked up in a cache of bounded size (two generations), else whole in the vocabulary, else
merged pair by pair, lowest rank first and leftmost among equals: short ones all abreast, long
ones with a heap, so that a piece of any length takes n log n steps.

**Decoding** takes a token's bytes from one array by offset and length.

The vocabulary file is read on the driver (a fixed file of some 50,000 entries) and broadcast.
Each row is handled alone, so nothing is shuffled. Null and empty texts have no tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType

from tillview.llm.arrays import slices

#: Classes of characters, after the contractions 's 't 'd 'm and 're 've 'll have been marked.
END, LETTER, NUMBER, OTHER, SPACE, BLANK, LONE, QUOTE2, QUOTE3 = range(9)
#: States: what the piece so far is. The last three count characters a contraction still takes.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_BLANKS, AFTER_SPACE, TAKE1, TAKE2 = range(8)
STATES, CLASSES = 8, 9

#: Characters that Unicode calls white space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

BLOCK = 256


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a piece begins at the character."""
    if state == TAKE2:
        return TAKE1, False
    if state == TAKE1:
        return START, False
    joined = state == AFTER_SPACE
    if kind == LETTER:
        return IN_LETTERS, not (joined or state == IN_LETTERS)
    if kind == NUMBER:
        return IN_NUMBERS, not (joined or state == IN_NUMBERS)
    if kind in (OTHER, QUOTE2, QUOTE3):
        if joined or state == IN_OTHER:
            return IN_OTHER, False
        return {OTHER: IN_OTHER, QUOTE2: TAKE1, QUOTE3: TAKE2}[kind], True
    if kind == SPACE:  # the last of its run, with text after it
        return AFTER_SPACE, True
    if kind == LONE:  # the same, but not a space: it stands alone
        return START, True
    if kind == BLANK:
        return IN_BLANKS, state != IN_BLANKS
    return START, True  # END, between two texts


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Element of each class, products, state each element leads to from START, and boundaries."""
    by_class = [tuple(_step(s, k)[0] for s in range(STATES)) for k in range(CLASSES)]
    elements = {tuple(range(STATES)): 0}
    todo = list(elements)
    while todo:
        f = todo.pop()
        for g in by_class:
            h = tuple(g[s] for s in f)
            if h not in elements:
                elements[h] = len(elements)
                todo.append(h)
    size = len(elements)
    table = np.zeros((size, size), dtype=np.uint16)
    for f, i in elements.items():
        for g, j in elements.items():
            table[i, j] = elements[tuple(g[s] for s in f)]
    leads = np.zeros(size, dtype=np.uint8)
    for f, i in elements.items():
        leads[i] = f[START]
    begins = np.array([[_step(s, k)[1] for k in range(CLASSES)] for s in range(STATES)])
    return np.array([elements[g] for g in by_class], dtype=np.uint16), table, leads, begins


def _scan(elements: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Products of all prefixes: in blocks abreast, then over the blocks' products."""
    n = len(elements)
    if n <= BLOCK:
        out = elements.copy()
        for k in range(1, n):
            out[k] = table[out[k - 1], out[k]]
        return out
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, dtype=np.uint16)  # 0 is the identity
    grid[:n] = elements
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    flat, size = table.ravel(), np.uint32(table.shape[0])
    for k in range(1, BLOCK):
        grid[k] = flat[grid[k - 1] * size + grid[k]]
    before = np.zeros(blocks, dtype=np.uint16)
    before[1:] = _scan(grid[-1], table)[:-1]
    return flat[before[None, :] * size + grid].T.ravel()[:n]


@cache
def _classes() -> np.ndarray:
    """Class of every code point; white space is BLANK."""
    out = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for point in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            out[point] = LETTER
        elif kind == "N":
            out[point] = NUMBER
    out[WHITE] = BLANK
    return out


def piece_starts(points: np.ndarray) -> np.ndarray:
    """Where pieces begin; a NUL that ``mark`` has put between texts counts as a piece."""
    n = len(points)
    kinds = _classes()[np.minimum(points, sys.maxunicode)]
    kinds[points == MARK] = END
    white = kinds == BLANK
    last = np.zeros(n, dtype=bool)  # the last of a run of white space, with text after it
    last[:-1] = white[:-1] & ~white[1:] & (kinds[1:] != END)
    kinds[last] = np.where(points[last] == 32, SPACE, LONE)
    quotes = np.flatnonzero(points == 39)
    one = points[np.minimum(quotes + 1, n - 1)]
    two = points[np.minimum(quotes + 2, n - 1)]
    fits = quotes + 1 < n
    kinds[quotes[fits & np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE2
    fits = quotes + 2 < n
    pairs = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e")))
    pairs |= (one == ord("l")) & (two == ord("l"))
    kinds[quotes[fits & pairs]] = QUOTE3
    elements, table, leads, begins = _monoid()
    products = _scan(elements[kinds], table)
    state = np.zeros(n, dtype=np.uint8)
    state[1:] = leads[products[:-1]]
    return np.flatnonzero(begins[state, kinds])


#: Pieces of up to so many bytes are cached, and merged abreast.
SHORT = 32
#: Above every rank.
NONE = 1 << 62

#: Stands between texts; no code point has this value.
MARK = 0x110000


def pieces(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all pieces in bytes, and the row of each."""
    if not len(data):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if len(lead) == len(data):
        points = data.astype(np.uint32)
    else:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    row_starts = at[:-1][at[1:] > at[:-1]]
    first = np.searchsorted(lead, row_starts)
    marked = np.insert(points, first, MARK)
    starts = piece_starts(marked)
    starts = starts[marked[starts] != MARK]
    marks = np.searchsorted(first + np.arange(len(first)), starts, side="left")
    begin = lead[starts - marks]
    end = np.append(begin[1:], len(data))
    return begin, end, np.searchsorted(at, begin, side="right") - 1


class Vocabulary:
    """Ranks of byte strings; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], cache_entries: int = 1 << 17):
        self.ranks = ranks
        self.cache_entries = cache_entries
        self.byte_ids = np.array([ranks.get(bytes([b]), 0) for b in range(256)], dtype=np.int64)
        pairs = sorted(
            (ranks[w[:i]] << 32 | ranks[w[i:]], rank)
            for w, rank in ranks.items()
            for i in range(1, len(w))
            if w[:i] in ranks and w[i:] in ranks
        )
        self.pair_keys = np.array([p[0] for p in pairs] or [-1], dtype=np.int64)
        self.pair_ranks = np.array([p[1] for p in pairs] or [NONE], dtype=np.int64)
        self.cached: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        words: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for word, rank in ranks.items():
            words[rank] = word
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(words), dtype=np.uint8)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what two tokens make together, ``NONE`` if that is no token."""
        keys = left << 32 | right
        place = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[place] == keys, self.pair_ranks[place], NONE)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many short pieces: in every round each piece merges its lowest pair."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces])
        owner = np.repeat(np.arange(len(pieces)), sizes)
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        rank = np.full(len(ids), NONE)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self._pair_ranks(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(starts, len(owner)))
            lowest = np.minimum.reduceat(rank, starts)
            ended = lowest == NONE
            if ended.any():
                gone = np.repeat(ended, sizes)
                raw = ids[gone].astype("<u4").tobytes()
                to = np.cumsum(sizes[ended]) * 4
                for piece, x, y in zip(
                    owner[starts[ended]].tolist(), [0, *to[:-1].tolist()], to.tolist(), strict=True
                ):
                    out[piece] = raw[x:y]
                ids, owner, rank = ids[~gone], owner[~gone], rank[~gone]
                lowest, sizes = lowest[~ended], sizes[~ended]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, sizes))
            at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])]  # the leftmost of each
            ids[at] = rank[at]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            at = at - np.arange(len(at))
            rank[at] = NONE
            inner = at[at + 1 < len(ids)]
            inner = inner[owner[inner] == owner[inner + 1]]
            rank[inner] = self._pair_ranks(ids[inner], ids[inner + 1])
            inner = at[at > 0]
            inner = inner[owner[inner - 1] == owner[inner]]
            rank[inner - 1] = self._pair_ranks(ids[inner - 1], ids[inner])
        return out

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap of pairs and links between the parts."""
        n, ranks = len(piece), self.ranks
        ends = list(range(1, n + 1))  # end of the part that begins here
        before = list(range(-1, n - 1))  # where the part before it begins
        heap = []
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 1, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, middle, end = heapq.heappop(heap)
            if ends[i] != middle or middle >= n or ends[middle] != end:
                continue
            ends[i], ends[middle] = end, 0
            if end < n:
                before[end] = i
                rank = ranks.get(piece[i : ends[end]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, end, ends[end]))
            if (left := before[i]) >= 0:
                rank = ranks.get(piece[left:end])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, i, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return out

    def _learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of all different pieces, as little-endian 32-bit integers."""
        found, new = {}, []
        for piece in set(pieces):
            ids = self.cached.get(piece)
            if ids is None:
                ids = self.older.get(piece)
                if ids is None:
                    rank = self.ranks.get(piece)
                    if rank is not None:
                        ids = pack("<I", rank)
                    elif len(piece) > SHORT:
                        found[piece] = np.array(self._merge_long(piece), dtype="<u4").tobytes()
                        continue
                    else:
                        new.append(piece)
                        continue
                self.cached[piece] = ids
            found[piece] = ids
        if new:
            merged = dict(zip(new, self.merge_many(new), strict=True))
            found |= merged
            self.cached |= merged
        if len(self.cached) >= self.cache_entries:
            self.older, self.cached = self.cached, {}
        return found

    def encode(self, data: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        begin, end, rows = pieces(data, at)
        raw = data.tobytes()
        parts = [raw[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
        ids = list(map(self._learn(parts).__getitem__, parts))
        bounds = np.searchsorted(rows, np.arange(len(at))).tolist()
        return [b"".join(ids[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes that the ids stand for; ``token_offsets`` says where each token lies in them."""
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        source = np.repeat(self.offsets[ids] - (ends - lengths), lengths) + np.arange(ends[-1])
        return self.bytes[source].tobytes()

    def token_offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token begins in the decoded bytes, and their length at last."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a base-64 word and a rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(w): int(r) for w, r in (line.split() for line in file if line.strip())}


_built: dict[str, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """The vocabulary of this process, built once from what the driver sent."""
    name, ranks = shared.value
    if name not in _built:
        _built.clear()
        _built[name] = Vocabulary(ranks)
    return _built[name]


def _send(documents: DataFrame, path: str):
    ranks = read_ranks(path)
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    return documents.sparkSession.sparkContext.broadcast((name, ranks))


def encode(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the token ids of every document, as ``tokens``, an array of integers."""
    shared = _send(documents, path)
    schema = documents.select(key).schema.add("tokens", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared)
        for batch in batches:
            for row, data, at in slices(batch.column(1)):
                found = vocabulary.encode(data, at)
                sizes = np.array([0, *(len(x) // 4 for x in found)], dtype=np.int64)
                values = pa.array(np.frombuffer(b"".join(found), dtype=np.int32))
                lists = pa.ListArray.from_arrays(np.cumsum(sizes).astype(np.int32), values)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(found)), lists], [key, "tokens"])

    return documents.select(key, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """``key``, the bytes and the token offsets of every row; null tokens give no bytes."""
    shared = _send(encoded, path)
    schema = encoded.select(key).schema.add("bytes", BinaryType()).add("offsets", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared)
        for batch in batches:
            ids = [np.array(x or [], dtype=np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([vocabulary.decode(x) for x in ids], pa.binary()),
                    pa.array([vocabulary.token_offsets(x) for x in ids], pa.list_(pa.int64())),
                ],
                [key, "bytes", "offsets"],
            )

    return encoded.select(key, tokens).mapInArrow(run, schema)


def round_trip(
    documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep_tokens: bool = False
) -> DataFrame:
    """Encode every text, decode the ids, and return a digest of both in one pass over the texts.

    ``key``, n_tokens, ids_sha256 and decoded_sha256; with ``keep_tokens`` also the ids.
    """
    shared = _send(documents, path)
    schema = documents.select(key).schema.add("n_tokens", LongType())
    schema = schema.add("ids_sha256", StringType()).add("decoded_sha256", StringType())
    if keep_tokens:
        schema = schema.add("tokens", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared)
        for batch in batches:
            for row, data, at in slices(batch.column(1)):
                found = vocabulary.encode(data, at)
                ids = [np.frombuffer(x, dtype="<u4") for x in found]
                columns = [
                    batch.column(0).slice(row, len(found)),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in found]),
                    pa.array([hashlib.sha256(vocabulary.decode(x)).hexdigest() for x in ids]),
                ]
                if keep_tokens:
                    sizes = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(ids).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return documents.select(key, text).mapInArrow(run, schema)
