"""Texts of Arrow batches seen as flat numpy arrays.

A batch's texts lie end to end in one byte array; row ``i`` is ``data[at[i]:at[i + 1]]``.
Null texts count as empty. Everything works on slices of about a megabyte, so memory
does not depend on the batch, only on the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

#: An odd multiplier of polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

#: ASCII letters, digits, the underscore, and all bytes of other characters make words.
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[[*b"0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
WORD_BYTES[128:] = True

SPACE_BYTES = np.zeros(256, dtype=bool)
SPACE_BYTES[[*b" \t\n\r\x0b\x0c"]] = True

_powers: dict[int, np.ndarray] = {}


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row bounds of a string or binary column."""
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(at):
        at = np.zeros(1, dtype=np.int64)
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros_like(at)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a column into ``(first row, data, at)`` of about ``limit`` bytes, whole rows each."""
    data, at = flat(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        stop = int(np.searchsorted(at, at[row] + limit, side="right")) - 1
        stop = min(rows, max(row + 1, stop))
        yield row, data[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop


def runs(member: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of true positions, none across rows."""
    n = len(member)
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1]
    last[:-1] &= ~member[1:]
    filled = at[:-1][at[1:] > at[:-1]]
    first[filled] = member[filled]
    before = filled[1:] - 1
    last[before] = member[before]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(at, starts, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """``base**i`` for ``i < n`` modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if len(have) <= 1 << 23:
            _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial sums of all prefixes; ``range_hash`` turns two of them into a hash."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(BASE, len(data)), out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``[starts, ends)``, equal for equal values wherever they lie."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    shift = _power(INVERSE, int(starts.max()) + 1)[starts]
    return mix((sums[ends] - sums[starts]) * shift ^ (ends - starts).astype(np.uint64) << np.uint64(48))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and hashes of the words of texts that are in lower case already."""
    starts, ends, rows = runs(WORD_BYTES[data], at)
    return starts, ends, rows, range_hash(prefix_hash(data), starts, ends)


def windows(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each window of ``size`` words within a row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(rows[:n] == rows[size - 1 :])
    out = np.zeros(len(first), dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(BASE) + hashes[first + k]
    return mix(out), first
