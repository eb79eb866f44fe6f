"""Secrets: keyword prefilter, anchored patterns near hits, then embedded checksums.

An Aho-Corasick automaton walks each text once and names the places of all keywords. A kind's
anchored pattern is tried at the places of its own keywords only. Long hexadecimal runs have no
keyword; for them every eighth byte is looked at, and only where four in a row are hexadecimal,
as they must be in any run of 32, the run around them is measured.

Kinds, in order: ``assign``, ``access``, ``hex`` (base kinds); ``github``, ``npm`` (six base-62
digits of the CRC-32 of the thirty characters before them) and ``xprv`` (four bytes of a double
SHA-256 at the end of a base-58 number). Kinds with a checksum count only if it holds.

Each row is handled alone, so nothing is shuffled. Null and empty texts have no spans; offsets
count code points, ends are exclusive; the order is by start, then by kind.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from tillview.llm.arrays import flat

BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
HEX = np.zeros(256, dtype=bool)
HEX[[*b"0123456789abcdef"]] = True
STRIDE, HEX_LENGTH = 8, 32


def crc_holds(found: bytes) -> bool:
    """``prefix_`` + 30 characters + the CRC-32 of those in six base-62 digits."""
    body = found[found.index(b"_") + 1 :]
    value, digits = zlib.crc32(body[:30]), b""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit : digit + 1] + digits
    return digits == body[30:36]


def base58_holds(found: bytes) -> bool:
    """A serialised key of 78 bytes and the first four bytes of its double SHA-256."""
    number = 0
    for char in found:
        number = number * 58 + BASE58.index(char)
    if number >> 656:
        return False
    raw = number.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:78]).digest()).digest()[:4] == raw[78:]


def _assigned(match: re.Match) -> bool:
    return len(match[2]) >= 8


#: kind -> keywords in lower case, pattern at the keyword's place, what a match must satisfy
RULES: dict[str, tuple[tuple[str, ...], re.Pattern, Callable[[re.Match], bool]]] = {
    "assign": (
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(
            rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        ),
        _assigned,
    ),
    "access": (("akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "github": (
        ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
        re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
        lambda m: crc_holds(m[0]),
    ),
    "npm": (("npm_",), re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: crc_holds(m[0])),
    "xprv": (
        ("xprv",),
        re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])"),
        lambda m: base58_holds(m[0]),
    ),
}
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "xprv")


@cache
def _automaton() -> ahocorasick.Automaton:
    """Keyword -> its kind and length."""
    automaton = ahocorasick.Automaton()
    for kind, (keywords, _, _) in RULES.items():
        for word in keywords:
            automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def hex_runs(text: bytes) -> list[tuple[int, int]]:
    """Maximal runs of at least ``HEX_LENGTH`` lower-case hexadecimal digits."""
    data = np.frombuffer(text, dtype=np.uint8)
    here = HEX[data[::STRIDE]]
    n = HEX_LENGTH // STRIDE
    if len(here) < n:
        return []
    hits = here[: len(here) - n + 1].copy()
    for k in range(1, n):
        hits &= here[k : len(here) - n + 1 + k]
    found, done = [], 0
    for hit in np.flatnonzero(hits) * STRIDE:
        if hit < done:
            continue
        start = int(hit)
        while start and HEX[data[start - 1]]:
            start -= 1
        stop = int(hit) + 1
        while stop < len(data):
            step = HEX[data[stop : stop + 4096]]
            if step.all():
                stop += len(step)
                continue
            stop += int(np.argmin(step))
            break
        if stop - start >= HEX_LENGTH:
            found.append((start, stop))
        done = stop
    return found


def spans(text: bytes) -> list[tuple[int, int, int]]:
    """``(start, end, number of the kind)`` in bytes, by start, then kind."""
    found = [(a, b, KINDS.index("hex")) for a, b in hex_runs(text)]
    places: dict[str, list[int]] = {}
    for last, (kind, length) in _automaton().iter(text.lower().decode("latin-1")):
        places.setdefault(kind, []).append(last + 1 - length)
    for kind, starts in places.items():
        _, pattern, holds = RULES[kind]
        done = 0
        for start in sorted(starts):
            if start >= done and (match := pattern.match(text, start)):
                done = match.end()
                if holds(match):
                    found.append((start, done, KINDS.index(kind)))
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def _code_points(text: bytes, places: list[int]) -> list[int]:
    """Code points before each byte position."""
    if text.isascii():
        return places
    lead = (np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(lead)])
    return before[places].tolist()


SPAN = StructType().add("kind", StringType()).add("start", IntegerType()).add("end", IntegerType())
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_secrets(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``secrets``, an array of (kind, start, end), for every document."""
    schema = documents.select(key).schema.add("secrets", ArrayType(SPAN))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column(1))
            rows = []
            for i in range(len(batch)):
                own = data[at[i] : at[i + 1]].tobytes()
                found = spans(own)
                if found:
                    place = _code_points(own, [p for a, b, _ in found for p in (a, b)])
                    found = [
                        {"kind": KINDS[k], "start": place[2 * j], "end": place[2 * j + 1]}
                        for j, (_, _, k) in enumerate(found)
                    ]
                rows.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, ARROW_SPANS)], [key, "secrets"])

    return documents.select(key, text).mapInArrow(scan, schema)


def span_text(spans: F.Column) -> F.Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digest(documents: DataFrame) -> DataFrame:
    """Counts and a digest of the base spans, and all spans as text, for every document."""

    def count(kind: str) -> F.Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast(LongType()).alias(f"n_{kind}")

    found = scan_secrets(documents)
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *map(count, BASE_KINDS),
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("secrets")).alias("spans"),
    )
