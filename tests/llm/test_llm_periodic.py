"""Runs by Lyndon arrays: against definitions spelt out."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from llm_rows import documents, table

from tillview.llm import periodic


def brute_lyndon(x):
    """A word is Lyndon if it is less than all its proper suffixes."""
    n = len(x)
    lengths = [[k for k in range(1, n - i + 1) if all(x[i : i + k] < x[j : i + k] for j in range(i + 1, i + k))] for i in range(n)]
    return [own[-1] for own in lengths]


def brute_runs(words):
    """Every period in turn: stretches where words equal those a period on, unless a lesser period fits."""
    known = {}
    x = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    found = {}
    for q in range(1, len(x) // periodic.EXPONENT + 1):
        edge = np.diff(np.concatenate([[0], (x[q:] == x[:-q]).astype(np.int8), [0]]))
        for start, end in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            length = end + q - start
            if length >= max(periodic.LEAST, periodic.EXPONENT * q):
                found.setdefault((start, length), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_lyndon_arrays_of_both_orders():
    rng = random.Random(3)
    for _ in range(400):
        x = [rng.randint(0, rng.randint(0, 3)) for _ in range(rng.randint(1, 18))]
        assert periodic.lyndon_lengths(x) == brute_lyndon(x)
        assert periodic.lyndon_lengths([-r for r in x]) == brute_lyndon([-r for r in x])


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_runs_of_random_and_periodic_words(letters):
    rng = random.Random(letters)
    for trial in range(300):
        x = [rng.randint(0, letters) for _ in range(rng.randint(0, 60))]
        if trial % 2 and x:
            start, q = rng.randrange(len(x)), rng.randint(1, 7)
            x[start:] = [x[start + k % q] if start + k % q < len(x) else 0 for k in range(len(x) - start)]
        ids = np.array(x, dtype=np.int64)
        near = periodic.crowded(ids, np.zeros(len(x), dtype=np.int64))
        assert [tuple(r) for r in periodic.text_runs(ids, near).tolist()] == brute_runs(x)


def test_extensions_of_words_that_fool_plain_hashes():
    """Thue-Morse words make sums of powers modulo 2**64 collide; they hold no run at all."""
    x = np.array([bin(i).count("1") & 1 for i in range(1 << 12)], dtype=np.int64)
    words = periodic.Extensions(x)
    at, shift = np.zeros(1, dtype=np.int64), np.array([1 << 11])
    assert words.right(at, shift).tolist() == [0]
    assert periodic.text_runs(x, np.ones(len(x), dtype=bool)).tolist() == []


def brute_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (
        len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256(listed.encode()).hexdigest(),
        hashlib.sha256(brute_collapsed(words, runs).encode()).hexdigest(),
    )


def test_digests_equal_a_plain_version(spark):
    df = table(spark, "documents")
    texts = {r.doc_id: r.text for r in df.collect()}
    rows = periodic.run_digest(df).collect()
    assert len(rows) == len(texts) and any(r.n_runs for r in rows)
    for r in rows:
        got = (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
        assert got == brute_digest(r.doc_id, texts[r.doc_id])


def test_spaces_and_odd_characters(spark):
    texts = ["x y " * 8, "  a \x1c b " * 5, "one\ttwo\r\nthree\x0b" * 6, "  ", "é é é é é é", "a b c d e f " * 4 + "a b c"]
    rows = [(2 * i + 1, t) for i, t in enumerate(texts)]
    for r in periodic.run_digest(documents(spark, rows)).collect():
        got = (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
        assert got == brute_digest(r.doc_id, dict(rows)[r.doc_id])


def test_collapsed_texts_keep_one_period(spark):
    rows = [(1, "to begin " + "again and " * 6 + "the end"), (2, "no runs here at all"), (3, "la " * 9)]
    found = {r.doc_id: r for r in periodic.find_runs(documents(spark, rows)).collect()}
    assert found[1].collapsed == "to begin again and the end" and found[3].collapsed == "la"
    assert [tuple(r) for r in found[1].runs] == [(2, 12, 2)] and found[2].runs == []
