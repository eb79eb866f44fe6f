"""Winnowing: against a plain version, its match guarantee, and the order of documents."""

import hashlib
import re

import pytest
from llm_rows import EDGE, documents, table

from tillview.llm import fingerprints as fp

TOKEN = re.compile(fp.TOKEN.replace(r"\x{20000}-\x{3FFFF}", "\U00020000-\U0003ffff").replace(
    r"\x{3040}-\x{9FFF}", "぀-鿿").replace(r"\x{C0}-\x{1FFF}\x{2070}-\x{2FFF}\x{A000}-\x{1FFFF}",
    "À-῿⁰-⿿ꀀ-\U0001ffff").replace(r"\w", "0-9A-Za-z_"))


def brute_tokens(text):
    return TOKEN.findall(text.lower()) or ([text] if text else [])


def brute(words, hashes, gram=fp.GRAM, window=fp.WINDOW):
    """Kept (hash, position) of a text, the least of every window, the rightmost of equal ones."""
    known = [hashes[w] & ((1 << fp.TOKEN_BITS) - 1) for w in words]
    grams = []
    for i in range(max(len(words) - gram + 1, min(1, len(words)))):
        own = (known + [0] * gram)[i : i + gram]
        total = 0
        for k, h in enumerate(own):
            total ^= h << (gram - 1 - k)
        grams.append(total)
    kept = set()
    for i in range(max(len(grams) - window + 1, min(1, len(grams)))):
        own = [(h, -(i + j)) for j, h in enumerate(grams[i : i + window])]
        kept.add(min(own))
    return sorted((-place, h) for h, place in kept)


def read(fingerprint):
    entries = [int(v) for v in fingerprint.split()]
    return [(fp.PLACES - (v & fp.PLACES), v >> 31) for v in entries]


def word_hashes(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "w string")
    return {r.w: r.h for r in df.selectExpr("w", "xxhash64(w) AS h").collect()}


def check(spark, df):
    rows = fp.edited_fingerprints(df).collect()
    texts = {t for r in rows for t in (r.text, r.edited)}
    hashes = word_hashes(spark, sorted({w for t in texts for w in brute_tokens(t)}))
    marks = {t: brute(brute_tokens(t), hashes) for t in texts}
    for r in rows:
        assert read(r.fingerprint) == marks[r.text]
        assert read(r.edited_fingerprint) == marks[r.edited]
        own, other = ({h for _, h in marks[t]} for t in (r.text, r.edited))
        assert r.near_edited == pytest.approx(len(own & other) / len(own | other) if own | other else 1.0, abs=1e-12)
    return rows, marks


def test_equals_a_plain_version_on_given_documents(spark):
    df = table(spark, "documents")
    rows, marks = check(spark, df)
    order = sorted(((r.doc_id, r.text) for r in rows), reverse=True)
    digests = {r.doc_id: r for r in fp.fingerprint_digest(df).collect()}
    by_id = {r.doc_id: r for r in rows}
    for place, (doc, text) in enumerate(order):
        following = order[(place + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert by_id[doc].edited == edited
        assert digests[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert digests[doc].n_chars == len(text)
        own, other = ({h for _, h in marks[t]} for t in (text, following))
        assert by_id[doc].near_next == pytest.approx(len(own & other) / len(own | other), abs=1e-12)


def test_shared_passages_leave_a_shared_hash(spark):
    passage = " ".join(f"w{i}" for i in range(fp.GRAM + fp.WINDOW - 1))
    rows = [(i, f"{'x ' * i} a{i} {passage} b{i} {'y ' * (9 - i)}") for i in range(9)]
    found = fp.fingerprints(documents(spark, rows)).collect()
    sets = [{h for _, h in read(r.fingerprint)} for r in found]
    assert all(a & b for a in sets for b in sets)


def test_rightmost_of_equal_hashes():
    hashes = {"a": 5}
    assert [p for p, _ in brute(["a"] * 12, hashes)] == [4, 5, 6, 7]


def test_scripts_without_spaces_and_texts_without_words(spark):
    rows = [(1, "中文字符的长长的句子没有空格"), (2, "!?!"), (3, "?!?"), (4, ""), (5, None), (6, "ÄRGER über Straße"), (7, "a a a a a a a a a a a a")]
    found, _ = check(spark, documents(spark, rows))
    marks = {r.doc_id: read(r.fingerprint) for r in found}
    assert len(marks[1]) > 1 and marks[2] != marks[3] and marks[4] == marks[5] == []


def test_ties_nulls_and_repeated_rows(spark):
    """Copies of a row follow one another; the last one's next is the row after them; null ids are last."""
    rows = fp.edited_fingerprints(documents(spark, EDGE)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in rows) == sorted((i or 0, t or "") for i, t in EDGE)
    near = sorted(r.near_next for r in rows if r.text == "one two")
    assert near[-1] == 1.0 and len(near) == 2
    last = next(r for r in rows if r.doc_id is None)
    assert last.edited == last.text[: len(last.text) - len(last.text) // 2] + EDGE[-1][1][: len(last.text) // 2]
    many = [(7, "the same words in every row of this id")] * 50 + [(i, f"text {i} alone here") for i in range(5)]
    rows = fp.edited_fingerprints(documents(spark, many)).collect()
    assert sorted(r.near_next for r in rows if r.doc_id == 7)[1:] == [1.0] * 49
    only = fp.edited_fingerprints(documents(spark, [(1, "a single text of some worlds")])).collect()
    assert [(r.near_next, r.edited) for r in only] == [(1.0, "a single text a single text ")]


def test_one_shuffle_of_texts_and_no_python(spark):
    plan = fp.fingerprint_digest(table(spark, "documents"))._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan
    assert plan.count("Exchange") == 1 and "hashpartitioning(block" in plan
