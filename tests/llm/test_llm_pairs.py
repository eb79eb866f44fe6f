"""Operators that compare documents, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from llm_rows import by_id, documents, table
from pyspark.sql import functions as F

from tillview.llm import decontaminate as decontamination
from tillview.llm import near_duplicates as near
from tillview.llm import repeats
from tillview.llm.components import components
from tillview.llm.decontaminate import decontaminate
from tillview.operators.lookup import look_up


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def shingles(text):
    own = words(text)
    if len(own) < 5:
        return frozenset([tuple(own)] if own else [])
    return frozenset(tuple(own[i : i + 5]) for i in range(len(own) - 4))


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_near(texts):
    """class_id and links of every document, by all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    holders, shared = defaultdict(list), Counter()
    for i in sorted(sets):
        for s in sets[i]:
            shared.update((j, i) for j in holders[s])
            holders[s].append(i)
    pairs = [p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n) - 1e-9]
    links = Counter(i for p in pairs for i in p)
    return {i: (root, links[i]) for i, root in roots(sets, pairs).items()}


def mutated(rng, own, n):
    own = list(own)
    for _ in range(n):
        own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
    return " ".join(own)


@pytest.fixture(scope="module")
def similar():
    """Groups of copies and near copies of texts, some on the edge of the similarity."""
    rng = random.Random(4)
    rows = []
    for group in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 30, 60, 150]))]
        rows += [mutated(rng, base, rng.randrange(4)) for _ in range(rng.randrange(1, 7))]
        rows += [" ".join(base).upper()] * (group % 3)
    hot = [f"h{i}" for i in range(80)]
    rows += [mutated(rng, hot, 1) for _ in range(60)] + [" ".join(hot)] * 40
    return dict(enumerate(rows))


def test_near_duplicates_equal_brute_force(spark, similar, monkeypatch):
    want = brute_near(similar)
    for block in (1024, 16):  # the second cuts the hot group into blocks
        monkeypatch.setattr(near, "BLOCK", block)
        rows = near.near_duplicates(documents(spark, list(similar.items()))).collect()
        assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == want


def test_near_duplicates_of_documents(spark):
    docs = table(spark, "documents")
    want = brute_near({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: (r.class_id, r.n_links) for r in near.near_duplicates(docs).collect()} == want


def test_prefixes_shorten_to_the_target():
    depth = near.prefix_depth(0.8)
    assert 1 - (1 - 0.8**depth) ** near.TREES >= near.TARGET > 1 - (1 - 0.8 ** (depth + 1)) ** near.TREES
    assert near.prefix_depth(0.5) < depth


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)]
    pairs += [(500, 500 + i) for i in range(1, 60)] + [(7, 7)]
    want = roots({n for p in pairs for n in p}, pairs)
    found = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_look_up_of_hot_and_missing_keys(spark):
    rows = [(i, 1 if i % 3 else i) for i in range(300)] + [(1000, None)]
    facts = spark.createDataFrame([(1, "hot"), (9, "nine")], "k long, fact string")
    df = spark.createDataFrame(rows, "i long, k long")
    want = {i: {1: "hot", 9: "nine"}.get(k) for i, k in rows}
    assert {r.i: r.fact for r in look_up(df, facts, "k").collect()} == want
    assert {r.i: r.fact for r in look_up(df, facts, "k", "inner").collect()} == {i: f for i, f in want.items() if f}


# Benchmark passages


def brute_contaminated(texts, items):
    out = defaultdict(set)
    for i, text in texts.items():
        own = words(text)
        for item, passage in items.items():
            theirs = words(passage)
            size = min(16, len(theirs))
            need = 13 if len(theirs) >= 16 else -(-8 * len(theirs) // 10) if len(theirs) >= 9 else len(theirs)
            if len(theirs) < 5:
                continue
            for shift in range(-len(theirs), len(own)):
                same = [0 <= q + shift < len(own) and own[q + shift] == w for q, w in enumerate(theirs)]
                if any(sum(same[s : s + size]) >= need for s in range(len(theirs) - size + 1)):
                    out[i].add(item)
                    break
    return {i: sorted(s) for i, s in out.items()}


def test_contaminated_equal_brute_force(spark):
    rng = random.Random(6)
    items = {i: " ".join(f"v{rng.randrange(500)}" for _ in range(n)) for i, n in enumerate([3, 5, 8, 16, 16, 20, 40, 59])}
    texts, doc = {}, 0
    for passage in items.values():
        own = passage.split()
        for changes in range(0, 9):
            inside = mutated(rng, own, changes)
            left = " ".join(f"v{rng.randrange(500)}" for _ in range(rng.randrange(20)))
            texts[doc] = f"{left} {inside.upper()}, {left}"
            texts[doc + 1] = " ".join(own[: len(own) // 2])
            doc += 2
    want = brute_contaminated(texts, items)
    bench = spark.createDataFrame(list(items.items()) + [(99, items[7])], "item_id long, text string")
    rows = by_id(decontaminate(documents(spark, list(texts.items())), bench))
    assert {i: r["items"] for i, r in rows.items() if r.contaminated} == want
    assert len(want) > 20


@pytest.mark.parametrize("size", range(9, 21))
def test_masks_hit_every_allowed_change(size):
    window = min(size, decontamination.WINDOW)
    for changed in combinations(range(window), window - decontamination.need(size)):
        equal = set(range(window)) - set(changed)
        assert any(
            all(first + k in equal for k in mask)
            for mask in decontamination.masks_of(size)
            for first in range(window - mask[-1])
        ), changed


def test_short_items_with_every_allowed_change(spark):
    items = {n: " ".join(f"i{n}w{k}" for k in range(n)) for n in range(9, 16)}
    texts = []
    for n, passage in items.items():
        own = passage.split()
        for many in range(n - -(-4 * n // 5) + 2):
            for changed in combinations(range(n), many):
                texts.append(" ".join(["before", *("x" if k in changed else w for k, w in enumerate(own)), "after"]))
                texts.append(" ".join(w for k, w in enumerate(own) if k + 1 > many and k not in changed[:1]))
    texts = dict(enumerate(random.Random(10).sample(texts, 1500)))
    want = brute_contaminated(texts, items)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = by_id(decontaminate(documents(spark, list(texts.items())), bench))
    assert {i: r["items"] for i, r in rows.items() if r.contaminated} == want


# Repeated bytes


def brute_cut(rows, length):
    """Result of every (id, text), ids in order, None first."""
    seen, out = set(), {}
    for i, text in sorted({(-1 if i is None else i, t or "") for i, t in rows}):
        raw = text.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            piece = raw[p : p + length]
            if piece in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(piece)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out[i, text] = (len(raw), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest(), kept)
    return Counter((i, *out[-1 if i is None else i, t or ""]) for i, t in rows)


def check_cut(spark, rows):
    found = repeats.cut_repeats(documents(spark, rows), keep_bytes=True).collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in found)
    assert got == brute_cut(rows, repeats.LENGTH)


def test_repeats_equal_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    passages = ["".join(rng.choices("abcdé ", k=n)) for n in (90, 100, 101, 150, 400)]
    line = "this very line of sixty bytes or so stands in many documents"
    rows = []
    for i in range(120):
        parts = ["".join(rng.choices("abcdefgh ", k=rng.randrange(200))) for _ in range(3)]
        rows.append((i * 7, parts[0] + rng.choice(passages) + parts[1] + line + parts[2] + rng.choice(passages)))
    rows += [(5000, "a" * 1000), (5001, "ab" * 300), (5002, None), (5003, ""), (5004, "a" * 99), (5005, rows[3][1])]
    check_cut(spark, rows)
    monkeypatch.setattr(repeats, "BUNDLE", 8)  # the line's contexts are more than a bundle
    check_cut(spark, rows)
    check_cut(spark, rows + rows[:9] + [(None, "ab" * 300), (None, "ba" * 99), (5001, "ab" * 400), (7, "x" * 250)])


def test_repeats_of_documents(spark):
    check_cut(spark, [(r.doc_id, r.text) for r in table(spark, "documents").select("doc_id", "text").collect()])


def test_longest_previous_factors():
    rng = np.random.default_rng(8)
    for letters in (1, 2, 4):
        text = rng.integers(97, 97 + letters, 300).astype(np.uint8)
        starts = np.arange(len(text))
        length = 20
        raw = text.tobytes()
        want = []
        for i in range(len(raw)):
            n = 0
            while n < length and i + n < len(raw) and any(raw[j : j + n + 1] == raw[i : i + n + 1] for j in range(i)):
                n += 1
            want.append(n)
        found = repeats.longest_previous(text, starts, starts, length)
        inner = len(raw) - length  # beyond, suffixes are shorter than the length
        assert found[:inner].tolist() == want[:inner]
        order, _ = repeats.suffix_order(text, starts, starts, length)
        keys = [(raw[i : i + length].ljust(length, b"\0"), i) for i in order]
        assert keys == sorted(keys)


def test_every_window_has_one_anchor():
    rng = np.random.default_rng(9)
    sizes = [0, 50, 99, 100, 101, 500, 3000]
    at = np.concatenate([[0], np.cumsum(sizes)])
    data = rng.integers(97, 101, at[-1]).astype(np.uint8)
    found = repeats.anchors(data, at)
    windows = [w for a, b in zip(found.first, found.last, strict=True) for w in range(a, b + 1)]
    want = [w for a, b in zip(at[:-1], at[1:], strict=True) for w in range(a, b - 99)]
    assert windows == want
    assert all(a <= p <= a + 100 - repeats.GRAM for a, p in zip(found.last, found.place, strict=True))


# Rows of a hot key are spread


def test_hot_prefixes_do_not_meet_in_one_task(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.min("id").alias("least"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = look_up(rows.repartition(8), facts, "k", "inner")
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in sizes) == 9000
    assert max(r["count"] for r in sizes) < 3000
