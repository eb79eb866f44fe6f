"""Operators on single texts against brute force and round trips."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import log2

import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from llm_rows import by_id, documents, table

from tillview.llm import disclosure
from tillview.llm.arrays import slices
from tillview.llm.bpe import Vocabulary, decode, encode, read_ranks, round_trip
from tillview.llm.disclosure import KINDS, find_spans, sanitise, span_digest
from tillview.llm.secrets import BASE62, base58_holds, secret_digest, spans

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = read_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(read_ranks(PATH), cache_entries=500)


def _encode(vocabulary, texts):
    out = []
    for _, data, at in slices(pa.array(texts), 2000):
        out += vocabulary.encode(data, at)
    return [list(memoryview(x).cast("I")) for x in out]


def test_bpe_equals_the_library(library, vocabulary):
    rng = random.Random(1)
    parts = ["'", " ", "  ", "\n", "\t", "s", "t", "ll", "re", "a", "Z", "é", "1", "½", "!", "...", "中", " ",
             "　", "'s", "'ll", "'LL", "I'm", "👍", "​", "\x00", "́", "\x85", "\x1c", "word"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(4000)]
    texts += ["a" * 5000, " " * 3000, "ab" * 4000, "'" * 50, "", "x", " ", "\n\n"]
    assert _encode(vocabulary, texts) == [library.encode_ordinary(t) for t in texts]


def test_bpe_round_trip_of_documents(spark, library):
    docs = table(spark, "documents")
    rows = by_id(round_trip(docs, PATH, keep_tokens=True))
    back = by_id(decode(encode(docs, PATH), PATH))
    for doc in docs.collect():
        ids, raw = library.encode_ordinary(doc.text or ""), (doc.text or "").encode()
        row = rows[doc.doc_id]
        assert row.tokens == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(raw).hexdigest()
        assert bytes(back[doc.doc_id].bytes) == raw
        offsets = back[doc.doc_id].offsets
        assert len(offsets) == len(ids) + 1 and offsets[-1] == len(raw)


# Secrets

ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)


def _base_secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def _check_digits(body):
    value, digits = zlib.crc32(body), b""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit : digit + 1] + digits
    return body + digits


def test_secrets_equal_the_patterns(spark):
    rng = random.Random(2)
    parts = ["password", "PassWd", "api_key", "APIKEY", "secret", "token", "=", ": ", " ", '"', "'", "abcdefgh", "short",
             "AKIA", "ABCDEFGHIJKL", "akia", "deadbeef" * 4, "0" * 31, "é", "👍", "ſecret", "\n", "x" * 50]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 14)))) for i in range(1500)]
    rows += [(r.doc_id + 10_000, r.text) for r in table(spark, "documents").collect()]
    texts = dict(rows)
    for row in secret_digest(documents(spark, rows)).collect():
        want = _base_secrets(texts[row.doc_id] or "")
        assert row.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[row.doc_id]
        assert row.n_assign + row.n_access + row.n_hex == len(want.split(",")) * bool(want)


def test_secrets_with_a_checksum():
    good = b"ghp_" + _check_digits(b"abcdefghij0123456789ABCDEFGHIJ")
    assert spans(b"x " + good) == [(2, 42, 3)]
    assert spans(b"x " + good[:-1] + (b"0" if good[-1:] != b"0" else b"1")) == []
    npm = b"npm_" + _check_digits(b"z" * 30)
    assert spans(npm + b" " + good) == [(0, 40, 4), (41, 81, 3)]
    raw = bytes(range(78))
    number = int.from_bytes(raw + hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4], "big")
    digits = b""
    while number:
        number, d = divmod(number, 58)
        digits = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"[d : d + 1] + digits
    assert base58_holds(digits) and not base58_holds(digits[:-1] + b"1")


# Personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits):
    doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def _entities(text):
    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    found = [
        [m for m in EMAIL.finditer(text)],
        [m for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        [m for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and _luhn(digits(m))],
        [m for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
    ]
    return [f"{kind}:{m.start()}:{m.end()}" for kind, ms in zip(KINDS, found, strict=True) for m in ms]


def test_personal_data_equals_the_patterns(spark):
    rng = random.Random(3)
    parts = ["a", "@", ".", "b.co", "1", "23", "256", "0", "-", " ", "+", "(", ")", "4111111111111111", "é", "_", "\n",
             "x@y.z", "1.2.3.4", "+1 (543) 555-1435", "👍", "%"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 16)))) for i in range(3000)]
    rows += [(r.doc_id + 10_000, r.text) for r in table(spark, "documents").collect()]
    rows += [(90_000, "a" * 50_000 + "@"), (90_001, "1 " * 3000), (90_002, "x@y" + ".z" * 5000), (90_003, "+1" + "(" * 9999)]
    texts = dict(rows)
    for row in span_digest(documents(spark, rows)).collect():
        want = _entities(texts[row.doc_id] or "")
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[row.doc_id][:200]
        assert row.n_email + row.n_ip + row.n_card + row.n_phone == len(want)
        assert row.spans.startswith(",".join(want))


def _span(entity):
    kind, start, end = entity.split(":")
    return kind, int(start), int(end)


def _word_list(text):
    return [m[0].lower() for m in regex.finditer(r"[\p{L}\p{N}]+", text)]


def brute_terms(texts):
    """Places of revealing words by id, from plain counts over all texts."""
    total, n_t, n_e, n_te = len(texts), Counter(), Counter(), Counter()
    for text in texts.values():
        spans = [_span(e) for e in _entities(text)]
        names, blank = set(), list(text)
        for kind, start, end in spans:
            value = text[start:end]
            names.add((kind, value.lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", value)))
            blank[start:end] = " " * (end - start)
        n_t.update(set(_word_list(text)))
        n_e.update(names)
        n_te.update((w, e) for w in set(_word_list("".join(blank))) for e in names)
    revealing = set()
    for (word, entity), both in n_te.items():
        if both > 1 and n_t[word] > 1 and 1 < n_e[entity] < total:
            content = log2(total / n_e[entity])
            information = log2(total * min(1, both / n_t[word]) / n_e[entity])
            if information >= 0.9 * content - 1e-9 and both * information > log2(total) + 1e-9:
                revealing.add(word)
    out = defaultdict(list)
    for i, text in texts.items():
        spans = [_span(e)[1:] for e in _entities(text)]
        for m in regex.finditer(r"[\p{L}\p{N}]+", text):
            if m[0].lower() in revealing and not any(a < m.end() and m.start() < b for a, b in spans):
                out[i].append((m.start(), m.end()))
    return out


def test_terms_that_reveal_an_entity(spark):
    common = "the quick brown bird sings about green hills"
    near = [(i, f"{common} number{i} by Zebulon42 wrote mail x.y@z.org today from Grimsdale orchard") for i in range(4)]
    other = [(10 + i, f"{common} and wrote mail today from word{i}") for i in range(60)]
    docs = documents(spark, near + other)
    rows = by_id(find_spans(docs))
    texts = dict(near + other)
    for i in range(4):
        found = [texts[i][t.start : t.end] for t in rows[i].terms]
        assert found == ["by", "Zebulon42", "Grimsdale", "orchard"]
    assert all(not rows[10 + i].terms for i in range(60))
    clean = by_id(sanitise(docs))
    assert clean[0].text == f"{common} number0  [NUMBER] wrote mail [EMAIL] today from [NAME] "
    assert clean[10].text == texts[10]


OTHERS = [(100 + i, f"somebody wrote mail number {i}") for i in range(60)]


def _found(spark, rows):
    texts = dict(rows)
    return {i: [texts[i][t.start : t.end] for t in r.terms] for i, r in by_id(find_spans(documents(spark, rows))).items()}


def test_short_names_are_terms(spark):
    found = _found(spark, [(i, f"Lee Kim wrote x.y@z.org number {i}") for i in range(4)] + OTHERS)
    assert all(found[i] == ["Lee", "Kim"] for i in range(4))


def test_two_documents_are_enough_and_one_is_not(spark):
    rows = [(0, "Zebulon wrote x.y@z.org"), (1, "x.y@z.org wrote Zebulon number 1"), (2, "Ignatius wrote a.b@c.org")]
    found = _found(spark, rows + OTHERS)
    assert found[0] == found[1] == ["Zebulon"] and found[2] == []


def test_terms_go_wherever_they_stand(spark):
    far = " somebody wrote mail" * 20
    rows = [(0, f"Zebulon x.y@z.org{far} Zebulon"), (1, f"Zebulon{far} x.y@z.org 👍 zebulon"), (2, "x.y@z.org to Zebulon")]
    rows += [(3, "👍 Zebulon wrote mail")]
    found = _found(spark, rows + OTHERS)
    assert found[0] == ["Zebulon"] * 2 and found[1] == ["Zebulon", "zebulon"]
    assert found[2] == ["Zebulon"] and found[3] == ["Zebulon"]
    clean = by_id(sanitise(documents(spark, rows + OTHERS)))
    assert clean[3].text == "👍 [NAME] wrote mail" and clean[0].text.endswith("mail [NAME]")


def test_numbers_do_not_end_a_context(spark):
    card = "4111 1111 1111 1111"
    near = [(i, f"Whitmore 1980 card {card} ext 12 until Larkspur {i}") for i in range(4)]
    other = [(10 + i, f"1980 card until mail {i}") for i in range(60)]
    rows = by_id(find_spans(documents(spark, near + other)))
    for i, text in near:
        assert [text[t.start : t.end] for t in rows[i].terms] == ["Whitmore", "ext", "12", "Larkspur"]  # 12 is in one other text of 60
        assert [e.kind for e in rows[i].entities] == [2]


@pytest.mark.parametrize("broadcast", [True, False])
def test_terms_equal_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(disclosure, "BROADCAST_TERMS", 0)
    rng = random.Random(4)
    people = [(f"p{i}@q.org", f"Name{i}", f"Ü{i}") for i in range(8)] + [("1.2.3.4", "Al", "B2"), ("+1 (543) 555-1435", "Bo", "中")]
    rows = []
    for i in range(300):
        words = rng.choices(["red", "green", "blue", "a", "of", "Lamp", f"w{rng.randint(0, 90)}"], k=rng.randint(0, 30))
        for _ in range(rng.choice([0, 0, 1, 2])):
            mail, *names = rng.choice(people)
            words += [mail] * rng.choice([0, 1, 1, 1]) + names[: rng.randint(0, 2)]
        rng.shuffle(words)
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(words)))
    rows += [(300 + i, rows[7][1]) for i in range(100)]  # a third of all rows are copies
    rows += [(1000 + r.doc_id, r.text or "") for r in table(spark, "documents").collect()]
    want = brute_terms(dict(rows))
    assert sum(map(len, want.values())) > 100
    for row in find_spans(documents(spark, rows)).collect():
        assert [tuple(t) for t in row.terms] == want[row.doc_id], dict(rows)[row.doc_id][:200]


def test_one_document_in_copies_reveals_nothing(spark):
    rows = [(i, "Zebulon wrote x.y@z.org") for i in range(50)]
    assert all(not r.terms for r in find_spans(documents(spark, rows)).collect())


def test_personal_data_runs_no_python(spark):
    plan = span_digest(documents(spark, [(1, "x.y@z.org")], False))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
