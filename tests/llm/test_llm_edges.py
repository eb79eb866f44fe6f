"""Every operator on documents: nulls, empty and long texts, repeated rows, empty tables, clashing names."""

import public_tokenizers
import pytest
from llm_rows import EDGE, documents

from tillview.llm.bpe import decode, encode, round_trip
from tillview.llm.decontaminate import decontaminate
from tillview.llm.disclosure import sanitise, span_digest
from tillview.llm.fingerprints import fingerprint_digest, fingerprints
from tillview.llm.near_duplicates import near_duplicates
from tillview.llm.periodic import find_runs, run_digest
from tillview.llm.quality import score_quality
from tillview.llm.repeats import cut_repeats
from tillview.llm.secrets import scan_secrets, secret_digest
from tillview.llm.toxicity import score_toxicity

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _labels(spark, rows=((1, 1, 0), (3, 0, 1), (4, 1, 0), (None, 1, 1), (5, None, None), (3, 0, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def _benchmark(spark):
    rows = [(1, None), (2, ""), (None, "again and again the quick brown fox jumps"), (4, "one two")]
    return spark.createDataFrame(rows, "item_id long, text string")


OPERATORS = {
    "toxicity": lambda s, d: score_toxicity(d, _labels(s)),
    "toxicity_unlabelled": lambda s, d: score_toxicity(d, _labels(s).limit(0)),
    "repeats": lambda s, d: cut_repeats(d),
    "disclosure": lambda s, d: span_digest(d),
    "sanitise": lambda s, d: sanitise(d),
    "bpe": lambda s, d: round_trip(d, PATH, keep_tokens=True),
    "bpe_decode": lambda s, d: decode(encode(d, PATH), PATH),
    "quality": lambda s, d: score_quality(d, _labels(s)),
    "quality_unlabelled": lambda s, d: score_quality(d, _labels(s).limit(0)),
    "near_duplicates": lambda s, d: near_duplicates(d),
    "decontaminate": lambda s, d: decontaminate(d, _benchmark(s)),
    "decontaminate_nothing": lambda s, d: decontaminate(d, _benchmark(s).limit(0)),
    "fingerprints": lambda s, d: fingerprints(d),
    "edited_fingerprints": lambda s, d: fingerprint_digest(d),
    "runs": lambda s, d: find_runs(d),
    "run_digest": lambda s, d: run_digest(d),
    "secrets": lambda s, d: secret_digest(d),
    "secret_spans": lambda s, d: scan_secrets(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row(spark, name):
    rows = OPERATORS[name](spark, documents(spark, EDGE)).collect()
    assert sorted(r.doc_id or 0 for r in rows) == sorted(i or 0 for i, _ in EDGE)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_documents(spark, name):
    assert OPERATORS[name](spark, documents(spark, [])).collect() == []


def test_one_class_scores_the_mean(spark):
    rows = score_quality(documents(spark, EDGE), _labels(spark, [(1, 1, 0), (4, 1, 0)])).collect()
    assert {r.score for r in rows} == {1.0}
    rows = score_quality(documents(spark, EDGE), _labels(spark).limit(0)).collect()
    assert {(r.score, r.predicted) for r in rows} == {(0.5, 0)}
    rows = score_toxicity(documents(spark, EDGE), _labels(spark).limit(0)).collect()
    assert {(r.score, r.predicted) for r in rows} == {(0.5, 1)}


def test_defined_results(spark):
    docs = documents(spark, EDGE)
    near = near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in near) == [
        (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (3, 3, 1), (3, 3, 1), (4, 4, 0), (5, 5, 0),
    ]
    found = decontaminate(docs, _benchmark(spark)).collect()
    assert {r.doc_id for r in found if r.contaminated} == {4}
    assert [(r.n_items, r["items"]) for r in found if r.doc_id == 4] == [(0, [])]  # the item has no id
    clean = sanitise(docs)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in clean.collect()) == sorted((i or 0, t or "") for i, t in EDGE)
    cut = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in cut_repeats(docs).collect()}
    long = max(cut)[1] if max(i or 0 for i, _ in cut) == 4 else next(n for i, n in cut if i == 4)
    assert cut[(4, long)] == (long - 62, 1)  # all but the first sentence recurs
    assert cut[(1, 0)] == cut[(2, 0)] == (0, 0)
