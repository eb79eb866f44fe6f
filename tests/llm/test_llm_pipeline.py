"""The pipeline against a brute-force version of its decisions."""

import re
import unicodedata

import corpus_pipeline
import public_tokenizers
import tiktoken
from llm_rows import CLASHES, SMALL, table
from pyspark.sql import functions as F
from test_llm_pairs import brute_contaminated, brute_near
from test_llm_text import PATH, _entities, brute_terms

import __spark_entry__ as entry_point
from tillview.llm.bpe import read_ranks
from tillview.llm.decontaminate import find_contaminated
from tillview.llm.quality import score_quality


def _clean(text, terms):
    """Entities and terms replaced from the left."""
    spans = [(int(a), int(b), k.upper()) for k, a, b in (s.split(":") for s in _entities(text))]
    spans += [(a, b, _general(text[a:b])) for a, b in terms]
    out, at = "", 0
    for start, end, name in sorted(spans):
        if start >= at:
            out += text[at:start] + (name and f"[{name}]")
        at = max(at, end)
    return out + text[at:]


def _general(word):
    if any(unicodedata.category(c)[0] == "N" for c in word):
        return "NUMBER"
    return "NAME" if unicodedata.category(word[0]) == "Lu" else ""


def test_pipeline_equals_brute_force(spark):
    docs = table(spark, "documents")
    kept = {r.doc_id: r.text or "" for r in docs.collect()}
    scored = score_quality(docs, table(spark, "labels")).collect()
    kept = {i: t for i, t in kept.items() if i in {r.doc_id for r in scored if r.predicted}}
    classes = brute_near(kept)
    kept = {i: t for i, t in kept.items() if classes[i][0] == i}
    items = {r.item_id: r.text for r in table(spark, "benchmark").collect()}
    seen = brute_contaminated(kept, items)
    kept = {i: t for i, t in kept.items() if i not in seen}
    terms = brute_terms(kept)
    kept = {i: _clean(t, terms[i]) for i, t in kept.items()}
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={}
    )
    want = {i: library.encode_ordinary(t) for i, t in kept.items()}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id: r.tokens for r in rows} == want
    assert len(rows) == len(want)


def test_stages_keep_the_columns(spark):
    docs = table(spark, "documents").limit(30)
    for _, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, docs, SMALL).columns == docs.columns


def test_stages_with_repeated_and_missing_ids(spark):
    row = table(spark, "documents").where("length(text) > 500").first()
    rows = [row.asDict() | {"doc_id": i, "text": t} for i, t in
            [(1, row.text), (1, row.text), (None, row.text), (2, None), (None, None), (3, "")]]
    docs = spark.createDataFrame(rows, table(spark, "documents").schema)
    left = corpus_pipeline.keep_one_of_each(spark, docs, SMALL).collect()
    assert sorted((r.text or "")[:5] for r in left) == sorted(["", "", "", row.text[:5]])
    for _, function in corpus_pipeline.STAGES:
        function(spark, docs, SMALL).collect()
        assert function(spark, docs.limit(0), SMALL).collect() == []


def test_filters_decide_per_row(spark):
    docs = table(spark, "documents").where("length(text) between 200 and 3000")
    verdicts = {r.doc_id: r.predicted for r in score_quality(docs, table(spark, "labels")).collect()}
    seen = {r.doc_id for r in find_contaminated(docs, table(spark, "benchmark")).collect()}
    texts = {r.doc_id: r for r in docs.collect()}
    good = next(i for i in sorted(texts) if verdicts[i] and i not in seen)
    junk = next(i for i in sorted(texts) if not verdicts[i])
    for stage, bad in ((corpus_pipeline.keep_good, junk), (corpus_pipeline.keep_unseen, min(seen))):
        # ids without labels, so that the model stays the same
        rows = [texts[i].asDict() | {"doc_id": own} for i in (good, bad, good) for own in (None, 10**9)]
        mixed = docs.unionByName(spark.createDataFrame(rows, docs.schema))
        left = [r for r in stage(spark, mixed, SMALL).collect() if r.doc_id in (None, 10**9)]
        assert sorted(str(r.doc_id) for r in left) == ["1000000000"] * 2 + ["None"] * 2
        assert {r.text for r in left} == {texts[good].text}


def test_quality_moves_no_texts(spark):
    docs = table(spark, "documents")
    good = {r.doc_id for r in score_quality(docs, table(spark, "labels")).collect() if r.predicted}
    wide = docs.withColumns({c: F.lit(c) for c in CLASHES})
    left = corpus_pipeline.keep_good(spark, wide, SMALL)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Join|Exchange|Sort", plan)
    assert left.schema.names == wide.schema.names
    assert sorted(left.collect()) == sorted(wide.where(F.col("doc_id").isin(good)).collect())


def test_registered_queries():
    names = entry_point.queries()
    for n in range(1, 11):
        assert sum(bool(re.match(rf"op{n}_", name)) for name in names) == 1
    assert "pipeline" in names
