"""PII: information-theoretic sanitisation, in DataFrame expressions throughout.

**Entities.** E-mail addresses, IP addresses, card numbers and phone numbers are found by
patterns; positions are sums of the lengths of what ``split`` leaves between matches. The
patterns are possessive, and begin where a run of their characters begins, so that neither long
runs nor many repetitions cost more than one look at each character.

**Terms.** Any word, of any length, reveals an entity as far as seeing the word makes the entity
likely: pointwise mutual information log(N n_te / (n_t n_e)), as a share of the entity's
information content log(N / n_e). Counts are of documents: n_t of those with the word, n_e of
those with the entity, n_te of those with both, the word outside entities. Small counts are
corrected for: all co-occurrences together, n_te times the mutual information, must be worth more
than the log N bits that name a document, so a word of one document reveals nothing. A word whose
mutual information reaches ``DISCLOSURE`` of the content is a ``term`` span wherever it stands in
any document, with the entity or without, unless it overlaps an entity. In the sanitised text
entities become their kind, terms with digits or a capital are generalised, other terms removed.

**Work.** Only words of texts with entities are paired, and each only with the entities of its
texts that a word so frequent could reveal (n_te is at most n_e, so this loses nothing). Entities of the same texts have the same counts and are paired as one, told apart by 128
bits of hashes. Copies of a text count as documents but are handled once. Entities, words and texts
that a third of all rows share are looked up by ``look_up``; revealing words, and the keys of the
texts that hold some, are broadcast up to ``BROADCAST_TERMS`` of them and joined by shuffles beyond,
with the same result.

Edge cases: null and empty texts have no spans; repeated ids keep one row each; offsets count
code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillview.operators.lookup import look_up
from tillview.sources.staging import stage

KINDS = ("email", "ip", "card", "phone")
TERM = len(KINDS)

#: In Java's notation. The contract's greedy parts never give anything back, but for the phone's.
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[ -]?[0-9])++",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
IP_PART = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
IP_VALID = rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"
WORD = r"[\p{L}\p{N}]++"

DISCLOSURE = 0.9
#: Some 100 bytes each on an executor.
BROADCAST_TERMS = 500_000
#: Room for rounding in logarithms.
CLOSE = 1e-9

SPANS = "array<struct<kind:int,start:int,end:int,value:string>>"
PLACES = "array<struct<start:int,end:int>>"


def _luhn(digits: Column) -> Column:
    """Whether the digits, every second from the right doubled, add up to a multiple of ten."""
    doubled = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: int, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if KINDS[kind] == "ip":
        return value.rlike(IP_VALID)
    if KINDS[kind] == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if KINDS[kind] == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _positions(found: Column, parts: Column, kind: int) -> Column:
    """Spans of the matches, whose places follow from the lengths of what lies between them."""
    n = F.size(found)
    zipped = F.arrays_zip(found.alias("value"), F.slice(parts, F.lit(1), n).alias("before"))

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + F.length(m["0"])
        end = start + F.length(m["1"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), m["1"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    zipped = F.transform(zipped, lambda z: F.struct(z["before"].alias("0"), z["value"].alias("1")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    return F.aggregate(zipped, none, step, lambda state: state["spans"])


def with_entities(
    documents: DataFrame, text: str = "text", out: str = "entities", words: str | None = None
) -> DataFrame:
    """Adds a column of entities: kind, start, end and value, by kind, then start.

    A column named by ``words`` gets the different words outside them, null without entities.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    found = documents.withColumns(
        {f"__found{k}": F.regexp_extract_all(own, F.lit(p), F.lit(0)) for k, p in enumerate(PATTERNS)}
    )
    spans = []
    for k, pattern in enumerate(PATTERNS):
        matches = F.col(f"__found{k}")
        here = F.when(F.size(matches) > 0, _positions(matches, F.split(own, pattern, -1), k))
        spans.append(_kept(here, k))
    found = found.withColumn(out, F.concat(*spans))
    if words is not None:
        found = found.withColumn(words, F.when(F.size(out) > 0, _words(_blank(own, F.col(out)))))
    return found.drop(*(f"__found{k}" for k in range(len(PATTERNS))))


def _words(text: Column) -> Column:
    """The different words of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def _blank(text: Column, spans: Column) -> Column:
    """The text with spaces in place of its entities, everything else where it was."""

    def step(state: Column, span: Column) -> Column:
        begin = F.greatest(span["start"], state["at"])
        end = F.greatest(span["end"], state["at"])
        added = F.concat(F.substring(text, state["at"] + 1, begin - state["at"]), F.repeat(F.lit(" "), end - begin))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(added)).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.aggregate(
        ordered,
        none,
        step,
        lambda state: F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"] + 1, F.length(text))),
    )


def _kept(spans: Column, kind: int) -> Column:
    return F.coalesce(F.filter(spans, lambda s: _valid(kind, s["value"])), F.array().cast(SPANS))


def _text_key(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _places(text: Column, at: Column) -> Column:
    """Places of the words whose numbers ``at`` lists in ascending order.

    Each step adds up the lengths between two of them, so a text is walked once.
    """
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lengths = F.zip_with(
        found,
        F.slice(F.split(text, WORD, -1), F.lit(1), F.size(found)),
        lambda w, before: F.struct((F.length(before) + F.length(w)).alias("step"), F.length(w).alias("word")),
    )

    def step(state: Column, i: Column) -> Column:
        passed = F.slice(state["lengths"], state["next"] + 1, i + 1 - state["next"])
        end = F.aggregate(passed, state["at"], lambda so_far, x: so_far + x["step"])
        place = F.struct((end - F.get(state["lengths"], i)["word"]).alias("start"), end.alias("end"))
        return F.struct(
            end.alias("at"),
            (i + 1).alias("next"),
            state["lengths"].alias("lengths"),
            F.concat(state["places"], F.array(place)).alias("places"),
        )

    none = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("next"), lengths.alias("lengths"), F.array().cast(PLACES).alias("places")
    )
    return F.aggregate(at, none, step, lambda state: state["places"])


def _entity(span: Column) -> Column:
    """Kind and value, without what does not matter in it."""
    value = span["value"]
    plain = F.when(span["kind"] < 2, F.lower(value)).otherwise(F.regexp_replace(value, "[^0-9]", ""))
    return F.concat_ws(":", span["kind"].cast("string"), plain)


def revealing_terms(documents: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """term and n_t of the words that reveal an entity.

    ``texts`` holds text_key, copies, entities and words of every different text with entities.
    """
    total = documents.count()
    all_documents = F.lit(float(max(total, 2)))

    def most(n_e: Column) -> Column:
        """How many documents a word may be in and still reveal an entity of n_e documents."""
        return n_e * F.pow(all_documents / n_e, F.lit(1 - DISCLOSURE)) * (1 + CLOSE)

    mentions = texts.select(
        "text_key", "copies", F.explode(F.array_distinct(F.transform("entities", _entity))).alias("entity")
    )
    places = (F.bit_xor(F.xxhash64(F.lit(seed), "text_key")).cast("string") for seed in (1, 2))
    entities = stage(
        mentions.groupBy("entity")
        .agg(F.sum("copies").alias("n_e"), F.count("*").alias("count"), F.concat_ws(":", *places).alias("class"))
        .where((F.col("n_e") > 1) & (F.col("n_e") < total)),
        "disclosure-entities",
    )
    widest = entities.agg(F.max(most(F.col("n_e")))).first()[0] or 0.0
    repeated = look_up(
        mentions, entities.select("entity", "n_e", "class"), "entity", "inner", entities.select("entity", "count")
    )
    classes = repeated.groupBy("text_key", "copies").agg(F.collect_set(F.struct("n_e", "class")).alias("classes"))
    vocabulary = stage(
        documents.select(F.explode(_words(F.col(text))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n_t"))
        .where((F.col("n_t") > 1) & (F.col("n_t") <= widest)),
        "disclosure-vocabulary",
    )
    held = look_up(texts.select("text_key", F.explode("words").alias("term")), vocabulary, "term", "inner")
    possible = F.filter("classes", lambda c: F.col("n_t") <= most(c["n_e"]))
    pairs = (
        held.join(classes, "text_key")
        .select("term", "n_t", "copies", F.explode(possible).alias("of"))
        .groupBy("term", "n_t", "of")
        .agg(F.sum("copies").alias("n_te"))
        .where("n_te > 1")
    )
    content = F.log2(all_documents / F.col("of.n_e"))
    likely = F.least(F.col("n_te") / F.col("n_t"), F.lit(1.0))
    information = F.log2(all_documents * likely / F.col("of.n_e"))
    enough = (information >= DISCLOSURE * content - CLOSE) & (
        F.col("n_te") * information > F.log2(all_documents) + CLOSE
    )
    return stage(pairs.where(enough).select("term", "n_t").distinct(), "disclosure-revealing")


def places_of_terms(documents: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """text_key, places (numbers of words) and copies of every different text that holds a term."""
    words = documents.select(
        _text_key(text).alias("text_key"),
        F.posexplode(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))).alias("place", "word"),
    ).select("text_key", "place", F.lower("word").alias("term"))
    if terms.count() <= BROADCAST_TERMS:
        found = words.join(F.broadcast(terms.select("term")), "term")
    else:
        counts = terms.select("term", F.col("n_t").alias("count"))
        found = look_up(words, terms.select("term"), "term", "inner", counts)
    # copies add up before a text's rows meet
    by_place = found.groupBy("text_key", "place").agg(F.count("*").alias("count"))
    return by_place.groupBy("text_key").agg(
        F.sort_array(F.collect_list("place")).alias("places"), F.max("count").alias("count")
    )


def _texts(documents: DataFrame, text: str) -> DataFrame:
    """text_key, copies, entities and words of every different text with entities."""
    found = with_entities(documents.select(text), text, "entities", "words").where(F.size("entities") > 0)
    return (
        found.select(_text_key(text).alias("text_key"), "entities", "words")
        .groupBy("text_key")
        .agg(F.count("*").alias("copies"), F.any_value("entities").alias("entities"), F.any_value("words").alias("words"))
    )


def with_spans(documents: DataFrame, text: str = "text", entities: str = "entities", terms: str = "terms") -> DataFrame:
    """Adds the columns ``entities`` and ``terms`` (start and end, none that overlaps an entity)."""
    texts = stage(_texts(documents, text), "disclosure-texts")
    hits = stage(places_of_terms(documents, revealing_terms(documents, texts, text), text), "disclosure-places")
    own_key = _text_key(text)
    if hits.count() <= BROADCAST_TERMS:
        # texts without terms stay where they are
        keys = F.broadcast(hits.select(F.col("text_key").alias("__text_key")))
        marked = documents.join(keys, own_key == F.col("__text_key"), "left")
    else:
        marked = documents.withColumn("__text_key", own_key)
    renamed = hits.select(F.col("text_key").alias("__text_key"), F.col("places").alias("__places"))
    counts = hits.select(F.col("text_key").alias("__text_key"), "count")
    rows = with_entities(look_up(marked, renamed, "__text_key", "left", counts), text, entities)
    own = F.when(F.col("__places").isNotNull(), _places(F.col(text), F.col("__places")))
    return rows.withColumn(terms, _apart(F.col(entities), own)).drop("__text_key", "__places")


def find_spans(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, entities and terms (start and end) of every document."""
    return with_spans(documents.select(key, text), text).select(key, "entities", "terms")


def _apart(entities: Column, terms: Column) -> Column:
    """Terms that overlap no entity."""
    clear = F.filter(
        terms,
        lambda t: ~F.exists(entities, lambda e: (t["start"] < e["end"]) & (e["start"] < t["end"])),
    )
    return F.coalesce(clear, F.array().cast(PLACES))


def sanitise(documents: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``documents``, with entities and revealing terms taken out of the text.

    Overlapping spans make one gap, named after the first kind listed. A null text stays null.
    """
    spanned = with_spans(documents, text, "__entities", "__terms")
    cuts = F.array_sort(
        F.concat(
            F.transform("__entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["kind"].alias("kind"))),
            F.transform("__terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit(TERM).alias("kind"))),
        )
    )
    return spanned.withColumn(text, F.when(F.size(cuts) > 0, _cut(F.col(text), cuts)).otherwise(F.col(text))).select(
        *documents.columns
    )


def _cut(text: Column, cuts: Column) -> Column:
    """The text with every gap filled by a name for it; cuts come by start."""

    def gap(kind: Column, inside: Column) -> Column:
        named = F.element_at(F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS)), F.least(kind + 1, F.lit(len(KINDS))))
        term = (
            F.when(inside.rlike(r"\p{N}"), F.lit("[NUMBER]"))
            .when(inside.rlike(r"^\p{Lu}"), F.lit("[NAME]"))
            .otherwise(F.lit(""))
        )
        return F.when(kind < TERM, named).otherwise(term)

    def step(state: Column, cut: Column) -> Column:
        begins = F.greatest(cut["start"], state["at"])
        inside = F.substring(text, begins + 1, cut["end"] - begins)
        kept = F.substring(text, state["at"] + 1, begins - state["at"])
        added = F.when(cut["start"] >= state["at"], F.concat(kept, gap(cut["kind"], inside))).otherwise(F.lit(""))
        return F.struct(
            F.greatest(cut["end"], state["at"]).alias("at"), F.concat(state["out"], F.array(added)).alias("out")
        )

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(
        cuts,
        none,
        step,
        lambda state: F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"] + 1, F.length(text))),
    )


def _name(kind: Column) -> Column:
    return F.element_at(F.array(*(F.lit(k) for k in KINDS)), kind + 1)


def span_digest(documents: DataFrame) -> DataFrame:
    """Counts and a digest of the entities, and all spans as text, for every document."""
    found = find_spans(documents)

    def count(kind: int) -> Column:
        return F.size(F.filter("entities", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    base = F.transform("entities", lambda s: F.concat_ws(":", _name(s["kind"]), s["start"], s["end"]))
    terms = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"], t["end"]))
    return found.select(
        "doc_id",
        *map(count, range(len(KINDS))),
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, terms), ",").alias("spans"),
    )
