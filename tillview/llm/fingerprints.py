"""Document fingerprints by winnowing, in DataFrame expressions only.

A text is a sequence of tokens in lower case: words, and characters of scripts without spaces; a text
without any is one token, itself. Each run of ``GRAM`` tokens has a cyclic hash, the rolling hash in
which hashes of tokens are shifted by their places and joined by XOR. Of every ``WINDOW`` neighbouring hashes the least is kept,
the rightmost of equal ones, together with its position. Two texts that share ``GRAM + WINDOW - 1``
tokens in a row therefore share a kept hash, and positions tell where. Texts of fewer tokens than a
gram have one hash, texts of fewer grams than a window keep the least of all.

A fingerprint is written as numbers by position, joined by spaces: hash * 2**31 + (2**31 - 1 - number
of the gram's first token). The likeness of two fingerprints is the Jaccard index of their hashes, 1 if
both are empty.

``edited_fingerprints`` also pairs every document with the next one in descending order of ids. The
order is cut into blocks of similar size whose bounds come from the ids alone, so texts are shuffled
once, to their blocks; the first document of a block also goes, as a sentinel, to the end of the
block before. Rows that equal more than an even share of a partition's rows are one row with a count.

Edge cases: a null text is an empty one, with an empty fingerprint; null ids come last; documents of
one id follow one another by a hash of their text, and equal ones among them directly, so their next
one is their like; a single document is its own next one; an empty table gives no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

GRAM = 5
WINDOW = 5
BLOCKS_PER_PARTITION = 4

#: Characters of scripts written without spaces stand alone; elsewhere letters, digits, marks and
#: the underscore make words (blocks of punctuation are left out, single signs beyond ASCII are not).
TOKEN = r"[\x{3040}-\x{9FFF}\x{20000}-\x{3FFFF}]|[\w\x{C0}-\x{1FFF}\x{2070}-\x{2FFF}\x{A000}-\x{1FFFF}]+"

#: A token's hash has so many bits; those of a gram are shifted by one bit each and joined by XOR.
TOKEN_BITS = 33 - GRAM
PLACES = (1 << 31) - 1


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return _let(found, lambda f: F.when((F.size(f) > 0) | (text == ""), f).otherwise(F.array(text)))


def placed_hashes(words: Column, gram: int = GRAM) -> Column:
    """The cyclic hash of each run of ``gram`` words, or one of all words where there are fewer.

    Each is one long, hash * 2**31 + (2**31 - 1 - position), so of equal hashes the rightmost is least.
    """
    word = F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit((1 << TOKEN_BITS) - 1)))

    def rolled(h: Column) -> Column:
        def at(first: Column, i: Column) -> Column:
            total = F.shiftleft(first, gram - 1)
            for k in range(1, gram):
                later = F.coalesce(F.get(h, i + k), F.lit(0).cast("long"))
                total = total.bitwiseXOR(F.shiftleft(later, gram - 1 - k) if k < gram - 1 else later)
            return F.shiftleft(total, 31) + (F.lit(PLACES) - i)

        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (gram - 1), F.least(F.size(h), F.lit(1)))), at)

    return _let(word, rolled)


def winnow(placed: Column, window: int = WINDOW) -> Column:
    """The least of each window of placed hashes, in order of position."""

    def least(p: Column) -> Column:
        starts = F.slice(p, 1, F.greatest(F.size(p) - (window - 1), F.least(F.size(p), F.lit(1))))
        return F.array_distinct(F.transform(starts, lambda v, i: F.least(v, *(F.get(p, i + k) for k in range(1, window)))))

    return _let(placed, least)


def kept(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The winnowed hashes of a text, in order of position."""
    return winnow(placed_hashes(tokens(text), gram), window)


def written(picked: Column) -> Column:
    return F.array_join(picked.cast("array<string>"), " ")


def hashes_of(picked: Column) -> Column:
    return F.array_distinct(F.transform(picked, lambda v: F.shiftright(v, 31)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of different hashes."""
    shared = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - shared
    return F.when(whole == 0, F.lit(1.0)).otherwise(shared / whole)


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``key`` and fingerprint of every document."""
    return documents.select(key, written(kept(F.coalesce(text, F.lit("")), gram, window)).alias("fingerprint"))


def _collapsed(rows: DataFrame) -> DataFrame:
    """``rows`` (id, text) with ``copies``; rows repeated more often than an even share are one."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = F.xxhash64("id", "text")
    counts = rows.groupBy(same.alias("same")).count().where("count > 1")
    share = max(1, rows.count() // partitions)
    hot = [r[0] for r in counts.where(F.col("count") > share).select("same").collect()]
    once = rows.withColumn("copies", F.lit(1).cast("long"))
    if not hot:
        return once
    many = rows.where(same.isin(hot)).groupBy("id", "text").agg(F.count("*").alias("copies"))
    return once.where(~same.isin(hot)).unionByName(many)


def in_descending_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place`` (order), ``block`` and ``sentinel``, cut by descending id.

    Bounds of blocks are taken from ids and hashes only; there are as many as a fixed multiple of
    the shuffle partitions, and they are looked up in two steps of their square root.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = partitions * BLOCKS_PER_PARTITION
    place = F.struct(F.col("id").alias("id"), F.xxhash64("text").alias("hash"))
    rows = rows.withColumn("place", place)
    ranged = rows.select("place").repartitionByRange(blocks, F.desc("place"))
    firsts = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.max("place").alias("first"))
    ordered = F.sort_array(F.collect_list("first"), asc=False)
    found = json.loads(firsts.agg(F.to_json(ordered)).first()[0])
    step = max(1, int(len(found) ** 0.5))

    def known(places: list) -> Column:
        """Bounds as a literal, which is read once and not per row."""
        return F.from_json(F.lit(json.dumps(places)), ArrayType(rows.schema["place"].dataType))

    bounds, heads = known(found), known(found[::step])

    def before(some: Column) -> Column:
        return F.size(F.filter(some, lambda f: f >= F.col("place")))

    rows = rows.withColumn("head", before(heads) - 1)
    rows = rows.withColumn("block", F.col("head") * step + before(F.slice(bounds, F.col("head") * step + 1, F.lit(step))) - 1)
    is_first = F.get(bounds, F.col("block")) == F.col("place")
    earlier = F.when(F.col("block") == 0, F.lit(len(found))).otherwise(F.col("block")) - 1
    own = F.struct("block", F.lit(False).alias("sentinel"))
    copy = F.struct(earlier.alias("block"), F.lit(True).alias("sentinel"))
    goes = F.explode(F.when(is_first, F.array(own, copy)).otherwise(F.array(own)))
    return rows.drop("head").withColumn("goes", goes).select(*rows.drop("head", "block").columns, "goes.block", "goes.sentinel")


def edited_fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``key``, text, edited text, both fingerprints, and the likeness to the edited and the next text.

    The edited text has its last half replaced by the first as many code points of the next document.
    """
    rows = documents.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    blocked = in_descending_blocks(_collapsed(rows))
    order = Window.partitionBy("block").orderBy("sentinel", F.desc("place"))
    follows = blocked.withColumn("next", F.lead("text").over(order))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next", half))
    # the windows meet in one shuffle and sort; texts that are read no more are left behind
    picked = follows.withColumn("picked", kept(F.col("text"), gram, window))
    paired = picked.withColumn("hashes", hashes_of(F.col("picked"))).withColumn("next_hashes", F.lead("hashes").over(order))
    one = paired.where(~F.col("sentinel")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    last = F.col("copy") == F.col("copies")
    one = one.withColumns(
        {
            "next": F.when(last, F.col("next")).otherwise(F.col("text")),
            "next_hashes": F.when(last, F.col("next_hashes")).otherwise(F.col("hashes")),
        }
    )
    one = one.withColumn("edited", edited).withColumn("edited_picked", kept(F.col("edited"), gram, window))
    return one.select(
        F.col("id").alias(key),
        "text",
        "edited",
        written(F.col("picked")).alias("fingerprint"),
        written(F.col("edited_picked")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), hashes_of(F.col("edited_picked"))).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )


def fingerprint_digest(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``edited_fingerprints`` with digests in the place of texts."""
    rows = edited_fingerprints(documents, key, text)
    return rows.select(
        key,
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )
