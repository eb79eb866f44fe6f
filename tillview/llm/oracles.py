"""Plain SQL for the operators whose results it can express, by comparing everything with everything."""

from __future__ import annotations

#: Words as the operators see them: ASCII letters, digits, the underscore, all other characters.
WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[0-9A-Za-z_\x{80}-\x{10FFFF}]+')"

REPEATS = """
WITH docs AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
windows AS MATERIALIZED (
  SELECT doc_id, pos, md5_number(hex(array_slice(raw, pos, pos + 99))) AS digest
  FROM (SELECT doc_id, unnest(range(1, octet_length(raw) - 98)) AS pos, raw FROM docs WHERE octet_length(raw) >= 100)),
ordered AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY digest ORDER BY doc_id, pos) AS n FROM windows),
repeated AS (
  SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM ordered WHERE n > 1),
marked AS (
  SELECT *, sum(CASE WHEN before IS NULL OR pos > before + 100 THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM repeated),
spans AS (SELECT doc_id, span, min(pos) AS first, max(pos) + 99 AS last FROM marked GROUP BY doc_id, span),
gaps AS (
  SELECT doc_id, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY first), 0) + 1 AS first, first - 1 AS last FROM spans
  UNION ALL SELECT doc_id, max(last) + 1, NULL FROM spans GROUP BY doc_id),
kept AS (
  SELECT gaps.doc_id, string_agg(hex(array_slice(raw, first, coalesce(last, octet_length(raw)))), '' ORDER BY first) AS rest
  FROM gaps JOIN docs ON gaps.doc_id = docs.doc_id GROUP BY gaps.doc_id),
sums AS (SELECT doc_id, sum(last - first + 1) AS removed, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT docs.doc_id, CAST(octet_length(raw) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  CASE WHEN rest IS NULL THEN sha256(raw) ELSE sha256(unhex(rest)) END AS kept_sha256
FROM docs LEFT JOIN sums ON docs.doc_id = sums.doc_id LEFT JOIN kept ON docs.doc_id = kept.doc_id"""

#: Five bits of the hexadecimal digest at a time give a letter or a digit.
WARC = """
WITH records AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha1(coalesce(html, '')) AS digest,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest FROM pages)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(digest, CAST(5 * i // 4 + 1 AS INTEGER), 2) AS INTEGER) >> CAST(3 - 5 * i % 4 AS INTEGER)) & 31)
      AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < largest THEN largest END AS refers_to
FROM records"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE texts AS (SELECT doc_id, {WORDS} AS words FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ')
    ELSE array_to_string(words[pos:pos + 4], ' ') END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS pos FROM texts WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS size FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 5 * n >= 4 * (x.size + y.size - n)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS other FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(other, doc_id)) AS class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links
FROM documents LEFT JOIN least ON doc_id = least.a LEFT JOIN counts ON doc_id = counts.a"""

CONTAMINATED = f"""
WITH doc_words AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM (SELECT doc_id, {WORDS} AS words FROM documents)),
items AS MATERIALIZED (SELECT item_id, words, len(words) AS size FROM (SELECT item_id, {WORDS} AS words FROM benchmark)),
item_words AS (SELECT item_id, unnest(words) AS word, unnest(range(size)) AS pos FROM items WHERE size >= 5),
same AS (
  SELECT doc_id, item_id, d.pos - i.pos AS shift, list(i.pos) AS places
  FROM doc_words d JOIN item_words i ON d.word = i.word GROUP BY 1, 2, 3 HAVING count(*) >= 5),
proven AS (
  SELECT DISTINCT doc_id, same.item_id FROM same JOIN items ON same.item_id = items.item_id
  WHERE len(list_filter(range(size - least(16, size) + 1),
    lambda s: len(list_filter(places, lambda p: p >= s AND p < s + least(16, size)))
      >= CASE WHEN size >= 16 THEN 13 WHEN size >= 9 THEN ceil(0.8 * size) ELSE size END)) > 0),
found AS (SELECT doc_id, list_sort(list(item_id)) AS items FROM proven GROUP BY doc_id)
SELECT documents.doc_id, items IS NOT NULL AS contaminated, CAST(coalesce(len(items), 0) AS INTEGER) AS n_items,
  coalesce(items, []) AS items
FROM documents LEFT JOIN found ON documents.doc_id = found.doc_id"""

ORACLES: dict[str, str] = {
    "op2_repeats": REPEATS,
    "op3_warc": WARC,
    "op8_near_duplicates": NEAR_DUPLICATES,
    "op9_decontaminate": CONTAMINATED,
}
