"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import licences

_WORDS = "'[^\\x20\\x09-\\x0D]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

REPEATS = f"""
WITH listed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS words FROM documents),
starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM listed WHERE len(words) >= 13),
windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS phrase FROM starts),
owners AS (SELECT phrase, min(doc_id) AS owner FROM windows GROUP BY phrase),
covered AS (
  SELECT DISTINCT w.doc_id, w.i + k.k AS i
  FROM windows w JOIN owners o ON w.phrase = o.phrase AND o.owner < w.doc_id
  CROSS JOIN range(13) k(k)),
each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM listed),
kept AS (
  SELECT e.doc_id, count(*) AS n, string_agg(e.word, ' ' ORDER BY e.i) AS kept_text
  FROM each e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.i = c.i
  WHERE c.i IS NULL GROUP BY e.doc_id)
SELECT l.doc_id, len(l.words) AS n_words, len(l.words) - coalesce(k.n, 0) AS n_removed,
  sha256(coalesce(k.kept_text, '')) AS kept_sha256
FROM listed l LEFT JOIN kept k ON l.doc_id = k.doc_id"""

WARC = """
WITH payloads AS (
  SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT hex, min(page_id) AS first FROM payloads GROUP BY hex)
SELECT p.page_id, octet_length(encode(p.html)) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
      (CAST('0x' || substr(p.hex, CAST(1 + 5 * (k // 4) AS INT), 5) AS INT)
        >> CAST(15 - 5 * (k % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN f.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM payloads p JOIN firsts f ON p.hex = f.hex"""

EXACT = f"""
WITH lowered AS (SELECT doc_id, {_LOWERED} AS text FROM documents),
groups AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM lowered GROUP BY text)
SELECT l.doc_id, g.keep_id, g.group_size, l.doc_id = g.keep_id AS kept,
  sha256(l.text) AS text_sha256
FROM lowered l JOIN groups g ON l.text = g.text"""

NEAR = f"""
WITH RECURSIVE listed AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, {_WORDS}) AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, hash(shingle) AS shingle FROM (
    SELECT doc_id, words[i : i + 2] AS shingle FROM (
      SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM listed WHERE len(words) >= 3)
    UNION ALL
    SELECT doc_id, words FROM listed WHERE len(words) IN (1, 2))),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b
  WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT r.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id,
  r.doc_id = r.component_id AS kept
FROM roots r LEFT JOIN sizes s ON r.doc_id = s.doc_id"""

_TERMS = "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'"

SEARCH = f"""
WITH listed AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, {_TERMS}) AS terms FROM documents),
sized AS (SELECT doc_id, terms, len(terms) AS n FROM listed WHERE len(terms) > 0),
whole AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sized),
each AS (SELECT doc_id, n, unnest(terms) AS term FROM sized),
wanted AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all({_LOWERED}, {_TERMS})) AS term FROM benchmark)
  GROUP BY item_id, term),
postings AS (
  SELECT doc_id, n, term, count(*) AS tf FROM each
  WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, n, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings, whole GROUP BY term, nn),
scored AS (
  SELECT q.item_id, p.doc_id,
    CAST(sum(q.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * nn) // ll))))
      AS BIGINT) AS score
  FROM wanted q JOIN postings p ON p.term = q.term JOIN weights w ON w.term = q.term, whole
  GROUP BY q.item_id, p.doc_id),
placed AS (
  SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place
  FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM placed WHERE place <= 20"""

LINES = f"""
WITH listed AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM listed),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    '{_UPPER}', '{_LOWER}') AS key FROM each),
common AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS kept_text
  FROM keyed WHERE key NOT IN (SELECT key FROM common) GROUP BY doc_id)
SELECT l.doc_id, len(l.lines) AS n_lines, len(l.lines) - coalesce(k.n, 0) AS n_dropped,
  sha256(coalesce(k.kept_text, '')) AS kept_sha256
FROM listed l LEFT JOIN kept k ON l.doc_id = k.doc_id"""

NEGATIVES = """
WITH given AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    unnest(embedding) AS x, unnest(range(len(embedding))) AS i
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND list_count(embedding) = len(embedding) AND isfinite(coalesce(list_sum(embedding), 0))),
parts AS (
  SELECT vec_id, label, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM given),
scores AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM parts a JOIN parts b ON a.i = b.i WHERE a.vec_id % 50 = 0 GROUP BY ALL),
positives AS (
  SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM scores
  WHERE label = own AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER)
    AS rank
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND s.label <> p.own
WHERE 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3"""

ALL = {
    "op2_repeats": REPEATS,
    "op3_licences": licences.oracle(),
    "op4_warc": WARC,
    "op9_exact": EXACT,
    "op10_near": NEAR,
    "op11_search": SEARCH,
    "op12_lines": LINES,
    "op13_negatives": NEGATIVES,
}
