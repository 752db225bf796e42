"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op3_decontaminate"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0) t,
       unnest(range(len(w) - n + 1)) AS u(i)),
lengths AS (SELECT DISTINCT n FROM windows),
occurrences AS (
  SELECT d.doc_id, d.i, l.n, array_to_string(w[i + 1 : i + l.n], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM words) d, lengths l
  WHERE i + l.n <= len(w)),
hits AS (SELECT o.doc_id, o.i, o.n, k.item_id FROM occurrences o JOIN windows k USING (n, win)),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
       sha256(coalesce(f.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(w.w) AS contaminated
FROM words w LEFT JOIN hit_words h USING (doc_id) LEFT JOIN found f USING (doc_id)
"""

ORACLE["op8_quality"] = r"""
WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
runs AS (
  SELECT doc_id, i, w[i + 1 : i + 3] AS r
  FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM parts WHERE len(w) >= 3)),
repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, r) AS n FROM runs) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY doc_id),
measured AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_intersect(list_transform(w, lambda x: lower(x)), [{stop_words}])) AS n_stop_words
  FROM parts LEFT JOIN covered c USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words <= 200000 AND word_chars BETWEEN 2 * n_words AND 14 * n_words
       AND n_symbols <= 0.4::DOUBLE * n_words AND n_stop_words >= 2
       AND (n_lines = 0 OR n_dup_lines <= 0.5 * n_lines) AS kept
FROM judged
"""


ORACLE["op9_suffix"] = r"""
WITH parts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
windows AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS win
  FROM (SELECT doc_id, h, unnest(range(n - 49)) AS i FROM parts WHERE n >= 50)),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM windows) WHERE first < doc_id),
edges AS (SELECT doc_id, i, i + 50 AS e, max(i + 50) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM gone),
runs AS (
  SELECT doc_id, min(i) AS a, max(e) AS b
  FROM (SELECT *, count(*) FILTER (before IS NULL OR i > before) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges)
  GROUP BY doc_id, run),
cut AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_byte FROM runs),
kept AS (
  SELECT c.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
         string_agg(substr(h, 2 * from_byte + 1, 2 * (a - from_byte)), '' ORDER BY a) AS head
  FROM cut c JOIN parts USING (doc_id) GROUP BY c.doc_id)
SELECT p.doc_id, p.n AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, coalesce(k.n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN k.doc_id IS NULL THEN p.h ELSE k.head || substr(p.h, 2 * k.last + 1) END)) AS kept_sha256
FROM parts p LEFT JOIN kept k USING (doc_id)
"""

ORACLE["op10_partenum"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 3, 1))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common c JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
  WHERE 100 * c.n >= 85 * (a.n + b.n - c.n)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (
  SELECT x AS doc_id, x AS other FROM both_ways
  UNION
  SELECT r.doc_id, l.y FROM reached r JOIN both_ways l ON r.other = l.x)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(m.least, w.doc_id) AS component_id
FROM words w LEFT JOIN sizes s USING (doc_id)
LEFT JOIN (SELECT doc_id, min(other) AS least FROM reached GROUP BY doc_id) m USING (doc_id)
"""

ORACLE["op12_nra"] = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
totals AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM words WHERE len(w) > 0),
occurrences AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM words) GROUP BY r, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM occurrences, totals GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, i, term
  FROM (SELECT item_id, row_number() OVER () AS i,
               unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark)),
scored AS (
  SELECT item_id, i, d.doc_id,
         CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(d.w) * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN occurrences USING (term) JOIN weights USING (term) JOIN words d USING (r), totals
  GROUP BY item_id, i, r, d.doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""

ORACLE["op11_trie"] = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id AS c, turn, coalesce(text, '') AS t,
         md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (
  SELECT c, digest, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) AS p
  FROM turns),
bits AS (
  SELECT DISTINCT c, CAST(c AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS v FROM turns
  UNION ALL
  SELECT c, s, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END
  FROM (SELECT c, s, i, CASE WHEN i % 8 = 0 THEN xor(v, CAST(ascii(substr(s, CAST(i // 8 + 1 AS INT), 1)) AS BIGINT)) ELSE v END AS x
        FROM bits WHERE i < 8 * length(s))),
convs AS (SELECT c, xor(v, CAST(4294967295 AS BIGINT)) % 4 AS h FROM bits WHERE i = 8 * length(s)),
rebuilt AS (
  SELECT k.c, 1 AS own, n.p, digest, words FROM convs k JOIN numbered n ON n.c = k.c - k.c % 20 WHERE n.p <= k.h
  UNION ALL
  SELECT k.c, 2 AS own, n.p, digest, words FROM convs k JOIN numbered n ON n.c = k.c WHERE n.p > k.h),
whole AS (SELECT c, list(digest ORDER BY own, p) AS l, list(words ORDER BY own, p) AS ws FROM rebuilt GROUP BY c),
paths AS (
  SELECT c, d, array_to_string(l[1 : d], '') AS key, CASE WHEN d > 0 THEN array_to_string(l[1 : d - 1], '') END AS parent,
         CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS words, d = len(l) AS last
  FROM (SELECT k.c, coalesce(l, []) AS l, ws, unnest(range(coalesce(len(l), 0) + 1)) AS d FROM convs k LEFT JOIN whole w USING (c))),
nodes AS (
  SELECT key, any_value(parent) AS parent, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * any_value(words) AS saved,
         coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '') AS ends
  FROM paths GROUP BY key),
children AS (SELECT parent AS key, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT a.key, sum(n.saved) AS saved, count(*) FILTER (k.key IS NULL) AS leaves
  FROM nodes n JOIN paths a ON a.c = n.conv_id AND a.d <= n.depth LEFT JOIN children k ON k.key = n.key GROUP BY a.key)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.leaves AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n LEFT JOIN nodes up ON up.key = n.parent LEFT JOIN children k ON k.key = n.key JOIN below b ON b.key = n.key
"""

ORACLE["op13_minhash"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 1, 1))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common c JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
  WHERE 100 * c.n >= 80 * (a.n + b.n - c.n)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (
  SELECT x AS doc_id, x AS other FROM both_ways
  UNION
  SELECT r.doc_id, l.y FROM reached r JOIN both_ways l ON r.other = l.x)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(m.least, w.doc_id) AS component_id,
       w.doc_id = coalesce(m.least, w.doc_id) AS kept
FROM words w LEFT JOIN sizes s USING (doc_id)
LEFT JOIN (SELECT doc_id, min(other) AS least FROM reached GROUP BY doc_id) m USING (doc_id)
"""


def _fill() -> None:
    from fleetlife.llm.qualityrules import STOP_WORDS

    words = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    ORACLE["op8_quality"] = ORACLE["op8_quality"].replace("{stop_words}", words)


_fill()
