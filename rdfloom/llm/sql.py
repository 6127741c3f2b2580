"""SQL of the queries that SQL can express."""

from __future__ import annotations

#: Words, lines and windows of each text; the verdict is the conjunction of the rules.
QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
lines AS (SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(l, '[^\x20\x09-\x0D]')) - count(DISTINCT l) FILTER (regexp_matches(l, '[^\x20\x09-\x0D]')) AS dup,
  count(*) FILTER (regexp_matches(l, '(\.\.\.|…)\s*$')) AS dots, count(*) FILTER (regexp_matches(l, '^\s*[-•*‣]')) AS bullets FROM l GROUP BY doc_id),
m AS (SELECT d.doc_id, t, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, lines.dup AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, lines.n AS n_lines, dots, bullets,
  length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS upper, length(t) - length(regexp_replace(t, '[!-@\[-`{-~]', '', 'g')) AS signs
  FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words OR 2 * word_chars < 5 * n_words OR word_chars > 15 * n_words OR n_dup_lines > 3 AND 10 * n_dup_lines > 3 * n_lines
  OR 2 * upper > word_chars OR 10 * signs > 4 * word_chars OR 10 * dots > 3 * n_lines OR 10 * bullets > 9 * n_lines) AS kept
FROM f
"""

LINES = r"""
WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS l FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
n AS (SELECT doc_id, i, trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS h, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
m AS (SELECT *, len(regexp_extract_all(h, '[^\x20\x09-\x0D]+')) AS words FROM n),
x AS (SELECT doc_id, k, i, h, words, lead(i) OVER o AS i1, lead(h) OVER o AS h1, lead(words) OVER o AS words1, lead(i, 2) OVER o AS i2, lead(h, 2) OVER o AS h2 FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
w AS (SELECT doc_id, k, [i, i1, i2] AS places, [h, h1, h2] AS w FROM x WHERE i2 IS NOT NULL UNION ALL SELECT doc_id, k, [i], [h] FROM x WHERE words >= 50
  UNION ALL SELECT doc_id, k, [i, i1], [h, h1] FROM x WHERE words < 50 AND words1 < 50 AND words + words1 >= 50),
later AS (SELECT doc_id, places FROM w QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, k) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(places) AS i FROM later),
c AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY i) FILTER (g.i IS NULL) AS t, count(g.i) AS n_removed FROM l LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, n_removed, length(coalesce(t, '')) AS clean_chars, md5(coalesce(t, '')) AS clean_md5 FROM c
"""

WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY sha1(h)) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + bit_string_value.v[i + 1], 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM s, LATERAL (SELECT list_transform(range(0, 32), lambda i: list_sum(list_transform(range(0, 5), lambda b:
  ((('0x' || substr(x, 1 + ((5 * i + b) // 4), 1))::INTEGER >> (3 - (5 * i + b) % 4)) & 1) << (4 - b)))::INTEGER) AS v) bit_string_value
"""

#: Every diagonal on which document and item agree often enough, without seeds: a stretch ends where they agree and begins as far
#: before its first agreement as the share of agreements allows.
LEAKS = r"""
WITH i AS (SELECT min(item_id) AS item_id, ts FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ts FROM benchmark WHERE item_id IS NOT NULL) WHERE len(ts) >= 5 GROUP BY ts),
iq AS (SELECT item_id, len(ts) AS n, least(13, len(ts)) AS need, unnest(ts) AS tok, unnest(range(0, len(ts))) AS q FROM i),
dp AS (SELECT doc_id, unnest(ts) AS tok, unnest(range(0, len(ts))) AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ts FROM documents)),
m AS (SELECT doc_id, item_id, need, p - q AS d, p FROM dp JOIN iq USING (tok)),
a AS (SELECT *, row_number() OVER o AS k, lag(p, 1, greatest(d, 0) - 1) OVER o AS before FROM m
  WINDOW o AS (PARTITION BY doc_id, item_id, d ORDER BY p) QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, d) >= 0.8 * need),
s AS (SELECT a.doc_id, a.item_id, a.need, b.p + 1 - greatest(a.before + 1, b.p + 1 - 5 * (b.k - a.k + 1) // 4) AS len, b.p - a.p AS least_len
  FROM a JOIN a b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND a.d = b.d AND a.k <= b.k),
found AS (SELECT doc_id, item_id, max(len) AS len FROM s WHERE len > least_len AND len >= need GROUP BY ALL),
per AS (SELECT doc_id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS item_ids, max(len) AS longest FROM found GROUP BY doc_id)
SELECT doc_id, item_ids IS NOT NULL AS contaminated, coalesce(item_ids, '') AS item_ids, coalesce(longest, 0)::BIGINT AS longest FROM documents LEFT JOIN per USING (doc_id)
"""

#: Both models counted over all documents, less the document itself; the empty word is the start and the end of a text.
LM = r"""
WITH d AS (SELECT doc_id, (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))::INTEGER AS g,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, g, CASE WHEN i = 1 THEN '' ELSE ws[i - 1] END AS h, coalesce(ws[i], '') AS w FROM (SELECT doc_id, g, ws, unnest(range(1, len(ws) + 2)) AS i FROM d WHERE len(ws) > 0)),
own AS (SELECT doc_id, g, h, w, count(*)::DOUBLE AS c FROM x GROUP BY ALL),
ow AS (SELECT doc_id, g, w, sum(c) AS o FROM own GROUP BY ALL),
pair AS (SELECT h, w, sum(c) AS b, sum(c * g) AS t FROM own GROUP BY ALL),
word AS (SELECT w, sum(o) AS b, sum(o * g) AS t FROM ow GROUP BY ALL),
n AS (SELECT sum(t) AS nt, sum(t) / sum(b) AS ratio FROM word),
s AS (SELECT doc_id, c * ln((ratio * (pair.b - c) + 50 * (ratio * (word.b - o) + 1) / (nt + 1)) / ((pair.t - c * own.g) + 50 * (word.t - o * own.g + 1) / (nt + 1))) AS v
    FROM own JOIN ow USING (doc_id, w) JOIN pair USING (h, w) JOIN word USING (w), n
  UNION ALL SELECT doc_id, -o * ln((ratio * (b - o) + 50) / (t - o * g + 50)) FROM ow JOIN word USING (w), n),
total AS (SELECT doc_id, sum(v) AS v FROM s GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_tokens, round(coalesce(v / (len(ws) + 1), 0), 9) AS score FROM d LEFT JOIN total USING (doc_id)
"""

ORACLES = {"op2_quality_rules": QUALITY, "op6_line_dedup": LINES, "op7_warc": WARC, "op9_decontamination": LEAKS, "op10_lm_scoring": LM}
