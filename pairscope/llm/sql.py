"""SQL for the queries that SQL can express, written from their contracts."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

_QUALITY = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), windows AS (
  SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), places AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS x FROM base)
  WHERE regexp_matches(x, '{WORD}') GROUP BY doc_id, x
), dups AS (SELECT doc_id, sum(n - 1) AS n FROM lines GROUP BY doc_id),
m AS (
  SELECT b.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(d.n, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
  FROM base b LEFT JOIN dups d USING (doc_id) LEFT JOIN places p USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > n_words
    OR word_chars < 2 * n_words OR word_chars > 14 * n_words) AS kept
FROM m
"""

_EXACT = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

_MIX = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5('mix:' || doc_id) AS key FROM documents
), source AS (
  SELECT source, sum(size)::DOUBLE AS s, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS w
  FROM sized GROUP BY source
), shares AS (
  SELECT 0 AS turn, source, s, w, 3 * s AS cap, false AS capped, 0.0::DOUBLE AS t FROM source
  UNION ALL
  SELECT turn + 1, source, s, w, cap, capped OR level * w >= cap, least(cap, level * w) FROM (
    SELECT *, CASE WHEN sum(CASE WHEN capped THEN 0 ELSE w END) OVER () > 0 THEN
      (sum(s) OVER () - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () ELSE 1e300 END AS level
    FROM shares WHERE turn <= (SELECT count(*) FROM source)
  )
), goal AS (SELECT source, s, t AS target FROM shares WHERE turn = (SELECT max(turn) FROM shares)),
placed AS (
  SELECT z.*, s, target, sum(size) OVER (PARTITION BY z.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized z JOIN goal g ON z.source IS NOT DISTINCT FROM g.source
), cut AS (
  SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS epochs FROM placed
), counted AS (
  SELECT *, least(3, CAST(epochs + CASE WHEN 2 * upto - size < 2 * (target - epochs * s) THEN 1 ELSE 0 END AS BIGINT)) AS copies FROM cut
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(s AS BIGINT) AS source_size, round(target, 6) AS target, CAST(copies AS BIGINT) AS copies,
  CAST(copies * size AS BIGINT) AS taken
FROM counted
"""

_CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS x FROM conversations
  UNION ALL SELECT -1, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok',
    CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM (SELECT unnest([0, 1]) AS k)
), sized AS (
  SELECT *, length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g'))
    + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + length('<|im_start|>') + 1 + length('<|im_end|>') + 1 AS n FROM turns
), grouped AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST) AS body,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST) FILTER (role = 'assistant'), '') AS learned, sum(n) AS n
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(body) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256,
  CAST(n AS BIGINT) AS formatted_chars FROM grouped
"""

_WARC = r"""
WITH base AS (
  SELECT page_id, coalesce(html, '') AS html, substr(sha256(coalesce(html, '')), 1, 16) AS tag, 1704067200 + (page_id * 7919) % 34560000 AS at,
    regexp_replace(trim(coalesce(url, '')), '#.*$', '') AS clean FROM pages
), bare AS (SELECT *, regexp_replace(clean, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM base),
canonical AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/?]*')), '^([^@]*@)?(www[0-9]*[.])?', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS front,
    list_sort(list_filter(string_split(regexp_extract(b, '[?](.*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid|ref|sessionid)(=|$)'))) AS args FROM bare
), named AS (SELECT *, front || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS c FROM canonical),
found AS (
  SELECT 'r' || v.page_id AS record_id, v.c AS canonical_url, v.page_id AS n, v.tag AS mine, r.page_id AS other, r.tag AS stored, r.html,
    row_number() OVER (PARTITION BY v.page_id ORDER BY r.at DESC NULLS LAST, 'p' || r.page_id DESC NULLS LAST) AS k
  FROM named v LEFT JOIN named r ON r.c = v.c AND r.at < v.at + 259200
), judged AS (
  SELECT *, CASE WHEN other IS NULL THEN 'missing' WHEN n % 11 = 0 THEN 'unverified'
    WHEN (CASE WHEN n % 5 = 0 THEN 'stale' ELSE mine END) = stored THEN 'resolved' ELSE 'mismatch' END AS outcome FROM found WHERE k = 1
)
SELECT record_id, canonical_url, CASE WHEN other IS NOT NULL THEN 'p' || other END AS response_id, outcome,
  CASE WHEN outcome = 'resolved' THEN 'max-age=3600' END AS cache_control,
  CASE WHEN outcome = 'resolved' THEN CAST(strlen(html) AS BIGINT) END AS content_length,
  CASE WHEN outcome = 'resolved' THEN sha256(html) END AS body_sha256
FROM judged
"""

_SPELLING = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents)
  ) WHERE length(run) >= 6 GROUP BY doc_id, run
), messages AS (
  SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END)) AS bytes FROM runs
), bits AS (
  SELECT CAST(b AS BIGINT) AS b, 0 AS s, CAST(b AS BIGINT) AS reg FROM (SELECT unnest(range(256)) AS b)
  UNION ALL SELECT b, s + 1, xor(reg >> 1, CASE WHEN reg & 1 = 1 THEN 3988292384 ELSE 0 END) FROM bits WHERE s < 8
), crc AS (SELECT b, reg FROM bits WHERE s = 8),
after AS (
  SELECT 0 AS k, b, reg FROM (SELECT b, reg FROM crc UNION ALL SELECT -1, 4294967295)
  UNION ALL SELECT a.k + 1, a.b, xor(a.reg >> 8, t.reg) FROM after a JOIN crc t ON t.b = a.reg & 255
  WHERE a.k < (SELECT max(len(bytes)) FROM messages)
), parts AS (
  SELECT doc_id, run, n, b, n - i AS k FROM (
    SELECT doc_id, run, len(bytes) AS n, unnest(bytes) AS b, unnest(range(1, len(bytes) + 1)) AS i FROM messages)
), coded AS (
  SELECT p.doc_id, p.run, any_value(p.n) AS n, bit_xor(a.reg) AS part FROM parts p JOIN after a ON a.b = p.b AND a.k = p.k GROUP BY p.doc_id, p.run
), hashed AS (
  SELECT r.run, r.c, xor(xor(c.part, a.reg), 4294967295) AS h FROM coded c
  JOIN after a ON a.b = -1 AND a.k = c.n JOIN runs r ON r.run = c.run AND r.doc_id IS NOT DISTINCT FROM c.doc_id
), words AS (
  SELECT word, sum(c) AS n FROM (
    SELECT c, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed
  ) WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
), dels AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other FROM dels a JOIN dels b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, w.word FROM dels d JOIN words w ON w.word = d.rest
  UNION SELECT w.word, d.word FROM dels d JOIN words w ON w.word = d.rest
), ranked AS (
  SELECT p.word, p.other, o.n AS other_n, count(*) OVER (PARTITION BY p.word) AS n_near,
    row_number() OVER (PARTITION BY p.word ORDER BY o.n DESC, p.other) AS k
  FROM near p JOIN words o ON o.word = p.other
), named AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= 5 * w.n THEN r.other END AS form,
    CASE WHEN r.other_n >= 5 * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.k = 1
), chain AS (
  SELECT word, word AS root, 0 AS depth FROM named
  UNION ALL SELECT c.word, f.form, c.depth + 1 FROM chain c JOIN named f ON f.word = c.root WHERE f.form IS NOT NULL
), last AS (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY word)
SELECT n.word, n.form, l.root, CAST(n.n AS BIGINT) AS n, CAST(n.n_near AS BIGINT) AS n_near, CAST(n.form_n AS BIGINT) AS form_n
FROM named n JOIN last l USING (word)
"""

ORACLES: dict[str, str] = {
    "op2_quality_rules": _QUALITY, "op3_exact_dedup": _EXACT, "op7_chat_format": _CHAT, "op8_warc_revisits": _WARC, "op10_source_mix": _MIX,
    "op12_spelling_variants": _SPELLING,
}
