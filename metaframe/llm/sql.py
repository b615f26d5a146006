"""DuckDB SQL that states operators' results independently of the Spark code."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"
_PLAIN = _WORDS.format(r"[^\x20\x09-\x0D]+")
_ALNUM = _WORDS.format(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_PLAIN} AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, least(i + 2, len(ws))), ' ') AS g
  FROM w, unnest(range(1, greatest(len(ws) - 1, 2))) AS t(i) WHERE len(ws) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS MATERIALIZED (
  SELECT x.a, x.b FROM (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS same FROM s l JOIN s r USING (g) WHERE l.doc_id <> r.doc_id GROUP BY 1, 2) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * same >= 90 * (na.n + nb.n - same)
),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(w.doc_id, r.low), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY 1) r ON r.a = w.doc_id
"""

DECONTAMINATION = f"""
WITH dw AS MATERIALIZED (SELECT doc_id, {_ALNUM} AS ws FROM documents),
iw AS (SELECT item_id, {_ALNUM} AS ws FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, least(13, len(ws)) AS k, array_to_string(list_slice(ws, i, i + least(13, len(ws)) - 1), ' ') AS g
  FROM iw, unnest(range(1, greatest(len(ws) - 11, 2))) AS t(i) WHERE len(ws) > 0
),
hits AS MATERIALIZED (
  SELECT DISTINCT d.doc_id, d.i, d.k, w.item_id FROM (
    SELECT doc_id, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g
    FROM dw, (SELECT DISTINCT k FROM windows), unnest(range(1, len(ws) - k + 2)) AS t(i)) d
  JOIN windows w USING (k, g)
),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM hits, unnest(range(i, i + k)) AS t(p) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(words_hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words_hit.n, 0) > 0 AND 20 * coalesce(words_hit.n, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUALITY = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM d, unnest(range(1, len(ws) - 3)) AS t(i)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM rep, unnest(range(i, i + 5)) AS t(p) GROUP BY 1),
raw AS MATERIALIZED (SELECT doc_id, host, text, line FROM d, unnest(string_split(text, chr(10))) AS t(line) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM raw GROUP BY 1),
lines AS MATERIALIZED (
  SELECT doc_id, host, text, translate(lower(l), '123456789', '000000000') AS line, len(string_split(l, ' ')) AS words
  FROM (SELECT doc_id, host, text, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS l FROM raw)),
hosts AS (SELECT host, greatest(9, floor(0.01 * count(DISTINCT text))) AS cap FROM d GROUP BY 1),
frequent AS (SELECT host, line FROM lines JOIN hosts USING (host) GROUP BY host, line, cap HAVING count(DISTINCT text) > cap),
removed AS (SELECT doc_id, sum(words) AS n FROM lines JOIN frequent USING (host, line) GROUP BY 1),
base AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(removed.n, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN removed USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_removed_words >= 0.3 * n_words AS kept
FROM base
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""

_CONTROLS = r"<s>|</s>|\[TURN\]|\[TEXT\]|\[END\]|\[INST\]|\[/INST\]|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>"
_ESCAPED = "|".join(x[: 2 if x[0] == "\\" else 1] + r"\\*" + x[2 if x[0] == "\\" else 1 :] for x in _CONTROLS.replace(r"\|", "\0").split("|")).replace("\0", r"\|")

CHAT = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, ['user', 'assistant'][i + 1], '</s>[INST] ok [/INST]' FROM range(2) AS t(i))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (7 + sum(17 + length(role) + length(text) + len(regexp_extract_all(role, '{_ESCAPED}')) + len(regexp_extract_all(text, '{_ESCAPED}'))))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

#: Pages of the test tables mark their article, without advert or form inside, and have these character references only.
HTML = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS x FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS x FROM a),
e AS (SELECT page_id, url, regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS x FROM t)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM (SELECT page_id, url, trim(regexp_replace(x, '[ \t\n\r\f\v]+', ' ', 'g')) AS text FROM e)
"""
