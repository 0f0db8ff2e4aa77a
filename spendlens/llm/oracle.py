"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_BLANK = r"[\x20\x09-\x0D]"

_QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, {_WORDS.format('text')} AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, ws FROM w),
texts AS (SELECT r, i, ws[i:i + 4] AS win FROM windows),
again AS (SELECT r, i FROM texts QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
spots AS (SELECT DISTINCT r, i + k AS p FROM again, range(0, 5) AS t(k)),
covered AS (SELECT r, count(*) AS n FROM spots GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '{_BLANK}', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '^{_BLANK}*[-*•]')))::BIGINT AS n_bullet_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…){_BLANK}*$')))::BIGINT AS n_ellipsis_lines
  FROM w LEFT JOIN covered c USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
  + CASE WHEN n_lines >= 3 AND 100 * n_bullet_lines > 90 * n_lines THEN 64 ELSE 0 END
  + CASE WHEN n_lines >= 3 AND 100 * n_ellipsis_lines > 50 * n_lines THEN 128 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, 'v2' AS policy FROM b
"""

_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_FOLDED = rf"regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_DECONTAMINATION = f"""
WITH i AS (SELECT item_id, {_FOLDED} AS ws FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS k FROM i WHERE len(ws) > 0),
items AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS win FROM iw),
d AS (SELECT row_number() OVER () AS r, doc_id, {_FOLDED} AS ws FROM documents),
dn AS (SELECT r, ws, n FROM d, (SELECT DISTINCT n FROM items) WHERE len(ws) >= n),
dk AS (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM dn),
dw AS (SELECT r, n, k, array_to_string(ws[k:k + n - 1], ' ') AS win FROM dk),
hits AS (SELECT DISTINCT r, k, n, item_id FROM dw JOIN items USING (n, win)),
starts AS (SELECT DISTINCT r, k, n FROM hits),
spots AS (SELECT DISTINCT r, unnest(range(k, k + n)) AS p FROM starts),
covered AS (SELECT r, count(*) AS n_hit FROM spots GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
          FROM hits GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""

_TOOL_CALLS = """
WITH RECURSIVE
t AS (SELECT conv_id, turn, role, text FROM conversations),
calls AS (
  SELECT conv_id, turn, 'c' || turn AS call_id, CASE role WHEN 'user' THEN 'reply' WHEN 'system' THEN 'configure' ELSE role END AS name, text,
         CASE WHEN role = 'user' AND turn >= 2 THEN turn - 2 END AS ref
  FROM t WHERE role IS DISTINCT FROM 'assistant'),
known AS (SELECT c.*, p.turn AS parent FROM calls c LEFT JOIN calls p ON p.conv_id = c.conv_id AND p.turn = c.ref),
lev AS (
  SELECT conv_id, turn, 0::BIGINT AS level FROM known WHERE parent IS NULL
  UNION ALL
  SELECT k.conv_id, k.turn, l.level + 1 FROM known k JOIN lev l ON l.conv_id = k.conv_id AND l.turn = k.parent),
judged AS (
  SELECT k.*, l.level,
         concat_ws('; ',
           CASE WHEN name NOT IN ('reply', 'configure') THEN 'unknown tool ' || name END,
           CASE WHEN text IS NULL THEN '$: text is missing' END,
           CASE WHEN text = '' THEN '$.text: too short' END,
           CASE WHEN name = 'configure' AND turn > 0 THEN '$.turn: above maximum' END,
           CASE WHEN turn < 0 THEN '$.turn: below minimum' END,
           CASE WHEN ref IS NOT NULL AND parent IS NULL THEN 'unknown reference c' || ref END) AS errors
  FROM known k JOIN lev l USING (conv_id, turn)),
results AS (SELECT conv_id, turn, 'c' || (turn - 1) AS call_id, text FROM t WHERE role = 'assistant')
SELECT coalesce(j.conv_id, r.conv_id) AS conv_id, coalesce(j.call_id, r.call_id) AS call_id, coalesce(j.turn, r.turn) AS turn,
       CASE WHEN j.call_id IS NULL THEN 'orphan_result' WHEN r.call_id IS NULL THEN 'missing_result' ELSE 'linked' END AS status,
       j.call_id IS NOT NULL AND j.errors = '' AS valid, coalesce(j.errors, '') AS errors, j.level,
       '{' || concat_ws(',',
         CASE WHEN j.call_id IS NOT NULL THEN '"call":{"arguments":{'
           || CASE WHEN j.ref IS NOT NULL THEN '"history":{"$ref":"c' || j.ref || '"},' ELSE '' END
           || CASE WHEN j.text IS NOT NULL THEN '"text":' || to_json(j.text)::VARCHAR || ',' ELSE '' END
           || '"turn":' || j.turn || '},"id":"' || j.call_id || '","name":"' || j.name || '"}' END,
         CASE WHEN r.call_id IS NOT NULL THEN '"result":{"content":' || coalesce(to_json(r.text)::VARCHAR, 'null') || ',"id":"' || r.call_id || '"}' END) || '}' AS message
FROM judged j FULL JOIN results r ON r.conv_id = j.conv_id AND r.call_id = j.call_id
"""

_COLLOCATIONS = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {_ASCII}) AS text FROM documents),
p AS (SELECT r, lang, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') AS ps FROM d),
q AS (SELECT r, lang, unnest(ps) AS piece, unnest(range(len(ps))) AS j FROM p),
w AS (SELECT r, j, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM q),
one AS (SELECT r, j, lang, unnest(ws) AS w1, unnest(range(len(ws))) AS i FROM w),
next AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM one WINDOW o AS (PARTITION BY r, j ORDER BY i)),
grams AS (SELECT lang, 1 AS n, w1 AS phrase FROM next
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM next WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM next WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM next WHERE w4 IS NOT NULL),
f AS (SELECT lang, n, phrase, count(*) AS f FROM grams GROUP BY ALL),
cand AS (SELECT lang, n, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE n > 1 AND f >= 30),
cuts AS (SELECT lang, n, phrase, a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:n], ' ') AS rp
         FROM cand, range(1, 4) AS t(k) WHERE k < n),
scored AS (SELECT c.lang, c.phrase, c.a, lf.f AS l, rf.f AS r, ((2000000::HUGEINT * a) // (lf.f + rf.f))::BIGINT AS score
           FROM cuts c JOIN f lf ON lf.lang = c.lang AND lf.phrase = c.lp JOIN f rf ON rf.lang = c.lang AND rf.phrase = c.rp
           QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
parts AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS most
          FROM cand, range(2, 4) AS t(m), range(1, 4) AS u(i) WHERE m < n AND i + m - 1 <= n GROUP BY 1, 2),
kept AS (SELECT s.* FROM scored s LEFT JOIN parts USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE f.n = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, total.n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""

_PREFIX_TRIE = """
WITH RECURSIVE
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1),
crc(conv_id, k, c) AS (
  SELECT conv_id, 0, 4294967295::BIGINT FROM own
  UNION ALL
  SELECT conv_id, k + 1, list_reduce([xor(c, ascii(substr(conv_id::VARCHAR, k + 1, 1))::BIGINT)] || range(8),
           lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)
  FROM crc WHERE k < length(conv_id::VARCHAR)),
plan AS (SELECT o.conv_id, xor(c, 4294967295) % 6 AS h, o.conv_id - o.conv_id % 100 AS base FROM own o JOIN crc ON crc.conv_id = o.conv_id AND k = length(o.conv_id::VARCHAR)),
rows AS (
  SELECT p.conv_id, 0 AS part, t.pos, role, text FROM plan p JOIN t ON t.conv_id = p.base AND t.pos < p.h
  UNION ALL
  SELECT p.conv_id, 1, t.pos, role, text FROM plan p JOIN t ON t.conv_id = p.conv_id AND t.pos >= p.h),
whole AS (SELECT p.conv_id, coalesce(list(struct_pack(role := role, text := text) ORDER BY part, pos) FILTER (WHERE role IS NOT NULL), []) AS ts
          FROM plan p LEFT JOIN rows r ON r.conv_id = p.conv_id GROUP BY 1),
paths AS (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM whole),
nodes AS (SELECT ts[1:d] AS node, d, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d > 0 THEN length(ts[d].text) ELSE 0 END AS cp,
                 coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(ts) = d), '') AS ends
          FROM paths GROUP BY ALL),
kids AS (SELECT node[1:d - 1] AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (node)),
up AS (SELECT node[1:a] AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n_convs - 1) * cp)::BIGINT AS saved
       FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_nodes) GROUP BY 1)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, u.n_leaves, u.saved AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_nodes f JOIN up u ON u.node = f.node LEFT JOIN nodes p ON f.d > 0 AND p.node = f.node[1:f.d - 1]
"""

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": _QUALITY,
    "op9_benchmark_decontamination": _DECONTAMINATION,
    "op10_tool_call_linking": _TOOL_CALLS,
    "op11_prefix_trie": _PREFIX_TRIE,
    "op13_phrase_collocations": _COLLOCATIONS,
}
