"""DuckDB SQL for the rows of the queries that SQL can express."""

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10 = f"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (SELECT doc_id, pos, line, {LOWER.format(f"trim(line, {BLANKS})")} AS k FROM lines),
repeated AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, pos, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN repeated USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP6 = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
sized AS (SELECT item, w, least(10, len(w)) AS size FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS t
        FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM sized)),
places AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s
           FROM dw, (SELECT DISTINCT size FROM win) WHERE len(w) >= size),
hits AS (SELECT doc_id, s, p.size, item FROM (SELECT doc_id, s, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS t FROM places) p
         JOIN win ON win.size = p.size AND win.t = p.t),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id),
df AS (SELECT t, count(*) AS df FROM (SELECT unnest(w) AS t FROM dw) GROUP BY t),
placed AS (SELECT item, w, p, w[p] AS t, coalesce(df, 0) AS df FROM (SELECT DISTINCT item, w, unnest(range(1, len(w) + 1)) AS p FROM iw WHERE len(w) >= 10) LEFT JOIN df ON t = w[p]),
two AS (SELECT DISTINCT item, w, k[1] AS a, k[2] AS b FROM (
          SELECT item, w, s, list({{'t': t, 'p': p}} ORDER BY df, p) FILTER (df > 0) AS k FROM placed, LATERAL (SELECT unnest(range(greatest(1, p - 9), least(p, len(w) - 9) + 1)) AS s) GROUP BY item, w, s) WHERE len(k) >= 9),
shifts AS (SELECT DISTINCT doc_id, d.w AS dw, item, g.w AS iw, shift FROM (
             SELECT doc_id, item, two.w, q - a.p AS shift, b FROM (SELECT doc_id, generate_subscripts(w, 1) AS q, unnest(w) AS t FROM dw) x JOIN two ON x.t = a.t) g JOIN dw d USING (doc_id)
           WHERE list_contains(d.w[greatest(1, shift + b.p - 2):greatest(0, shift + b.p + 2)], b.t)),
met AS (SELECT doc_id, item, iw, list_filter(range(1, len(iw) + 1), lambda k: list_contains(dw[greatest(1, shift + k - 2):greatest(0, shift + k + 2)], iw[k])) AS h FROM shifts),
near AS (SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM met
         WHERE len(list_filter(range(1, len(iw) - 8), lambda s: len(list_filter(h, lambda k: k >= s AND k < s + 10)) >= 9)) > 0) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(named.items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, sha256(coalesce(near.items, '')) AS near_sha256
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near USING (doc_id)
"""

OP9 = """
WITH t AS (SELECT DISTINCT conv_id, CAST(turn AS BIGINT) AS turn, replace(translate(coalesce(role, ''), chr(13) || chr(10), '  '), '<|', '< |') AS role,
             replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
sized AS (SELECT *, CAST(coalesce(sum(1024 + strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM t),
shown AS (SELECT *, place // 1048576 AS block, true AS own FROM sized
          UNION ALL SELECT *, place // 1048576 + 1, false FROM sized WHERE place % 1048576 >= 1048576 - 131072),
blocks AS (SELECT conv_id, block, min(place) AS first_place FROM shown GROUP BY ALL HAVING bool_or(own)),
heads AS (SELECT s.conv_id, s.turn, s.role, s.text, s.place, b.block, false AS own FROM blocks b JOIN sized s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.role = 'system' AND s.place // 1048576 < b.block
          QUALIFY row_number() OVER (PARTITION BY b.conv_id, b.block ORDER BY s.place DESC) = 1),
led AS (SELECT s.* FROM shown s JOIN blocks b ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.block = b.block
        UNION ALL SELECT h.* FROM heads h JOIN blocks b ON h.conv_id IS NOT DISTINCT FROM b.conv_id AND h.block = b.block WHERE h.place < b.first_place),
people AS (SELECT DISTINCT conv_id AS conv, block AS in_block, role AS perspective FROM led WHERE own AND role <> 'system'),
seen AS (SELECT conv_id, block, perspective, place, own AND role = perspective AS own,
           '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head,
           text || '<|im_end|>' AS body
         FROM led JOIN people ON led.conv_id IS NOT DISTINCT FROM people.conv AND led.block = people.in_block),
placed AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, block, perspective ORDER BY place
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begins FROM seen)
SELECT conv_id, perspective, block, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own, sha256(string_agg(head || body || chr(10), '' ORDER BY place)) AS text_sha256,
       coalesce(string_agg(CAST(begins AS BIGINT) || ':' || CAST(begins + length(body) AS BIGINT), ',' ORDER BY place) FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, perspective, block
"""

OP7 = f"""
WITH RECURSIVE w AS (SELECT doc_id, [x for x in string_split_regex({LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+') if x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""

OP11 = """
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT *, len(w) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS r FROM u),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(w[:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(pre || mid || suf) AS restored_sha256
FROM p
"""


def secrets(kinds: tuple, scope: int) -> str:
    """SQL for the spans of `kinds` (name, pattern, group, least, must, role, weak), weak ones linked within scope."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for i, (_, pattern, group, least, must, role, weak) in enumerate(kinds):
        good = "".join(f" AND regexp_matches(g, {quote(m)})" for m in must)
        parts.append(
            f"SELECT doc_id, {i} AS kind, {quote(role)} AS role, {weak} AS weak, begin AS s, begin + length(m) AS e FROM ("
            f"SELECT doc_id, m[i] AS m, g[i] AS g, CAST(list_sum([length(x) for x in b[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) AS BIGINT) AS begin FROM ("
            f"SELECT doc_id, m, g, b, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {quote(pattern)}) AS m, regexp_extract_all(t, {quote(pattern)}, {group}) AS g, string_split_regex(t, {quote(pattern)}) AS b FROM d)))"
            f" WHERE length(g) >= {least}{good}"
        )
    names = "CASE kind " + " ".join(f"WHEN {i} THEN '{k[0]}'" for i, k in enumerate(kinds)) + " END"
    line = f"{names} || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS ({" UNION ALL ".join(parts)}),
kept AS (SELECT doc_id, kind, s, e FROM parts p WHERE NOT weak OR EXISTS (SELECT 1 FROM parts q WHERE q.doc_id = p.doc_id AND q.s - p.e <= {scope} AND p.s - q.e <= {scope}
         AND p.role <> q.role AND (p.role = 'secret' OR q.role = 'secret')))
SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
       sha256(coalesce(string_agg({line}, ',' ORDER BY s, kind) FILTER (WHERE kind < 3), '')) AS base_sha256, coalesce(string_agg({line}, ',' ORDER BY s, kind) FILTER (WHERE kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN kept USING (doc_id) GROUP BY doc_id
"""
