"""DuckDB SQL of the queries that SQL can express; for the others tests hold brute-force versions."""

from __future__ import annotations

import string

from panelspark.llm.linededup import WORDS
from panelspark.llm.secretscan import ISSUED
from panelspark.llm.suffixes import LENGTH

WORD = r"'[^\x20\x09-\x0D]+'"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), {WORD}) AS ws FROM documents),
 s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) END)) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
 both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach AS (SELECT a AS x, b AS y FROM both_ways UNION SELECT r.x, e.b FROM reach r JOIN both_ways e ON r.y = e.a),
 least_of AS (SELECT x AS doc_id, min(y) AS y FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.y, d.doc_id)) AS component_id, least(d.doc_id, coalesce(l.y, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_of l ON l.doc_id = d.doc_id"""

LINE_DEDUP = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
 k AS (SELECT *, len(regexp_extract_all(line, {WORD})) AS n FROM l),
 c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM k),
 e AS (SELECT a.doc_id, a.i, min(b.i) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= {WORDS} GROUP BY 1, 2),
 windows AS (SELECT e.doc_id, e.i, e.e, string_agg(c.line, chr(10) ORDER BY c.i) AS content FROM e JOIN c ON c.doc_id = e.doc_id AND c.i BETWEEN e.i AND e.e GROUP BY 1, 2, 3),
 later AS (SELECT doc_id, i, e FROM windows QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, i) > 1),
 gone AS (SELECT DISTINCT c.doc_id, c.i FROM c JOIN later t ON c.doc_id = t.doc_id AND c.i BETWEEN t.i AND t.e),
 kept AS (SELECT c.doc_id, string_agg(c.line, chr(10) ORDER BY c.i) FILTER (g.i IS NULL) AS text, count(*) AS n_lines, count(g.i) AS n_removed FROM c LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.i = c.i GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id"""

SUFFIX_DEDUP = f"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 p AS (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - {LENGTH - 1}, 0))) AS i FROM b),
 s AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, {2 * LENGTH})) AS g FROM p),
 later AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
 m AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS fresh FROM later),
 r AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM m),
 spans AS (SELECT doc_id, nth, min(i) AS a, max(i) + {LENGTH} AS e FROM r GROUP BY 1, 2),
 gaps AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
 cut AS (SELECT g.doc_id, sum(e - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(e) AS last FROM gaps g JOIN b ON b.doc_id = g.doc_id GROUP BY 1)
SELECT b.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN cut c ON c.doc_id = b.doc_id"""

def _either_case(word: str) -> str:
    """A word in letters of either case, of ASCII alone."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


#: (kind, pattern, group that has `least` characters or more); the kinds in order.
_SECRETS = [
    ("assign", "(" + "|".join(map(_either_case, ["password", "passwd", "secret", "token", "api_?key"])) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    *((r.kind, r.pattern, 0, 0) for r in ISSUED),
]


def _spans(k: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Rows (doc_id, row, kind, start, stop) of a pattern's matches, from the lengths of matches and of the pieces between."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT row, {k} AS k, '{kind}' AS kind, stop - size AS start, stop FROM (
 SELECT row, length(m) AS size, length(v) AS value, sum(length(p) + length(m)) OVER (PARTITION BY row ORDER BY i) AS stop FROM (
 SELECT row, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(ps[: len(ms)]) AS p FROM (
 SELECT row, regexp_extract_all(t, '{quoted}') AS ms, regexp_extract_all(t, '{quoted}', {group}) AS vs, string_split_regex(t, '{quoted}') AS ps FROM d))) WHERE value >= {least}"""


SECRETS = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
 s AS ({" UNION ALL ".join(_spans(k, *x) for k, x in enumerate(_SECRETS))}),
 p AS (SELECT *, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS printed FROM s)
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))},
 sha256(coalesce(string_agg(printed, ',' ORDER BY start, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(printed, ',' ORDER BY start, k), '') AS spans
FROM d LEFT JOIN p USING (row) GROUP BY row, doc_id"""

_LETTERS = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"

INTERACTION = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws FROM documents),
 known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
 f AS (SELECT doc_id, part, CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT) + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS INT)
   + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask FROM t),
 h AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN known USING (doc_id) GROUP BY 1, 2),
 o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
   FROM {_LETTERS} a(f, b), {_LETTERS} b(f, b), {_LETTERS} c(f, b), {_LETTERS} d(f, b), {_LETTERS} e(f, b) WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
 s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step, bits FROM o),
 w AS (SELECT filter_order, step, bits[step] AS own, CAST(coalesce(list_sum(bits[1 : step - 1]), 0) AS INT) AS before FROM s),
 r AS (SELECT part, filter_order, step, own, sum(n) FILTER (mask & (own | before) = 0) AS kept, sum(n) FILTER (mask & own > 0 AND mask & before = 0) AS removed, sum(n) FILTER (mask & own > 0 AND mask & before > 0) AS redundant,
   sum(n) FILTER (mask = own) AS unique_fails, sum(good) FILTER (mask & own > 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (mask & own > 0 AND mask & before = 0) AS toxic_lost FROM h, w GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
 CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""

# crc32 of an ASCII string, byte by byte and bit by bit
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT))),
 lambda sofar, byte: list_reduce(list_concat([xor(sofar, byte)], CAST(range(8) AS BIGINT[])), lambda x, nth: xor(x >> 1, 3988292384 * (x & 1)))))"""
_BLANK = r"[\x20\x09-\x0D]"

# one row for each conversation, number of rows so far, and last initial given out; of equal costs the least audit
CONVERSATIONS = rf"""
WITH RECURSIVE n AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
 k AS (SELECT *, {_CRC} % 20 AS kind FROM n),
 d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE kind <> 0),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
 f AS (SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
   CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?]{_BLANK}*\z') THEN 3 ELSE 0 END AS fault FROM o),
 c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
   count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS rows FROM f GROUP BY 1),
 given AS (SELECT * FROM (VALUES ('n', 'u', ''), ('n', 'a', 'u'), ('s', 'u', ''), ('s', 'a', 'u'), ('u', 'u', 'a'), ('u', 'a', ''), ('a', 'u', ''), ('a', 'a', 'u')) g(state, after, missing)),
 steps AS (SELECT 'n' AS state, 's' AS after, '' AS missing, 's' AS needs, 0 AS cost, 'K' AS edit UNION ALL SELECT state, after, missing, after, 5 * length(missing), repeat('I', length(missing)) || 'K' FROM given
   UNION ALL SELECT state, after, missing, NULL, 5 * length(missing) + 1, repeat('I', length(missing)) || 'R' FROM given),
 full_name AS (SELECT * FROM (VALUES ('u', 'user'), ('a', 'assistant')) v(initial, name)),
 w AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 'n' AS state, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': CAST([] AS VARCHAR[])}} AS way FROM c
  UNION ALL SELECT conv_id, i, state, min(way) FROM (
   SELECT w.conv_id, f.i, w.state, {{'cost': w.way.cost + 2, 'audit': w.way.audit || 'D', 'lines': w.way.lines}} AS way FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
   UNION ALL SELECT w.conv_id, f.i, s.after, {{'cost': w.way.cost + s.cost + CASE WHEN fault = 3 THEN 5 ELSE 0 END, 'audit': w.way.audit || s.edit,
     'lines': w.way.lines || CASE WHEN m.name IS NULL THEN CAST([] AS VARCHAR[]) ELSE [m.name || ':'] END || [CASE WHEN s.needs IS NULL THEN r.name ELSE f.role END || ':' || f.text]}}
    FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 AND f.fault NOT IN (1, 2) JOIN steps s ON s.state = w.state AND (s.needs IS NULL OR s.needs = f.initial)
    LEFT JOIN full_name m ON m.initial = s.missing LEFT JOIN full_name r ON r.initial = s.after) GROUP BY 1, 2, 3),
 ends AS (SELECT * FROM (VALUES ('n', '', []), ('s', 'II', ['user:', 'assistant:']), ('u', 'I', ['assistant:']), ('a', '', [])) e(state, edit, lines)),
 best AS (SELECT w.conv_id, min({{'cost': way.cost + 5 * length(e.edit), 'audit': way.audit || e.edit, 'lines': way.lines || e.lines}}) AS way FROM w JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.rows = w.i JOIN ends e ON e.state = w.state GROUP BY 1)
SELECT a.conv_id, {", ".join(f"coalesce({x}, 0) AS {x}" for x in ("gaps", "blank", "duplicate", "truncated", "illegal"))}, coalesce(way.cost, 0) AS cost, coalesce(way.audit, '') AS audit, sha256(coalesce(array_to_string(way.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id"""

SQL = {"op2_near_duplicates": NEAR_DUPLICATES, "op9_line_dedup": LINE_DEDUP, "op10_suffix_dedup": SUFFIX_DEDUP, "op11_secrets": SECRETS, "op12_interaction": INTERACTION, "op13_conversations": CONVERSATIONS}
