"""SQL for DuckDB that says what the queries of operators 2, 3, 9, 11, 12 and 13 return."""

from __future__ import annotations

from folio.llm import secrets

_WORDS = r"""words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents))"""

OP2 = f"""WITH {_WORDS.format(text="coalesce(text, '')")},
grams AS (SELECT *, string_agg(word, ' ') OVER w AS g, count(*) OVER w AS n FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
counted AS (SELECT doc_id, i, word, n = 35 AND count(*) OVER (PARTITION BY CASE WHEN n = 35 THEN g ELSE doc_id || ':' || i END) > 1 AS again FROM grams),
marked AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM counted)
SELECT d.doc_id, count(m.i) AS n_words, count(CASE WHEN gone THEN 1 END) AS n_removed, sha256(coalesce(string_agg(CASE WHEN NOT gone THEN word END, ' ' ORDER BY i), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m USING (doc_id) GROUP BY d.doc_id"""

OP3 = f"""WITH RECURSIVE {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
grams AS (SELECT doc_id, string_agg(word, ' ') OVER w AS g, count(*) OVER w AS n, i FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
shingles AS (SELECT DISTINCT doc_id, g FROM grams WHERE n = 4 OR i = 1),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches(kind: str, rank: int, pattern: str) -> str:
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, m, (sum(length(p) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id ORDER BY k) - coalesce(length(m), 0))::BIGINT AS start
  FROM (SELECT doc_id, unnest(p) AS p, unnest(m) AS m, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, regexp_split_to_array(t, {_q(pattern)}) AS p, regexp_extract_all(t, {_q(pattern)}) AS m FROM d)) QUALIFY m IS NOT NULL"""


def _hulls(c: secrets.EntropyClass, rank: int) -> str:
    w = c.window
    return f"""SELECT doc_id, {rank} AS rank, '{c.name}' AS kind, min(start + i) AS start, max(start + i) + {w} AS stop FROM (
   SELECT *, sum(new) OVER (PARTITION BY doc_id, start ORDER BY i) AS hull FROM (
    SELECT doc_id, start, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, start ORDER BY i) <= {w} THEN 0 ELSE 1 END AS new FROM (
     SELECT doc_id, start, m, unnest(range(length(m) - {w} + 1)) AS i FROM ({_matches(c.name, rank, c.pattern)}) WHERE NOT ({" OR ".join(f"regexp_full_match(m, {_q(a)})" for a in secrets.ALLOW)}))
    WHERE list_entropy(string_split(substr(m, i + 1, {w}), '')) >= {c.bits})) GROUP BY doc_id, start, hull"""


_SPAN = "kind || ':' || start || ':' || stop"
OP9 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS (
 SELECT doc_id, rank, kind, start, start + length(m) AS stop FROM ({_matches("assign", 0, secrets.ASSIGN)}) WHERE length(regexp_extract(m, {_q(secrets.ASSIGN)}, 2)) >= {secrets.ASSIGN_MIN}
 UNION ALL SELECT doc_id, rank, kind, start, start + length(m) FROM ({_matches("access", 1, secrets.ACCESS)})
 UNION ALL SELECT doc_id, rank, kind, start, start + length(m) FROM ({_matches("hex", 2, secrets.HEX)})
 UNION ALL {_hulls(secrets.HEX_CLASS, 3)} UNION ALL {_hulls(secrets.BASE64_CLASS, 4)})
SELECT d.doc_id, count(CASE WHEN rank = 0 THEN 1 END) AS n_assign, count(CASE WHEN rank = 1 THEN 1 END) AS n_access, count(CASE WHEN rank = 2 THEN 1 END) AS n_hex,
 sha256(coalesce(string_agg(CASE WHEN rank < 3 THEN {_SPAN} END, ',' ORDER BY start, rank), '')) AS base_sha256, coalesce(string_agg({_SPAN}, ',' ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""


#: CRC-32 by bits: a table of 256 entries, then a byte at a time; digits, minus, colon and blank are their own bytes.
_CRC = "crc AS (SELECT list(list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"


def _crc(text: str) -> str:
    bytes_ = f"list_transform(range(1, length({text}) + 1), lambda k: ascii(substr({text}, k, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _more(value: str, cost: int | str, edit: str = "") -> str:
    """A value, nine digits of cost and then an audit, after one more edit before it."""
    return f"(lpad((substr({value}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{edit}' || substr({value}, 10))"


def _eaten(state: str, keeps: dict[str, str], forced: str) -> str:
    keep = " ".join(f"WHEN '{x}' THEN {_more('v' + to, 'late', 'K')}" for x, to in keeps.items())
    return f"least({_more('v' + state, 3, 'D')}, CASE WHEN NOT gone THEN {_more('v' + forced, 'late + 2', 'R')} END, CASE WHEN NOT gone THEN CASE initial {keep} END END) AS e{state}"


_INSERTED = {"0": "2", "1": "2", "2": "3", "3": "2"}
_MIXED = ", ".join(f"least(e{x}, {_more('e' + y, 2, 'I')}, {_more('e' + _INSERTED[y], 4, 'II')}) AS v{x}" for x, y in _INSERTED.items())
_KEY = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
OP11 = f"""WITH RECURSIVE {_CRC},
kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc(_KEY)} % 20 AS kind FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM placed),
faults AS (SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS initial, last = '' AS blank, last <> '' AND again AS twice, last <> '' AND NOT again AND last NOT IN ('.', '!', '?') AS cut FROM seen),
needs AS (SELECT conv_id, i, initial, blank OR twice AS gone, cut::INT AS late, max(i) OVER (PARTITION BY conv_id) AS n FROM faults),
steps AS (
 SELECT conv_id, n + 1 AS i, '000000000' AS v0, '000000004II' AS v1, '000000002I' AS v2, '000000000' AS v3 FROM (SELECT conv_id, n FROM needs GROUP BY ALL)
 UNION ALL
 SELECT conv_id, i, {_MIXED} FROM (
  SELECT r.conv_id, r.i, {_eaten("0", {"s": "1", "u": "2"}, "2")}, {_eaten("1", {"u": "2"}, "2")}, {_eaten("2", {"a": "3"}, "3")}, {_eaten("3", {"u": "2"}, "2")}
  FROM steps s JOIN needs r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i - 1)),
solved AS (SELECT conv_id, substr(v0, 1, 9)::BIGINT AS cost, substr(v0, 10) AS audit FROM steps WHERE i = 1),
edits AS (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS k, audit FROM solved),
edited AS (SELECT conv_id, k, substr(audit, k, 1) AS edit, length(regexp_replace(substr(audit, 1, k), 'I', '', 'g')) AS i, length(regexp_replace(substr(audit, 1, k), 'D', '', 'g')) AS nth FROM edits),
kept AS (SELECT e.conv_id, e.k, e.edit, e.nth, f.role, f.text, bool_or(edit = 'K' AND nth = 1 AND f.initial = 's') OVER (PARTITION BY e.conv_id) AS system FROM edited e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i AND e.edit <> 'I' WHERE e.edit <> 'D'),
spelt AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - system::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS whole FROM kept GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(CASE WHEN blank THEN 1 END) AS blank, count(CASE WHEN twice THEN 1 END) AS duplicate, count(CASE WHEN cut THEN 1 END) AS truncated,
 count(CASE WHEN before || initial NOT IN ('su', 'ua', 'au') THEN 1 END) AS illegal FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM faults) GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN spelt p ON p.conv_id IS NOT DISTINCT FROM c.conv_id"""

OP12 = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept FROM embeddings e JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id"""

OP13 = f"""WITH {_CRC},
split AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, {_crc("doc_id::VARCHAR")} AS h FROM documents, crc),
spots AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AS hit, (h // 10) % greatest(len(w), 1) AS a, h // 10 AS g FROM split),
long AS (SELECT doc_id, w, n, unnest(range(n)) AS i, hit, a, 1 + (n - a) // (3 + g % 8) AS p FROM spots),
words AS (SELECT doc_id, i, n, w[1 + CASE WHEN hit AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM long),
alike AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
isles AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM alike) GROUP BY doc_id, q, isle HAVING count(*) >= q AND count(*) + q >= 12),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM isles GROUP BY ALL),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS t FROM words w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period, (1000 * b.length // b.period)::BIGINT AS exponent_milli, sha256(coalesce(l.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN best b USING (doc_id) LEFT JOIN lines l USING (doc_id) LEFT JOIN kept k USING (doc_id)"""
