"""SQL for the queries of this package that SQL can express: brute force over shingles as text."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_SHINGLES = "unnest(range(1, greatest(len({w}) - 3, 2))) u(i)"
_ONE = "CASE WHEN len({w}) >= 5 THEN array_to_string({w}[i:i + 4], ' ') ELSE array_to_string({w}, ' ') END"

_NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')")} w FROM documents),
s AS (SELECT DISTINCT doc_id, {_ONE.format(w="w")} sh FROM d, {_SHINGLES.format(w="w")} WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a u, b v FROM l UNION ALL SELECT b, a FROM l),
reach(node, label) USING KEY (node) AS (SELECT doc_id, doc_id FROM documents UNION
  SELECT node, label FROM (SELECT e.v node, min(r.label) AS label FROM reach r JOIN e ON r.node = e.u GROUP BY ALL) m WHERE NOT EXISTS (FROM recurring.reach k WHERE k.node = m.node AND k.label <= m.label))
SELECT doc_id, coalesce(n, 0) n_shingles, label AS component_id, doc_id = label AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN reach ON node = doc_id"""

_LEAKS = f"""WITH d AS (SELECT doc_id, {_WORDS.format(text="lower(coalesce(text, ''))")} w FROM documents),
b AS (SELECT item_id, {_WORDS.format(text="lower(coalesce(text, ''))")} w FROM benchmark),
ds AS (SELECT doc_id, {_ONE.format(w="w")} sh FROM d, {_SHINGLES.format(w="w")} WHERE len(w) > 0),
bs AS (SELECT item_id, {_ONE.format(w="w")} sh, count(*) n FROM b, {_SHINGLES.format(w="w")} WHERE len(w) > 0 GROUP BY ALL),
pairs AS (SELECT DISTINCT doc_id, item_id FROM ds JOIN bs USING (sh)),
windows AS (SELECT doc_id, item_id, pos, d.w[pos:pos + len(b.w) - 1] v, len(b.w) k FROM pairs JOIN d USING (doc_id) JOIN b USING (item_id), unnest(range(1, greatest(len(d.w) - len(b.w), 0) + 2)) u(pos)),
ws AS (SELECT doc_id, item_id, pos, {_ONE.format(w="v")} sh, count(*) n FROM windows, {_SHINGLES.format(w="v")} GROUP BY ALL),
common AS (SELECT doc_id, item_id, pos, sum(least(ws.n, bs.n)) c FROM ws JOIN bs USING (item_id, sh) GROUP BY ALL),
sizes AS (SELECT doc_id, item_id, pos, sum(n) n FROM ws GROUP BY ALL), totals AS (SELECT item_id, sum(n) m FROM bs GROUP BY ALL)
SELECT doc_id, item_id, round(max(c / (n + m - c)::DOUBLE), 6) similarity FROM common JOIN sizes USING (doc_id, item_id, pos) JOIN totals USING (item_id) WHERE 100 * c >= 75 * (n + m - c) GROUP BY doc_id, item_id"""

ORACLE_SQL: dict[str, str] = {"op5_benchmark_decontamination": _LEAKS, "op7_minhash_near_dedup": _NEAR}

_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
#: Every document is scored for every item.
ORACLE_SQL["op12_lexical_search"] = f"""WITH d AS (SELECT row_number() OVER () k, doc_id, {_TERMS} ts FROM documents),
size AS (SELECT k, doc_id, len(ts)::BIGINT n FROM d WHERE len(ts) > 0), total AS (SELECT count(*)::BIGINT big_n, sum(n)::BIGINT big_l FROM size),
tfs AS (SELECT k, term, count(*)::BIGINT tf FROM (SELECT k, unnest(ts) term FROM d) GROUP BY ALL), dfs AS (SELECT term, count(*)::BIGINT df FROM tfs GROUP BY term),
asked AS (SELECT item_id, term, count(*)::BIGINT q FROM (SELECT item_id, unnest({_TERMS}) term FROM benchmark) GROUP BY ALL),
weighed AS (SELECT item_id, term, q, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) w FROM asked JOIN dfs USING (term), total),
scored AS (SELECT item_id, doc_id, k, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT score FROM weighed JOIN tfs USING (term) JOIN size USING (k), total GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER w AS INT) AS rank, doc_id, score FROM scored WHERE score > 0 WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY rank <= 20"""


def _plus(key: str, cost: str, letters: str) -> str:
    """A path's key, ten digits of cost and its letters, with more of both."""
    return f"(lpad((substr({key}, 1, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || substr({key}, 11) || '{letters}')"


def _insertions(state: str) -> str:
    """The keys of a state after insertions."""
    one, two = lambda k: _plus(k, "2", "I"), lambda k: _plus(k, "4", "II")
    return f"least(ku, {one('k0')}, {one('ks')}, {one('ka')})" if state == "u" else f"least(ka, {one('ku')}, {two('k0')}, {two('ks')})"


#: The damage by a checksum written out, then the best path to each state row by row, and the repaired turns read off the letters.
ORACLE_SQL["op13_conversation_repair"] = f"""WITH RECURSIVE crc_table AS (SELECT list(v ORDER BY i) t FROM (SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) v FROM range(256) r(i))),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') k FROM conversations),
summed AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(k, ''), lambda x: ascii(x)::UBIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 20 w FROM keyed, crc_table),
harmed AS (SELECT conv_id, turn, CASE w WHEN 4 THEN 'user' ELSE role END role, CASE w WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM summed, unnest(range(CASE w WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) k FROM harmed),
faulty AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END fault,
  substr(role, 1, 1) i, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) || substr(role, 1, 1) pair FROM numbered),
paths AS (SELECT conv_id, 0::BIGINT k, '0000000000' k0, NULL::VARCHAR ks, NULL::VARCHAR ku, NULL::VARCHAR ka FROM conversations GROUP BY conv_id UNION ALL
  SELECT conv_id, k, {_plus("k0", "3", "D")}, least({_plus("ks", "3", "D")}, CASE WHEN i = 's' AND free THEN {_plus("k0", "t", "K")} END),
    least({_plus("pu", "3", "D")}, CASE WHEN free THEN least({_plus("k0", "2 + t", "R")}, {_plus("ks", "2 + t", "R")}, {_plus("pa", "2 + t", "R")}) END, CASE WHEN i = 'u' AND free THEN least({_plus("k0", "t", "K")}, {_plus("ks", "t", "K")}, {_plus("pa", "t", "K")}) END),
    least({_plus("pa", "3", "D")}, CASE WHEN free THEN {_plus("pu", "2 + t", "R")} END, CASE WHEN i = 'a' AND free THEN {_plus("pu", "t", "K")} END)
  FROM (SELECT f.conv_id, f.k, i, fault NOT IN ('blank', 'duplicate') free, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END t, k0, ks, {_insertions("u")} pu, {_insertions("a")} pa FROM paths p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.k = p.k + 1)),
ends AS (SELECT conv_id, least(k0, {_insertions("a")}) e FROM paths QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1),
edits AS (SELECT conv_id, p, substr(e, 10 + p, 1) x, length(replace(substr(e, 11, p), 'I', '')) k, length(replace(substr(e, 11, p), 'D', '')) place FROM ends, unnest(range(1, length(e) - 9)) u(p)),
turns AS (SELECT e.conv_id, p, x, place, f.role, f.text, bool_or(place = 1 AND x = 'K' AND i = 's') OVER (PARTITION BY e.conv_id) led FROM edits e LEFT JOIN faulty f ON x <> 'I' AND f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.k = e.k WHERE x <> 'D'),
said AS (SELECT conv_id, string_agg(CASE WHEN x = 'K' THEN role WHEN (place - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) s FROM turns GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) gaps, count(*) FILTER (WHERE fault = 'blank') blank, count(*) FILTER (WHERE fault = 'duplicate') duplicate, count(*) FILTER (WHERE fault = 'truncated') truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) illegal FROM faulty GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, substr(e, 1, 10)::BIGINT AS cost, substr(e, 11) audit, sha256(coalesce(s, '')) repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN said t ON t.conv_id IS NOT DISTINCT FROM e.conv_id"""
