"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

#: Part, whole and bounded sides of the measures of operator 1.
_MEASURES = (
    ("n_symbols", "word_chars", "hi"), ("n_dup_lines", "n_words", "hi"), ("n_repeat_words", "n_words", "hi"), ("n_upper", "word_chars", "hi"),
    ("n_marks", "word_chars", "hi"), ("word_chars", "n_words", "hi lo"), ("n_words", "n_lines", "lo"),
)

OP1 = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, row_number() OVER () AS r, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
g AS (SELECT r, i, ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] AS k FROM (SELECT r, ws, unnest(range(len(ws) - 2)) AS i FROM w)),
rep AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
cov AS (SELECT r, count(DISTINCT i + j) AS n FROM rep, range(3) x(j) GROUP BY 1),
c AS (SELECT w.*, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS ls,
  (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper, (length(t) - length(regexp_replace(t, '[!"#$%&()*+/<=>?@\[\\\]^_`{{|}}~]', '', 'g')))::BIGINT AS n_marks, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (r)),
e AS (SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
f AS (SELECT *, {", ".join(f"greatest(({part} + 1) * 1048576 // ({whole} + 1), 1)::BIGINT AS a{i}" for i, (part, whole, _) in enumerate(_MEASURES))} FROM e),
s AS (SELECT lang, source, unnest([{", ".join(f"{{'m': {i}, 'v': a{i}}}" for i in range(len(_MEASURES)))}]) AS x FROM f WHERE NOT base_failed),
k AS (SELECT lang, source, x.m AS m, (x.v >> greatest(length(bin(x.v)) - 6, 0)) << greatest(length(bin(x.v)) - 6, 0) AS cell FROM s),
{", ".join(f"{name} AS (SELECT {keys}m, count(*) AS n, ln(quantile_disc(cell, 0.5)::DOUBLE) AS mid, ln(quantile_disc(cell, 0.5)::DOUBLE) - ln(quantile_disc(cell, 0.25)::DOUBLE) AS up, ln(quantile_disc(cell, 0.75)::DOUBLE) - ln(quantile_disc(cell, 0.5)::DOUBLE) AS down FROM k GROUP BY {keys}m)" for name, keys in (("own", "lang, source, "), ("mrg", "lang, "), ("whl", "")))},
dr AS (SELECT own.lang, own.source, own.m, {", ".join(f"(own.n * own.{c} + 50 * ((mrg.n * mrg.{c} + 50 * whl.{c}) / (mrg.n + 50))) / (own.n + 50) AS {c}" for c in ("mid", "up", "down"))}
  FROM own JOIN mrg ON own.lang IS NOT DISTINCT FROM mrg.lang AND own.m = mrg.m JOIN whl ON own.m = whl.m),
fen AS (SELECT lang, source, m, floor(exp(mid + 6 * greatest(up, ln(33 / 32::DOUBLE))) + 0.3::DOUBLE)::BIGINT AS hi, floor(exp(mid - 6 * greatest(down, ln(33 / 32::DOUBLE))) + 0.3::DOUBLE)::BIGINT AS lo FROM dr),
p AS (SELECT lang, source, {", ".join(f"max({side}) FILTER (m = {i}) AS {side}{i}" for i, (_, _, sides) in enumerate(_MEASURES) for side in sides.split())} FROM fen GROUP BY 1, 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(f"a{i} {'<=' if side == 'hi' else '>='} coalesce({side}{i}, a{i})" for i, (_, _, sides) in enumerate(_MEASURES) for side in sides.split())} AS kept
FROM f LEFT JOIN p ON f.lang IS NOT DISTINCT FROM p.lang AND f.source IS NOT DISTINCT FROM p.source"""

_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
#: Without seeds: every pair of equal tokens votes for its shift, and stretches of well-voted shifts are counted.
OP3 = f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL), b AS (SELECT item_id, {_TOKENS} AS t FROM benchmark WHERE text IS NOT NULL),
dt AS (SELECT doc_id, unnest(t) AS w, unnest(range(len(t))) AS p FROM d), bt AS (SELECT item_id, unnest(t) AS w, unnest(range(len(t))) AS p FROM b),
m AS (SELECT doc_id, item_id, dt.p - bt.p AS shift, count(*) AS c, list(bt.p) AS qs FROM dt JOIN bt USING (w) GROUP BY 1, 2, 3 HAVING count(*) >= 5),
v AS (SELECT m.*, len(d.t) AS x, len(b.t) AS y, least(13, len(d.t), len(b.t)) AS n FROM m JOIN d USING (doc_id) JOIN b USING (item_id)),
o AS (SELECT *, unnest(range(greatest(0, -shift), least(y, x - shift) - n + 1)) AS s FROM v WHERE n >= 10 AND c >= n - 2),
k AS (SELECT doc_id, item_id FROM o WHERE len(list_filter(qs, lambda j: j >= s AND j < s + n)) >= n - 2 UNION SELECT doc_id, item_id FROM v WHERE y < 10 AND c = y),
n AS (SELECT doc_id, count(*) AS n_items, min(item_id) AS first_item FROM k GROUP BY 1)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items, first_item FROM documents LEFT JOIN n USING (doc_id)"""

_KEY = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_RULES = (
    ("assign", _KEY + r"[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 6, 3),
    ("access", r"AKIA[A-Z0-9]+", 20, 2),
    ("hex", r"[0-9a-f]+", 24, 2),
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 1, 2),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 40, 2),
)
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS k, '{kind}' AS kind, {least} AS least, unnest(regexp_extract_all(t, '((?s:.*?))({pattern})', 1)) AS g, unnest(regexp_extract_all(t, '((?s:.*?))({pattern})', 2)) AS m, unnest(regexp_extract_all(t, '((?s:.*?))({pattern})', {group})) AS v, unnest(range(len(regexp_extract_all(t, '((?s:.*?))({pattern})', 1)))) AS i FROM d"
    for i, (kind, pattern, least, group) in enumerate(_RULES)
)
OP4 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({_FOUND}),
e AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS stop FROM f),
s AS (SELECT doc_id, k, (stop - length(m))::BIGINT AS start, kind || ':' || (stop - length(m))::BIGINT || ':' || stop::BIGINT AS x FROM e WHERE length(v) >= least),
a AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(x, ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(x, ',' ORDER BY start, k) AS spans FROM s GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN a USING (doc_id)"""

OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] END AS k
  FROM (SELECT doc_id, ws, unnest(range(CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(len(ws) - 2, 1) END)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
r(node, low) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(low) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = doc_id"""

OP10 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[(i + 1):(i + 13)], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(len(ws) - 12)) AS i FROM d)),
r AS (SELECT doc_id, i FROM w QUALIFY min(doc_id) OVER (PARTITION BY k) < doc_id),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM r, range(13) x(j)),
k AS (SELECT u.doc_id, string_agg(u.w, ' ' ORDER BY u.p) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d) u ANTI JOIN c USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
