"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACE = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_SPACE}') AS w FROM documents),
n AS (SELECT doc_id, list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)
                                    IF len(w) > 0]) AS s FROM w),
s AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
      GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY 1)
SELECT n.doc_id, len(n.s)::BIGINT AS n_shingles, least(n.doc_id, coalesce(m, n.doc_id)) AS component_id,
       n.doc_id = least(n.doc_id, coalesce(m, n.doc_id)) AS kept
FROM n LEFT JOIN c USING (doc_id)
"""

OP2 = rf"""
WITH
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n,
       unnest([array_to_string(w[i:i + least(len(w), 13) - 1], ' ') FOR i IN range(1, greatest(len(w) - 12, 1) + 1)]) AS g
       FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT p.doc_id, p.n, p.i, bw.item_id FROM p JOIN bw ON bw.n = p.n AND bw.g = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
marked AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS x FROM hit) GROUP BY 1),
its AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS its FROM hit GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(its), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(its, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP3 = rf"""
WITH
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_SPACE}'))::BIGINT AS size FROM documents),
q AS (SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0 ELSE 0.25 END)::DOUBLE AS w FROM labels WHERE quality IN (0, 1) GROUP BY 1),
k AS (SELECT doc_id, source, size, 1 - pow((('0x' || md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || size)[1:13])::BIGINT
      ::DOUBLE + 0.5) / 4503599627370496, 1 / coalesce(w, 1)) AS key FROM d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
      [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY 1),
f AS (SELECT *, 3 * source_size / w AS ratio, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
      ORDER BY 3 * source_size / w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
      sum(w) OVER (ORDER BY 3 * source_size / w, w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, w * (SELECT level FROM f WHERE ratio >= level ORDER BY ratio, level LIMIT 1))
      AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT k.*, source_size, target, epochs, round(target)::BIGINT - epochs * source_size AS rest,
      sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target,
       (epochs * size + greatest(0, least(size, rest - (upto - size))))::BIGINT AS taken FROM r
"""


#: Written out on their own, for RE2.
_TAGS = ("p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|table|thead|tbody|tr|td|th|article|section|header|footer|nav|main|"
         "aside|title|head|body|html|blockquote|pre|form|figure|figcaption|option|select")
_HTML = (
    (r"(?is)<script[^<>]*>.*?</script[^<>]*>", "\n"), (r"(?is)<style[^<>]*>.*?</style[^<>]*>", "\n"),
    (r"(?s)<!--.*?-->", ""), (r"(?i)</?(?:" + _TAGS + r")(?:[\t\n\f\r /][^<>]*)?>", "\n"), (r"<[^<>]*>", ""),
    (r"&nbsp;", " "), (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", '"'), (r"&#39;", "'"), (r"&amp;", "&"),
    (r"[\t\f\r ]+", " "), (r" ?\n ?", "\n"),
)
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def _op4() -> str:
    html = "coalesce(html, '')"
    for pattern, to in _HTML:
        quoted = to.replace("'", "''").replace("\n", "' || chr(10) || '")
        html = "regexp_replace({}, '{}', '{}', 'g')".format(html, pattern.replace("'", "''"), quoted)
    return f"""
WITH
p AS (SELECT row_number() OVER () AS r, page_id, lower(nullif(regexp_extract(url, '{_HOST}', 1), '')) AS host,
      [x FOR x IN string_split(trim({html}, ' '), chr(10)) IF x <> ''] AS l FROM pages),
t AS (SELECT host, count(*) AS pages FROM p WHERE host IS NOT NULL GROUP BY 1),
c AS (SELECT host, x FROM (SELECT DISTINCT r, host, unnest(l) AS x FROM p WHERE host IS NOT NULL) JOIN t USING (host)
      GROUP BY host, x HAVING count(*) >= 3 AND count(*) > 0.1 * any_value(pages)),
e AS (SELECT r, unnest(l) AS x, unnest(range(len(l))) AS i, host FROM p),
k AS (SELECT r, count(*) AS n, string_agg(x, chr(10) ORDER BY i) AS text FROM e ANTI JOIN c USING (host, x) GROUP BY 1)
SELECT page_id, host, len(l)::BIGINT AS n_lines, (len(l) - coalesce(n, 0))::BIGINT AS n_removed, coalesce(text, '') AS text
FROM p LEFT JOIN k USING (r)
"""


OP5 = rf"""
WITH
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM k) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP6 = """
WITH
v AS (SELECT row_number() OVER () AS r, vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, q.v AS qv, c.vec_id,
      list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)])::BIGINT AS score
      FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""

_ESCAPED = r"regexp_replace({}, '(<|\[)(\\*)(\||/?s>|/?INST\]|/?<?SYS>>)', '\1\2\\\3', 'g')"
OP7 = f"""
WITH
c AS (SELECT conv_id, turn, role, text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t, role, text FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (r = 'assistant'), '')) AS loss_sha256,
       sum(length({_ESCAPED.format('r')}) + length({_ESCAPED.format('t')}) + 24)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


#: Unsigned crc32 of a column's decimal text (ASCII), bit by bit.
_CRC32 = """xor(list_reduce([4294967295::BIGINT] || [ascii(c)::BIGINT FOR c IN string_split({0}::VARCHAR, '')],
      lambda crc, c: list_reduce([xor(crc, c)] || range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

OP11 = rf"""
WITH
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w, {_CRC32.format('doc_id')} AS h FROM documents),
a AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
p AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a,
      CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM a),
t AS (SELECT doc_id, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS x FROM (
      SELECT *, unnest(range(n)) AS i FROM p)),
grams AS (SELECT doc_id, i, md5(string_agg(x, ' ') OVER six) AS s, count(*) OVER six AS c FROM t
          WINDOW six AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
again AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y
          ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i AND x.c = 6 AND y.c = 6),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM again),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM (
           SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 6 + q AS length FROM islands GROUP BY doc_id, q, k)
         WHERE length >= greatest(12, 2 * q) GROUP BY ALL),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s,
         first({{'s': start, 'l': length, 'p': period}} ORDER BY length DESC, start, period) AS best FROM runs GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS s FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period,
       (1000 * best.l // best.p)::BIGINT AS exponent_milli, sha256(coalesce(told.s, '')) AS runs_sha256,
       sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP12 = """
WITH RECURSIVE
v AS (SELECT row_number() OVER () AS r, vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings),
g AS (SELECT *, sqrt(list_sum([x * x FOR x IN v])) AS n FROM v
      WHERE len(v) > 0 AND len([x FOR x IN v IF x IS NULL OR NOT isfinite(x)]) = 0 AND list_max([abs(x) FOR x IN v]) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.r <> b.r AND len(a.v) = len(b.v)
      WHERE list_sum([x[1] * x[2] FOR x IN list_zip(a.v, b.v)]) >= 0.95 * a.n * b.n),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS vec_id, min(b) AS m FROM r GROUP BY 1),
l AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY 1)
SELECT vec_id, coalesce(l.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM v LEFT JOIN c USING (vec_id) LEFT JOIN l USING (vec_id)
"""

OP13 = f"""
WITH
t AS (SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS x,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(x ORDER BY i) AS x, {_CRC32.format('conv_id')} % 6 AS h FROM t GROUP BY 1),
b AS (SELECT o.conv_id, coalesce(f.x[1:o.h], []) || o.x[o.h + 1:] AS x FROM o LEFT JOIN o f ON f.conv_id = o.conv_id - o.conv_id % 100),
s AS (SELECT conv_id, x[1:d] AS x, d, d = len(x) AS ends FROM (SELECT *, unnest(range(len(x) + 1)) AS d FROM b)),
n AS (SELECT x, d, min(conv_id) AS conv_id, count(*) AS n_convs,
      sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM s GROUP BY x, d),
k AS (SELECT p.x, p.d, count(*) AS n FROM n p JOIN n c ON c.d = p.d + 1 AND c.x[1:p.d] = p.x GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(k.n, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * length(n.x[n.d].text) END AS saved
      FROM n LEFT JOIN k ON k.x = n.x AND k.d = n.d),
u AS (SELECT x[1:e] AS x, e AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
      FROM (SELECT *, unnest(range(d + 1)) AS e FROM m) GROUP BY 1, 2)
SELECT m.conv_id, m.d::BIGINT AS depth, p.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children,
       u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN u ON u.x = m.x AND u.d = m.d LEFT JOIN n p ON p.d = m.d - 1 AND p.x = m.x[1:m.d - 1]
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": OP1, "op2_decontaminate": OP2, "op3_mixing": OP3, "op4_lines": _op4(), "op5_debruijn": OP5,
            "op6_topk": OP6, "op7_chat": OP7, "op11_runs": OP11, "op12_epsjoin": OP12, "op13_trie": OP13}
