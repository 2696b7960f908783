"""DuckDB statements of the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op9_host_quality"] = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT r, i, list_aggregate(ws[i:i + 4], 'string_agg', ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
cov AS (SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
m AS (SELECT w.r, doc_id, host, len(ws)::BIGINT AS n_words, length(translate(t, E' \t\n\x0b\f\r', ''))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             (len(list_filter(string_split(t, E'\n'), lambda x: translate(x, E' \t\n\x0b\f\r', '') <> ''))
              - len(list_distinct(list_filter(string_split(t, E'\n'), lambda x: translate(x, E' \t\n\x0b\f\r', '') <> ''))))::BIGINT AS n_dup_lines,
             len(list_filter(string_split(t, E'\n'), lambda x: translate(x, E' \t\n\x0b\f\r', '') <> '')) AS n_lines,
             coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
j AS (SELECT *, base_failed OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 30 * n_lines AS failed FROM f),
h AS (SELECT host, count(*) AS nd, sum(failed::BIGINT) AS nf FROM j GROUP BY host),
p AS (SELECT sum(nf) / sum(nd) AS mu, var_pop(nf / nd) AS va, least(sum(nf) / sum(nd), avg(nf / nd)) AS r FROM h),
k AS (SELECT mu, r, CASE WHEN va > 0 AND mu * (1 - mu) > va THEN mu * (1 - mu) / va - 1 ELSE 1.0 END AS s FROM p),
q AS (SELECT host, nd + s AS n, (nf + mu * s) / (nd + s) AS x, greatest(0.25, 4 * r / (1 + 3 * r)) AS most FROM h, k),
v AS (SELECT host, x - 2 * sqrt(x * (1 - x) / (n + 1)) <= most AS ok FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND ok AS kept FROM j JOIN v USING (host)
"""

ORACLES["op3_url_filter"] = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u)
SELECT page_id, host, path, r AS rule, CASE WHEN r IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT *, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS r FROM p)
"""

ORACLES["op1_spaced_seed_decontamination"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark),
dt AS (SELECT r, doc_id, len(ws) AS nd, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM d),
it AS (SELECT item_id, len(ws) AS n, least(len(ws), 20) AS win, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS j FROM b),
m AS (SELECT r, doc_id, nd, item_id, n, win, p - j AS diag, list(j ORDER BY j) AS js FROM dt JOIN it USING (w)
      GROUP BY ALL HAVING count(*) >= win - CASE WHEN win >= 10 THEN win // 5 ELSE 0 END),
s AS (SELECT *, unnest(range(greatest(0, -diag), least(n, nd - diag) - win + 1)) AS a FROM m),
ok AS (SELECT r, doc_id, item_id, diag, js, min(a) AS a0, max(a) + win AS a1 FROM
       (SELECT *, len(list_filter(js, lambda x: x >= a AND x < a + win)) AS c FROM s) WHERE c >= win - CASE WHEN win >= 10 THEN win // 5 ELSE 0 END
       GROUP BY r, doc_id, item_id, diag, js, win),
o AS (SELECT r, doc_id, item_id, (diag + a0)::INTEGER AS first, (diag + a1 - 1)::INTEGER AS last, len(list_filter(js, lambda x: x >= a0 AND x < a1))::INTEGER AS agree, a0::INTEGER AS item_first FROM ok)
SELECT doc_id, item_id, first, last, agree, item_first FROM o
QUALIFY row_number() OVER (PARTITION BY r, item_id ORDER BY agree DESC, first, item_first) = 1
"""

ORACLES["op6_reply_tree_chat"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 AS size FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

# the pages of the test tables keep their main text in one article element
ORACLES["op10_consensus_html"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|\z)', 1) AS h FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(h, '</?(p|h1|div|ul|li)>'), lambda x: trim(regexp_replace(
        replace(replace(replace(replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g'))) AS bs FROM a)
SELECT page_id, url, array_to_string(list_filter(bs, lambda x: x <> ''), chr(10)) AS text, length(array_to_string(list_filter(bs, lambda x: x <> ''), chr(10)))::BIGINT AS n_chars FROM b
"""

ORACLES["op12_grace_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (PARTITION BY doc_id, coalesce(text, '')) AS nth FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND nth = 1 AS kept, sha256(t) AS text_sha256 FROM g
"""

# CRC-32 byte by byte over distinct words, with the table of the reflected polynomial
ORACLES["op11_importance_resampling"] = r"""
WITH RECURSIVE bits AS (SELECT b, b::UBIGINT AS c, 0 AS i FROM range(256) AS r(b)
    UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END, i + 1 FROM bits WHERE i < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE i = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM d),
v AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
u AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM (SELECT w FROM w UNION ALL SELECT w FROM v)),
k AS (SELECT w, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(x) + 1, 2), lambda i: ('0x' || x[i:i + 1])::UBIGINT)),
                                lambda c, b: xor(c // 256, t[(xor(c % 256, b) + 1)::INTEGER])), 4294967295::UBIGINT) % 10000 AS bucket FROM u, tab),
s AS (SELECT bucket, count(*) AS s FROM w JOIN k USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM v JOIN k USING (w) GROUP BY bucket),
g AS (SELECT b AS bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE
             / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
      FROM range(10000) AS r(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
n AS (SELECT r, count(*) AS n, sum(gain) AS gain FROM w JOIN k USING (w) JOIN g USING (bucket) GROUP BY r),
e AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, CASE WHEN n > 0 THEN floor(gain / n)::BIGINT ELSE 0 END AS weight,
             ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT AS h FROM d LEFT JOIN n USING (r)),
f AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS every FROM f)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= every * 10 // 100 THEN place END AS rank FROM p
"""
