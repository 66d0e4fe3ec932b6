"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from tessera.llm import quality_rules as qr

SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
_WORDS = rf"list_filter(regexp_split_to_array({{t}}, '{SPACE}+'), lambda x: x <> '')"

URL_FILTER = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(rule, action, suffix, start) AS (VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'), ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')),
m AS (SELECT page_id, rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k FROM p JOIN rules ON (host = suffix OR ends_with(host, '.' || suffix)) AND starts_with(path, start))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (page_id)"""


def _quality() -> str:
    log_gamma, gamma = repr(qr.math.log(qr.GAMMA)), repr(qr.GAMMA)
    names, values = ", ".join(f"'{k}'" for k in qr.FENCED), ", ".join(qr.FENCED)
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS.format(t='t')} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS gram FROM w, unnest(range(1, len(ws) - 1)) r(i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM twice) GROUP BY doc_id),
c AS (SELECT doc_id, lang, source, len(ws) AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
       len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
s AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS word_length, CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS symbol_share,
       CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_share, CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS repeat_share FROM c),
m AS (SELECT doc_id, n_words >= {qr.LEAST_WORDS} AS sketched, lang, source, unnest([{names}]) AS measure, unnest([{values}]::DOUBLE[]) AS v FROM s),
b AS (SELECT lang, source, measure, CASE WHEN v < {qr.LEAST!r}::DOUBLE THEN -1000000 ELSE CAST(ceil(ln(v) / {log_gamma}::DOUBLE) AS INTEGER) END AS bucket, count(*) AS n FROM m WHERE sketched GROUP BY ALL),
l AS (SELECT 0 AS level, * FROM b UNION ALL SELECT 1, lang, NULL, measure, bucket, sum(n) FROM b GROUP BY ALL UNION ALL SELECT 2, NULL, NULL, measure, bucket, sum(n) FROM b GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total,
       CASE WHEN bucket = -1000000 THEN 0 ELSE 2 * pow({gamma}::DOUBLE, bucket) / ({gamma}::DOUBLE + 1) END AS v FROM l),
q AS (SELECT level, lang, source, measure, min(v) FILTER (WHERE upto >= total * 0.25) * (1 - {qr.ACCURACY}) AS q1, min(v) FILTER (WHERE upto >= total * 0.75) * (1 + {qr.ACCURACY}) AS q3, min(v) FILTER (WHERE upto >= total * 0.9) AS q90, min(v) FILTER (WHERE upto >= total * 0.99) AS q99, max(total) AS total FROM k GROUP BY ALL),
f AS (SELECT level, lang, source, measure, CASE measure WHEN 'n_words' THEN q1 / pow(q3 / q1, {qr.WIDTHS["n_words"]}) WHEN 'word_length' THEN q1 - {qr.WIDTHS["word_length"]} * (q3 - q1) END AS low,
       CASE WHEN measure = 'n_words' THEN q3 * pow(q3 / q1, {qr.WIDTHS["n_words"]}) WHEN measure = 'word_length' THEN q3 + {qr.WIDTHS["word_length"]} * (q3 - q1) WHEN q99 > q90 THEN (q90 + {qr.TAIL} * (q99 - q90)) * (1 + {qr.ACCURACY}) END AS high FROM q WHERE total >= {qr.ENOUGH} OR level = 2),
best AS (SELECT x.doc_id, x.measure, x.v, arg_min(f.low, f.level) AS low, arg_min(f.high, f.level) AS high FROM m x JOIN f ON f.measure = x.measure AND f.high IS NOT NULL AND (f.level = 2 OR (f.lang IS NOT DISTINCT FROM x.lang AND (f.level = 1 OR f.source IS NOT DISTINCT FROM x.source))) GROUP BY ALL),
inside AS (SELECT doc_id, bool_and(v >= coalesce(low, v) AND v <= high) AS ok FROM best GROUP BY doc_id),
r AS (SELECT *, n_words < {qr.LEAST_WORDS} OR 100 * n_repeat_words > {qr.MOST_REPEATED} * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, true) AS kept FROM r LEFT JOIN inside USING (doc_id)"""


PARITY_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(t="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS x FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, b AS r FROM edge UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON reach.r = edge.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce((SELECT min(r) FROM reach WHERE reach.doc_id = w.doc_id), doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id)"""

#: Bytes as pairs of hexadecimal digits; windows of 100 bytes are 200 digits.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, i, hash(substr(h, 2 * i - 1, 200)) AS k, md5_number(substr(h, 2 * i - 1, 200)) AS k2 FROM d, unnest(range(1, length(h) // 2 - 98)) r(i)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k, k2 ORDER BY doc_id, i) AS n FROM x) WHERE n > 1),
edges AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + 100 AS new FROM late),
runs AS (SELECT doc_id, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM edges),
spans AS (SELECT doc_id, g, min(i) AS a, max(i) + 99 AS b FROM runs GROUP BY ALL),
cuts AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends, sum(b - a + 1) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
kept AS (SELECT d.doc_id, h, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN starts IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(starts) + 1), lambda k: substr(h, 2 * CASE WHEN k = 0 THEN 0 ELSE ends[k] END + 1, 2 * (CASE WHEN k = len(starts) THEN length(h) // 2 ELSE starts[k + 1] - 1 END - CASE WHEN k = 0 THEN 0 ELSE ends[k] END))), '') END AS rest
  FROM d LEFT JOIN cuts USING (doc_id))
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept"""

FILL_IN_MIDDLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '{SPACE}*{WORD}+|{SPACE}+') AS us, [CAST('0x' || substr(h, k, 8) AS BIGINT) FOR k IN [1, 9, 17, 25]] AS r FROM d),
c AS (SELECT *, len(us) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b FROM c),
x AS (SELECT *, array_to_string(us[1:a], '') AS prefix, array_to_string(us[a + 1:b], '') AS middle, array_to_string(us[b + 1:], '') AS suffix FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM x"""

#: A conversation's path is the list of its rebuilt turns so far; a node is a path. CRC-32 bit by bit, least bit of a byte first.
PREFIX_TRIE = """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT c, list_transform(range(0, 8 * length(CAST(c AS VARCHAR))), lambda j: CAST((ascii(substr(CAST(c AS VARCHAR), CAST(j // 8 + 1 AS BIGINT), 1)) >> CAST(j % 8 AS INTEGER)) & 1 AS BIGINT)) AS b FROM (SELECT DISTINCT c FROM t)),
h AS (SELECT c, c - c % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295::BIGINT) % 6 AS h FROM bits),
k AS (SELECT h.c, h.h, count(t.i) AS k FROM h LEFT JOIN t ON t.c = h.base AND t.i <= h.h GROUP BY ALL),
turns AS (SELECT h.c, t.i AS d, role, text FROM h JOIN t ON t.c = h.base AND t.i <= h.h UNION ALL SELECT t.c, k.k + t.i - k.h, role, text FROM t JOIN k ON t.c = k.c AND t.i > k.h),
rows AS (SELECT c, 0 AS d, []::VARCHAR[] AS path, 0 AS chars FROM h UNION ALL SELECT c, d, list(length(role) || ':' || role || text) OVER (PARTITION BY c ORDER BY d), length(text) FROM turns),
nodes AS (SELECT d, path, min(c) AS m, count(*) AS n, max(chars) AS chars FROM rows GROUP BY d, path),
spot AS (SELECT c, d, m FROM rows JOIN nodes USING (d, path)),
lasts AS (SELECT c, max(d) AS d FROM spot GROUP BY c),
ends AS (SELECT spot.m, spot.d, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS sha FROM spot JOIN lasts USING (c, d) GROUP BY ALL),
up AS (SELECT nodes.m, nodes.d, p.m AS pm FROM nodes LEFT JOIN spot p ON p.c = nodes.m AND p.d = nodes.d - 1),
kids AS (SELECT pm AS m, d - 1 AS d, count(*) AS n FROM up WHERE d > 0 GROUP BY ALL),
below AS (SELECT a.m, a.d, sum((nodes.n - 1) * nodes.chars) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves FROM nodes LEFT JOIN kids USING (m, d) JOIN spot a ON a.c = nodes.m AND a.d <= nodes.d GROUP BY ALL)
SELECT m AS conv_id, CAST(d AS BIGINT) AS depth, pm AS parent_conv_id, nodes.n AS n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM nodes JOIN up USING (m, d) JOIN below USING (m, d) LEFT JOIN kids USING (m, d) LEFT JOIN ends USING (m, d)"""

SQL = {"op12_prefix_trie": PREFIX_TRIE, "op11_fill_in_middle": FILL_IN_MIDDLE, "op2_url_filter": URL_FILTER, "op4_suffix_dedup": SUFFIX_DEDUP, "op7_quality_rules": _quality(), "op9_parity_join": PARITY_JOIN}
