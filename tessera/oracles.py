"""DuckDB SQL that the queries are held against."""

from __future__ import annotations

from tessera.functions import text as tx

CJK = r"[\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}\x{3400}-\x{4dbf}]"
EMOJI = r"[\x{1F300}-\x{1F9FF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{2300}-\x{23FF}\x{2190}-\x{21FF}\x{25A0}-\x{25FF}\x{2B00}-\x{2BFF}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def n(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def tokens(x: str) -> str:
    """The approximate token count of a text without fenced code."""
    prose = f"regexp_replace({x}, {q(tx.INLINE_CODE)}, '', 'g')"
    rest = f"regexp_replace({prose}, {q(tx.PATHS)}, '', 'g')"
    slashes = "(length(p) - length(replace(p, '/', '')))"
    marks, lines, cjk, emoji = n(rest, tx.PUNCTUATION), n(rest, r"\n"), n(x, CJK), n(x, EMOJI)
    inline = f"coalesce(list_sum(list_transform(regexp_extract_all({x}, {q(tx.INLINE_CODE)}), lambda p: 2 + (length(p) - 2) / 2.5)), 0)"
    paths = f"coalesce(list_sum(list_transform(regexp_extract_all({prose}, {q(tx.PATHS)}), lambda p: {slashes} + (length(p) - {slashes}) / 3.5)), 0)"
    return f"CAST(ceil((greatest(0, length({rest}) - {lines} - {cjk} - {emoji} - {marks})::DOUBLE / 3.5 + {lines} + {inline}::DOUBLE + {paths}::DOUBLE + {marks}::DOUBLE * 0.8::DOUBLE + {cjk}::DOUBLE * 1.2::DOUBLE + {emoji}::DOUBLE * 2.5::DOUBLE) * 1.1::DOUBLE) AS INTEGER)"


def words(x: str) -> str:
    t = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN {t} = '' THEN 0 ELSE len(regexp_split_to_array({t}, '\\s+')) END"


#: Sections of conv_md in closed form: turns have no markers and no blank lines.
SEC = f"""
t AS (SELECT conv_id, turn, role, text, len(string_split(text, chr(10))) AS n,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations),
u AS (SELECT *, coalesce(sum(n + 3) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t),
s0 AS (
  SELECT 'conv/' || conv_id || '.md' AS path, 0 AS ordinal, 'Conversation ' || conv_id AS heading, 1 AS level, CAST(NULL AS INTEGER) AS parent_ordinal, '1' AS number,
         1 AS start_line, 1 AS end_line, '# Conversation ' || conv_id AS content, '' AS plain_text FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT 'conv/' || conv_id || '.md', CAST(k AS INTEGER), role, 2, 0, '1.' || k, CAST(3 + before AS INTEGER), CAST(4 + before + n AS INTEGER), '## ' || role || chr(10) || chr(10) || text, text FROM u),
sec AS (SELECT *, substr(md5(path), 1, 12) || '-' || replace(lower(heading), ' ', '-') || '-L' || start_line AS section_id,
               {words('plain_text')} AS word_count, {tokens('content')} AS token_count FROM s0)"""
#: Sections of doc_plain: one each, headed by its first line.
PLAIN = f"""
p0 AS (SELECT source || '/' || doc_id || '.md' AS path, trim(string_split(text, chr(10))[1]) AS heading, regexp_replace(text, '\\s+$', '') AS content FROM documents),
plain AS (SELECT path, heading, content, 1 AS start_line, path AS section_id FROM p0)"""
#: BM25 over conv_md.
BM25 = f"""{SEC},
elig AS (SELECT section_id, list_filter(regexp_split_to_array(lower(heading), '\\W+'), lambda x: length(x) > 2) AS h,
                list_filter(regexp_split_to_array(lower(content), '\\W+'), lambda x: length(x) > 2) AS c FROM sec WHERE token_count >= 10),
dls AS (SELECT section_id, h, c, len(h) + len(c) AS dl FROM elig),
post AS (SELECT term, section_id, dl, sum(w) AS tf FROM (
           SELECT unnest(h) AS term, section_id, dl, 2.0 AS w FROM dls UNION ALL SELECT unnest(c), section_id, dl, 1.0 FROM dls) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avg_dl FROM dls)"""


#: Sections of conv_md and doc_plain together; those of documents are named by their paths alone.
BOTH = f"""{SEC.replace("sec AS (SELECT *", "sec1 AS (SELECT *")}, {PLAIN},
sec AS (SELECT section_id, path, heading, content, token_count FROM sec1 UNION ALL SELECT substr(md5(path), 1, 12) || '-', path, heading, content, {tokens("content")} FROM plain)"""


def bm25(queries: list[tuple[int, str]], limit: int, documents: bool = False) -> str:
    """The best sections of each query; with ``documents``, of conv_md and doc_plain together."""
    if documents:
        return bm25(queries, limit).replace(SEC, BOTH)
    rows = ", ".join(f"({i}, {q(x)})" for i, x in queries)
    return f"""{BM25},
ask AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(query), '\\W+'), lambda x: length(x) > 2)) AS term FROM (VALUES {rows}) v(query_id, query)),
score AS (SELECT query_id, section_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl)))) AS score
          FROM ask JOIN post USING (term) JOIN dfs USING (term), st GROUP BY ALL),
bm AS (SELECT * FROM (SELECT query_id, section_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, section_id) AS rank FROM score) WHERE rank <= {limit})"""


def nearest(k: int, important: bool = False) -> str:
    """Exact neighbours of the vectors whose ids are divisible by 100, among all."""
    file = "CASE WHEN e.vec_id % 7 = 0 THEN '/README.md' ELSE '.md' END" if important else "'.md'"
    return f"""
v AS (SELECT e.vec_id AS section_id, d.source || '/' || d.doc_id || {file} AS path, trim(string_split(d.text, chr(10))[1]) AS heading, CAST(e.embedding AS DOUBLE[]) AS x FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id),
qv AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS y FROM embeddings WHERE vec_id % 100 = 0),
sim AS (SELECT query_id, section_id, path, heading, list_cosine_similarity(x, y) AS similarity FROM v, qv),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, section_id) AS rank FROM sim) WHERE rank <= {k})"""


def bm25_documents(queries: list[tuple[int, str]], limit: int) -> str:
    """bm25() over doc_plain, its sections named by the number of the document."""
    own = f"""{PLAIN},
sec AS (SELECT CAST(regexp_extract(path, '/(\\d+)\\.md$', 1) AS BIGINT) AS section_id, heading, content, {tokens("content")} AS token_count FROM plain)"""
    return bm25(queries, limit).replace(SEC, own)


def hashed_vectors(name: str, source: str, key: str, text: str) -> str:
    """Vectors of the hashing provider: (key, x), from the bytes of each word's MD5."""
    nibble = lambda k: f"(instr('0123456789abcdef', substr(md5(w), {k}, 1)) - 1)"
    return f"""
{name}_w AS (SELECT {key}, unnest(list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda x: x <> '')) AS w FROM {source}),
{name}_h AS (SELECT {key}, (16 * {nibble(1)} + {nibble(2)}) % 64 AS k, sum(CASE WHEN {nibble(15)} >= 8 THEN 1 ELSE -1 END) AS n FROM {name}_w GROUP BY ALL),
{name}_n AS (SELECT {key}, sqrt(CAST(sum(n * n) AS DOUBLE)) AS size FROM {name}_h GROUP BY {key}),
{name} AS (SELECT t.{key}, list(CAST(CAST(coalesce(CAST(n AS DOUBLE) / CASE WHEN size > 0 THEN size ELSE 1 END, 0) AS FLOAT) AS DOUBLE) ORDER BY r.k) AS x
 FROM {source} t CROSS JOIN (SELECT unnest(range(64)) AS k) r LEFT JOIN {name}_h h ON h.{key} = t.{key} AND h.k = r.k LEFT JOIN {name}_n m ON m.{key} = t.{key} GROUP BY t.{key})"""
