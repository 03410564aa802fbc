"""SQL counterparts of the registered queries, restating the definitions for DuckDB.

The queries share building blocks, each a common table expression named after what
it holds.
"""

from workload import inputs

# Fixed values, stated here too so that the comparison does not rest on the library.
BACKGROUND_KEYWORDS = ("background", "introduction", "overview")
SCOPE_KEYWORDS = ("scope", "scope of work", "objectives")

WS = r"\x09-\x0D\x1C-\x20\x85\p{Z}"
WORD = r"\p{L}\p{M}\p{N}_"
TOKEN = rf"[{WORD}]+(?:[''’.][{WORD}]+)*"
FIELDS = ("title", "headings", "background", "scope", "content")


def strip(x):
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def tokens(x):
    return f"regexp_extract_all(lower({x}), '{TOKEN}')"


def duck(sql):
    return sql.replace("array(", "list_value(").replace("`", '"')


def found_at(keyword):
    prefix = rf"(?s)^((?:.*?[^\p{{L}}\p{{N}}_])?){keyword}(?:[^\p{{L}}\p{{N}}_]|$)"
    return (
        f"CASE WHEN contains(low, '{keyword}') AND regexp_matches(low, '{prefix}') "
        f"THEN length(regexp_extract(low, '{prefix}', 1)) END"
    )


def section(name, keywords):
    """CTEs that end in ``name(id, value)``: the section of each text in ``lowered``."""
    nxt = rf"(?s)^(.*?)\n[A-Z\p{{Nd}}][A-Z{WS}]{{5,}}\n"
    start = ", ".join(found_at(k) for k in keywords)
    return f"""
{name}_rest AS (
  SELECT id, substr(text, (coalesce({start}) + 1)::BIGINT) AS rest FROM lowered
), {name}_cut AS (
  SELECT id, rest, regexp_matches(substr(rest, 101), '{nxt}') AS ends,
         length(regexp_extract(substr(rest, 101), '{nxt}', 1)) AS more FROM {name}_rest
), {name} AS (
  SELECT id, {strip("substr(rest, 1, CASE WHEN ends THEN 100 + more ELSE length(rest) END)")} AS value
  FROM {name}_cut
)"""


EXTENSION = r"lower(regexp_extract(file_path, '[^./]\.*(\.[^./]*)$', 1))"

CLASSIFIED = f"""
reports AS ({inputs.REPORTS}),
classified AS (
  SELECT *, CASE {EXTENSION} WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' WHEN '.doc' THEN 'docx'
                 WHEN '.txt' THEN 'txt' END AS file_type FROM reports
)"""


def parsing(source, name="docs"):
    """CTEs from ``source(id, file_path, file_type, text)`` to ``name``."""
    heading = (
        r"(regexp_matches(l, '\p{Lu}') AND NOT regexp_matches(l, '[\p{Ll}\p{Lt}ªº]') "
        r"AND length(l) > 3 AND length(l) < 100) "
        rf"OR regexp_matches(l, '^\p{{Nd}}+\.(\p{{Nd}}+\.)*[{WS}]+[A-Z]')"
    )
    return f"""
usable AS MATERIALIZED (SELECT * FROM {source} WHERE file_type IS NOT NULL AND length(text) > 0),
lowered AS MATERIALIZED (SELECT id, text, lower(text) AS low FROM usable),
{section("background_of", BACKGROUND_KEYWORDS)},
{section("scope_of", SCOPE_KEYWORDS)},
lines AS MATERIALIZED (
  SELECT id, [l FOR l IN [{strip("r")} FOR r IN string_split(text, chr(10))] IF {heading}] AS headings
  FROM usable
), {name} AS MATERIALIZED (
  SELECT u.id, coalesce(headings[1], regexp_extract(file_path, '[^/]*$')) AS title, file_path, file_type,
         headings, b.value AS background, s.value AS scope, text AS content
  FROM usable u JOIN lines USING (id) JOIN background_of b USING (id) JOIN scope_of s USING (id)
)"""


DOCS = f"{CLASSIFIED}, {parsing('classified')}"

PARTS = """
parts AS (
  SELECT conv_id::VARCHAR AS file_path, CASE WHEN conv_id % 2 = 0 THEN 'pdf' ELSE 'docx' END AS file_type,
         CASE WHEN conv_id % 2 = 0 THEN string_agg(coalesce(text, ''), '' ORDER BY turn)
              ELSE string_agg(coalesce(text, ''), chr(10) ORDER BY turn) END AS text
  FROM conversations GROUP BY conv_id
)"""

EMBEDDED = (
    "concat(coalesce(title, ''), ' ', coalesce(background, ''), ' ', coalesce(scope, ''), ' ', "
    "coalesce(content, ''))"
)


def encoded(x):
    """The hash encoder applied to a text column."""
    counts = (
        f"[len([b FOR b IN bs IF b = k])::DOUBLE FOR k IN range(64)] "
        f"FOR bs IN [[('0x' || substr(md5(t), 1, 8))::BIGINT % 64 FOR t IN {tokens(x)}]]"
    )
    unit = "[CASE WHEN norm > 0 THEN n / norm ELSE 0 END::FLOAT::DOUBLE FOR n IN ns]"
    return (
        f"[{unit} FOR p IN [struct_pack(ns := c, norm := sqrt(list_sum([n * n FOR n IN c]))) "
        f"FOR c IN [{counts}]]][1]"
    ).replace("FOR n IN ns", "FOR n IN p.ns").replace("norm > 0", "p.norm > 0").replace("n / norm", "n / p.norm")


FIELD_TEXTS = " UNION ALL ".join(
    f"SELECT '{f}' AS field, id AS doc_id, "
    + (f"array_to_string({f}, chr(10))" if f == "headings" else f)
    + " AS value FROM docs"
    for f in FIELDS
)

POSTINGS = f"""
field_tokens AS (
  SELECT field, doc_id, {tokens("value")} AS ts FROM ({FIELD_TEXTS}) WHERE value IS NOT NULL
), postings AS MATERIALIZED (
  SELECT field, term, doc_id, count(*) AS tf, any_value(dl) AS dl
  FROM (SELECT field, doc_id, len(ts)::BIGINT AS dl, unnest(ts) AS term FROM field_tokens)
  GROUP BY ALL
), term_stats AS MATERIALIZED (SELECT field, term, count(*) AS df FROM postings GROUP BY ALL),
field_stats AS MATERIALIZED (
  SELECT field, count(*) AS n_docs, avg(dl) AS avgdl
  FROM (SELECT DISTINCT field, doc_id, dl FROM postings) GROUP BY ALL
)"""
POSTINGS = POSTINGS.replace("term, doc_id, count(*) AS tf, any_value(dl) AS dl", "term, doc_id, count(*) AS tf, dl")

PLACES = """
places AS MATERIALIZED (
  SELECT field, doc_id, unnest(ts) AS term, unnest(range(len(ts))) AS place FROM field_tokens
)"""

ALL_FIELDS = "list_value(" + ", ".join(f"'{f}'" for f in FIELDS) + ")"
PLAIN_QUERIES = (
    f"SELECT query_id, query, '' AS keyword, {ALL_FIELDS} AS search_fields, 1 AS page, 20 AS page_size, "
    f'20 AS "limit" FROM ({inputs.QUERIES})'
)
SUMMARY_QUERIES = PLAIN_QUERIES.replace('20 AS "limit"', '5 AS "limit"')
PAGED_QUERIES = duck(inputs.PAGED_QUERIES)


def asked(queries):
    return f"""
queries AS MATERIALIZED (
  SELECT *, CASE WHEN length(keyword) > 0 THEN keyword ELSE query END AS search_term,
         least(page_size, "limit") AS page_rows
  FROM ({queries})
), spoken AS (SELECT * FROM queries WHERE length({strip("search_term")}) > 0),
blank AS (SELECT * FROM queries WHERE length({strip("search_term")}) = 0),
query_terms AS MATERIALIZED (
  SELECT query_id, field, term, count(*) AS mult
  FROM (SELECT query_id, unnest(search_fields) AS field, ts
        FROM (SELECT query_id, search_fields, {tokens("search_term")} AS ts FROM spoken)),
       LATERAL (SELECT unnest(ts) AS term)
  GROUP BY ALL
)"""


# DuckDB's edit distances count bytes, so every non-ASCII character is first replaced
# by an ASCII one that no token holds. Unrestricted Damerau distance is never larger
# than the distance wanted, hence a safe first filter; the swaps are then tried out.
FUZZY = """
characters AS (
  SELECT c, row_number() OVER (ORDER BY c) AS n
  FROM (SELECT DISTINCT unnest(regexp_extract_all(term, '[^\\x00-\\x7F]')) AS c
        FROM (SELECT term FROM term_stats UNION ALL SELECT term FROM query_terms))
), coding AS (
  SELECT coalesce(string_agg(c, '' ORDER BY n), '') AS plain,
         coalesce(string_agg(chr(CASE WHEN n <= 26 THEN 64 + n ELSE n - 26 END::INTEGER), '' ORDER BY n), '') AS code
  FROM characters
), q_words AS MATERIALIZED (
  SELECT term, w, length(w) AS n, CASE WHEN length(w) < 3 THEN 0 WHEN length(w) < 6 THEN 1 ELSE 2 END AS k
  FROM (SELECT DISTINCT term, translate(term, plain, code) AS w FROM query_terms, coding)
), v_words AS MATERIALIZED (
  SELECT DISTINCT term AS expansion, translate(term, plain, code) AS v FROM term_stats, coding
), near AS MATERIALIZED (
  SELECT term, expansion, w, v, n, k FROM q_words JOIN v_words
  ON abs(n - length(v)) <= k AND damerau_levenshtein(w, v) <= k
), tried AS (
  SELECT *, [concat(substr(w, 1, i - 1), substr(w, i + 1, 1), substr(w, i, 1), substr(w, i + 2))
             FOR i IN range(1, n)] AS one,
         flatten([[concat(substr(w, 1, i - 1), substr(w, i + 1, 1), substr(w, i, 1), substr(w, i + 2, j - i - 2),
                          substr(w, j + 1, 1), substr(w, j, 1), substr(w, j + 2))
                   FOR j IN range(i + 2, n)] FOR i IN range(1, n)]) AS two
  FROM near
), distances AS (
  SELECT term, expansion, k, least(length(w), length(v)) AS shorter,
         least(levenshtein(w, v), 1 + coalesce(list_min([levenshtein(x, v) FOR x IN one]), 99),
               CASE WHEN list_contains(two, v) THEN 2 ELSE 99 END) AS d
  FROM tried
), expanded AS (
  SELECT q.field, q.term, t.term AS expansion, 1 - d::DOUBLE / shorter AS weight, df
  FROM (SELECT DISTINCT field, term FROM query_terms) q
  JOIN distances x ON x.term = q.term AND d <= k
  JOIN term_stats t ON t.field = q.field AND t.term = x.expansion
  WHERE d < shorter
), expansions AS MATERIALIZED (
  SELECT query_id, field, term, mult, expansion, weight, df
  FROM expanded JOIN query_terms USING (field, term)
)"""

EXACT = """
expansions AS MATERIALIZED (
  SELECT query_id, field, term, mult, term AS expansion, 1.0::DOUBLE AS weight, df
  FROM query_terms JOIN term_stats USING (field, term)
)"""

SCORES = """
matched AS (
  SELECT query_id, e.field, e.term, mult, doc_id, weight, tf, dl,
         max(df) OVER (PARTITION BY query_id, e.field, e.term) AS unused, df
  FROM expansions e JOIN postings p ON p.field = e.field AND p.term = e.expansion
), frequency AS (
  SELECT query_id, field, term, max(df) AS df_max FROM expansions GROUP BY ALL
), contributions AS (
  SELECT query_id, field, term, doc_id, mult,
         max(weight * ln(1 + (n_docs - df_max + 0.5::DOUBLE) / (df_max + 0.5::DOUBLE))
             * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS best
  FROM matched JOIN frequency USING (query_id, field, term) JOIN field_stats USING (field)
  GROUP BY ALL
), bm25 AS MATERIALIZED (
  SELECT query_id, field, doc_id, sum(mult * best) AS score FROM contributions GROUP BY ALL
), keyword_hits AS MATERIALIZED (
  SELECT query_id, doc_id, max(score) AS score FROM bm25 GROUP BY ALL
)"""
SCORES = SCORES.replace(
    ",\n         max(df) OVER (PARTITION BY query_id, e.field, e.term) AS unused, df", ""
)

HITS = f"""
doc_vectors AS MATERIALIZED (SELECT id, {encoded("t")} AS v FROM (SELECT id, {EMBEDDED} AS t FROM docs)),
query_vectors AS MATERIALIZED (SELECT query_id, {encoded("search_term")} AS q FROM spoken),
knn_all AS (
  SELECT query_id, id AS doc_id, 0.9::DOUBLE * (1 + list_cosine_similarity(v, q)) / 2 AS score
  FROM doc_vectors, query_vectors WHERE list_sum(v) > 0 AND list_sum(q) > 0
), knn_hits AS (
  SELECT * FROM knn_all
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) <= 10
), hits AS MATERIALIZED (
  SELECT query_id, doc_id, sum(score) AS score
  FROM (SELECT * FROM keyword_hits UNION ALL SELECT * FROM knn_hits) GROUP BY ALL
), all_hits AS MATERIALIZED (
  SELECT * FROM hits UNION ALL SELECT query_id, id, 1.0::DOUBLE FROM blank, docs
)"""


def paged(hits="all_hits"):
    return f"""
pages AS MATERIALIZED (
  SELECT query_id, rank::INTEGER AS rank, doc_id, score
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank
        FROM {hits}) JOIN queries USING (query_id)
  WHERE rank > (page - 1) * page_size AND rank <= (page - 1) * page_size + page_rows
), totals AS MATERIALIZED (
  SELECT q.query_id, count(doc_id) AS total FROM queries q LEFT JOIN {hits} h USING (query_id) GROUP BY ALL
)"""


# Fragments of the searched fields of every row on a page. Each is cut into tokens and
# single characters, and those that are expansions of the query are marked.
HIGHLIGHTS = f"""
field_values AS (
  SELECT query_id, doc_id, field, field_no,
         CASE field WHEN 'title' THEN title WHEN 'background' THEN background WHEN 'scope' THEN scope
              WHEN 'content' THEN content END AS value, headings
  FROM (SELECT query_id, doc_id, unnest(search_fields) AS field, unnest(range(len(search_fields))) AS field_no
        FROM pages JOIN queries USING (query_id)) p JOIN docs d ON d.id = p.doc_id
), fragments AS (
  SELECT query_id, doc_id, field, field_no, unnest(fs) AS fragment, unnest(range(len(fs))) AS fragment_no
  FROM (SELECT *, CASE WHEN field = 'headings' THEN headings
                       ELSE regexp_extract_all(value, '[^.!?\\n]+[.!?]*') END AS fs FROM field_values)
), pieces AS (
  SELECT * EXCLUDE (ps, fragment), unnest(ps) AS piece, unnest(range(len(ps))) AS piece_no
  FROM (SELECT *, regexp_extract_all(fragment, '(?s){TOKEN}|.') AS ps FROM fragments)
), marked AS (
  SELECT p.query_id, p.doc_id, p.field, field_no, fragment_no,
         string_agg(CASE WHEN x.expansion IS NULL THEN piece ELSE '<mark>' || piece || '</mark>' END, ''
                    ORDER BY piece_no) AS fragment,
         count(x.expansion) AS marks
  FROM pieces p LEFT JOIN (SELECT DISTINCT query_id, field, expansion FROM expansions) x
    ON x.query_id = p.query_id AND x.field = p.field AND x.expansion = lower(piece)
  GROUP BY p.query_id, p.doc_id, p.field, field_no, fragment_no
  HAVING count(x.expansion) > 0
), highlights AS MATERIALIZED (
  SELECT query_id, doc_id, field, field_no, no, fragment
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, field ORDER BY fragment_no) - 1 AS no
        FROM marked)
), shown AS (
  SELECT query_id, doc_id, min_by(fragment, (field_no, no)) AS first,
         string_agg(line, ' || ' ORDER BY field_no) AS highlights
  FROM (SELECT query_id, doc_id, field_no, min_by(fragment, (field_no, no)) AS fragment, min(no) AS no,
               field || ': ' || string_agg(fragment, ' | ' ORDER BY no) AS line
        FROM highlights GROUP BY query_id, doc_id, field, field_no)
  GROUP BY ALL
), results AS MATERIALIZED (
  SELECT query_id, rank, d.id, title,
         coalesce(substr(first, 1, 200), substr(nullif(background, ''), 1, 200),
                  substr(nullif(content, ''), 1, 200), '') AS snippet,
         file_path, coalesce(nullif(file_type, ''), 'pdf') AS file_type,
         '/documents/' || d.id || '/download' AS download_url, score,
         coalesce(highlights, '') AS highlights, total, page, page_size
  FROM pages JOIN queries USING (query_id) JOIN totals USING (query_id) JOIN docs d ON d.id = doc_id
  LEFT JOIN shown USING (query_id, doc_id)
)"""

CONTEXT = """
context AS MATERIALIZED (
  SELECT query_id, rank, coalesce(nullif(content, ''), coalesce(background, '') || ' ' || coalesce(scope, '')) AS text
  FROM pages JOIN docs ON id = doc_id WHERE rank <= 3
)"""


def sentences(x):
    pieces = rf"[{strip('r')} FOR r IN string_split(translate({x}, '!?', '..'), '.')]"
    return f"[l FOR l IN {pieces} IF length(l) > 20]"


POOL = f"""
pool AS MATERIALIZED (
  SELECT query_id, pos, sentence
  FROM (SELECT query_id, sentence, row_number() OVER (PARTITION BY query_id ORDER BY rank, no) AS pos
        FROM (SELECT query_id, rank, unnest(ss) AS sentence, unnest(range(len(ss))) AS no
              FROM (SELECT query_id, rank, {sentences("text")} AS ss FROM context)))
)"""

RANKED_SENTENCES = f"""
sentence_scores AS (
  SELECT query_id, pos, sentence,
         CASE WHEN list_sum(v) > 0 AND list_sum(q) > 0 THEN list_cosine_similarity(v, q) ELSE 0 END AS score
  FROM (SELECT query_id, pos, sentence, {encoded("sentence")} AS v FROM pool)
  JOIN (SELECT query_id, {encoded("query")} AS q FROM queries) USING (query_id)
), ranked_sentences AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, pos DESC)::INTEGER AS sentence_rank
  FROM sentence_scores QUALIFY sentence_rank <= 5
)"""

EXPORTS = f"exports AS ({inputs.EXPORTS}), fetched AS (SELECT ord, docs.* FROM exports e JOIN docs ON docs.id = e.doc_id)"


def with_(*parts):
    return "WITH " + ", ".join(p.strip() for p in parts)


def report(include_summary, chars=None):
    cut = lambda column: column if chars is None else f"substr({column}, 1, {chars})"
    extra = (
        """
  UNION ALL SELECT ord, 6, 'h2', 'AI Summary:' FROM fetched
  UNION ALL SELECT ord, 7, 'paragraph', '[Summary placeholder for future AI integration]' FROM fetched"""
        if include_summary
        else ""
    )
    return (
        with_(DOCS, EXPORTS)
        + f"""
SELECT ord, row_number() OVER (PARTITION BY ord ORDER BY place)::INTEGER AS block_no, kind, text FROM (
  SELECT ord, 1 AS place, 'h1' AS kind, coalesce(title, 'Untitled') AS text FROM fetched
  UNION ALL SELECT ord, 2, 'h2', 'Background:' FROM fetched WHERE length(background) > 0
  UNION ALL SELECT ord, 3, 'paragraph', {cut("background")} FROM fetched WHERE length(background) > 0
  UNION ALL SELECT ord, 4, 'h2', 'Scope:' FROM fetched WHERE length(scope) > 0
  UNION ALL SELECT ord, 5, 'paragraph', {cut("scope")} FROM fetched WHERE length(scope) > 0{extra}
  UNION ALL SELECT ord, 8, 'page_break', '' FROM fetched WHERE ord < (SELECT max(ord) FROM fetched)
)"""
    )


STATUS = (
    "SELECT file_path, CASE WHEN file_type IS NULL OR length(text) = 0 THEN 'skipped' ELSE 'success' END AS status "
    "FROM classified"
)
COUNTS = (
    "count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, "
    "count(*) FILTER (status = 'skipped') AS skipped"
)

INDEXED = f"{DOCS}, {POSTINGS}"
SEARCHED = f"{INDEXED}, {asked(PLAIN_QUERIES)}, {FUZZY}, {SCORES}"
HYBRID = f"{SEARCHED}, {HITS}"
PAGED = f"{INDEXED}, {asked(PAGED_QUERIES)}, {FUZZY}, {SCORES}, {HITS}, {paged()}"
SUMMARY = (
    f"{INDEXED}, {asked(SUMMARY_QUERIES)}, {FUZZY}, {SCORES}, {HITS}, {paged()}, {CONTEXT}, {POOL}"
)
NEIGHBOURS = """
SELECT a.vec_id AS query_id, b.vec_id AS doc_id,
       0.9::DOUBLE * (1 + list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / 2 AS score
FROM embeddings a, embeddings b"""


def _cells(rounds):
    """k-means over unit vectors, begun at the first vectors by MD5 of the id; a round is two tables."""
    nearest = """
  SELECT id, v, cell FROM points, {centres}
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_inner_product(v, c) - list_inner_product(c, c) / 2 DESC, cell) = 1"""
    parts = [
        """
units AS MATERIALIZED (
  SELECT vec_id AS id, [x / sqrt(list_inner_product(e, e)) FOR x IN e] AS v, md5(vec_id::VARCHAR) AS mark
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
)""",
        "points AS MATERIALIZED (SELECT id, v, row_number() OVER (ORDER BY mark) - 1 AS place FROM units)",
        "centres_0 AS MATERIALIZED (SELECT place AS cell, v AS c FROM points WHERE place < (SELECT round(sqrt(count(*))) FROM points))",
    ]
    for i in range(rounds):
        parts.append(f"assigned_{i} AS MATERIALIZED ({nearest.format(centres=f'centres_{i}')})")
        parts.append(f"""
centres_{i + 1} AS MATERIALIZED (
  SELECT o.cell, coalesce(n.c, o.c) AS c FROM centres_{i} o LEFT JOIN (
    SELECT cell, list(x ORDER BY d) AS c FROM (
      SELECT cell, d, avg(x) AS x FROM (
        SELECT cell, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM assigned_{i}) GROUP BY cell, d) GROUP BY cell) n USING (cell)
)""")
    parts.append(f"assigned AS ({nearest.format(centres=f'centres_{rounds}')})")
    return parts


RESULT_COLUMNS = (
    "query_id, rank, id, title, snippet, file_path, file_type, download_url, round(score, 6) AS score, "
    "highlights, total, page, page_size"
)

ORACLE = {
    "corpus": "SELECT source || '-' || doc_id AS id, '/corpus/' || source || '/' || source || '-' || doc_id || '.txt' "
    "AS file_path, text FROM documents",
    "file_types": with_(CLASSIFIED)
    + "SELECT id, file_path, file_type, file_type IS NOT NULL AS supported FROM classified",
    "assemble_parts": with_(PARTS) + "SELECT * FROM parts",
    "parts_documents": with_(
        PARTS,
        "files AS (SELECT 'talk-' || file_path AS id, 'talk-' || file_path || '.' || file_type AS file_path, "
        "file_type, text FROM parts)",
        parsing("files"),
    )
    + "SELECT id, title, file_type, array_to_string(headings, ' | ') AS headings, background, scope, content FROM docs",
    "latest_upsert": """
SELECT * EXCLUDE (n) FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY (event_type IS NOT DISTINCT FROM 'click'), ts DESC, event_id DESC) AS n FROM events)
WHERE n = 1""",
    "parse_status": with_(CLASSIFIED) + STATUS,
    "ingest_report": with_(CLASSIFIED) + f"SELECT {COUNTS} FROM ({STATUS})",
    "ingest_message": with_(CLASSIFIED)
    + f"""SELECT CASE WHEN success + failed + skipped > 0 THEN 'Indexed ' || success || ' documents'
ELSE 'No documents found' END AS message, success AS count FROM (SELECT {COUNTS} FROM ({STATUS}))""",
    "delete_where": "SELECT * FROM events WHERE NOT coalesce(value > 50, false)",
    "headings": with_(DOCS) + "SELECT id, unnest(headings) AS heading FROM docs",
    "sections": with_(DOCS) + "SELECT id, background, scope FROM docs",
    "parse_documents": with_(DOCS)
    + "SELECT * REPLACE (array_to_string(headings, ' | ') AS headings), NULL::VARCHAR AS category FROM docs",
    "parse_documents_cut": with_(DOCS)
    + "SELECT id, title, array_to_string(headings[1:20], ' | ') AS headings, substr(content, 1, 5000) AS content FROM docs",
    "document_table": with_(DOCS) + "SELECT id, file_type, title, content FROM docs WHERE file_type <> 'txt'",
    "embedding_text": with_(DOCS) + f"SELECT id, {EMBEDDED} AS text FROM docs",
    "document_ids": with_(CLASSIFIED)
    + r"SELECT file_path, regexp_replace(regexp_extract(file_path, '[^/]*$'), '^(.+)\.[^.]+$', '\1') AS id FROM reports",
    "stripped_lines": f"""
SELECT doc_id, line_no, {strip("line")} AS line FROM (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))""",
    "tokens": f"""
SELECT doc_id, unnest(range(len(ts))) AS pos, unnest(ts) AS token
FROM (SELECT doc_id, {tokens("text")} AS ts FROM documents)""",
    "sentences": f"""
SELECT doc_id, unnest(range(len(ss))) AS pos, unnest(ss) AS sentence
FROM (SELECT doc_id, {sentences("text")} AS ss FROM documents)""",
    "postings": with_(INDEXED) + "SELECT field, term, doc_id, tf, dl FROM postings",
    "positional_postings": with_(INDEXED, PLACES)
    + """SELECT field, term, doc_id, string_agg(gap, ' ' ORDER BY place) AS gaps FROM (
  SELECT *, (place - coalesce(lag(place) OVER (PARTITION BY field, doc_id, term ORDER BY place), -1))::VARCHAR AS gap FROM places)
GROUP BY field, term, doc_id""",
    "phrases": with_(INDEXED, PLACES)
    + f""", asked AS (
  SELECT DISTINCT array_to_string(w[i:i + 2], ' ') AS phrase
  FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT {tokens("query")} AS w FROM ({inputs.QUERIES})))
)
SELECT phrase, field, doc_id, string_agg(place, ' ' ORDER BY place) AS starts
FROM (SELECT field, doc_id, i - 1 AS place, array_to_string(ts[i:i + 2], ' ') AS phrase
      FROM (SELECT field, doc_id, ts, unnest(range(1, len(ts) - 1)) AS i FROM field_tokens)) JOIN asked USING (phrase)
GROUP BY phrase, field, doc_id""",
    "term_stats": with_(INDEXED) + "SELECT field, term, df FROM term_stats",
    "term_stats_in_batches": with_(INDEXED) + "SELECT field, term, df FROM term_stats",
    "field_stats": with_(INDEXED) + "SELECT field, n_docs, round(avgdl, 6) AS avgdl FROM field_stats",
    "hash_embedding": with_(DOCS)
    + f"""SELECT id, unnest(range(64)) AS dim, unnest([round(x, 6) FOR x IN v]) AS value
FROM (SELECT id, {encoded("t")} AS v FROM (SELECT id, {EMBEDDED} AS t FROM docs))""",
    "query_terms": with_(asked(PAGED_QUERIES)) + "SELECT query_id, field, term, mult FROM query_terms",
    "fuzzy_expand": with_(INDEXED, asked(PLAIN_QUERIES), FUZZY)
    + "SELECT query_id, field, term, mult, expansion, round(weight, 6) AS weight, df FROM expansions",
    "bm25": with_(SEARCHED) + "SELECT query_id, field, doc_id, round(score, 6) AS score FROM bm25",
    "bm25_exact": with_(INDEXED, asked(PLAIN_QUERIES), EXACT, SCORES)
    + "SELECT query_id, field, doc_id, round(score, 6) AS score FROM bm25",
    "best_fields": with_(SEARCHED) + "SELECT query_id, doc_id, round(score, 6) AS score FROM keyword_hits",
    "keyword_scores": with_(INDEXED, asked(PAGED_QUERIES), FUZZY, SCORES)
    + "SELECT query_id, doc_id, round(score, 6) AS score FROM keyword_hits",
    "match_all": with_(DOCS, asked(PAGED_QUERIES))
    + "SELECT query_id, id AS doc_id, 1.0::DOUBLE AS score FROM blank, docs",
    "cosine": """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "knn": f"""
SELECT query_id, doc_id, round(score, 6) AS score FROM ({NEIGHBOURS})
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) <= 10""",
    "ann_all_cells": f"""
SELECT query_id, doc_id, round(score, 6) AS score FROM ({NEIGHBOURS})
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) <= 10""",
    "vector_cells": with_(*_cells(8)) + "SELECT id AS vec_id, cell::INTEGER AS cell FROM assigned",
    "knn_pairs": f"""
SELECT query_id, doc_id, round(score, 6) AS score FROM ({NEIGHBOURS} WHERE a.vec_id = b.label)""",
    "hybrid": with_(HYBRID) + "SELECT query_id, doc_id, round(score, 6) AS score FROM hits",
    "ranked_page": with_(PAGED) + "SELECT query_id, rank, doc_id, round(score, 6) AS score FROM pages",
    "totals": with_(PAGED) + "SELECT query_id, total FROM totals",
    "keyword_page": with_(INDEXED, asked(PLAIN_QUERIES), EXACT, SCORES, paged("keyword_hits"))
    + "SELECT query_id, rank, doc_id, round(score, 6) AS score FROM pages",
    "search": with_(HYBRID, paged(), HIGHLIGHTS) + f"SELECT {RESULT_COLUMNS} FROM results",
    "search_paged": with_(PAGED, HIGHLIGHTS) + f"SELECT {RESULT_COLUMNS} FROM results",
    "highlights": with_(HYBRID, paged(), HIGHLIGHTS)
    + "SELECT query_id, doc_id AS id, field, no, fragment FROM highlights",
    "snippets": with_(PAGED, HIGHLIGHTS) + "SELECT query_id, id, snippet FROM results",
    "present": with_(PAGED, HIGHLIGHTS)
    + """SELECT query_id, rank, title, snippet, upper(file_type) AS type,
regexp_extract(file_path, '[^/]*$') AS file_name, printf('%.2f', score) AS relevance,
'Found ' || n || CASE WHEN n = 1 THEN ' document' ELSE ' documents' END AS found
FROM results JOIN (SELECT query_id, count(*) AS n FROM results GROUP BY ALL) USING (query_id)""",
    "context": with_(SUMMARY) + "SELECT query_id, rank, text FROM context",
    "pool": with_(SUMMARY) + "SELECT query_id, pos, sentence FROM pool",
    "sentence_rank": with_(SUMMARY, RANKED_SENTENCES)
    + "SELECT query_id, pos, sentence, round(score, 6) AS score, sentence_rank FROM ranked_sentences",
    "summary": with_(SUMMARY, RANKED_SENTENCES)
    + """SELECT query_id, query,
CASE WHEN query_id NOT IN (SELECT query_id FROM context) THEN 'No documents found to summarize.'
     WHEN lines IS NULL THEN 'Content is too short to summarize.'
     ELSE 'Based on the search results, here are the most relevant points:' || chr(10) || chr(10) || lines END AS summary
FROM queries LEFT JOIN (
  SELECT query_id, string_agg('- ' || sentence || '.' || chr(10), '' ORDER BY sentence_rank) AS lines
  FROM ranked_sentences GROUP BY ALL) USING (query_id)""",
    "fetch_by_ids": with_(DOCS, EXPORTS)
    + "SELECT ord, id, title, file_path, array_to_string(headings, ' | ') AS headings FROM fetched",
    "resolve_ids": with_(CLASSIFIED, f"requests AS ({inputs.REQUESTS})")
    + r""", names AS (
  SELECT file_path, regexp_extract(file_path, '[^/]*$') AS file_name,
         regexp_replace(regexp_extract(file_path, '[^/]*$'), '\.[^.]+$', '') AS stem FROM reports
), candidates AS (
  SELECT ord, r.doc_id, file_path, file_name,
         CASE WHEN file_name = r.doc_id || '.pdf' THEN 1 WHEN file_name = r.doc_id || '.docx' THEN 2
              WHEN file_name = r.doc_id THEN 3 ELSE 4 END AS match_rank
  FROM requests r, names
  WHERE file_name IN (r.doc_id || '.pdf', r.doc_id || '.docx', r.doc_id)
     OR (regexp_matches(file_name, '\.(pdf|docx)$') AND (contains(stem, r.doc_id) OR contains(r.doc_id, stem)))
), best AS (
  SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY ord ORDER BY match_rank, file_name) = 1
)
SELECT r.ord, r.doc_id, b.file_path, b.match_rank::INTEGER AS match_rank
FROM requests r LEFT JOIN best b USING (ord)""",
    "export_csv": with_(DOCS, EXPORTS)
    + """SELECT coalesce(title, '') AS Title, coalesce(file_path, '') AS "File Path",
coalesce(background, '') AS Background, coalesce(scope, '') AS Scope,
coalesce(array_to_string(headings, ' | '), '') AS Headings FROM fetched""",
    "export_csv_cut": with_(DOCS, EXPORTS)
    + """SELECT coalesce(title, '') AS Title, coalesce(file_path, '') AS "File Path",
substr(coalesce(background, ''), 1, 500) AS Background, substr(coalesce(scope, ''), 1, 500) AS Scope,
coalesce(array_to_string(headings[1:5], ' | '), '') AS Headings FROM fetched""",
    "export_report_cut": report(False, 1000),
    "export_report": report(False),
    "export_report_with_summary": report(True),
}
ORACLE = {name: sql.replace(")SELECT", ")\nSELECT") for name, sql in ORACLE.items()}
