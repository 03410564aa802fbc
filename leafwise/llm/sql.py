"""SQL counterparts of the operators' queries, for DuckDB over the same tables.

Each states what its query returns, not how: windows are compared pair by pair.
Packing, permutations, language profiles and lattice likelihoods have none.
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
_WORDS = r"[^\x20\x09-\x0D]+"

URL_FILTERS = rf"""
    WITH parts AS (
      SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
                           THEN substr(url, strpos(url, '://') + 3) END AS rest
      FROM pages),
    named AS (
      SELECT page_id,
             coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_UPPER.lower()}'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
      FROM parts),
    fits AS (
      SELECT *, CASE
          WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
          WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
          WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
          WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
          WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
        END AS rule
      FROM named)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/')
                THEN 'block' ELSE 'allow' END AS verdict
    FROM fits"""

NEAR_DEDUP = rf"""
    WITH RECURSIVE texts AS (
      SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
    places AS (
      SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM texts),
    sets AS (
      SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM places),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    shared AS (
      SELECT a.doc_id AS one, b.doc_id AS two, count(*) AS common
      FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
      GROUP BY ALL),
    links AS (
      SELECT one, two FROM shared
      JOIN sizes a ON a.doc_id = one JOIN sizes b ON b.doc_id = two
      WHERE 100 * common >= 85 * (a.n + b.n - common)),
    either AS (SELECT one, two FROM links UNION ALL SELECT two, one FROM links),
    reached AS (
      SELECT doc_id, doc_id AS other FROM documents
      UNION
      SELECT r.doc_id, e.two FROM reached r JOIN either e ON e.one = r.other),
    least_of AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM documents d JOIN least_of USING (doc_id) LEFT JOIN sizes USING (doc_id)"""

SUBSTRING_DEDUP = rf"""
    WITH texts AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
    places AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM texts),
    windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM places),
    firsts AS (SELECT s, min(doc_id) AS least_id FROM windows GROUP BY s),
    removed AS (
      SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i
      FROM windows JOIN firsts USING (s) WHERE least_id < doc_id),
    words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts),
    kept AS (
      SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
      FROM words ANTI JOIN removed USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed,
           sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM texts LEFT JOIN kept USING (doc_id)"""

DECONTAMINATION = rf"""
    WITH texts AS (
      SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    items AS (
      SELECT CAST(item_id AS VARCHAR) AS item,
             regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    item_places AS (
      SELECT item, w, least(len(w), 13) AS k, unnest(range(1, greatest(len(w) - 12, least(len(w), 1)) + 1)) AS i
      FROM items),
    item_windows AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM item_places),
    places AS (
      SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i
      FROM texts CROSS JOIN (SELECT DISTINCT k FROM item_windows) WHERE len(w) >= k),
    found AS (
      SELECT doc_id, i, p.k, item
      FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM places) p
      JOIN item_windows q ON p.k = q.k AND p.s = q.s),
    hit AS (
      SELECT doc_id, count(DISTINCT place) AS n
      FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM found) GROUP BY doc_id),
    named AS (
      SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
      FROM (SELECT DISTINCT doc_id, item FROM found WHERE item IS NOT NULL) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
           sha256(coalesce(names, '')) AS items_sha256,
           coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
    FROM texts LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches(kind: int, pattern: str, group: int) -> str:
    """Rows of all matches with what stands before each, of which sums give the places."""
    return rf"""
      SELECT rid, {kind} AS kind, unnest(regexp_extract_all(t, '{pattern}')) AS m,
             unnest(regexp_extract_all(t, '{pattern}', {group})) AS own,
             unnest(string_split_regex(t, '{pattern}')) AS b,
             unnest(range(len(regexp_extract_all(t, '{pattern}')) + 1)) AS nth
      FROM texts"""


#: A value of more owners than this, or of more repositories, is copied; see ``secrets``.
SECRET_SCANS = rf"""
    WITH texts AS (
      SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
    matches AS ({_matches(0, _ASSIGN, 1)} UNION ALL {_matches(1, 'AKIA[A-Z0-9]+', 0)}
      UNION ALL {_matches(2, '[0-9a-f]+', 0)} UNION ALL {_matches(3, '[A-Za-z0-9+/_-]+', 0)}),
    placed AS (
      SELECT rid, kind, m, own,
             sum(length(b) + coalesce(length(m), 0)) OVER (PARTITION BY rid, kind ORDER BY nth) - coalesce(length(m), 0) AS a
      FROM matches),
    spans AS (
      SELECT rid, kind, a::BIGINT AS a, (a + length(m))::BIGINT AS z, CASE kind WHEN 0 THEN own ELSE m END AS value FROM placed
      WHERE CASE kind WHEN 0 THEN length(own) >= 6 WHEN 1 THEN length(m) >= 20 WHEN 2 THEN length(m) >= 24
            ELSE length(m) >= 20 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') END),
    base AS (SELECT * FROM spans WHERE kind < 3),
    counted AS (
      SELECT * FROM base UNION ALL
      SELECT * FROM spans s
      WHERE kind = 3 AND NOT EXISTS (FROM base b WHERE b.rid = s.rid AND b.a < s.z AND s.a < b.z)),
    holders AS (SELECT DISTINCT value, owner, doc_id FROM counted JOIN texts USING (rid)),
    owned AS (SELECT value, count(DISTINCT owner) AS owners, count(*) AS repositories FROM holders GROUP BY value),
    judged AS (SELECT counted.*, owners <= 1 AND repositories <= 10 AS live FROM counted JOIN owned USING (value)),
    named AS (SELECT *, concat_ws(':', ['assign', 'access', 'hex', 'live'][kind + 1], a, z) AS shown FROM judged),
    joined AS (
      SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
             count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3 AND live) AS n_live,
             count(*) FILTER (kind = 3 AND NOT live) AS n_copied,
             count(*) FILTER (kind < 3 AND live) AS n_base_live, count(*) FILTER (kind < 3 AND NOT live) AS n_base_copied,
             string_agg(shown, ',' ORDER BY a, kind, z) FILTER (kind < 3) AS base,
             string_agg(shown, ',' ORDER BY a, kind, z) FILTER (kind < 3 OR live) AS spans,
             string_agg(concat(shown, CASE WHEN live THEN ':live' ELSE ':copied' END), ',' ORDER BY a, kind, z) FILTER (kind < 3) AS classes
      FROM named GROUP BY rid)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
           coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
           coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(classes, '') AS base_classes,
           coalesce(n_base_live, 0) AS n_base_live, coalesce(n_base_copied, 0) AS n_base_copied
    FROM texts LEFT JOIN joined USING (rid)"""

QUALITY_RULES = rf"""
    WITH texts AS (
      SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
    lines AS (
      SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts)
      WHERE regexp_matches(line, '{_WORDS}') GROUP BY doc_id),
    places AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM texts),
    windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM places),
    twice AS (SELECT * FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
    covered AS (
      SELECT doc_id, count(DISTINCT place) AS n_repeat
      FROM (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM twice) GROUP BY doc_id),
    pairs AS (
      SELECT a.doc_id, a.i, b.i - a.i AS apart FROM twice a
      JOIN twice b ON a.doc_id = b.doc_id AND a.s = b.s AND a.i < b.i),
    runs AS (
      SELECT doc_id, apart, i - row_number() OVER (PARTITION BY doc_id, apart ORDER BY i) AS run FROM pairs),
    longest AS (
      SELECT doc_id, max(n) + 7 AS longest
      FROM (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id, apart, run) GROUP BY doc_id),
    counted AS (
      SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
             coalesce(longest, 0) AS longest_repeat
      FROM texts LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN longest USING (doc_id))
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
           n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words AND longest_repeat <= 200 AS kept
    FROM counted"""


def _encoded(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value} END"


def _leaf(text: str) -> str:
    return f"sha256(concat({', '.join(_encoded(v) for v in ('doc_id', 'source', 'lang', 'n_chars', text))}))"


#: The unsigned CRC-32 of the decimal id, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], [ascii(c)::UBIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
         lambda crc, c: list_reduce(list_concat([xor(crc, c)], [0::UBIGINT FOR bit IN range(8)]),
         lambda x, zero: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))), 4294967295::UBIGINT)"""


def _tree(name: str, leaves: str) -> str:
    """Nodes ``tree, level, pos, digest, n`` (nodes of the level) over ``leaves``."""
    return f"""
    {name} AS (
      SELECT tree, 0 AS level, pos, digest, n FROM {leaves}
      UNION ALL
      SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 2) // 3)
      FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 3)"""


def _way_up(name: str, begin: str, nodes: str) -> str:
    """From each row of ``begin`` up to the root, with its digest in place of the stored one."""
    return f"""
    {name} AS (
      SELECT rid, tree, 0 AS level, pos, digest, n FROM {begin}
      UNION ALL
      SELECT rid, f.tree, f.level + 1, f.pos // 3,
             sha256(string_agg(CASE WHEN x.pos = f.pos THEN f.digest ELSE x.digest END, '' ORDER BY x.pos)), any_value((f.n + 2) // 3)
      FROM {name} f JOIN {nodes} x ON x.tree = f.tree AND x.level = f.level AND x.pos // 3 = f.pos // 3
      WHERE f.n > 1 GROUP BY rid, f.tree, f.level, f.pos)"""


MANIFEST = f"""
    WITH RECURSIVE rows AS (
      SELECT *, row_number() OVER () AS rid, {_encoded('source')} AS tree, {_leaf('text')} AS digest,
             CASE WHEN {_CRC} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS shown
      FROM documents),
    leaves AS MATERIALIZED (
      SELECT rid, doc_id, source, tree, digest, shown, count(*) OVER (PARTITION BY tree) AS n,
             row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest, rid) - 1 AS pos
      FROM rows), {_tree('nodes', 'leaves')},
    ranks AS (
      SELECT tree, count(*) OVER () AS n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos
      FROM (SELECT DISTINCT tree, source FROM leaves)),
    tops AS MATERIALIZED (
      SELECT '' AS tree, r.tree AS own, pos, r.n, digest
      FROM ranks r JOIN (SELECT tree, digest FROM nodes WHERE n = 1) USING (tree)), {_tree('top_nodes', 'tops')},
    begins AS MATERIALIZED (SELECT rid, tree, pos, n, shown AS digest FROM leaves), {_way_up('inside', 'begins', 'nodes')},
    reached AS MATERIALIZED (
      SELECT rid, t.tree, t.pos, t.n, i.digest FROM inside i JOIN tops t ON t.own = i.tree WHERE i.n = 1),
    {_way_up('above', 'reached', 'top_nodes')},
    steps AS (
      SELECT i.rid, 0 AS part, x.level, x.pos, x.digest FROM inside i
      JOIN nodes x ON x.tree = i.tree AND x.level = i.level AND x.pos // 3 = i.pos // 3 AND x.pos <> i.pos
      UNION ALL
      SELECT i.rid, 1, x.level, x.pos, x.digest FROM above i
      JOIN top_nodes x ON x.level = i.level AND x.pos // 3 = i.pos // 3 AND x.pos <> i.pos),
    proofs AS (SELECT rid, string_agg(digest, '' ORDER BY part, level, pos) AS proof FROM steps GROUP BY rid),
    roots AS (SELECT digest AS root FROM top_nodes WHERE n = 1)
    SELECT doc_id, l.digest AS leaf, t.digest AS subroot, root, sha256(coalesce(proof, '')) AS proof_sha256,
           a.digest AS folded_root, a.digest = root AS verified
    FROM leaves l JOIN tops t ON t.own = l.tree JOIN above a ON a.rid = l.rid AND a.n = 1 CROSS JOIN roots
    LEFT JOIN proofs p ON p.rid = l.rid"""
