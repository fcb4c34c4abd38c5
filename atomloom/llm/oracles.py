"""DuckDB SQL for the queries of this subpackage."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(column: str) -> str:
    return f"translate({column}, '{UPPER}', '{LOWER}')"


def normal_words(column: str) -> str:
    return rf"regexp_extract_all({lowered(column)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE = {
    "op2_decontaminate": f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {normal_words("coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win, least(len(w), 10) AS n
       FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
d AS (SELECT doc_id, {normal_words("coalesce(text, '')")} AS w FROM documents),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM d, (SELECT DISTINCT n FROM bw) AS sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT doc_id, item, i, n FROM dw JOIN bw USING (win, n)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op5_minhash": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({lowered("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct([array_to_string(w[i:i + 1], ' ') for i in range(1, greatest(len(w), 2))]) AS s FROM d WHERE len(w) > 0),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM one AS a JOIN one AS b ON a.g = b.g AND a.doc_id < b.doc_id
          WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT documents.doc_id, CAST(coalesce(len(s), 0) AS BIGINT) AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents JOIN least USING (doc_id) LEFT JOIN sets USING (doc_id)
""",
    "op8_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
least AS (SELECT win, min(doc_id) AS first FROM win GROUP BY win),
gone AS (SELECT DISTINCT doc_id, p FROM win JOIN least USING (win), unnest(range(i, i + 13)) AS t(p) WHERE doc_id > first),
words AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p))
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(count(gone.p) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p
GROUP BY d.doc_id, w
""",
    "op9_line_dedup": f"""
WITH l AS (SELECT doc_id, i, lines[i] AS line, {lowered(f"trim(lines[i], {SPACE})")} AS k
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS t(i)),
common AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(common.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE common.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN common ON l.k = common.k GROUP BY doc_id
""",
}


def codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Product codes: each round's assignment and codebook as a table of its own."""
    steps = [
        f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT vec_id, label, p, x[p * len(x) // {parts} + 1:(p + 1) * len(x) // {parts}] AS x FROM v, unnest(range({parts})) AS t(p)),
books0 AS MATERIALIZED (SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS BIGINT) AS e, x AS c FROM part
QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries})"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""far{r} AS (SELECT vec_id, label, p, x, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
FROM part JOIN books{r} USING (p)),
near{r} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, p, any_value(x) AS x, min({{'d': d, 'e': e}}) AS best FROM far{r} GROUP BY vec_id, p)""")
        if r < rounds:
            steps.append(f"""sums{r} AS (SELECT p, best.e AS e, k, sum(x[k]) AS s, count(*) AS n FROM near{r}, unnest(range(1, len(x) + 1)) AS t(k) GROUP BY ALL),
mean{r} AS (SELECT p, e, list(CAST(CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END AS BIGINT) ORDER BY k) AS c FROM sums{r} GROUP BY p, e),
books{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM books{r} AS b LEFT JOIN mean{r} AS m USING (p, e))""")
    return ",\n".join(steps) + f""",
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id),
digest AS (SELECT sha256(coalesce(string_agg(array_to_string(c, ','), ',' ORDER BY p, e), '')) AS codebooks_sha256 FROM books{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest
"""


ORACLE["op13_vector_codes"] = codes_sql()

ORACLE["op11_source_divergence"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all({lowered("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
total AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n,
             1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (total.n + 5 * v.v)::HUGEINT AS p,
             1 + (1000000000 * (kept.n + 5)::HUGEINT) // (v.n + 5 * v.v)::HUGEINT AS q
      FROM total JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
        FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
          FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
own AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""
