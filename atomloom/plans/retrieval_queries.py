"""Registered queries of retrieval: keyword scores, fusion, re-ranking, packing, web results."""

from __future__ import annotations

from pyspark.sql import functions as F

from atomloom.config import BLOCKED_RESULT_DOMAINS, SearchConfig
from atomloom.operators import graph, postings, retrieval, vector, websearch
from atomloom.plans import fixtures as fx
from atomloom.plans.graph_queries import DEGREE_SQL, GRAPH_SQL
from atomloom.plans.registry_base import Registry
from atomloom.plans.text_queries import TOKENS_SQL, any_of
from atomloom.session import materialize

query = Registry()
T = fx.table
_TOK = "list_filter(string_split_regex(lower({}), '[ \\t\\n\\r\\v\\f]+'), lambda w: w <> '')"


def _docs(spark, sf_dir):
    return T(spark, sf_dir, "documents").select(F.col("doc_id").alias("atom_id"), F.col("text").alias("content"))


_ASKED = fx.ASKED_SQL
_FULL = f"""{_ASKED}, terms AS (SELECT query_id, list_distinct({_TOK.format("text")}) AS t FROM asked), toks AS (SELECT doc_id AS atom_id, text AS content, {_TOK.format("text")} AS w FROM documents),
hits AS (SELECT query_id, atom_id, content, w FROM toks, terms WHERE list_has_all(w, t) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY atom_id) <= 5)"""
_BM25 = f"""{_FULL}, c AS (SELECT query_id, count(*) AS n, avg(len(w)) AS avgdl FROM hits GROUP BY query_id),
tf AS (SELECT query_id, atom_id, dl, term, count(*) AS tf FROM (SELECT query_id, atom_id, len(w) AS dl, unnest(w) AS term FROM hits) GROUP BY ALL),
df0 AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY ALL), df1 AS (SELECT query_id, term, ln(n - df + 0.5) - ln(df + 0.5) AS raw, avgdl FROM df0 JOIN c USING (query_id)),
idf AS (SELECT query_id, term, avgdl, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY query_id) ELSE raw END AS idf FROM df1),
asked_terms AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TOK.format("text")}) AS term FROM asked) GROUP BY ALL),
bm AS (SELECT h.query_id, h.atom_id, coalesce(s, 0) AS bm25 FROM hits AS h LEFT JOIN (SELECT query_id, atom_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM tf JOIN asked_terms USING (query_id, term) JOIN idf USING (query_id, term) GROUP BY ALL) AS x USING (query_id, atom_id)),
norm AS (SELECT query_id, atom_id, CASE WHEN max(bm25) OVER w <= 0 THEN bm25 WHEN max(bm25) OVER w = min(bm25) OVER w THEN 0 ELSE (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) END AS score FROM bm WINDOW w AS (PARTITION BY query_id))"""


@query(f"""WITH toks AS (SELECT doc_id AS atom_id, unnest({_TOK.format("text")}) AS term FROM documents)
SELECT term, count(DISTINCT atom_id) AS df, count(*) AS occurrences, max(n) AS most FROM (SELECT *, count(*) OVER (PARTITION BY atom_id, term) AS n FROM toks) GROUP BY term""")
def q_keyword_index(spark, sf_dir):
    """What the index holds of each term: atoms, occurrences, and the most in one atom."""
    p = fx.keyword_index(spark, sf_dir).postings
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return p.groupBy("term").agg(F.sum("n").alias("df"), F.sum(total).alias("occurrences"), F.max(F.array_max("counts")).cast("bigint").alias("most"))


@query(f"WITH {_FULL} SELECT query_id, atom_id FROM hits")
def q_fulltext(spark, sf_dir):
    return postings.full_text(fx.keyword_index(spark, sf_dir), fx.asked(spark, sf_dir), 5)


@query(f"WITH {_BM25} SELECT query_id, atom_id, round(score, 6) AS score FROM norm")
def q_bm25_rerank(spark, sf_dir):
    asked = fx.asked(spark, sf_dir)
    hits = postings.full_text(fx.keyword_index(spark, sf_dir), asked, 5).join(_docs(spark, sf_dir), "atom_id")
    return retrieval.min_max(retrieval.bm25(hits, asked), "bm25").select("query_id", "atom_id", F.round("bm25", 6).alias("score"))


@query(f"""WITH {_ASKED}, toks AS (SELECT doc_id AS atom_id, {_TOK.format("text")} AS w FROM documents), c AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM toks),
asked_terms AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TOK.format("text")}) AS term FROM asked) GROUP BY ALL),
tf AS (SELECT atom_id, dl, term, count(*) AS tf FROM (SELECT atom_id, len(w) AS dl, unnest(w) AS term FROM toks) WHERE term IN (SELECT term FROM asked_terms) GROUP BY ALL),
idf AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf, avgdl FROM tf, c GROUP BY term, n, avgdl),
s AS (SELECT query_id, atom_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM tf JOIN asked_terms USING (term) JOIN idf USING (term) GROUP BY ALL)
SELECT query_id, atom_id, round(s, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, atom_id) <= 10""")
def q_bm25_corpus(spark, sf_dir):
    got = postings.bm25_top(fx.keyword_index(spark, sf_dir), fx.asked(spark, sf_dir), 10)
    return got.select("query_id", "atom_id", F.round("bm25", 6).alias("score"))


@query("""SELECT doc_id, CAST(CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 3 THEN 0.4 ELSE 0.7 END AS DOUBLE) AS score FROM documents""")
def q_modality_score(spark, sf_dir):
    m = F.element_at(F.array(*[F.lit(x) for x in ("text", "image", "audio", "table")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return T(spark, sf_dir, "documents").select("doc_id", retrieval.modality_score(m, F.array(F.lit("text"))).alias("score"))


_VEC = f"""v AS (SELECT query_id, vec_id AS node, list_inner_product(a.v, q.v) / (a.norm * q.norm) AS score, row_number() OVER (PARTITION BY query_id ORDER BY list_inner_product(a.v, q.v) / (a.norm * q.norm) DESC, vec_id) AS rank
FROM n AS a, (SELECT vec_id AS query_id, v, norm FROM n WHERE vec_id % 20 = 0) AS q QUALIFY rank <= 10)"""


def _vector(spark, sf_dir):
    e = T(spark, sf_dir, "embeddings").drop("label")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.top_k(e, q, 10).select("query_id", F.col("vec_id").alias("node"), F.col("cos").alias("score"), "rank")


def _keyword(spark, sf_dir):
    got = postings.bm25_top(fx.keyword_index(spark, sf_dir), fx.asked(spark, sf_dir), 10)
    return got.select("query_id", F.col("atom_id").alias("node"), F.col("bm25").alias("score"), "rank")


_KEY = f"""{_ASKED}, toks AS (SELECT doc_id AS atom_id, {_TOK.format("text")} AS w FROM documents), c AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM toks),
asked_terms AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TOK.format("text")}) AS term FROM asked) GROUP BY ALL),
tf AS (SELECT atom_id, dl, term, count(*) AS tf FROM (SELECT atom_id, len(w) AS dl, unnest(w) AS term FROM toks) WHERE term IN (SELECT term FROM asked_terms) GROUP BY ALL),
idf AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf, avgdl FROM tf, c GROUP BY term, n, avgdl),
k0 AS (SELECT query_id, atom_id AS node, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN asked_terms USING (term) JOIN idf USING (term) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS rank FROM k0 QUALIFY rank <= 10)"""


@query(f"WITH {fx.NORMED_SQL}, {_VEC}, {_KEY} SELECT query_id, node, round(sum(1.0 / (60 + rank)), 8) AS rrf FROM (SELECT query_id, node, rank FROM v UNION ALL SELECT query_id, node, rank FROM k) GROUP BY ALL")
def q_rrf(spark, sf_dir):
    return retrieval.rrf([_vector(spark, sf_dir), _keyword(spark, sf_dir)]).withColumn("rrf", F.round("rrf", 8))


_UNI = f"""{GRAPH_SQL}, {_VEC}, {_KEY}, long AS (SELECT query_id, node, score, 'v' AS kind FROM v UNION ALL SELECT query_id, node, score, 'g' FROM g UNION ALL SELECT query_id, node, score, 'b' FROM k),
m AS (SELECT query_id, node, coalesce(max(score) FILTER (WHERE kind = 'v'), 0) AS sv, coalesce(max(score) FILTER (WHERE kind = 'g'), 0) AS sg, coalesce(max(score) FILTER (WHERE kind = 'b'), 0) AS sb FROM long GROUP BY ALL),
cand AS (SELECT query_id, node FROM m), {DEGREE_SQL},
u AS (SELECT query_id, node, 0.3 * sv + 0.25 * sg + 0.2 * sb + 0.15 * degree + 0.1 * CASE node % 4 WHEN 0 THEN 1.0 WHEN 3 THEN 0.4 ELSE 0.7 END AS score FROM m JOIN central USING (query_id, node))"""


def _unified(spark, sf_dir):
    edges = fx.edges(spark, sf_dir).drop("edge_id")
    g = retrieval.graph_evidence(edges, fx.seeds(spark, sf_dir), SearchConfig(ppr_iterations=3), tolerance=None)
    c = materialize(retrieval.merged(_vector(spark, sf_dir), g, _keyword(spark, sf_dir)), "candidates")
    c = c.join(graph.degree_centrality(edges, c.select("query_id", "node")).withColumnRenamed("degree", "s"), ["query_id", "node"])
    m = F.element_at(F.array(*[F.lit(x) for x in ("text", "image", "audio", "table")]), (F.col("node") % 4 + 1).cast("int"))
    return retrieval.unified(c.withColumn("m", retrieval.modality_score(m, F.array(F.lit("text")))))


@query(f"WITH {_UNI} SELECT query_id, node, round(score, 6) AS score FROM u")
def q_unified_evidence(spark, sf_dir):
    return _unified(spark, sf_dir).select("query_id", "node", F.round("score", 6).alias("score"))


@query(f"""WITH {fx.NORMED_SQL}, {_VEC}, {_KEY}, a AS (SELECT query_id, node, score, rank, 0 AS part FROM v UNION ALL SELECT query_id, node, score, rank, 1 FROM k),
f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id, node ORDER BY part, rank) = 1)
SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY part, rank, node) AS pos, round(score, 6) AS score FROM f QUALIFY pos <= 15""")
def q_quick(spark, sf_dir):
    got = retrieval.quick(_vector(spark, sf_dir), _keyword(spark, sf_dir))
    return got.select("query_id", "node", F.col("pos").cast("bigint").alias("pos"), F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {_UNI}, mc AS (SELECT query_id, node, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS pos, count(*) OVER (PARTITION BY query_id) AS size,
list_transform(v, lambda x: x / norm) AS unit FROM u LEFT JOIN n ON vec_id = node),
mr AS (SELECT query_id, node, 1 AS rank, score, [node] AS chosen, [unit] AS units FROM mc WHERE pos = 1 AND size > 8
       UNION ALL SELECT query_id, b.node, rank + 1, b.score, list_append(chosen, b.node), list_append(units, b.unit)
       FROM (SELECT mr.query_id, mr.rank, mr.chosen, mr.units, arg_max({{'node': mc.node, 'score': mc.score, 'unit': mc.unit}},
                    (mc.score - 0.25 * coalesce(list_sum(list_transform(mr.units, lambda x: coalesce(list_inner_product(x, mc.unit), 0))), 0), -mc.pos)) AS b
             FROM mr JOIN mc ON mc.query_id = mr.query_id WHERE rank < 8 AND NOT list_contains(mr.chosen, mc.node) GROUP BY ALL))
SELECT query_id, node, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM mr UNION ALL SELECT query_id, node, pos, round(score, 6) FROM mc WHERE size <= 8""")
def q_mmr(spark, sf_dir):
    from pyspark.sql import Window

    c = _unified(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node")))
    e = T(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), vector.as_double(F.col("embedding")).alias("embedding"))
    return retrieval.mmr(c.join(e, "node", "left").select("query_id", "node", "pos", "score", "embedding"), k=8).withColumn("score", F.round("score", 6))


def _packed(spark, sf_dir):
    v = _vector(spark, sf_dir).where("rank <= 5")
    return retrieval.packed(v, fx.edges(spark, sf_dir), _docs(spark, sf_dir))


_PACK = f"""{fx.EDGES_SQL}, {_VEC}, o AS (SELECT DISTINCT node, other FROM (SELECT src AS node, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges) WHERE node IN (SELECT node FROM v WHERE rank <= 5)),
r AS (SELECT node, text, row_number() OVER (PARTITION BY node ORDER BY other) AS i FROM o JOIN documents ON doc_id = other QUALIFY i <= 3),
ctx AS (SELECT node, list(text ORDER BY i) AS context FROM r GROUP BY node),
p AS (SELECT query_id, node, rank, coalesce(context, []) AS context FROM v LEFT JOIN ctx USING (node) WHERE rank <= 5)"""


@query(f"WITH {_PACK} SELECT query_id, node, context FROM p")
def q_pack(spark, sf_dir):
    return _packed(spark, sf_dir).select("query_id", "node", "context")


@query(f"""WITH {_PACK}, b AS (SELECT query_id, rank, source, '[' || rank || '] ' || CASE WHEN length(text) > 1500 THEN substring(text, 1, 1500) || '...' ELSE text END || chr(10) || '   (Source: ' || source || ', Modality: text)'
|| CASE WHEN len(context) > 0 THEN chr(10) || chr(10) || '   Context: ' || substring(context[1], 1, 150) || '...' ELSE '' END AS t FROM p JOIN documents ON doc_id = node)
SELECT query_id, string_agg(t, chr(10) || chr(10) ORDER BY rank) AS evidence, list_sort(list_distinct(list(source))) AS sources FROM b GROUP BY query_id""")
def q_evidence(spark, sf_dir):
    docs = T(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), F.col("text").alias("content"), "source", F.lit("text").alias("modality"))
    return retrieval.evidence(_packed(spark, sf_dir).join(docs, "node"))


@query()
def q_hybrid(spark, sf_dir):
    """The flagship: every kind of evidence, fused, re-ranked and packed."""
    edges = fx.edges(spark, sf_dir).drop("edge_id")
    got = retrieval.hybrid(fx.atoms(spark, sf_dir), edges, fx.queries(spark, sf_dir), index=fx.keyword_index(spark, sf_dir))
    return got.select("query_id", "rank", "node", "score", "v", "g", "b", "s", "m", "source", "modality", "context")


_QUERY = "The heading of another thing"
_REC = "CASE WHEN d IS NULL THEN 0.0 WHEN d <= 7 THEN 1.0 WHEN d <= 30 THEN 0.8 WHEN d <= 90 THEN 0.6 WHEN d <= 365 THEN 0.4 WHEN d <= 730 THEN 0.2 ELSE 0.1 END"
_DAYS = f"CAST(floor(epoch(TIMESTAMP '{fx.AS_OF}' - coalesce(try_strptime(substring(date, 1, 19), '%Y-%m-%dT%H:%M:%S'), try_strptime(substring(date, 1, 19), '%Y-%m-%d'), try_strptime(substring(date, 1, 19), '%B %-d, %Y'))) / 86400) AS BIGINT)"
_TF = f"""(SELECT CASE WHEN len(dw) = 0 THEN 0 ELSE list_sum(list_transform(qw, lambda t: CASE WHEN list_contains(dw, t) THEN 1 + ln(1 + len(list_filter(dw, lambda w: w = t)) / len(dw)) ELSE 0 END)) / len(qw) END)"""
_QW = TOKENS_SQL.replace("{0}", f"'{_QUERY}'")


@query(f"SELECT doc_id, round({_TF}, 6) AS score FROM (SELECT doc_id, {TOKENS_SQL.replace('{0}', 'text')} AS dw, {_QW} AS qw FROM documents)")
def q_tf_score(spark, sf_dir):
    from atomloom.functions.text import search_tokens

    terms = T(spark, sf_dir, "documents").select("doc_id", search_tokens(F.lit(_QUERY)).alias("q"), search_tokens(F.col("text")).alias("d"))
    return terms.select("doc_id", F.round(websearch.term_score(F.col("q"), F.col("d")), 6).alias("score"))


@query(rf"""WITH {fx.RESULTS_SQL}, r AS (SELECT *, lower(split_part(split_part(regexp_replace(rtrim(url, '/'), '^https?://(www\.)?', ''), '?', 1), '#', 1)) AS norm_url FROM results),
c AS (SELECT norm_url, count(*) AS provider_count FROM r GROUP BY norm_url), f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY norm_url ORDER BY provider, pos) = 1),
s AS (SELECT norm_url, provider, provider_count, {TOKENS_SQL.replace("{0}", "coalesce(title, '') || ' ' || coalesce(snippet, '')")} AS dw, {_QW} AS qw, {_DAYS} AS d FROM f JOIN c USING (norm_url) WHERE NOT {any_of("split_part(norm_url, '/', 1)", BLOCKED_RESULT_DOMAINS)})
SELECT norm_url, provider, provider_count, round({_TF} * 0.6 + (provider_count - 1) * 0.15 * 0.25 + {_REC} * 0.15, 6) AS final_score FROM s""")
def q_fusion(spark, sf_dir):
    got = websearch.fuse(fx.results(spark, sf_dir), F.lit(_QUERY), F.to_timestamp(F.lit(fx.AS_OF)))
    return got.select("norm_url", "provider", "provider_count", F.round("final_score", 6).alias("final_score"))


@query(f"WITH {fx.RESULTS_SQL} SELECT count(DISTINCT provider) AS providers_with_results, count(*) AS total_raw FROM results")
def q_provider_metrics(spark, sf_dir):
    return websearch.provider_metrics(fx.results(spark, sf_dir)).select("providers_with_results", "total_raw")
