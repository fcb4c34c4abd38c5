"""Registered queries over what surrounds retrieval: logs, traces, prompts, facets, provider keys, session status."""

from __future__ import annotations

from pyspark.sql import functions as F

from atomloom.functions import models, prompts
from atomloom.operators import chunking, graph, judge, research, sessions, stats, tables, vector, websearch
from atomloom.plans import fixtures as fx
from atomloom.plans.graph_queries import ORIENTED_SQL
from atomloom.plans.registry_base import Registry
from atomloom.streaming import progress

query = Registry()
T = fx.table


@query(f"WITH {fx.FRAGMENTS_SQL} SELECT fragment_id, CAST(CASE WHEN access_count % 3 = 0 THEN 0.9 ELSE importance END AS DOUBLE) AS importance FROM fragments")
def q_set_importance(spark, sf_dir):
    f = fx.fragments(spark, sf_dir)
    updates = f.where("access_count % 3 = 0").select("fragment_id", F.lit(0.9).alias("importance"))
    return tables.set_importance(f, updates).select("fragment_id", F.col("importance").cast("double").alias("importance"))


@query(f"""WITH {fx.RESULTS_SQL} SELECT 's1' AS session_id, CASE WHEN pos % 5 = 0 THEN 'unknown' ELSE provider END AS provider, CASE WHEN pos % 7 = 0 THEN '' ELSE url END AS url, coalesce(title, '') AS title,
CAST(CASE WHEN pos % 2 = 0 THEN pos ELSE 0 END AS DOUBLE) AS score, snippet FROM results""")
def q_web_log(spark, sf_dir):
    r = fx.results(spark, sf_dir).withColumn("score", F.when(F.col("pos") % 2 == 0, F.col("pos").cast("double")))
    r = r.withColumn("provider", F.when(F.col("pos") % 5 != 0, F.col("provider"))).withColumn("url", F.when(F.col("pos") % 7 != 0, F.col("url")))
    return sessions.web_log(r, "s1")


@query(f"SELECT doc_id, doc_id % 3 AS page, content FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN ' ' || chr(10) ELSE text END AS content FROM documents) WHERE {fx.strip_sql('content')} <> ''")
def q_page_atoms(spark, sf_dir):
    text = F.when(F.col("doc_id") % 10 == 3, F.lit(" \n")).otherwise(F.col("text"))
    return chunking.page_atoms(T(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3).alias("page"), text.alias("text")))


@query("""SELECT doc_id, 'Query: ' || substring(text, 1, 2000) || chr(10) || 'Sources: ' || array_to_string(list_transform(range(1, least(doc_id % 14, 10) + 1), lambda k: source || k), ', ') || chr(10) || 'Response: ' || lang AS prompt FROM documents""")
def q_judge_prompt(spark, sf_dir):
    n = F.col("doc_id") % 14
    sources = F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), n), lambda k: F.concat("source", k.cast("string"))))
    return T(spark, sf_dir, "documents").select("doc_id", prompts.judge(F.col("text"), F.col("lang"), sources).alias("prompt"))


@query(f"""WITH {fx.NORMED_SQL}, s AS (SELECT q.vec_id AS query_id, a.vec_id AS node, list_inner_product(a.v, q.v) / (a.norm * q.norm) AS cos FROM n AS a, n AS q WHERE q.vec_id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, node) AS rank FROM s QUALIFY rank <= 8),
r AS (SELECT query_id, list(node ORDER BY rank) AS retrieved_ids, list(source ORDER BY rank) AS s FROM t LEFT JOIN documents ON node = doc_id GROUP BY query_id)
SELECT query_id, array_to_string(retrieved_ids, ',') AS retrieved_ids, array_to_string(list_sort(list_distinct(s)), ',') AS sources, substring(text, 1, 300) AS answer FROM r LEFT JOIN documents ON query_id = doc_id""")
def q_trace(spark, sf_dir):
    e = T(spark, sf_dir, "embeddings").drop("label")
    best = vector.top_k(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 8).withColumnRenamed("vec_id", "node")
    docs = T(spark, sf_dir, "documents")
    found = best.join(docs.select(F.col("doc_id").alias("node"), "source"), "node", "left").withColumn("score", F.col("cos"))
    got = sessions.trace_rows(found, docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("answer")))
    return got.select("query_id", F.array_join("retrieved_ids", ",").alias("retrieved_ids"), F.array_join(F.array_sort("sources"), ",").alias("sources"), "answer")


@query("SELECT source, (row_number() OVER (ORDER BY source) - 1) % 10 AS color FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def q_facets(spark, sf_dir):
    return stats.facets(T(spark, sf_dir, "documents"), "source").select("source", F.col("color").cast("bigint").alias("color"))


@query(f"""WITH {fx.EDGES_SQL}, {ORIENTED_SQL}, {fx.SEEDS_SQL}, x AS (SELECT * FROM o WHERE edge_type = 'NEXT'),
h1 AS (SELECT query_id, other AS node, edge_id, weight AS w FROM seeds JOIN x ON node = seed), h2 AS (SELECT query_id, x.other AS node, h1.w + x.weight AS w FROM h1 JOIN x ON x.node = h1.node AND x.edge_id <> h1.edge_id)
SELECT query_id, node, CAST(min(d) AS BIGINT) AS distance, round(max(w), 6) AS path_weight FROM (SELECT query_id, node, w, 1 AS d FROM h1 UNION ALL SELECT query_id, node, w, 2 FROM h2) GROUP BY ALL""")
def q_traverse_typed(spark, sf_dir):
    got = graph.traverse(fx.edges(spark, sf_dir), fx.seeds(spark, sf_dir), edge_types=["NEXT"])
    return got.select("query_id", "node", F.col("distance").cast("bigint").alias("distance"), F.round("path_weight", 6).alias("path_weight"))


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'cancelled' WHEN doc_id % 7 = 0 THEN 'failed_retrieval' WHEN doc_id % 5 = 0 THEN 'no_context' WHEN length(trim(text)) < 200 THEN 'insufficient_kb' ELSE 'ok' END AS status FROM documents""")
def q_status(spark, sf_dir):
    d = F.col("doc_id")
    status = prompts.status(d % 11 == 0, F.when(d % 10 != 0, d % 5), F.col("text"), F.when(d % 7 == 0, F.lit("error")))
    return T(spark, sf_dir, "documents").select("doc_id", status.alias("status"))


@query("SELECT event_id, least(1.0, greatest(0.0, value / 50 - 0.5)) AS x FROM events")
def q_clamp(spark, sf_dir):
    return T(spark, sf_dir, "events").select("event_id", research.clamp(F.col("value") / 50 - 0.5).alias("x"))


@query("SELECT item_id AS step_index, CASE WHEN item_id % 3 = 0 THEN 'done' ELSE 'planned' END AS status FROM benchmark")
def q_plan_status(spark, sf_dir):
    plan = T(spark, sf_dir, "benchmark").select(F.col("item_id").alias("step_index"), F.lit("planned").alias("status"))
    return research.merged_status(plan, plan.where("step_index % 3 = 0").withColumn("status", F.lit("done")))


@query("SELECT event_type AS provider, count(*) AS total_keys, count(*) FILTER (WHERE event_id % 3 = 0) AS active_keys, CAST(sum(user_id) AS BIGINT) AS requests, CAST(sum(event_id % 2) AS BIGINT) AS errors FROM events GROUP BY event_type")
def q_key_stats(spark, sf_dir):
    e = F.col("event_id")
    keys = T(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), (e % 3 == 0).alias("active"), F.col("user_id").alias("requests"), (e % 2).alias("errors"))
    return stats.key_stats(keys)


@query(f"WITH {fx.RESULTS_SQL} SELECT url, min(pos) AS pos FROM results GROUP BY url ORDER BY pos, url LIMIT 15")
def q_distinct_urls(spark, sf_dir):
    return websearch.distinct_urls(fx.results(spark, sf_dir), "pos", 15)


@query(f"WITH {fx.RESULTS_SQL}, f AS (SELECT provider AS session_id, url, title, pos FROM results QUALIFY row_number() OVER (PARTITION BY provider, url ORDER BY pos) = 1) SELECT session_id, url, title, pos FROM f QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos) <= 10")
def q_history_sources(spark, sf_dir):
    logs = fx.results(spark, sf_dir).select(F.col("provider").alias("session_id"), "url", "title", "pos")
    return websearch.history_sources(logs)


@query(f"WITH {fx.RESULTS_SQL} SELECT url, pos FROM (SELECT DISTINCT url, pos FROM results) QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1")
def q_unique_sources(spark, sf_dir):
    return research.unique_sources(fx.results(spark, sf_dir).select("url", "pos").distinct())


@query(f"WITH {fx.RESEARCH_SQL} SELECT id, depth, row_number() OVER w AS position, lead(id) OVER w IS NULL AS final FROM nodes WHERE type = 'synthesis' WINDOW w AS (ORDER BY depth, id)")
def q_synthesis_chain(spark, sf_dir):
    got = research.synthesis_chain(fx.research(spark, sf_dir)[0])
    return got.select("id", "depth", F.col("position").cast("bigint").alias("position"), "final")


@query("SELECT doc_id, CASE WHEN given IS NULL OR given = 5 THEN computed ELSE given END AS score FROM (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN CAST(doc_id % 9 AS DOUBLE) END AS given, doc_id % 10 + 0.5 AS computed FROM labels)")
def q_final_score(spark, sf_dir):
    given = F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 9).cast("double"))
    return T(spark, sf_dir, "labels").select("doc_id", judge.final_score(given, F.col("doc_id") % 10 + 0.5).alias("score"))


@query(f"WITH {fx.RESULTS_SQL} SELECT provider, url FROM results WHERE provider <> 'gamma'")
def q_all_providers(spark, sf_dir):
    r = fx.results(spark, sf_dir)
    found = [r.where(F.col("provider") == p) for p in ("alpha", "beta", "delta")]
    return websearch.all_providers([*found, r.limit(0)], ["provider", "url"])


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_event_counts(spark, sf_dir):
    return progress.counts(T(spark, sf_dir, "events"))


@query("SELECT event_id, event_type FROM events WHERE event_id > 700")
def q_after_cursor(spark, sf_dir):
    return progress.after_cursor(T(spark, sf_dir, "events"), 700, "event_id").select("event_id", "event_type")


@query("""WITH a AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS s FROM events WHERE user_id % 2 = 0 GROUP BY user_id), b AS (SELECT DISTINCT user_id, 'stored' AS s FROM events WHERE user_id % 3 = 0)
SELECT user_id AS session_id, coalesce(a.s, b.s) AS status FROM a FULL JOIN b USING (user_id)""")
def q_known_status(spark, sf_dir):
    e = T(spark, sf_dir, "events")
    live = progress.latest(e.where("user_id % 2 = 0")).select(F.col("user_id").alias("session_id"), F.col("event_type").alias("status"))
    stored = e.where("user_id % 3 = 0").select(F.col("user_id").alias("session_id"), F.lit("stored").alias("status")).distinct()
    return progress.known_status(live, stored)


@query("SELECT event_id, user_id AS session_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 50 = 0)")
def q_without_cancelled(spark, sf_dir):
    e = T(spark, sf_dir, "events").withColumnRenamed("user_id", "session_id")
    return progress.without_cancelled(e, e.where("event_type = 'error' and event_id % 50 = 0")).select("event_id", "session_id")


@query("""SELECT doc_id AS id, source AS name FROM documents WHERE contains(lower(coalesce(nullif(source, ''), 'Knowledge Node')), 'src1')
OR contains(lower(CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END), 'src1')""")
def q_text_search(spark, sf_dir):
    atoms = T(spark, sf_dir, "documents").select(F.col("doc_id").alias("atom_id"), F.col("text").alias("content"), F.lit("text").alias("modality"), F.lit("fine").alias("resolution"), "source")
    return graph.matching(graph.view_nodes(atoms), "SRC1").select("id", "name")


@query(f"WITH {fx.EDGES_SQL} SELECT CAST(src AS VARCHAR) AS source, CAST(dst AS VARCHAR) AS target, edge_type AS label, round(weight, 6) AS weight FROM edges")
def q_view_edges(spark, sf_dir):
    e = fx.edges(spark, sf_dir).withColumn("src", F.concat(F.lit("nodes/"), "src")).withColumn("dst", F.concat(F.lit("nodes/"), "dst"))
    return graph.view_edges(e).withColumn("weight", F.round("weight", 6))


@query(f"WITH {fx.EDGES_SQL} SELECT src, dst, edge_type FROM edges WHERE src IN (SELECT doc_id FROM documents WHERE source = 'src2') OR dst IN (SELECT doc_id FROM documents WHERE source = 'src2')")
def q_touching(spark, sf_dir):
    nodes = T(spark, sf_dir, "documents").where("source = 'src2'").select(F.col("doc_id").alias("fragment_id"))
    return graph.touching(fx.edges(spark, sf_dir), nodes).select("src", "dst", "edge_type")


@query("SELECT 'f' || user_id AS src, a.x AS dst, 'extracted_from' AS edge_type, CAST(1 AS DOUBLE) AS weight FROM (SELECT user_id, unnest([user_id, user_id + 100000000]) AS x FROM (SELECT DISTINCT user_id FROM events)) AS a WHERE a.x IN (SELECT doc_id FROM documents)")
def q_knowledge_links(spark, sf_dir):
    f = T(spark, sf_dir, "events").select("user_id").distinct()
    f = f.select(F.concat(F.lit("f"), "user_id").alias("fragment_id"), F.array(F.col("user_id"), F.col("user_id") + 100_000_000).alias("related_ids"))
    return sessions.knowledge_links(f, T(spark, sf_dir, "documents").select(F.col("doc_id").alias("atom_id")))


@query(f"""WITH {fx.FRAGMENTS_SQL}, r AS (SELECT session_id, content, row_number() OVER (PARTITION BY session_id ORDER BY importance DESC, fragment_id) AS k FROM fragments WHERE NOT is_deleted QUALIFY k <= 5)
SELECT session_id, string_agg('- [knowledge] ' || content, chr(10) ORDER BY k) AS context FROM r GROUP BY session_id""")
def q_semantic_context(spark, sf_dir):
    return sessions.semantic_context(fx.fragments(spark, sf_dir).withColumn("fragment_type", F.lit(None).cast("string")))


@query("SELECT conv_id, turn, CAST(turn * 12.5 AS DOUBLE) AS total_time_ms FROM conversations WHERE role = 'assistant' AND turn % 2 = 1")
def q_metric_rows(spark, sf_dir):
    made = F.when(F.col("turn") % 2 == 1, F.concat(F.lit('{"total_time_ms": '), (F.col("turn") * 12.5).cast("string"), F.lit("}"))).otherwise(F.lit('{"other": 1}'))
    return sessions.metric_rows(T(spark, sf_dir, "conversations").withColumn("metadata", made)).select("conv_id", "turn", "total_time_ms")


_SIZES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in models.EMBEDDING_SIZES.items())


@query(f"SELECT doc_id, CAST(CASE (['text', 'image', 'audio', 'other'])[doc_id % 4 + 1] {_SIZES} ELSE 1024 END AS BIGINT) AS size FROM documents")
def q_embedding_size(spark, sf_dir):
    m = F.element_at(F.array(*[F.lit(x) for x in ("text", "image", "audio", "other")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return T(spark, sf_dir, "documents").select("doc_id", models.embedding_size(m).cast("bigint").alias("size"))
