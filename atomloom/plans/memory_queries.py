"""Registered queries over sessions, memory, research runs, judged responses and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from atomloom.config import JUDGE_WEIGHTS
from atomloom.operators import judge, research, sessions, tables, vector
from atomloom.plans import fixtures as fx
from atomloom.plans.registry_base import Registry
from atomloom.streaming import progress

query = Registry()
T = fx.table
AS_OF = fx.AS_OF


def _talk(spark, sf_dir):
    return T(spark, sf_dir, "conversations")


@query("SELECT conv_id, count(*) AS n_messages, max(turn) AS updated_at FROM conversations GROUP BY conv_id")
def q_chat_list(spark, sf_dir):
    return sessions.chat_list(_talk(spark, sf_dir))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def q_history_lastn(spark, sf_dir):
    return sessions.last_messages(_talk(spark, sf_dir), 3).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, CAST(sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS spent FROM conversations QUALIFY spent <= 60")
def q_history_budget(spark, sf_dir):
    return sessions.within_budget(_talk(spark, sf_dir), 60).select("conv_id", "turn", F.col("spent").cast("bigint").alias("spent"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index FROM conversations WHERE role = 'user'")
def q_turn_index(spark, sf_dir):
    return sessions.turn_index(_talk(spark, sf_dir).where("role = 'user'")).select("conv_id", "turn", F.col("turn_index").cast("bigint").alias("turn_index"))


@query("SELECT conv_id, turn, user_text FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_text FROM conversations) WHERE role = 'assistant'")
def q_prev_user(spark, sf_dir):
    return sessions.previous_user(_talk(spark, sf_dir)).select("conv_id", "turn", "user_text")


@query("SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || coalesce(text, '') || chr(10) || chr(10), '' ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def q_flatten_chat(spark, sf_dir):
    return sessions.flattened(_talk(spark, sf_dir))


@query("SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE conv_id % 4 = 1)")
def q_cascade_delete(spark, sf_dir):
    m = _talk(spark, sf_dir)
    chats = m.select("conv_id").distinct()
    return tables.cascade_delete(chats, {"messages": m}, chats.where("conv_id % 4 = 1"), "conv_id")["messages"].select("conv_id", "turn")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def q_upsert_config(spark, sf_dir):
    e = T(spark, sf_dir, "events").withColumn("version", F.struct("ts", "event_id"))
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    return tables.upsert(old, new, ["user_id"], "version").select("user_id", "event_type", "ts")


@query("""WITH m AS (SELECT conv_id AS chat_id, turn FROM conversations), p AS (SELECT DISTINCT chat_id FROM m WHERE chat_id % 2 = 0)
SELECT chat_id, CASE WHEN chat_id % 2 = 0 THEN 'kept' ELSE 'New Chat' END AS title, max(turn) AS updated_at FROM m GROUP BY chat_id""")
def q_append_messages(spark, sf_dir):
    m = _talk(spark, sf_dir).select(F.col("conv_id").alias("chat_id"), "turn")
    old = m.where("chat_id % 2 = 0").select("chat_id").distinct().withColumn("title", F.lit("kept")).withColumn("updated_at", F.lit(-1).cast("bigint"))
    return tables.append_with_parent(old, m, "chat_id", {"title": F.lit("New Chat")}, "updated_at", "turn")


@query(f"""WITH {fx.FRAGMENTS_SQL} SELECT 'fragment' AS kind, fragment_id AS id, is_deleted OR session_id = 's7' AS is_deleted FROM fragments
UNION ALL SELECT 'trace', conv_id || ':' || turn, false FROM conversations WHERE role = 'user' AND conv_id <> 7 UNION ALL SELECT 'log', CAST(event_id AS VARCHAR), false FROM events WHERE user_id <> 7""")
def q_clear_session(spark, sf_dir):
    traces = _talk(spark, sf_dir).where("role = 'user'").select(F.concat(F.lit("s"), "conv_id").alias("session_id"), F.concat_ws(":", "conv_id", "turn").alias("id"))
    logs = T(spark, sf_dir, "events").select(F.concat(F.lit("s"), "user_id").alias("session_id"), F.col("event_id").cast("string").alias("id"))
    left = tables.clear_session(traces, logs, fx.fragments(spark, sf_dir), "s7")
    rows = [left[2].select(F.lit("fragment").alias("kind"), F.col("fragment_id").alias("id"), "is_deleted")]
    rows += [df.select(F.lit(kind).alias("kind"), "id", F.lit(False).alias("is_deleted")) for kind, df in (("trace", left[0]), ("log", left[1]))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"WITH {fx.FRAGMENTS_SQL} SELECT md5(fragment_id || '|' || 'shared') AS fragment_id, 'shared' AS namespace, CAST(0 AS BIGINT) AS access_count FROM fragments WHERE session_id IN ('s1', 's2', 's3') AND NOT is_deleted")
def q_clone_fragments(spark, sf_dir):
    got = tables.cloned(fx.fragments(spark, sf_dir), ["s1", "s2", "s3"], "shared", F.to_timestamp_ntz(F.lit(AS_OF)))
    return got.select("fragment_id", "namespace", "access_count")


@query(f"""WITH {fx.FRAGMENTS_SQL}, h AS (SELECT 'f-' || user_id || '-' || event_type AS fragment_id, count(*) AS n FROM events WHERE event_id % 11 = 0 GROUP BY ALL)
SELECT fragment_id, access_count + coalesce(n, 0) AS access_count, CASE WHEN n IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE last_accessed END AS last_accessed FROM fragments LEFT JOIN h USING (fragment_id)""")
def q_fragment_access(spark, sf_dir):
    hits = T(spark, sf_dir, "events").where("event_id % 11 = 0").select(F.concat_ws("-", F.lit("f"), "user_id", "event_type").alias("fragment_id"))
    return tables.bumped(fx.fragments(spark, sf_dir), hits, F.to_timestamp_ntz(F.lit(AS_OF))).select("fragment_id", "access_count", "last_accessed")


@query("""WITH m AS (SELECT conv_id % 50 AS s, * FROM conversations), l AS (SELECT conv_id, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 200),
a AS (SELECT conv_id AS session_id, count(*) AS total_messages, count(*) FILTER (WHERE role = 'user') AS user_messages, count(*) FILTER (WHERE role = 'assistant') AS assistant_messages FROM l GROUP BY ALL),
f AS (SELECT user_id AS session_id, count(DISTINCT event_type) AS fragments FROM events GROUP BY ALL), t AS (SELECT conv_id AS session_id, count(*) AS traces FROM conversations WHERE role = 'user' GROUP BY ALL), w AS (SELECT user_id AS session_id, count(*) AS web_searches FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT session_id, coalesce(total_messages, 0) AS total_messages, coalesce(user_messages, 0) AS user_messages, coalesce(assistant_messages, 0) AS assistant_messages, coalesce(fragments, 0) AS fragments, coalesce(web_searches, 0) AS web_searches, coalesce(traces, 0) AS traces
FROM a FULL JOIN f USING (session_id) FULL JOIN t USING (session_id) FULL JOIN w USING (session_id)""")
def q_memory_dump_stats(spark, sf_dir):
    m = _talk(spark, sf_dir).withColumnRenamed("conv_id", "session_id")
    f = T(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_type").distinct().withColumn("is_deleted", F.lit(False))
    logs = T(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("session_id"))
    return sessions.memory_stats(m, f, logs, m.where("role = 'user'"))


@query(f"WITH {fx.FRAGMENTS_SQL}, c AS (SELECT namespace, count(*) AS n FROM fragments WHERE NOT is_deleted GROUP BY namespace) SELECT namespace, coalesce(n, 0) AS n FROM (VALUES ('global'), ('session_nobody-h')) AS a(namespace) FULL JOIN c USING (namespace)")
def q_namespaces(spark, sf_dir):
    return sessions.namespaces(fx.fragments(spark, sf_dir), "nobody-here")


@query(f"WITH {fx.FRAGMENTS_SQL} SELECT fragment_id FROM fragments WHERE namespace IN ('global', 'session_s1') AND NOT is_deleted")
def q_namespace_filter(spark, sf_dir):
    return sessions.in_namespaces(fx.fragments(spark, sf_dir), ["global", "session_s1"]).select("fragment_id")


@query("""WITH n AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings),
s AS (SELECT q.vec_id AS query_id, a.vec_id AS fragment_id, list_inner_product(a.v, q.v) / (a.norm * q.norm) AS cos FROM n AS a, n AS q WHERE q.vec_id % 20 = 0 AND a.label IN (1, 3))
SELECT query_id, fragment_id, round(cos, 6) AS cos FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s.cos DESC, fragment_id) <= 5""")
def q_fragment_search(spark, sf_dir):
    e = T(spark, sf_dir, "embeddings")
    f = e.select(F.col("vec_id").alias("fragment_id"), F.col("label").cast("string").alias("namespace"), F.lit(False).alias("is_deleted"), "embedding")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = vector.top_k(sessions.in_namespaces(f, ["1", "3"]).drop("namespace", "is_deleted"), q, 5, item="fragment_id")
    return got.select("query_id", "fragment_id", F.round("cos", 6).alias("cos"))


_IMPORTANCE = f"""{fx.FRAGMENTS_SQL}, scored AS (SELECT fragment_id, is_deleted, created_at, least(1, greatest(0, 0.3 * access_count / greatest((SELECT max(access_count) FROM fragments WHERE NOT is_deleted), 1)
+ 0.4 * exp(-0.01 * (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(coalesce(last_accessed, created_at))) / 3.6e9) + 0.3 * importance)) AS importance FROM fragments)"""


def _scored(spark, sf_dir):
    f = fx.fragments(spark, sf_dir)
    f = f.withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("last_accessed", F.col("last_accessed").cast("timestamp"))
    return sessions.rescored(f, F.to_timestamp(F.lit(AS_OF)))


@query(f"WITH {_IMPORTANCE} SELECT fragment_id, round(importance, 6) AS importance FROM scored")
def q_importance(spark, sf_dir):
    return _scored(spark, sf_dir).select("fragment_id", F.round("importance", 6).alias("importance"))


@query(f"WITH {_IMPORTANCE} SELECT fragment_id FROM scored WHERE NOT is_deleted AND importance < 0.2 AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY")
def q_decay(spark, sf_dir):
    return _scored(spark, sf_dir).where(sessions.decayed(F.to_timestamp(F.lit(AS_OF)), 0.2, 90)).select("fragment_id")


@query("""WITH RECURSIVE f AS (SELECT source, doc_id, list_distinct(regexp_extract_all(lower(substring(text, 1, 120)), '[a-z]{3,}')) AS w, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
r AS (SELECT source, doc_id, k, TRUE AS fresh, [w] AS kept FROM f WHERE k = 1
      UNION ALL SELECT source, doc_id, k, fresh, CASE WHEN fresh THEN list_append(kept, w) ELSE kept END
      FROM (SELECT f.source, f.doc_id, f.k, f.w, r.kept, len(list_filter(r.kept, lambda x: len(list_intersect(x, f.w)) / (len(x) + len(f.w) - len(list_intersect(x, f.w))) > 0.65::DOUBLE)) = 0 AS fresh
            FROM r JOIN f ON f.source IS NOT DISTINCT FROM r.source AND f.k = r.k + 1))
SELECT source, doc_id FROM r WHERE fresh""")
def q_dedup_findings(spark, sf_dir):
    return research.distinct_findings(T(spark, sf_dir, "documents"), "source", "doc_id", "text")


@query("SELECT md5(text) AS content_hash, min(text) AS text FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY 1")
def q_content_hash_dedup(spark, sf_dir):
    d = T(spark, sf_dir, "documents")
    return tables.content_cache(d, d.where("doc_id % 3 = 0").select(F.md5("text").alias("content_hash")), "text")


@query(f"WITH {fx.RESEARCH_SQL} SELECT id, count(*) AS findings_count FROM nodes JOIN redges ON dst = id AND redges.type = 'extracted_from' WHERE nodes.type = 'web_source' GROUP BY id")
def q_provenance_sources(spark, sf_dir):
    return research.source_counts(*fx.research(spark, sf_dir)).select("id", "findings_count")


@query(f"WITH {fx.RESEARCH_SQL} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def q_graph_stats(spark, sf_dir):
    return research.type_counts(fx.research(spark, sf_dir)[0])


@query(f"""WITH RECURSIVE {fx.RESEARCH_SQL}, made AS (SELECT DISTINCT src, dst FROM redges WHERE type = 'synthesized_from'),
walk AS (SELECT id, 0 AS d FROM (SELECT id FROM nodes WHERE type = 'synthesis' ORDER BY depth DESC, id DESC LIMIT 1) UNION SELECT dst, d + 1 FROM walk JOIN made ON src = id)
SELECT id, any_value(type) AS type, CAST(min(d) AS BIGINT) AS distance FROM walk JOIN nodes USING (id) GROUP BY id""")
def q_decision_trace(spark, sf_dir):
    return research.decision_trace(*fx.research(spark, sf_dir)).select("id", "type", F.col("distance").cast("bigint").alias("distance"))


@query("""SELECT source, doc_id AS id FROM (SELECT source, doc_id, row_number() OVER w AS rank, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id % 10 DESC, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id % 10 DESC, doc_id)) WHERE rank <= 30 AND used <= 12000""")
def q_top_findings(spark, sf_dir):
    f = T(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("id"), (F.col("doc_id") % 10).alias("importance"), F.col("text").alias("content"))
    return research.top_findings(f, group="source").select("source", "id")


def _plan_sql() -> str:
    steps = [(i, t, k, q) for i, (t, qs) in enumerate(research.PLAN) for k, q in enumerate(qs)]
    return ", ".join(f"({i}, '{t}', {k}, '{q}')" for i, t, k, q in steps)


@query(f"""WITH plan(step_index, title, query_index, q) AS (VALUES {_plan_sql()}), w AS (SELECT item_id, text, {fx.words_sql("text")} AS w FROM benchmark)
SELECT item_id AS query_id, step_index, title, query_index, CASE WHEN len(w) > 5 THEN array_to_string(w[1:5], ' ') ELSE text END || ' ' || q AS search_query FROM w, plan""")
def q_fallback_plan(spark, sf_dir):
    return research.fallback_plan(T(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


def _dims():
    """Judge rows from labels; some dimensions are missing."""
    return {d: F.when((F.col("doc_id") + i) % 7 != 0, (F.col("doc_id") * (i + 3) + F.col("quality")) % 10 + 1).cast("int").alias(d) for i, d in enumerate(JUDGE_WEIGHTS)}


_DIMS = "j AS (SELECT doc_id, " + ", ".join(f"CASE WHEN (doc_id + {i}) % 7 <> 0 THEN CAST((doc_id * {i + 3} + quality) % 10 + 1 AS INTEGER) END AS {d}" for i, d in enumerate(JUDGE_WEIGHTS)) + " FROM labels)"
_MEAN = "round(list_avg(list_filter([" + ", ".join(f"CAST({d} AS DOUBLE)" for d in JUDGE_WEIGHTS) + "], lambda x: x IS NOT NULL)), 1)"
_FILL = "f AS (SELECT doc_id, " + ", ".join(f"coalesce(CAST({d} AS DOUBLE), {_MEAN}) AS {d}" for d in JUDGE_WEIGHTS) + " FROM j)"
_SCORE = "round((" + " + ".join(f"{d} * CAST({w} AS DOUBLE)" for d, w in JUDGE_WEIGHTS.items()) + f") / CAST({sum(JUDGE_WEIGHTS.values()):.6g} AS DOUBLE), 1)"


@query(f"WITH {_DIMS}, {_FILL} SELECT * FROM f")
def q_judge_fill(spark, sf_dir):
    j = T(spark, sf_dir, "labels").select("doc_id", *_dims().values())
    return j.select("doc_id", *[c.alias(d) for d, c in judge.filled().items()])


@query(f"WITH {_DIMS}, {_FILL}, s AS (SELECT doc_id, {_SCORE} AS overall FROM f) SELECT doc_id, overall, CASE WHEN overall >= 8 THEN 'excellent' WHEN overall >= 6 THEN 'good' WHEN overall >= 4 THEN 'fair' ELSE 'poor' END AS verdict FROM s")
def q_judge_overall(spark, sf_dir):
    j = T(spark, sf_dir, "labels").select("doc_id", *_dims().values())
    filled = j.select("doc_id", *[c.alias(d) for d, c in judge.filled().items()])
    return filled.select("doc_id", judge.overall().alias("overall")).withColumn("verdict", judge.verdict(F.col("overall")))


@query("""SELECT doc_id, CASE WHEN r BETWEEN 1 AND 10 THEN r END AS relevance, CASE WHEN g BETWEEN 1 AND 10 THEN g END AS factual_grounding FROM (SELECT doc_id, CAST(doc_id % 13 AS INTEGER) AS r, CAST(doc_id % 11 AS INTEGER) AS g FROM labels)""")
def q_judge_regex(spark, sf_dir):
    raw = F.concat(F.lit('Scores: "relevance": '), (F.col("doc_id") % 13).cast("string"), F.lit(", Factual grounding = "), (F.col("doc_id") % 11).cast("string"))
    got = judge.recovered(raw)
    return T(spark, sf_dir, "labels").select("doc_id", got["relevance"].alias("relevance"), got["factual_grounding"].alias("factual_grounding"))


@query("SELECT user_id, count(*) AS n_events, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS at FROM events GROUP BY user_id")
def q_event_latest_state(spark, sf_dir):
    return progress.latest(T(spark, sf_dir, "events"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_tumbling(spark, sf_dir):
    return progress.tumbling(T(spark, sf_dir, "events"), "1 day").withColumn("total", F.round("total", 4))


@query("SELECT time_bucket(INTERVAL 12 HOUR, ts) - k * INTERVAL 12 HOUR AS start, event_type, count(*) AS n FROM events, unnest([0, 1]) AS t(k) GROUP BY ALL")
def q_sliding(spark, sf_dir):
    return progress.sliding(T(spark, sf_dir, "events"), "1 day", "12 hours")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM s GROUP BY user_id, k""")
def q_session(spark, sf_dir):
    return progress.sessions(T(spark, sf_dir, "events"), "6 hours")


@query("""SELECT user_id, coalesce(max(event_type) FILTER (WHERE event_type = 'purchase'), 'none') AS config, CAST(coalesce(max(event_id) FILTER (WHERE event_type = 'purchase'), -1) AS BIGINT) AS at FROM events GROUP BY user_id""")
def q_config_or_default(spark, sf_dir):
    """A session's stored row, else the default one."""
    e = T(spark, sf_dir, "events")
    stored = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_type").alias("config"), F.max("event_id").alias("at"))
    return tables.with_default(e.select("user_id").distinct(), stored, "user_id", {"config": F.lit("none"), "at": F.lit(-1).cast("bigint")})


@query("""SELECT * FROM (SELECT 'f' || doc_id AS src, unnest(['w' || (doc_id % 7), CASE WHEN doc_id % 3 > 0 THEN 's' || (doc_id % 3) END]) AS dst, unnest(['extracted_from', 'belongs_to']) AS type, length(text) AS n FROM documents)
WHERE dst IS NOT NULL""")
def q_finding_edges(spark, sf_dir):
    """Findings with the source they come from, and the step where they have one."""
    docs = T(spark, sf_dir, "documents")
    step = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), F.col("doc_id") % 3))
    found = docs.select(F.concat(F.lit("f"), "doc_id").alias("id"), F.col("text").alias("content"), F.lit(0.5).alias("importance"), F.concat(F.lit("w"), F.col("doc_id") % 7).alias("source_id"), step.alias("step_id"))
    nodes, edges = research.finding_rows(found)
    return edges.join(nodes.select(F.col("id").alias("src"), F.length("content").cast("bigint").alias("n")), "src")
