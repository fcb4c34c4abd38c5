"""Registered queries over what comes in and is stored: files, providers, histories, findings, evaluations, inserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from atomloom import schemas
from atomloom.config import INSTRUCTION_VERBS
from atomloom.functions import messy_json, prompts, search_text, text, urls
from atomloom.operators import chunking, graph, judge, research, retrieval, sessions, tables
from atomloom.plans import fixtures as fx
from atomloom.plans.registry_base import Registry
from atomloom.sources import files, providers, sinks
from atomloom.streaming import progress

query = Registry()
T = fx.table

SUFFIXES = ["TXT", "md", "pdf", "docx", "pptx", "jpeg", "ogg", "mkv", "tsv", "xls", "zip"]


def _picked(values: list[str], by: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(by) % len(values) + 1).cast("int"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(f"SELECT doc_id, ({_list(['text', 'text', 'pdf', 'docx', 'pptx', 'image', 'audio', 'video', 'csv', 'excel'])})[doc_id % {len(SUFFIXES)} + 1] AS kind, doc_id || '.x.' || ({_list(SUFFIXES)})[doc_id % {len(SUFFIXES)} + 1] AS name FROM documents")
def q_file_kinds(spark, sf_dir):
    path = F.concat(F.lit("/in/"), "source", F.lit("/"), "doc_id", F.lit(".x."), _picked(SUFFIXES, "doc_id"))
    return T(spark, sf_dir, "documents").select("doc_id", files.kind_of(path).alias("kind"), files.file_name(path).alias("name"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'youtube' ELSE 'web' END AS kind, CASE WHEN page_id % 3 = 1 THEN 'https://arxiv.org/pdf/' || page_id || '.pdf' WHEN page_id % 3 = 0 THEN 'https://youtu.be/' || page_id ELSE url END AS target FROM pages""")
def q_url_kinds(spark, sf_dir):
    p = F.col("page_id")
    u = F.when(p % 3 == 0, F.concat(F.lit("https://youtu.be/"), p)).when(p % 3 == 1, F.concat(F.lit("https://arxiv.org/abs/"), p)).otherwise(F.col("url"))
    return T(spark, sf_dir, "pages").select("page_id", urls.kind(u).alias("kind"), urls.arxiv_pdf(u).alias("target"))


@query("SELECT doc_id AS video_id, CAST(k AS BIGINT) AS frame, k * 5.0::DOUBLE AS at FROM (SELECT doc_id, unnest(range(0, CAST(ceil((doc_id % 47) * 0.75::DOUBLE / 5) AS BIGINT))) AS k FROM documents)")
def q_frame_times(spark, sf_dir):
    videos = T(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), ((F.col("doc_id") % 47) * 0.75).alias("duration"))
    return chunking.frame_times(videos).select("video_id", F.col("frame").cast("bigint").alias("frame"), "at")


@query("""SELECT conv_id AS audio_id, CAST(turn AS BIGINT) AS idx, text AS content, 'fine' AS resolution, CAST(conv_id * 1000 + turn * 10 AS DOUBLE) AS ts, 7.5::DOUBLE AS duration FROM conversations
UNION ALL SELECT conv_id, -1, string_agg(text, ' ' ORDER BY turn), 'coarse', CAST(conv_id * 1000 AS DOUBLE), max(turn) * 10 + 7.5 FROM conversations GROUP BY conv_id""")
def q_transcripts(spark, sf_dir):
    start = F.col("turn") * 10.0
    s = T(spark, sf_dir, "conversations").select(F.col("conv_id").alias("audio_id"), F.col("turn").cast("bigint").alias("idx"), start.alias("start"), (start + 7.5).alias("stop"), "text", (F.col("conv_id") * 1000.0).alias("ts"))
    return files.transcripts(s)


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT vec_id * 3 FROM embeddings WHERE vec_id % 20 = 0)")
def q_by_keys(spark, sf_dir):
    keys = T(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select((F.col("vec_id") * 3).alias("k"))
    return tables.by_keys(T(spark, sf_dir, "documents"), keys, "doc_id", "k").select("doc_id", "source")


@query("SELECT event_id, event_type FROM events ORDER BY ts, event_id LIMIT 100")
def q_oldest(spark, sf_dir):
    return sessions.oldest(T(spark, sf_dir, "events"), 100, ("ts", "event_id")).select("event_id", "event_type")


@query("SELECT item_id AS query_id, text AS sub_query, CASE WHEN item_id % 3 = 0 THEN 'image,table' ELSE 'text' END AS modalities, 1.0::DOUBLE AS intent_weight, CAST(2 AS BIGINT) AS depth FROM benchmark")
def q_decomposed(spark, sf_dir):
    named = F.when(F.col("item_id") % 3 == 0, F.array(F.lit("image"), F.lit("table"))).when(F.col("item_id") % 3 == 1, F.array().cast("array<string>"))
    got = retrieval.decomposed(T(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", named.alias("modalities")))
    return got.withColumn("modalities", F.array_join("modalities", ",")).withColumn("depth", F.col("depth").cast("bigint"))


@query("""SELECT doc_id % 400 AS message_id, CAST(max_by(CASE WHEN doc_id % 3 = 0 THEN 8 ELSE 5 END, doc_id) AS DOUBLE) AS relevance, 5.0::DOUBLE AS safety, 'fair' AS verdict, max_by(substring(text, 1, 2000), doc_id) AS response
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) GROUP BY doc_id % 400""")
def q_evaluations(spark, sf_dir):
    d = T(spark, sf_dir, "documents").select((F.col("doc_id") % 400).alias("message_id"), F.when(F.col("doc_id") % 3 == 0, 8).alias("relevance"), F.col("text").alias("response"), F.col("doc_id").alias("updated_at"))
    rows = judge.evaluation_rows(d)
    return tables.upsert(rows.limit(0), rows, ["message_id"], "updated_at").select("message_id", "relevance", "safety", "verdict", "response")


@query("SELECT item_id AS session_id, CASE WHEN item_id % 4 IN (0, 1) THEN NULL ELSE CAST(item_id AS BIGINT) END AS depth, CAST(CASE WHEN item_id % 4 IN (0, 1) THEN 0 ELSE item_id % 4 END AS BIGINT) AS n_steps FROM benchmark")
def q_research_sessions(spark, sf_dir):
    i = F.col("item_id")
    raw = F.when(i % 4 == 0, F.lit("{broken")).when(i % 4 > 1, F.concat(F.lit('{"depth": '), i, F.lit(', "steps": ['), F.array_join(F.transform(F.sequence(F.lit(1).cast("bigint"), i % 4), lambda k: F.concat(F.lit('"s'), k, F.lit('"'))), ", "), F.lit("]}")))
    got = T(spark, sf_dir, "benchmark").select(i.alias("session_id"), tables.json_column(raw, "struct<depth:bigint,steps:array<string>>").alias("c"))
    return got.select("session_id", F.col("c.depth").alias("depth"), F.size(F.coalesce("c.steps", F.array().cast("array<string>"))).cast("bigint").alias("n_steps"))


_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {fx.strip_sql('x')}), lambda x: NOT regexp_full_match(x, '[0-9]{{1,3}}|[-_=]{{3,}}'))"


@query(rf"SELECT doc_id, {fx.strip_sql(rf"regexp_replace(regexp_replace(array_to_string({_LINES}, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g')")} AS content FROM (SELECT doc_id, ' 12 ' || chr(10) || '----' || chr(10) || text || chr(10) || doc_id || chr(10) AS text FROM documents)")
def q_clean_pdf_text(spark, sf_dir):
    paged = F.concat(F.lit(" 12 \n----\n"), "text", F.lit("\n"), "doc_id", F.lit("\n"))
    return T(spark, sf_dir, "documents").select("doc_id", text.clean_pdf_text(paged).alias("content"))


COMMANDS = ["Please search the web for ", "search for ", "FIND ", "please  google ", "finder "]


@query(f"SELECT item_id, {fx.strip_sql('CASE WHEN item_id % 5 = 4 THEN ' + chr(39) + 'finder ' + chr(39) + ' || text ELSE text END')} AS q FROM benchmark")
def q_strip_command(spark, sf_dir):
    return T(spark, sf_dir, "benchmark").select("item_id", search_text.strip_command(F.concat(_picked(COMMANDS, "item_id"), "text")).alias("q"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'New Chat' ELSE 'Note ' || doc_id || ' On Things' || CASE WHEN doc_id % 4 = 2 THEN ' That Were' ELSE '' END END AS title FROM documents""")
def q_titles(spark, sf_dir):
    d = F.col("doc_id")
    raw = F.when(d % 4 == 3, " # ").otherwise(F.concat(F.when(d % 4 == 0, "Title: \"").when(d % 4 == 1, " chat title: **").otherwise(""), F.lit("note "), d, F.lit(" on things"), F.when(d % 4 == 0, "\"").when(d % 4 == 1, "**").otherwise(" that were said in here today")))
    return T(spark, sf_dir, "documents").select("doc_id", text.title(raw).alias("title"))


@query("""SELECT doc_id, regexp_replace(text, '[^\\p{L}\\p{N}_-]', '_', 'g') AS safe, CASE WHEN length(text) > 8 THEN left(text, 4) || '...' || right(text, 4) ELSE '****' END AS masked, CASE WHEN length(source) > 8 THEN left(source, 4) || '...' || right(source, 4) ELSE '****' END AS masked_source FROM documents""")
def q_keys(spark, sf_dir):
    """Whole texts as safe keys, and texts and sources masked like keys."""
    return T(spark, sf_dir, "documents").select("doc_id", text.safe_key(F.col("text")).alias("safe"), text.masked(F.col("text")).alias("masked"), text.masked(F.col("source")).alias("masked_source"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 4 THEN NULL WHEN 3 THEN '[' || doc_id || ', 2]' ELSE '{"a": ' || doc_id || ', "b": "x"}' END AS json FROM documents""")
def q_json_in_text(spark, sf_dir):
    d = F.col("doc_id")
    raw = (
        F.when(d % 5 == 0, F.concat(F.lit('Sure:\n```json\n{"b": "x", "a": '), d, F.lit(",}\n```"))).when(d % 5 == 1, F.concat(F.lit("so {'a': "), d, F.lit(", 'b': 'x'} it is")))
        .when(d % 5 == 2, F.concat(F.lit('[see: {"a": '), d, F.lit(', "b": "x"}'))).when(d % 5 == 3, F.concat(F.lit("["), d, F.lit(", 2,]"))).otherwise("nothing here")
    )
    return T(spark, sf_dir, "documents").select("doc_id", messy_json.json_in(raw).alias("json"))


_STYLE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in prompts.STYLES.items())


@query(f"""SELECT item_id, 'You answer from a knowledge base and cite its sources. ' || CASE ({_list([*prompts.STYLES, 'other'])})[item_id % {len(prompts.STYLES) + 1} + 1] {_STYLE} ELSE '{prompts.STYLES['explanatory']}' END AS system,
CASE WHEN item_id % 2 = 0 THEN 'Memory:' || chr(10) || 'm' || item_id || chr(10) || chr(10) ELSE '' END || 'Evidence:' || chr(10) || text || chr(10) || chr(10) || 'Question: q' || item_id AS prompt FROM benchmark""")
def q_prompts(spark, sf_dir):
    i = F.col("item_id")
    memory = F.when(i % 2 == 0, F.concat(F.lit("m"), i))
    return T(spark, sf_dir, "benchmark").select("item_id", prompts.system(_picked([*prompts.STYLES, "other"], "item_id")).alias("system"), prompts.user(F.concat(F.lit("q"), i), F.col("text"), memory).alias("prompt"))


@query(f"SELECT doc_id, len({fx.words_sql('text')}) > 6 AND len(list_filter({_list(INSTRUCTION_VERBS)}, lambda v: contains(lower(text), v))) > 0 AS asks FROM documents")
def q_conversational(spark, sf_dir):
    return T(spark, sf_dir, "documents").select("doc_id", search_text.conversational(F.col("text")).alias("asks"))


@query(f"""SELECT doc_id AS unit_id, CAST(k AS BIGINT) AS pos, {fx.strip_sql('line')} AS content, 'fact' AS extraction_type, least(1.0, greatest(0.0, k / 4.0::DOUBLE - 0.25)) AS importance
FROM (SELECT doc_id, unnest(lines[1:10]) AS line, generate_subscripts(lines[1:10], 1) - 1 AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)) WHERE length({fx.strip_sql('line')}) >= 20""")
def q_valid_findings(spark, sf_dir):
    one = lambda x, i: F.struct(x.alias("content"), F.lit(None).cast("string").alias("extraction_type"), (i / 4 - 0.25).alias("importance"))
    found = F.transform(F.split("text", "\n"), one)
    got = research.valid_findings(T(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), found.alias("findings")))
    return got.withColumn("pos", F.col("pos").cast("bigint"))


@query("""SELECT step_id, string_agg('[' || k || '] (type: fact, importance: ' || (doc_id % 11 // 10) || '.' || (doc_id % 11 % 10) || ', source: ' || CASE WHEN doc_id % 2 = 0 THEN source ELSE 'http://x/' || doc_id END || ')' || chr(10) || '    ' || content, chr(10) || chr(10) ORDER BY k) AS findings
FROM (SELECT *, doc_id // 10 AS step_id, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) AS k, coalesce(text, '') AS content FROM documents) GROUP BY step_id""")
def q_findings_text(spark, sf_dir):
    d = F.col("doc_id")
    rows = T(spark, sf_dir, "documents").select(F.floor(d / 10).alias("step_id"), d.alias("pos"), F.col("text").alias("content"), F.lit("fact").alias("extraction_type"), ((d % 11) / 10).alias("importance"), F.when(d % 2 == 0, F.col("source")).otherwise("").alias("source_title"), F.concat(F.lit("http://x/"), d).alias("source_url"))
    return research.findings_text(rows)


def _runs(spark, sf_dir):
    docs = T(spark, sf_dir, "documents")
    one = F.struct(F.concat(F.lit("http://x/"), "doc_id").alias("url"), F.col("lang").alias("title"), (F.col("doc_id") / 2).alias("score"))
    return docs.select(F.col("doc_id").alias("run_id"), F.concat(F.lit("c"), "doc_id").alias("session_id"), (F.col("doc_id") % 3).alias("turn_index"), F.col("source").alias("query"), F.col("text").alias("report"), F.array(one).alias("sources"))


@query("SELECT 'c' || doc_id AS session_id, doc_id % 3 AS turn_index, source AS user_query, 'http://x/' || doc_id AS sources, 'deep_research' AS algorithms, coalesce(substring(text, 1, 300), '') AS answer FROM documents")
def q_run_traces(spark, sf_dir):
    t = research.run_rows(_runs(spark, sf_dir))[0]
    return t.select("session_id", "turn_index", "user_query", F.array_join("sources", ",").alias("sources"), F.array_join("algorithms", ",").alias("algorithms"), "answer")


@query("SELECT 'c' || doc_id AS session_id, doc_id % 3 AS turn_index, 'deep_research' AS provider, source AS query_sent, 'http://x/' || doc_id AS url, lang AS title, doc_id / 2 AS score, '' AS snippet FROM documents")
def q_run_web_log(spark, sf_dir):
    return research.run_rows(_runs(spark, sf_dir))[1]


@query("SELECT md5('c' || doc_id || '|' || doc_id) AS fragment_id, 'Deep Research: ' || source || chr(10) || chr(10) || coalesce(substring(text, 1, 1000), '') AS content, 'deep_research,' || doc_id AS tags, 'global' AS namespace, 0.8::DOUBLE AS importance FROM documents")
def q_run_fragments(spark, sf_dir):
    f = research.run_rows(_runs(spark, sf_dir))[2]
    return f.select("fragment_id", "content", F.array_join("tags", ",").alias("tags"), "namespace", "importance")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '[none]' ELSE source END AS content FROM documents WHERE doc_id % 4 <> 0")
def q_real_syntheses(spark, sf_dir):
    return research.real_syntheses(T(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "[none]").otherwise(F.col("source")).alias("content")))


@query("SELECT doc_id, doc_id % 12 BETWEEN 1 AND 10 AND doc_id % 7 <> 0 AND doc_id % 13 BETWEEN 1 AND 10 AS valid FROM labels")
def q_judge_valid(spark, sf_dir):
    d = F.col("doc_id")
    cols = {"relevance": d % 12, "accuracy": F.when(d % 7 != 0, d % 7), "helpfulness": d % 13}
    return T(spark, sf_dir, "labels").select("doc_id", judge.valid(cols).alias("valid"))


@query(f"WITH {fx.EDGES_SQL}, own AS (SELECT doc_id FROM documents WHERE doc_id % 3 = 1) SELECT src, dst, edge_type FROM edges WHERE src IN (SELECT doc_id FROM own) AND dst IN (SELECT doc_id FROM own)")
def q_session_subgraph(spark, sf_dir):
    own = T(spark, sf_dir, "documents").where("doc_id % 3 = 1").select(F.col("doc_id").alias("atom_id"))
    return graph.between(fx.edges(spark, sf_dir), own).select("src", "dst", "edge_type")


@query("SELECT item_id, 'alpha' AS provider, 'a' || item_id AS result FROM benchmark UNION ALL SELECT item_id, 'beta', CASE WHEN item_id % 2 = 0 THEN 'b' || item_id END FROM benchmark")
def q_zipped(spark, sf_dir):
    i = F.col("item_id")
    got = T(spark, sf_dir, "benchmark").select(i, F.array(F.lit("alpha"), F.lit("beta")).alias("p"), F.array(F.concat(F.lit("a"), i), F.when(i % 2 == 0, F.concat(F.lit("b"), i))).alias("r"))
    return got.select("item_id", F.inline(sessions.zipped(F.col("p"), F.col("r")))).select("item_id", "provider", F.col("results").alias("result"))


@query("SELECT event_id, round(0.4 * (event_id % 2) + 0.3 * (event_id % 5) / 4 + 0.3 * (event_id % 3) / 2, 9) AS reward FROM events")
def q_reward(spark, sf_dir):
    e = F.col("event_id")
    return T(spark, sf_dir, "events").select("event_id", F.round(retrieval.reward((e % 2).cast("double"), (e % 5) / 4, (e % 3) / 2), 9).alias("reward"))


@query("SELECT md5(coalesce(source, '') || '|fine|' || doc_id || '|' || coalesce(lang, '')) AS atom_id, doc_id FROM documents")
def q_insert_ids(spark, sf_dir):
    d = T(spark, sf_dir, "documents")
    rows = sinks.with_ids(d.select("doc_id", "source", F.lit("fine").alias("resolution"), F.col("doc_id").alias("ts"), F.col("lang").alias("content")))
    return rows.select("atom_id", "doc_id")


@query(f"WITH {fx.FRAGMENTS_SQL}, gone AS (SELECT fragment_id FROM fragments WHERE session_id = 's7'), e AS (SELECT fragment_id AS src, 'f-' || (access_count % 20) || '-click' AS dst FROM fragments) SELECT src, dst FROM e WHERE src NOT IN (SELECT fragment_id FROM gone) AND dst NOT IN (SELECT fragment_id FROM gone)")
def q_delete_fragments(spark, sf_dir):
    f = fx.fragments(spark, sf_dir)
    e = f.select(F.col("fragment_id").alias("src"), F.concat(F.lit("f-"), F.col("access_count") % 20, F.lit("-click")).alias("dst"))
    return tables.delete_fragments(f, e, f.where("session_id = 's7'"))[1]


@query("SELECT conv_id AS chat_id, CASE WHEN conv_id % 3 = 0 THEN 'Chat ' || conv_id ELSE 'New Chat' END AS title, 'default' AS namespace FROM (SELECT DISTINCT conv_id FROM conversations)")
def q_new_chats(spark, sf_dir):
    c = T(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat_id")).distinct().withColumn("title", F.when(F.col("chat_id") % 3 == 0, F.concat(F.lit("Chat "), "chat_id")))
    return tables.with_defaults(c, {"title": F.lit("New Chat"), "namespace": F.lit("default")})


@query(f"WITH {fx.FRAGMENTS_SQL} SELECT fragment_id AS src, 'd' || x AS dst, 'extracted_from' AS edge_type, 1.0::DOUBLE AS weight FROM (SELECT fragment_id, unnest([access_count, access_count + 1]) AS x FROM fragments)")
def q_dual_edges(spark, sf_dir):
    related = F.transform(F.array(F.col("access_count"), F.col("access_count") + 1), lambda x: F.concat(F.lit("d"), x))
    f = fx.fragments(spark, sf_dir).withColumn("related_ids", related).withColumn("embedding", F.array(F.lit(1.0)))
    return tables.dual(f)[1]


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE source END AS source, lang FROM documents")
def q_update_columns(spark, sf_dir):
    d = T(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return tables.update_columns(d, F.col("doc_id") % 2 == 0, {"source": F.lit("x"), "lang": F.lit("y"), "other": F.lit(1)}, {"source", "other"})


@query(f"WITH {fx.RESEARCH_SQL} SELECT id, type, depth FROM nodes")
def q_graph_round_trip(spark, sf_dir):
    nodes, edges = fx.research(spark, sf_dir)
    return research.graph_from_json(research.graph_json(nodes, edges), "id string, type string, depth bigint", "src string, dst string, type string")[0]


@query(f"WITH {fx.RESEARCH_SQL} SELECT src, dst, type FROM redges WHERE type = 'synthesized_from' AND src IN (SELECT 's' || item_id FROM benchmark WHERE item_id % 20 = 0)")
def q_out_edges(spark, sf_dir):
    asked = T(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.concat(F.lit("s"), "item_id").alias("id"))
    return tables.by_keys(fx.research(spark, sf_dir)[1].where("type = 'synthesized_from'"), asked, "src", "id")


@query("SELECT event_id AS event_index, CAST(user_id AS VARCHAR) AS session_id, event_type, CAST(NULL AS VARCHAR) AS payload FROM events")
def q_evolved(spark, sf_dir):
    old = T(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("EVENT_INDEX"), "event_type", "value")
    return schemas.evolve(old, schemas.PROGRESS).select("session_id", "event_index", "event_type", "payload")


@query("SELECT event_id, user_id AS session_id FROM events WHERE event_id > 100 AND user_id % 20 = 0")
def q_poll(spark, sf_dir):
    e = progress.after_cursor(T(spark, sf_dir, "events"), 100, "event_id")
    return tables.by_keys(e, e.where("user_id % 20 = 0"), "user_id", "user_id").select("event_id", F.col("user_id").alias("session_id"))


_ANSWERS = ["list", "blocks", "links", "encyclopedia", "metasearch", "list"]
_PARSERS = {"list": providers.list_items, "blocks": providers.result_blocks, "links": providers.redirect_links, "encyclopedia": providers.encyclopedia_json, "metasearch": providers.metasearch_json}
_ABOUT = "A short passage about the number {i} that is long enough to be taken"


def _answer(provider: str) -> tuple[str, str, str]:
    """(before, for each result, after) of a provider's answer; {i} stands for the result's number."""
    return {
        "list": ("<ol>", '<li class="b_algo x"><h2><a class="k" href="http://x.org/{i}">No. <b>{i}</b> &amp; more</a></h2><div class="b_caption"><p>' + _ABOUT + "</p></div></li>", '<li class="b_ad"><h2><a href="http://ad">ad</a></h2></li></ol>'),
        "blocks": ("<div>", '<div class="result x"><h2 class="result__title"><a class="result__a" href="http://x.org/{i}">No. {i} &amp; more</a></h2><a class="result__snippet" href="#">' + _ABOUT + "</a></div>", '<div class="results_end"></div></div>'),
        "links": ('<a href="/url?q=http://google.com/x&a">own</a>', '<a href="/url?q=http%3A%2F%2Fx.org%2F{i}&sa=U">No. {i} <i>&amp; more</i></a><span>' + _ABOUT + "</span>", ""),
        "encyclopedia": ('{"query": {"search": [', '{"title": "No. {i} & more", "snippet": "A short <span class=\\"searchmatch\\">passage</span> about the number {i} that is long enough to be taken", "timestamp": "t{i}"}, ', '{"title": "last"}]}}'),
        "metasearch": ('{"results": [', '{"title": "No. {i} & more", "url": "http://x.org/{i}", "content": "' + _ABOUT + '", "publishedDate": "t{i}"}, ', '{"title": "last", "url": "u"}]}'),
    }[provider]


@query(f"""SELECT page_id, provider, CAST(k AS BIGINT) AS pos, 'No. ' || i || ' & more' AS title, CASE provider WHEN 'encyclopedia' THEN 'https://en.wikipedia.org/wiki/No._' || i || '_&_more' ELSE 'http://x.org/' || i END AS url,
{' || '.join(repr(x) for x in _ABOUT.split('{i}')).replace(' || ', ' || i || ')} AS snippet, CASE WHEN provider IN ('encyclopedia', 'metasearch') THEN 't' || i END AS date
FROM (SELECT page_id, ({_list(_ANSWERS)})[page_id % 6 + 1] AS provider, unnest(range(0, CASE page_id % 6 WHEN 5 THEN 0 WHEN 0 THEN 6 WHEN 3 THEN 5 WHEN 4 THEN 5 ELSE 8 END)) AS k, page_id * 100 + k AS i FROM pages)""")
def q_provider_results(spark, sf_dir):
    p = T(spark, sf_dir, "pages").select("page_id", _picked(_ANSWERS, "page_id").alias("provider"))
    body = F.lit(None).cast("string")
    for name in _PARSERS:
        before, each, after = (F.lit(x) for x in _answer(name))
        filled = [F.replace(each, F.lit("{i}"), (F.col("page_id") * 100 + k).cast("string")) for k in range(10)]
        made = F.concat(*filled)
        body = F.when(F.col("provider") == name, F.concat(before, made, after)).otherwise(body)
    answers = p.withColumn("body", F.when(F.col("page_id") % 6 != 5, body))
    return providers.result_rows(answers, _PARSERS).withColumn("pos", F.col("pos").cast("bigint"))
