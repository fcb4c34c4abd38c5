"""Registered queries over texts, URLs and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from atomloom.config import BLOCKED_PAGE_DOMAINS, FORCE_WEB, GATE_STOPWORDS, GENERIC_WORDS, INTENTS, PRIORITY_DOMAINS, STOPWORDS, URL_HINTS
from atomloom.functions import messy_json, search_text, text, urls
from atomloom.operators import chunking, websearch
from atomloom.plans.fixtures import strip_sql, table, words_sql
from atomloom.plans.registry_base import Registry
from atomloom.sources import files

query = Registry()


def any_of(x: str, phrases) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(x, p.replace("'", "''")) for p in phrases) + ")"


def listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


COLLAPSED = r"regexp_replace(regexp_replace({}, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g')"
LINES = strip_sql("x")


@query(f"""SELECT doc_id, idx, content FROM (SELECT doc_id, unnest(parts) AS content, generate_subscripts(parts, 1) - 1 AS idx
FROM (SELECT doc_id, list_filter(list_transform(string_split(text, '.'), lambda x: {LINES}), lambda x: x <> '') AS parts FROM documents)) WHERE length(content) > 10""")
def q_chunk_fine(spark, sf_dir):
    return chunking.sentences(table(spark, sf_dir, "documents")).select("doc_id", F.col("idx").cast("bigint").alias("idx"), "content")


@query(f"""SELECT doc_id, idx, content FROM (SELECT doc_id, unnest(parts) AS content, generate_subscripts(parts, 1) - 1 AS idx
FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {LINES}), lambda x: x <> '') AS parts FROM documents)) WHERE length(content) > 50""")
def q_chunk_mid(spark, sf_dir):
    return chunking.paragraphs(table(spark, sf_dir, "documents")).select("doc_id", F.col("idx").cast("bigint").alias("idx"), "content")


@query("SELECT doc_id, substring(text, 1, 5000) AS content FROM documents")
def q_chunk_coarse(spark, sf_dir):
    return chunking.whole(table(spark, sf_dir, "documents")).select("doc_id", "content")


@query(f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS sentence, content || '.' AS content
FROM (SELECT doc_id, unnest(parts) AS content, generate_subscripts(parts, 1) AS i
FROM (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), ' '), '.'), lambda x: {LINES}), lambda x: length(x) > 20) AS parts FROM documents))""")
def q_page_sentences(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").withColumn("page", F.lit(1))
    return chunking.page_sentences(pages).select("doc_id", F.col("sentence").cast("bigint").alias("sentence"), "content")


@query(f"""SELECT doc_id, idx, content FROM (SELECT doc_id, unnest(parts) AS content, generate_subscripts(parts, 1) - 1 AS idx FROM (SELECT doc_id,
list_transform(CASE WHEN len(string_split(text, chr(10) || chr(10))) <= 1 THEN list_filter(string_split(text, chr(10)), lambda x: length({LINES}) > 50) ELSE string_split(text, chr(10) || chr(10)) END, lambda x: {LINES}) AS parts
FROM documents)) WHERE length(content) > 50""")
def q_chunk_lines(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").withColumn("page", F.lit(1))
    return chunking.page_paragraphs(pages).select("doc_id", F.col("idx").cast("bigint").alias("idx"), "content")


@query("""SELECT doc_id, CAST(i AS BIGINT) AS idx, substring(text, CAST(i * 4000 + 1 AS BIGINT), CAST(least(4000, 20000 - i * 4000) AS BIGINT)) AS content
FROM documents, unnest(range(0, 5)) AS t(i) WHERE i * 4000 < least(length(text), 20000)""")
def q_chunk_windows(spark, sf_dir):
    return chunking.windows(table(spark, sf_dir, "documents")).select("doc_id", F.col("idx").cast("bigint").alias("idx"), "content")


@query()
def q_rlm_chunks(spark, sf_dir):
    return chunking.extraction_units(table(spark, sf_dir, "documents"), size=2000)


@query("""SELECT doc_id, CASE WHEN len(l) > 8 THEN l[1:3] || l[len(l) // 2 - 1:len(l) // 2 + 2] || l[len(l):len(l)] ELSE l END AS lines
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def q_chunk_sample(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", chunking.sampled(F.split("text", "\n")).alias("lines"))


@query(f"""SELECT doc_id, {strip_sql("array_to_string(list_filter(list_transform(string_split(" + COLLAPSED.format("text") + ", chr(10)), lambda x: " + LINES + "), lambda x: length(x) > 3 OR x = ''), chr(10))")} AS clean,
{strip_sql(COLLAPSED.format("array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: " + LINES + "), lambda x: NOT regexp_matches(x, '^[0-9]{1,3}$') AND NOT regexp_matches(x, '^[-_=]{3,}$')), chr(10))"))} AS pdf_clean FROM documents""")
def q_clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_text(F.col("text")).alias("clean"), text.clean_pdf_text(F.col("text")).alias("pdf_clean"))


@query(rf"""SELECT doc_id, CASE WHEN length(s) > 500 THEN substring(s, 1, 500) || '...' ELSE s END AS snippet,
CASE WHEN length(text) > 2000 THEN substring(text, 1, 2000) || chr(10) || chr(10) || '[Content truncated...]' ELSE text END AS capped, CAST(len({words_sql("text")}) AS BIGINT) AS n_words,
CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS preview, 'passage: ' || substring(text, 1, 2000) AS input, length(text) // 4 AS tokens
FROM (SELECT doc_id, text, {strip_sql("regexp_replace(text, '[ " + chr(92) + "t" + chr(92) + "n" + chr(92) + "r" + chr(92) + "v" + chr(92) + "f]+', ' ', 'g')")} AS s FROM documents)""")
def q_snippet(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(c).alias("snippet"), text.cap(c, 2000).alias("capped"), text.word_count(c).cast("bigint").alias("n_words"), text.preview(c).alias("preview"), text.embedding_input(c).alias("input"), text.estimated_tokens(c).alias("tokens"))


@query("""SELECT doc_id, CASE WHEN length(text) > 12000 THEN substring(text, 1, 1333) || chr(10) || chr(10) || '[... middle section of response ...]' || chr(10) || chr(10) || substring(text, length(text) // 2 - 666 + 1, 1333)
|| chr(10) || chr(10) || '[... end section of response ...]' || chr(10) || chr(10) || right(text, 1333) ELSE text END AS short FROM documents""")
def q_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.smart_truncate(F.col("text")).alias("short"))


@query(r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), chr(32) || chr(9) || chr(10) || chr(13)) AS title FROM pages""")
def q_html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_title(F.col("html")).alias("title"))


@query()
def q_html_text(spark, sf_dir):
    return files.pages_as_atoms(table(spark, sf_dir, "pages"))


@query(r"""SELECT page_id, rtrim(regexp_replace(rtrim(CASE WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN url ELSE 'https://' || url END, '/'), '[?&](utm_\w+|ref|source|fbclid|gclid)=[^&]*', '', 'g'), '?&') AS url FROM pages""")
def q_url_norm_scrape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.for_scraping(F.col("url")).alias("url"))


@query(r"""SELECT page_id, lower(split_part(split_part(regexp_replace(rtrim(url, '/'), '^https?://(www\.)?', ''), '?', 1), '#', 1)) AS url FROM pages""")
def q_url_norm_search(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.for_search(F.col("url")).alias("url"))


DOMAIN = r"replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', '')"


@query(f"SELECT page_id, {DOMAIN} AS domain, CASE WHEN contains(url, 'youtube.com') OR contains(url, 'youtu.be') THEN 'youtube' ELSE 'web' END AS kind FROM pages")
def q_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"), urls.kind(F.col("url")).alias("kind"))


VARIANTS_SQL = "v AS (SELECT page_id * 3 + k AS pos, CASE k WHEN 0 THEN replace(url, '.example.', '.example.') WHEN 1 THEN regexp_replace(url, '://([^/]+)/', '://\\1/de-de/') ELSE regexp_replace(url, '://([^/]+)/', '://\\1/en-us/') END AS url FROM pages, unnest([0, 1, 2]) AS t(k))"
LOCALE_SQL = urls.LOCALE.replace("(?i)", "").replace("(?=/|$)", "(/|$)")
KEY_SQL = rf"""lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) || lower(rtrim(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '{LOCALE_SQL}', '\3', 'gi'), '/'))"""


@query(rf"""WITH {VARIANTS_SQL}, k AS (SELECT pos, url, {KEY_SQL} AS content_key, {any_of("lower(url)", urls.ENGLISH)} AS en FROM v)
SELECT content_key, min(pos) AS pos, coalesce(arg_min(url, pos) FILTER (WHERE en), arg_min(url, pos)) AS url FROM k GROUP BY content_key""")
def q_url_dedup_locale(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    url = F.when(F.col("k") == 0, F.col("url")).when(F.col("k") == 1, F.regexp_replace("url", "://([^/]+)/", "://$1/de-de/")).otherwise(F.regexp_replace("url", "://([^/]+)/", "://$1/en-us/"))
    return websearch.without_locales(p.select((F.col("page_id") * 3 + F.col("k")).alias("pos"), url.alias("url")), "pos")


@query(f"SELECT page_id AS pos, url, CASE WHEN {any_of(f'lower({DOMAIN})', PRIORITY_DOMAINS)} THEN 10 WHEN {any_of('lower(url)', URL_HINTS)} THEN 5 ELSE 0 END AS priority, {any_of('lower(url)', URL_HINTS)} AS hinted FROM pages")
def q_url_priority(spark, sf_dir):
    return websearch.scrape_order(table(spark, sf_dir, "pages"), "page_id")


@query(f"SELECT page_id, url FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(url, 'example', 'reddit') ELSE url END AS url FROM pages) WHERE NOT {any_of(f'lower({DOMAIN})', BLOCKED_PAGE_DOMAINS)}")
def q_blocklist(spark, sf_dir):
    url = F.when(F.col("page_id") % 5 == 0, F.replace("url", F.lit("example"), F.lit("reddit"))).otherwise(F.col("url"))
    return websearch.scrapable(table(spark, sf_dir, "pages").select("page_id", url.alias("url")))


TOKENS_SQL = rf"list_filter({words_sql('regexp_replace(lower({0}), ' + chr(39) + '[^a-z0-9 ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r' + chr(92) + 'v' + chr(92) + 'f]' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, lambda w: length(w) > 1 AND NOT list_contains({listed(STOPWORDS)}, w))"


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS_SQL.replace('{0}', 'text')}) AS term FROM documents) GROUP BY ALL")
def q_tokens_tf(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(text.search_tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


GATE_QUERY = "thing of the onanst reading"
_CORE = f"list_distinct(list_filter(regexp_extract_all('{GATE_QUERY}', '[a-z]{{3,}}'), lambda w: NOT list_contains({listed(GATE_STOPWORDS)}, w)))"
_ALL = f"list_distinct(list_filter(regexp_extract_all('{GATE_QUERY} ' || lower(source), '[a-z]{{3,}}'), lambda w: NOT list_contains({listed(GATE_STOPWORDS)}, w)))"


@query(f"""SELECT doc_id, NOT ((len(core) > 0 AND length(text) >= 300 AND hit = 0) OR (len(every) >= 5 AND found / len(every) < 0.08)) AS relevant
FROM (SELECT doc_id, text, core, every, len(list_filter(core, lambda w: contains(lower(substring(text, 1, 12000)), w))) AS hit, len(list_filter(every, lambda w: contains(lower(substring(text, 1, 12000)), w))) AS found
FROM (SELECT doc_id, text, {_CORE} AS core, {_ALL} AS every FROM documents))""")
def q_relevance_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.relevant(F.col("text"), F.lit(GATE_QUERY), F.col("source")).alias("relevant"))


def _intent_sql() -> str:
    starts = " OR ".join("starts_with(q, '{}')".format(p.replace("'", "''")) for p in INTENTS["conversational"])
    rest = " ".join(f"WHEN {any_of('q', v)} THEN '{k}'" for k, v in list(INTENTS.items())[1:])
    return f"CASE WHEN {starts} THEN 'conversational' {rest} ELSE 'explanatory' END"


@query(f"SELECT conv_id, turn, {_intent_sql()} AS intent FROM (SELECT conv_id, turn, {strip_sql('lower(text)')} AS q FROM conversations WHERE role = 'user')")
def q_intent(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", search_text.intent(F.col("text")).alias("intent"))


@query(rf"""SELECT doc_id, CASE WHEN len(terms) = 0 OR len(list_filter(terms, lambda w: contains(lower(q), lower(w)))) > 0 THEN q ELSE array_to_string(terms[1:3], ' ') || ' ' || q END AS anchored
FROM (SELECT doc_id, 'survey of ' || source || ' methods' AS q, list_filter(regexp_extract_all(text, '[A-Za-z]{{4,}}'), lambda w: NOT list_contains({listed(GENERIC_WORDS)}, lower(w))) AS terms FROM documents)""")
def q_anchor(spark, sf_dir):
    q = F.concat(F.lit("survey of "), "source", F.lit(" methods"))
    return table(spark, sf_dir, "documents").select("doc_id", search_text.anchored(q, F.col("text")).alias("anchored"))


@query(rf"""SELECT doc_id, list_filter([CASE WHEN len(w) > 4 THEN array_to_string(w[1:4], ' ') END, CASE WHEN u <> '' AND u <> q AND length(u) > 5 THEN u END,
CASE WHEN NOT contains(lower(q), 'paper') AND NOT contains(lower(q), 'research') THEN q || ' research' END], lambda x: x IS NOT NULL)[1:2] AS queries
FROM (SELECT doc_id, q, {words_sql("q")} AS w, {strip_sql("regexp_replace(regexp_replace(q, '" + chr(92) + "b(20" + chr(92) + "d{2})" + chr(92) + "b', '', 'g'), '[ " + chr(92) + "t" + chr(92) + "n" + chr(92) + "r" + chr(92) + "v" + chr(92) + "f]+', ' ', 'g')")} AS u
FROM (SELECT doc_id, source || ' ' || lang || ' results ' || (2015 + doc_id % 12) || CASE WHEN doc_id % 2 = 0 THEN ' review paper' ELSE '' END AS q FROM documents))""")
def q_fallback_queries(spark, sf_dir):
    q = F.concat("source", F.lit(" "), "lang", F.lit(" results "), (2015 + F.col("doc_id") % 12).cast("string"), F.when(F.col("doc_id") % 2 == 0, " review paper").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", search_text.fallbacks(q).alias("queries"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'arxiv detection ' || source WHEN doc_id % 3 = 1 THEN 'tutorial ' || source ELSE 'attention neurips in ' || source END AS stripped,
CASE WHEN doc_id % 3 = 0 THEN 'detection ' || source || ' arxiv' WHEN doc_id % 3 = 1 THEN 'tutorial filetype:pdf ' || source ELSE 'attention in ' || source || ' neurips paper' END AS sanitized FROM documents""")
def q_query_sanitize(spark, sf_dir):
    q = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("site:arxiv.org detection "), "source")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("site:medium.com tutorial filetype:pdf "), "source")).otherwise(F.concat(F.lit("attention Site:neurips.cc in "), "source"))
    return table(spark, sf_dir, "documents").select("doc_id", search_text.strip_operators(q).alias("stripped"), search_text.sanitize(q).alias("sanitized"))


@query(rf"""SELECT conv_id, turn, CASE WHEN {any_of("lower(text)", FORCE_WEB)} THEN 'forced_web' WHEN turn = 0 THEN 'no_results' WHEN length({strip_sql("ev")}) < 100 THEN 'short_evidence'
WHEN len(list_filter(regexp_extract_all(text, '\b[A-Z][a-z]{{2,}}\b'), lambda w: NOT contains(lower(ev), lower(w)))) > 0 THEN 'missing_entity' WHEN turn / 10.0 < 0.7 THEN 'low_score' ELSE 'sufficient' END AS verdict
FROM (SELECT conv_id, turn, text, repeat(lower(text), CAST(turn % 4 AS BIGINT)) AS ev FROM conversations)""")
def q_sufficiency(spark, sf_dir):
    evidence = F.expr("repeat(lower(text), cast(turn % 4 as int))")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", search_text.sufficiency(F.col("text"), F.col("turn"), evidence, F.col("turn") / 10.0).alias("verdict"))


@query(f"SELECT n_nationkey AS idx, 'n_nationkey: ' || n_nationkey || ', n_name: ' || n_name || ', n_regionkey: ' || n_regionkey AS content FROM nation WHERE n_nationkey < 100")
def q_csv_row_text(spark, sf_dir):
    return files.csv_rows(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(messy_json.json_in(F.concat(F.lit("Here it is: "), "props", F.lit(" ok"))), "$.k").cast("bigint").alias("k"))
