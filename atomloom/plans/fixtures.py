"""Tables that the registered queries derive from the base tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.operators import graph, postings, vector
from atomloom.session import materialize

AS_OF = "2024-04-15 00:00:00"
BLANK_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
THRESHOLD = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strip_sql(x: str) -> str:
    return f"trim({x}, {BLANK_SQL})"


def words_sql(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '[ \t\n\r\v\f]+'), lambda w: w <> '')"


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ten neighbours of each vector with a cosine of 0.3 or more."""
    return vector.knn(table(spark, sf_dir, "embeddings"), 10, THRESHOLD)


NORMED_SQL = "n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings)"
KNN_SQL = f"""{NORMED_SQL},
sims AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_inner_product(a.v, b.v) / (a.norm * b.norm) AS cos FROM n AS a JOIN n AS b ON a.vec_id <> b.vec_id),
knn AS (SELECT src, dst, least(cos, 1.0) AS weight FROM sims WHERE cos >= {THRESHOLD}
        QUALIFY row_number() OVER (PARTITION BY src ORDER BY cos DESC, dst) <= 10)"""


def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIMILAR_TO edges: neighbours, written once, and the reversed copies."""
    return graph.reversed_too(materialize(knn(spark, sf_dir), "knn").select(*graph.edge("src", "dst", "SIMILAR_TO", F.col("weight"))))


def following(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NEXT edges between documents of a source by id, a minute apart for each step of the id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("doc_id") * 60.0).alias("ts"))
    return graph.next_edges(docs, ("source",), "ts", "doc_id")


NEXT_SQL = "next_e AS (SELECT doc_id AS src, nxt AS dst, 'NEXT' AS edge_type, exp(-(nxt - doc_id) * 60.0 / 3600.0) AS weight FROM (SELECT doc_id, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS nxt FROM documents) WHERE nxt IS NOT NULL)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity (one direction) and NEXT edges, each with an id that its ends and type give; written once, as walks read them often."""
    rows = knn(spark, sf_dir).select(*graph.edge("src", "dst", "SIMILAR_TO", F.col("weight"))).unionByName(following(spark, sf_dir))
    return materialize(rows.withColumn("edge_id", F.col("src") * 10_000_000 + F.col("dst") * 10 + F.when(F.col("edge_type") == "NEXT", 1).otherwise(0)), "graph")


EDGES_SQL = f"""{KNN_SQL}, {NEXT_SQL},
edges AS (SELECT src, dst, edge_type, weight, src * 10000000 + dst * 10 + CASE WHEN edge_type = 'NEXT' THEN 1 ELSE 0 END AS edge_id
          FROM (SELECT src, dst, 'SIMILAR_TO' AS edge_type, weight FROM knn UNION ALL SELECT * FROM next_e))"""


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a vector as atoms; the resolution follows from the id."""
    docs, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    res = F.element_at(F.array(F.lit("fine"), F.lit("mid"), F.lit("coarse")), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = docs.join(e, docs["doc_id"] == e["vec_id"])
    modality = F.element_at(F.array(*[F.lit(m) for m in ("text", "image", "audio", "table")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return rows.select(F.col("doc_id").alias("atom_id"), F.col("text").alias("content"), modality.alias("modality"), res.alias("resolution"), "source", "embedding")


ATOMS_SQL = """atoms AS (SELECT doc_id AS atom_id, text AS content, (['text', 'image', 'audio', 'table'])[doc_id % 4 + 1] AS modality,
          (['fine', 'mid', 'coarse'])[doc_id % 3 + 1] AS resolution, source, CAST(embedding AS DOUBLE[]) AS v,
          sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm
          FROM documents JOIN embeddings ON doc_id = vec_id)"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth benchmark item as a query; a query's vector is that of its id. The text is two words of its item."""
    b, e = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0"), table(spark, sf_dir, "embeddings")
    words = F.slice(F.split(F.lower("text"), r"[^a-zà-ÿ]+"), 2, 2)
    rows = b.join(e, b["item_id"] == e["vec_id"])
    return rows.select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("text"), "embedding", F.array(F.lit("text")).alias("modalities"))


QUERIES_SQL = """queries AS (SELECT item_id AS query_id, array_to_string(string_split_regex(lower(text), '[^a-zà-ÿ]+')[2:3], ' ') AS text,
            CAST(embedding AS DOUBLE[]) AS v, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm
            FROM benchmark JOIN embeddings ON item_id = vec_id WHERE item_id % 20 = 0)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword queries: two words of every twentieth benchmark item."""
    words = F.slice(F.split(F.lower("text"), r"[^a-zà-ÿ]+"), 2, 2)
    return table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("text"))


ASKED_SQL = "asked AS (SELECT item_id AS query_id, array_to_string(string_split_regex(lower(text), '[^a-zà-ÿ]+')[2:3], ' ') AS text FROM benchmark WHERE item_id % 20 = 0)"

_INDEXES: dict[tuple[str, str], postings.Index] = {}


def keyword_index(spark: SparkSession, sf_dir: str) -> postings.Index:
    """The index over all documents, built once in a session for each folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("atom_id"), F.col("text").alias("content"))
        _INDEXES[key] = postings.build(docs)
    return _INDEXES[key]


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two seeds for each query; every twentieth vector is a query."""
    q = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    return q.select(F.col("vec_id").alias("query_id"), F.explode(F.array(F.col("vec_id"), F.col("vec_id") + 3)).alias("seed"))


SEEDS_SQL = "seeds AS (SELECT vec_id AS query_id, unnest([vec_id, vec_id + 3]) AS seed FROM embeddings WHERE vec_id % 20 = 0)"


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory fragment for each user and event type."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("access_count"), F.min("ts").alias("created_at"), F.max("ts").alias("last_accessed"), F.min("event_id").alias("k"))
    return g.select(
        F.concat_ws("-", F.lit("f"), "user_id", "event_type").alias("fragment_id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_type").alias("content"),
        F.when(F.col("user_id") % 3 == 0, "global").otherwise(F.concat(F.lit("session_"), F.lit("s"), F.col("user_id").cast("string"))).alias("namespace"), ((F.col("k") % 10) / 100.0).alias("importance"),
        "access_count", "created_at", F.when(F.col("user_id") % 5 != 0, F.col("last_accessed")).alias("last_accessed"), (F.col("k") % 7 == 0).alias("is_deleted"),
    )


FRAGMENTS_SQL = """fragments AS (SELECT 'f-' || user_id || '-' || event_type AS fragment_id, 's' || user_id AS session_id, event_type AS content,
    CASE WHEN user_id % 3 = 0 THEN 'global' ELSE 'session_s' || user_id END AS namespace, (k % 10) / 100.0 AS importance, access_count, created_at,
    CASE WHEN user_id % 5 <> 0 THEN last_accessed END AS last_accessed, k % 7 = 0 AS is_deleted
    FROM (SELECT user_id, event_type, count(*) AS access_count, min(ts) AS created_at, max(ts) AS last_accessed, min(event_id) AS k FROM events GROUP BY ALL))"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results of three providers that overlap, with variants of the same URL."""
    p = table(spark, sf_dir, "pages")
    names = F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma"))
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    date = F.element_at(F.array(F.lit("2024-04-10"), F.lit("2024-03-20T10:00:00"), F.lit("January 5, 2024"), F.lit("2022-01-01"), F.lit("unknown")), (F.col("page_id") % 5 + 1).cast("int"))
    base = p.select(F.element_at(names, (F.col("page_id") % 3 + 1).cast("int")).alias("provider"), F.col("page_id").alias("pos"), title.alias("title"), "url", F.substring(title, 1, 40).alias("snippet"), date.alias("date"))
    again = base.where("pos % 2 = 0").withColumn("provider", F.lit("delta")).withColumn("url", F.concat(F.lit("https://www."), F.regexp_replace(F.regexp_replace("url", r"^https?://(www\.)?", ""), r"[?#].*$", ""), F.lit("?from=delta")))
    return base.unionByName(again)


RESULTS_SQL = r"""base AS (SELECT (['alpha', 'beta', 'gamma'])[page_id % 3 + 1] AS provider, page_id AS pos, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, url,
    substring(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), 1, 40) AS snippet,
    (['2024-04-10', '2024-03-20T10:00:00', 'January 5, 2024', '2022-01-01', 'unknown'])[page_id % 5 + 1] AS date FROM pages),
results AS (SELECT * FROM base UNION ALL SELECT 'delta', pos, title, 'https://www.' || regexp_replace(regexp_replace(url, '^https?://(www\.)?', ''), '[?#].*$', '') || '?from=delta', snippet, date FROM base WHERE pos % 2 = 0)"""


def research(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): pages are sources, documents findings, benchmark items syntheses over findings and each other."""
    sources = table(spark, sf_dir, "pages").select(F.concat(F.lit("w"), "page_id").alias("id"), F.lit("web_source").alias("type"), F.lit(0).cast("bigint").alias("depth"))
    n = table(spark, sf_dir, "pages").count()
    docs = table(spark, sf_dir, "documents")
    found = docs.select(F.concat(F.lit("f"), "doc_id").alias("id"), F.lit("finding").alias("type"), F.lit(0).cast("bigint").alias("depth"))
    items = table(spark, sf_dir, "benchmark")
    made = items.select(F.concat(F.lit("s"), "item_id").alias("id"), F.lit("synthesis").alias("type"), F.col("item_id").alias("depth"))
    e = docs.select(F.concat(F.lit("f"), "doc_id").alias("src"), F.concat(F.lit("w"), F.col("doc_id") * 3 % n).alias("dst"), F.lit("extracted_from").alias("type"))
    e = e.unionByName(items.select(F.concat(F.lit("s"), "item_id").alias("src"), F.explode(F.array(F.concat(F.lit("f"), "item_id"), F.concat(F.lit("f"), F.col("item_id") + 50))).alias("dst"), F.lit("synthesized_from").alias("type")))
    e = e.unionByName(items.where("item_id >= 2").select(F.concat(F.lit("s"), "item_id").alias("src"), F.concat(F.lit("s"), F.col("item_id") - 2).alias("dst"), F.lit("synthesized_from").alias("type")))
    return sources.unionByName(found).unionByName(made), e


RESEARCH_SQL = """nodes AS (SELECT 'w' || page_id AS id, 'web_source' AS type, CAST(0 AS BIGINT) AS depth FROM pages UNION ALL SELECT 'f' || doc_id, 'finding', 0 FROM documents
          UNION ALL SELECT 's' || item_id, 'synthesis', item_id FROM benchmark),
redges AS (SELECT 'f' || doc_id AS src, 'w' || (doc_id * 3 % (SELECT count(*) FROM pages)) AS dst, 'extracted_from' AS type FROM documents
           UNION ALL SELECT 's' || item_id, unnest(['f' || item_id, 'f' || (item_id + 50)]), 'synthesized_from' FROM benchmark
           UNION ALL SELECT 's' || item_id, 's' || (item_id - 2), 'synthesized_from' FROM benchmark WHERE item_id >= 2)"""
