"""Keyword scores, evidence fusion, diversity re-ranking and packing, for batches of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atomloom.config import RetrievalWeights, SearchConfig
from atomloom.functions.text import bm25_tokens
from atomloom.operators import graph, vector
from atomloom.session import materialize

K1, B, EPSILON = 1.5, 0.75, 0.25
MAX_TERMS = 5000


def decomposed(queries: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, sub_query, modalities, intent_weight, depth): without a model each query is its own only part.

    Modalities are text where the query names none.
    """
    wanted = F.col("modalities") if "modalities" in queries.columns else F.lit(None).cast("array<string>")
    modalities = F.when(F.coalesce(F.size(wanted), F.lit(0)) > 0, wanted).otherwise(F.array(F.lit("text")))
    return queries.select("query_id", F.col(text).alias("sub_query"), modalities.alias("modalities"), F.lit(1.0).alias("intent_weight"), F.lit(2).alias("depth"))


def restricted(atoms: DataFrame, sources: list[str] | None = None, modality: str | None = None, resolution: str | None = None) -> DataFrame:
    """The atoms of some sources, a modality and a resolution; None leaves all."""
    if sources is not None:
        atoms = atoms.where(F.col("source").isin(sources) if sources else F.lit(False))
    for column, value in (("modality", modality), ("resolution", resolution)):
        atoms = atoms if value is None else atoms.where(F.col(column) == value)
    return atoms


def asked_terms(queries: DataFrame) -> list[str] | None:
    """The distinct tokens of all queries, if they are few enough to be part of an expression."""
    terms = queries.select(F.explode(bm25_tokens(F.col("text"))).alias("term")).distinct().limit(MAX_TERMS + 1).collect()
    return sorted(r[0] for r in terms) if len(terms) <= MAX_TERMS else None


def of_queries(tokens: Column, terms: list[str] | None) -> Column:
    """The tokens that some query has; all of them where queries have too many, and the join with them decides."""
    return tokens if terms is None else F.filter(tokens, lambda t: t.isin(terms)) if terms else F.array().cast("array<string>")


def full_text(atoms: DataFrame, queries: DataFrame, limit: int | None = None, item: str = "atom_id", text: str = "content") -> DataFrame:
    """(query_id, item): atoms that hold all lower-case tokens of a query, over an inverted index; the first by id."""
    terms = queries.select("query_id", F.explode(F.array_distinct(bm25_tokens(F.col("text")))).alias("term"))
    wanted = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    index = atoms.select(item, F.explode(F.array_distinct(of_queries(bm25_tokens(F.col(text)), asked_terms(queries)))).alias("term"))
    hits = index.join(terms, "term").groupBy("query_id", item).agg(F.count(F.lit(1)).alias("n")).join(wanted, "query_id").where("n = wanted").select("query_id", item)
    return hits if limit is None else first_by_id(hits, limit, item)


def first_by_id(hits: DataFrame, limit: int, item: str = "atom_id") -> DataFrame:
    """The first ``limit`` hits of each query by id."""
    return hits.withColumn("__r", F.row_number().over(Window.partitionBy("query_id").orderBy(item))).where(F.col("__r") <= limit).drop("__r")


def bm25(hits: DataFrame, queries: DataFrame, item: str = "atom_id", text: str = "content") -> DataFrame:
    """(query_id, item, bm25): Okapi scores of each query's hits (query_id, item, content), the statistics being those hits.

    A negative idf becomes a quarter of the mean idf; a term of the query counts as often as it occurs there.
    """
    tokens = hits.select("query_id", item, bm25_tokens(F.col(text)).alias("w")).withColumn("dl", F.size("w"))
    corpus = tokens.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    tf = tokens.select("query_id", item, "dl", F.explode("w").alias("term")).groupBy("query_id", item, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df")).join(corpus, "query_id")
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df = df.withColumn("raw", raw).withColumn("mean", F.avg("raw").over(Window.partitionBy("query_id")))
    df = df.withColumn("idf", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")))
    asked = queries.select("query_id", F.explode(bm25_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = tf.join(asked, ["query_id", "term"]).join(df.select("query_id", "term", "idf", "avgdl"), ["query_id", "term"]).groupBy("query_id", item).agg(F.sum(part).alias("bm25"))
    return hits.select("query_id", item).join(scored, ["query_id", item], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))


def bm25_corpus(atoms: DataFrame, queries: DataFrame, k: int = 10, item: str = "atom_id", text: str = "content") -> DataFrame:
    """(query_id, item, bm25, rank): the best ``k`` of the whole corpus by its own statistics.

    One pass over the texts writes each one's length and the tokens that queries have; the rest works on these.
    """
    tokens = atoms.select(item, bm25_tokens(F.col(text)).alias("w")).select(item, F.size("w").alias("dl"), of_queries(F.col("w"), asked_terms(queries)).alias("w"))
    tokens = materialize(tokens, "query-tokens")
    stats = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    asked = queries.select("query_id", F.explode(bm25_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    wanted = asked.select("term").distinct()
    tf = tokens.select(item, "dl", F.explode("w").alias("term")).join(wanted, "term", "left_semi").groupBy(item, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(stats)).withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))  # stats is one row
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = tf.join(df.select("term", "idf", "avgdl"), "term").join(asked, "term").groupBy("query_id", item).agg(F.sum(part).alias("bm25"))
    best = Window.partitionBy("query_id").orderBy(F.desc("bm25"), item)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def min_max(scores: DataFrame, column: str, by: str = "query_id") -> DataFrame:
    """A query's scores from 0 to 1 if the best is over 0; all equal ones are 0; otherwise as they are."""
    w = Window.partitionBy(by)
    low, high = F.min(column).over(w), F.max(column).over(w)
    out = F.when(high <= 0, F.col(column)).when(high == low, 0.0).otherwise((F.col(column) - low) / (high - low))
    return scores.withColumn(column, out)


def modality_score(modality: Column, wanted: Column) -> Column:
    """1 for a wanted modality, .7 between text and image, video or audio, else .4."""
    media = ("image", "video", "audio")
    cross = (F.array_contains(wanted, "text") & modality.isin(*media)) | ((modality == "text") & F.exists(wanted, lambda w: w.isin(*media)))
    return F.when(F.array_contains(wanted, modality), 1.0).when(cross, 0.7).otherwise(0.4)


def graph_evidence(edges: DataFrame, seeds: DataFrame, config: SearchConfig = SearchConfig(), fast: bool = False, tolerance: float | None = 1e-6) -> DataFrame:
    """(query_id, node, score): .6 PageRank + .4 path weight of what two hops reach, without the seeds; the best ten."""
    reached = graph.traverse(edges, seeds, config.hops).join(seeds.select("query_id", F.col("seed").alias("node")), ["query_id", "node"], "left_anti")
    if fast:
        scored = reached.select("query_id", "node", F.col("path_weight").alias("score"))
    else:
        rank = graph.personalized_pagerank(edges, seeds, config.ppr_alpha, config.ppr_iterations, tolerance)
        scored = reached.join(rank.withColumnRenamed("score", "ppr"), ["query_id", "node"], "left").select("query_id", "node", (0.6 * F.coalesce("ppr", F.lit(0.0)) + 0.4 * F.col("path_weight")).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= config.top_k_graph)


def merged(vector_scores: DataFrame, graph_scores: DataFrame, keyword_scores: DataFrame) -> DataFrame:
    """(query_id, node, v, g, b) of three score tables (query_id, node, score); missing scores are 0.

    A long union and one aggregation instead of outer joins.
    """
    parts = [d.select("query_id", "node", "score", F.lit(k).alias("kind")) for k, d in (("v", vector_scores), ("g", graph_scores), ("b", keyword_scores))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("query_id", "node").agg(*[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ("v", "g", "b")])


def unified(candidates: DataFrame, weights: RetrievalWeights = RetrievalWeights()) -> DataFrame:
    """``score``: the weighted sum of v, g, b, s (structural) and m (modality)."""
    w = weights
    return candidates.withColumn("score", w.alpha * F.col("v") + w.beta * F.col("g") + w.gamma * F.col("b") + w.delta * F.col("s") + w.epsilon * F.col("m"))


def rrf(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, node, rank)."""
    rows = rankings[0].select("query_id", "node", "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select("query_id", "node", "rank"))
    return rows.groupBy("query_id", "node").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))


def mmr(candidates: DataFrame, k: int = 20, penalty: float = 0.25) -> DataFrame:
    """(query_id, node, rank, score): greedy choice by score less ``penalty`` times the summed cosine to those chosen.

    A query with ``k`` candidates or fewer keeps their order. Candidates (query_id, node, pos, score, embedding) are the
    few that retrieval left for a query; one without a vector has no penalty.
    """
    kinds = dict(candidates.dtypes)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["pos", "node", "score", "embedding"]).to_pylist(), key=lambda r: r["pos"])
        size = max((len(r["embedding"] or []) for r in rows), default=0)
        vectors = np.zeros((len(rows), max(1, size)))
        for i, r in enumerate(rows):
            if r["embedding"]:
                vectors[i] = r["embedding"]
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
        score, lost = np.array([r["score"] for r in rows], float), np.zeros(len(rows))
        order, open_ = [], np.ones(len(rows), bool)
        if len(rows) <= k:
            order = list(range(len(rows)))
        while len(order) < min(k, len(rows)):
            gain = np.where(open_, score - penalty * lost, -np.inf)
            best = int(np.argmax(gain))
            order.append(best)
            open_[best] = False
            lost += vectors @ vectors[best]
        q, n = table.column("query_id")[0].as_py(), table.schema.field("node").type
        return pa.table({"query_id": pa.array([q] * len(order), table.schema.field("query_id").type), "node": pa.array([rows[i]["node"] for i in order], n), "rank": pa.array(range(1, len(order) + 1), pa.int64()), "score": score[order]})

    return candidates.groupBy("query_id").applyInArrow(run, f"query_id {kinds['query_id']}, node {kinds['node']}, rank long, score double")


def quick(vector_scores: DataFrame, graph_scores: DataFrame, limit: int = 15) -> DataFrame:
    """The fast path: vector results then graph results in their order, the first of each node, ``limit`` in all."""
    rows = vector_scores.select("query_id", "node", "score", "rank", F.lit(0).alias("part")).unionByName(graph_scores.select("query_id", "node", "score", "rank", F.lit(1).alias("part")))
    first = Window.partitionBy("query_id", "node").orderBy("part", "rank")
    pos = Window.partitionBy("query_id").orderBy("part", "rank", "node")
    rows = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return rows.withColumn("pos", F.row_number().over(pos)).where(F.col("pos") <= limit).withColumn("modality_score", F.lit(1.0))


def packed(results: DataFrame, edges: DataFrame, atoms: DataFrame, most: int = 3, item: str = "atom_id", text: str = "content") -> DataFrame:
    """``results`` (query_id, node, ...) with ``context``: the contents of a node's first neighbours by id."""
    near = graph.neighbors(edges, results.select("node").distinct()).select("node", "other").distinct()
    near = near.join(atoms.select(F.col(item).alias("other"), F.col(text).alias("c")), "other")
    first = Window.partitionBy("node").orderBy("other")
    near = near.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= most)
    context = F.transform(F.array_sort(F.collect_list(F.struct("__r", "c"))), lambda s: s["c"])
    return results.join(near.groupBy("node").agg(context.alias("context")), "node", "left").withColumn("context", F.coalesce("context", F.array().cast("array<string>")))


def evidence(results: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, evidence, sources): a query's best results as numbered text, each with its source and first neighbour.

    ``results``: query_id, rank, content, source, modality, context.
    """
    top = results.where(F.col("rank") <= most)
    body = F.when(F.length("content") > 1500, F.concat(F.substring("content", 1, 1500), F.lit("..."))).otherwise(F.col("content"))
    main = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), body, F.lit("\n   (Source: "), F.coalesce("source", F.lit("None")), F.lit(", Modality: "), F.col("modality"), F.lit(")"))
    extra = F.when(F.size("context") > 0, F.concat(F.lit("\n\n   Context: "), F.substring(F.element_at("context", 1), 1, 150), F.lit("..."))).otherwise("")
    blocks = F.array_sort(F.collect_list(F.struct("rank", F.concat(main, extra).alias("t"))))
    sources = F.array_sort(F.collect_set(F.when(F.col("source") != "", F.col("source"))))
    return top.groupBy("query_id").agg(F.array_join(F.transform(blocks, lambda b: b["t"]), "\n\n").alias("evidence"), sources.alias("sources"))


def reward(hit: Column, overlap: Column, engagement: Column) -> Column:
    return 0.4 * hit + 0.3 * overlap + 0.3 * engagement


def learned_weights(weights: RetrievalWeights, rewards: list[float], least: int = 10) -> RetrievalWeights:
    """The weights after a batch of rewards; fewer than ``least`` change nothing."""
    return weights.updated(sum(rewards) / len(rewards)) if len(rewards) >= least else weights


def hybrid(atoms: DataFrame, edges: DataFrame, queries: DataFrame, config: SearchConfig = SearchConfig(), weights: RetrievalWeights = RetrievalWeights(), sources: list[str] | None = None, modality: str | None = None, resolution: str | None = None, index: postings.Index | None = None) -> DataFrame:
    """Hybrid retrieval for a batch of queries (query_id, text, embedding, modalities): the ranked, packed results.

    With a keyword ``index`` of these atoms (or of more) keyword hits come from it, not from a pass over all texts.

    ``atoms``: atom_id, content, modality, resolution, source, embedding. Only those of ``sources``, ``modality`` and
    ``resolution`` are found, whichever way, or packed; walks may pass through others.
    """
    from atomloom.config import RESOLUTION_WEIGHTS
    from atomloom.operators import postings

    atoms = restricted(atoms, sources, modality, resolution)

    v = vector.multi_resolution(atoms, queries, RESOLUTION_WEIGHTS, config.top_k_vector)
    v = materialize(v.select("query_id", F.col("atom_id").alias("node"), "score", "rank"), "vector-evidence")
    seeds = v.select("query_id", F.col("node").alias("seed"))
    g = graph_evidence(edges, seeds, config, tolerance=config.ppr_tolerance)
    hits = full_text(atoms, queries) if index is None else postings.full_text(index, queries)
    # hits of atoms that are left out don't count, so the first by id are taken behind the join
    hits = first_by_id(hits.join(atoms.select("atom_id"), "atom_id", "left_semi"), config.top_k_bm25).join(atoms.select("atom_id", "content"), "atom_id")
    b = min_max(bm25(hits, queries), "bm25").select("query_id", F.col("atom_id").alias("node"), F.col("bm25").alias("score"))
    c = materialize(merged(v, g, b), "candidates")
    s = graph.structural(edges, c.select("query_id", "node")).select("query_id", "node", F.col("structural").alias("s"))
    about = atoms.select(F.col("atom_id").alias("node"), "content", "modality", "source", "embedding")
    c = c.join(s, ["query_id", "node"]).join(about, "node").join(queries.select("query_id", "modalities"), "query_id")
    c = unified(c.withColumn("m", modality_score(F.col("modality"), F.col("modalities"))), weights)
    c = c.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node")))
    picked = mmr(c.select("query_id", "node", "pos", "score", vector.as_double(F.col("embedding")).alias("embedding")), config.mmr_size, config.diversity_lambda)
    kept = picked.select("query_id", "node", "rank").join(c.drop("embedding", "modalities", "pos"), ["query_id", "node"])
    return packed(kept, edges, atoms, config.context_neighbors)
