"""Research runs: plans, findings and their provenance graph (nodes: id, type, ...; edges: src, dst, type)."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atomloom.functions.text import strip, words_of
from atomloom.operators.graph import set_pairs
from atomloom.operators.tables import first_by
from atomloom.session import materialize

#: The steps of a plan without a model, and what is put behind the query's first five words to search.
PLAN = [
    ("Core Definitions and Formal Foundations", ["survey arxiv", "formal definition research paper", "seminal work foundational", "overview technical explanation"]),
    ("Architecture and Technical Design", ["architecture design paper", "algorithm technical details arxiv", "implementation tutorial"]),
    ("Key Components and Mechanisms", ["components mechanisms paper", "internals deep dive"]),
    ("Implementations and Frameworks", ["frameworks libraries tutorial", "open source implementation GitHub"]),
    ("Empirical Results and Benchmarks", ["benchmark evaluation results", "SOTA state of the art performance", "ablation study arxiv paper"]),
    ("Current Research Frontiers", ["latest advances arxiv", "open problems challenges survey"]),
    ("Constraints and Limitations", ["limitations drawbacks paper", "failure modes analysis"]),
    ("Applications and Case Studies", ["real world applications deployment", "industry use case practical", "production system tutorial"]),
    ("Integration and Best Practices", ["best practices guide", "integration tutorial engineering"]),
    ("Future Outlook", ["future directions new paper", "predictive models outlook"]),
]


def fallback_plan(queries: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, step_index, title, search_query) for each query: ten fixed steps."""
    w = words_of(F.col(text))
    short = F.when(F.size(w) > 5, F.array_join(F.slice(w, 1, 5), " ")).otherwise(F.col(text))
    steps = F.array(*[F.struct(F.lit(i).alias("step_index"), F.lit(t).alias("title"), F.array(*[F.lit(q) for q in qs]).alias("qs")) for i, (t, qs) in enumerate(PLAN)])
    rows = queries.select("query_id", short.alias("short"), F.inline(steps))
    return rows.select("query_id", "step_index", "title", F.posexplode("qs").alias("query_index", "q"), "short").select("query_id", "step_index", "title", "query_index", F.concat("short", F.lit(" "), "q").alias("search_query"))


def merged_status(plan: DataFrame, local: DataFrame, key: str = "step_index") -> DataFrame:
    """Plan steps with the local status where there is one."""
    return plan.join(local.select(key, F.col("status").alias("__s")), key, "left").withColumn("status", F.coalesce("__s", "status")).drop("__s")


def first_independent(edges: DataFrame) -> DataFrame:
    """(v): the nodes that a greedy choice in order leaves out; edges (v, u) lead from each node to the earlier ones it conflicts with.

    In rounds: a node without an open earlier neighbour is chosen, and its later neighbours are left out. Rounds are as many
    as the longest chain of decisions that depend on each other, not as many as nodes. Each is written.
    """
    edges, out = materialize(edges, "conflicts"), None
    while not edges.isEmpty():
        chosen = edges.select("u").distinct().join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_anti")
        gone = materialize(edges.join(chosen, "u", "left_semi").select("v").distinct(), "left-out")
        out = gone if out is None else out.unionByName(gone)
        edges = materialize(edges.join(gone, "v", "left_anti").join(gone.withColumnRenamed("v", "u"), "u", "left_anti"), "conflicts")
    return edges.select("v") if out is None else out


def distinct_findings(findings: DataFrame, group: str, order: str, text: str, threshold: float = 0.65, head: int = 120) -> DataFrame:
    """The findings of each group that aren't like an earlier one that was kept (Jaccard of words of their first characters).

    The same choice as going through a group in order, by rounds over the pairs that are alike; a group may have any size.
    Of findings with the same words only the first can be kept; findings without words all are.
    """
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.substring(text, 1, head)), F.lit("([a-z]{3,})"), 1)))
    rows = findings.select(F.col(group), F.col(order), F.coalesce(words, F.array().cast("array<string>")).alias("words"))
    bare = rows.where(F.size("words") == 0).select(group, order)
    if threshold >= 1:
        return rows.select(group, order)
    first = rows.where(F.size("words") > 0).groupBy(group, "words").agg(F.min(order).alias(order))
    first = materialize(first.withColumn("rep", F.monotonically_increasing_id()), "first-findings")
    # words of different groups are different
    named = F.transform("words", lambda w: F.to_json(F.struct(F.col(group), w)))
    pairs = set_pairs(first.select("rep", named.alias("e")), threshold)
    place = lambda n: first.select(F.col("rep").alias(n), F.struct(order, "words").alias(f"at_{n}"))
    met = pairs.join(place("a"), "a").join(place("b"), "b")
    later = F.col("at_a") > F.col("at_b")
    gone = first_independent(met.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("v"), F.when(later, F.col("b")).otherwise(F.col("a")).alias("u")))
    return first.join(gone.withColumnRenamed("v", "rep"), "rep", "left_anti").select(group, order).unionByName(bare)


def valid_findings(extracted: DataFrame, most: int = 10, least: int = 20, unit: str = "unit_id", found: str = "findings") -> DataFrame:
    """(unit, pos, content, extraction_type, importance): of each unit's first ``most`` findings those long enough.

    ``found`` holds an array of (content, extraction_type, importance); contents are stripped, the type is "fact" and the
    importance .5 where they are missing, and the importance is clamped.
    """
    rows = extracted.select(unit, F.posexplode(F.slice(found, 1, most)).alias("pos", "f"))
    rows = rows.select(unit, "pos", strip(F.col("f.content")).alias("content"), F.coalesce("f.extraction_type", F.lit("fact")).alias("extraction_type"), clamp(F.coalesce("f.importance", F.lit(0.5))).alias("importance"))
    return rows.where(F.length("content") >= least)


def findings_text(findings: DataFrame, group: str = "step_id", order: str = "pos") -> DataFrame:
    """(group, findings): each group's findings as numbered text with type, importance and source."""
    source = F.coalesce(F.when(F.col("source_title") != "", F.col("source_title")), F.col("source_url"), F.lit("Unknown"))
    head = F.concat(F.lit("type: "), F.coalesce("extraction_type", F.lit("fact")), F.lit(", importance: "), F.format_string("%.1f", F.coalesce("importance", F.lit(0.5))), F.lit(", source: "), source)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), head.alias("h"), F.coalesce("content", F.lit("")).alias("c"))))
    lines = F.transform(parts, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), p["h"], F.lit(")\n    "), p["c"]))
    return findings.groupBy(group).agg(F.array_join(lines, "\n\n").alias("findings"))


def run_rows(runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(traces, web log, fragments) that finished runs leave in memory.

    ``runs``: run_id, session_id, turn_index, query, report, sources as an array of (url, title, score).
    """
    kind, report = F.lit("deep_research"), F.coalesce("report", F.lit(""))
    urls = F.transform("sources", lambda s: s["url"])
    traces = runs.select("session_id", "turn_index", F.col("query").alias("user_query"), F.array().cast("array<string>").alias("retrieved_ids"), urls.alias("sources"), F.array(kind).alias("algorithms"), F.lit(True).alias("web_search"), F.substring(report, 1, 300).alias("answer"))
    logs = runs.select("session_id", "turn_index", kind.alias("provider"), F.col("query").alias("query_sent"), F.inline("sources")).withColumn("snippet", F.lit(""))
    content = F.concat(F.lit("Deep Research: "), "query", F.lit("\n\n"), F.substring(report, 1, 1000))
    fragments = runs.select(F.md5(F.concat_ws("|", "session_id", "run_id")).alias("fragment_id"), "session_id", F.lit("deep_research_summary").alias("fragment_type"), content.alias("content"), F.array(kind, F.col("run_id").cast("string")).alias("tags"), F.lit("global").alias("namespace"), F.lit(0.8).alias("importance"), F.lit(0).cast("bigint").alias("access_count"))
    return traces, logs, fragments


def finding_rows(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) for findings (id, content, importance, source_id, step_id): extracted_from, and belongs_to if known."""
    nodes = findings.select("id", F.lit("finding").alias("type"), "content", "importance")
    pairs = F.array(F.struct(F.col("source_id").alias("dst"), F.lit("extracted_from").alias("type")), F.struct(F.col("step_id").alias("dst"), F.lit("belongs_to").alias("type")))
    return nodes, findings.select(F.col("id").alias("src"), F.inline(pairs)).where("dst is not null")


def synthesis_rows(syntheses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) for syntheses (id, depth, content, input_ids): synthesized_from each input."""
    nodes = syntheses.select("id", F.lit("synthesis").alias("type"), "content", "depth", F.size("input_ids").alias("input_count"))
    return nodes, syntheses.select(F.col("id").alias("src"), F.explode("input_ids").alias("dst"), F.lit("synthesized_from").alias("type"))


def simple(edges: DataFrame, order: str = "pos") -> DataFrame:
    """Between two nodes the last edge wins."""
    return first_by(edges, ["src", "dst"], [F.desc(order)]).drop(order)


def source_counts(nodes: DataFrame, edges: DataFrame, found_only: bool = True) -> DataFrame:
    """Web sources with the number of findings extracted from them."""
    n = edges.where("type = 'extracted_from'").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("findings_count"))
    rows = nodes.where("type = 'web_source'").join(n, "id", "inner" if found_only else "left")
    return rows.withColumn("findings_count", F.coalesce("findings_count", F.lit(0)))


def step_findings(nodes: DataFrame, edges: DataFrame, step: str) -> DataFrame:
    inside = edges.where((F.col("type") == "belongs_to") & (F.col("dst") == step)).select(F.col("src").alias("id")).distinct()
    return nodes.where("type = 'finding'").join(inside, "id", "left_semi")


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def unique_sources(hits: DataFrame, order: str = "pos") -> DataFrame:
    """One source for each URL, the first."""
    return first_by(hits, ["url"], [order])


def decision_trace(nodes: DataFrame, edges: DataFrame, hops: int = 4) -> DataFrame:
    """(id, type, distance) of what the deepest synthesis was made from, over synthesized_from edges; ordered by distance, id.

    Runs until no new node is reached, however deep. A round takes ``hops`` levels and is written to the shared folder;
    nodes seen before are left out, so cycles end.
    """
    made = materialize(edges.where("type = 'synthesized_from'").select("src", "dst").distinct(), "trace")
    last = nodes.where("type = 'synthesis'").orderBy(F.desc("depth"), F.desc("id")).limit(1)
    seen = front = materialize(last.select("id", F.lit(0).alias("distance")), "trace")
    for d in count(hops, hops):
        level, levels = front, []
        for k in range(hops):
            level = level.select(F.col("id").alias("src")).join(made, "src").select(F.col("dst").alias("id")).distinct()
            levels.append(level.withColumn("distance", F.lit(d - hops + k + 1)))
        new = reduce(DataFrame.unionByName, levels).groupBy("id").agg(F.min("distance").alias("distance")).join(seen, "id", "left_anti")
        new = materialize(new, "trace")
        seen = materialize(seen.unionByName(new), "trace")
        front = new.where(F.col("distance") == d)
        if front.isEmpty():
            break
    return seen.join(nodes, "id")


def synthesis_chain(nodes: DataFrame) -> DataFrame:
    """Syntheses by depth, then id, with their place in the chain and whether they are the final one.

    A research run has a synthesis for each of its few steps, so that one task orders them.
    """
    rows = nodes.where("type = 'synthesis'")
    order = Window.partitionBy(F.lit(0)).orderBy("depth", "id")
    return rows.withColumn("position", F.row_number().over(order)).withColumn("final", F.lead("id").over(order).isNull())


def top_findings(findings: DataFrame, most: int = 30, budget: int = 12_000, group: str = "step_id") -> DataFrame:
    """A group's most important findings, up to the first that passes the character budget."""
    w = Window.partitionBy(group).orderBy(F.desc("importance"), "id")
    rows = findings.withColumn("rank", F.row_number().over(w)).withColumn("used", F.sum(F.length("content")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("rank") <= most) & (F.col("used") <= budget))


def real_syntheses(rows: DataFrame, placeholder: str = "[") -> DataFrame:
    """Syntheses that are no placeholders; all of them if every one is."""
    flagged = rows.withColumn("__p", F.col("content").startswith(placeholder))
    every = flagged.agg(F.coalesce(F.min("__p"), F.lit(False)).alias("__all"))
    return flagged.join(F.broadcast(every)).where("__all or not __p").drop("__p", "__all")  # every is one row


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON text a row for each node and edge, for export."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("*")).alias("json"))
    return n.unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct("*")).alias("json")))


def graph_from_json(rows: DataFrame, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    read = lambda k, s: rows.where(F.col("kind") == k).select(F.from_json("json", s).alias("r")).select("r.*")
    return read("node", nodes), read("edge", edges)


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def empty_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id string, content string, importance double, source_id string, step_id string")
