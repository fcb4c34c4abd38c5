"""Chat histories and session memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atomloom.functions.text import estimated_tokens, preview


def chat_list(messages: DataFrame, chat: str = "conv_id", at: str = "turn") -> DataFrame:
    return messages.groupBy(chat).agg(F.count(F.lit(1)).alias("n_messages"), F.max(at).alias("updated_at")).orderBy(F.desc("updated_at"), chat)


def last_messages(messages: DataFrame, n: int, chat: str = "conv_id", at: str = "turn") -> DataFrame:
    w = Window.partitionBy(chat).orderBy(F.desc(at))
    return messages.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def oldest(messages: DataFrame, limit: int = 100, at: tuple[str, ...] = ("turn",)) -> DataFrame:
    """The first messages of a history in the order of time."""
    return messages.orderBy(*at).limit(limit)


def within_budget(messages: DataFrame, budget: int = 3000, chat: str = "conv_id", at: str = "turn", text: str = "text") -> DataFrame:
    """The newest messages of each chat up to the first that passes the token budget."""
    newest = Window.partitionBy(chat).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(F.coalesce(estimated_tokens(F.col(text)), F.lit(0))).over(newest)
    return messages.withColumn("spent", spent).where(F.col("spent") <= budget)


def turn_index(traces: DataFrame, session: str = "conv_id", at: str = "turn") -> DataFrame:
    return traces.withColumn("turn_index", F.row_number().over(Window.partitionBy(session).orderBy(at)) - 1)


def previous_user(messages: DataFrame, chat: str = "conv_id", at: str = "turn", text: str = "text") -> DataFrame:
    """Assistant messages with the last user message before them."""
    w = Window.partitionBy(chat).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("user_text", F.last(F.when(F.col("role") == "user", F.col(text)), ignorenulls=True).over(w)).where("role = 'assistant'")


def flattened(messages: DataFrame, chat: str = "conv_id", at: str = "turn", text: str = "text") -> DataFrame:
    """Each chat as one prompt of "Role: content" blocks."""
    parts = F.array_sort(F.collect_list(F.struct(at, F.concat(F.initcap("role"), F.lit(": "), F.coalesce(text, F.lit("")), F.lit("\n\n")).alias("t"))))
    return messages.groupBy(chat).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("prompt"))


def memory_stats(messages: DataFrame, fragments: DataFrame, logs: DataFrame, traces: DataFrame, limit: int = 200) -> DataFrame:
    """Per session: messages (of the last ``limit``) by role, active fragments, web log rows, traces."""
    m = last_messages(messages, limit, "session_id", "turn").groupBy("session_id").agg(F.count(F.lit(1)).alias("total_messages"), F.count_if(F.col("role") == "user").alias("user_messages"), F.count_if(F.col("role") == "assistant").alias("assistant_messages"))
    f = fragments.where(~F.col("is_deleted")).groupBy("session_id").agg(F.count(F.lit(1)).alias("fragments"))
    w, t = logs.groupBy("session_id").agg(F.count(F.lit(1)).alias("web_searches")), traces.groupBy("session_id").agg(F.count(F.lit(1)).alias("traces"))
    out = m.join(f, "session_id", "full_outer").join(w, "session_id", "full_outer").join(t, "session_id", "full_outer")
    return out.na.fill(0, [c for c in out.columns if c != "session_id"])


def namespaces(fragments: DataFrame, session: str | None = None) -> DataFrame:
    """(namespace, n): active fragments of each namespace; "global" and the session's own are always there."""
    always = ["global"] + ([f"session_{session[:8]}"] if session else [])
    names = fragments.sparkSession.createDataFrame([(n,) for n in always], "namespace string")
    counts = fragments.where(~F.col("is_deleted")).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "namespace", "full_outer").select("namespace", F.coalesce("n", F.lit(0)).alias("n"))


def in_namespaces(fragments: DataFrame, names: list[str]) -> DataFrame:
    """Active fragments of some namespaces; of none for an empty list."""
    return fragments.where(F.col("namespace").isin(names) & ~F.col("is_deleted")) if names else fragments.limit(0)


def importance(fragment_count: Column, most: Column, accessed: Column, created: Column, relevance: Column, as_of: Column, decay: float = 0.01) -> Column:
    """.3 relative frequency + .4 recency (e^-decay*hours; .5 if unknown) + .3 relevance, within [0, 1]."""
    hours = (F.unix_micros(as_of) - F.unix_micros(F.coalesce(accessed, created))) / 3.6e9
    recency = F.coalesce(F.exp(-decay * hours), F.lit(0.5))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.3 * fragment_count / F.greatest(most, F.lit(1)) + 0.4 * recency + 0.3 * F.coalesce(relevance, F.lit(0.5))))


def rescored(fragments: DataFrame, as_of: Column) -> DataFrame:
    """All fragments with their importance computed anew; the greatest access count is one row, joined in."""
    most = fragments.where(~F.col("is_deleted")).agg(F.greatest(F.coalesce(F.max("access_count"), F.lit(1)), F.lit(1)).alias("__most"))
    rows = fragments.join(F.broadcast(most))
    return rows.withColumn("importance", importance(F.col("access_count"), F.col("__most"), F.col("last_accessed"), F.col("created_at"), F.col("importance"), as_of)).drop("__most")


def decayed(as_of: Column, threshold: float = 0.1, days: int = 90) -> Column:
    """Which fragments to drop: active, of low importance, and old."""
    return ~F.col("is_deleted") & (F.col("importance") < threshold) & (F.col("created_at") < as_of - F.expr(f"INTERVAL {days} DAYS"))


def trace_rows(results: DataFrame, answers: DataFrame) -> DataFrame:
    """A trace for each query: ids, distinct sources and scores of its results, the first 300 characters of the answer."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "node", "source", "score")))
    t = results.groupBy("query_id").agg(ordered.alias("r"))
    t = t.select("query_id", F.transform("r", lambda x: x["node"]).alias("retrieved_ids"), F.array_distinct(F.filter(F.transform("r", lambda x: x["source"]), lambda s: s.isNotNull())).alias("sources"), F.map_from_entries(F.transform("r", lambda x: F.struct(x["node"].cast("string"), x["score"]))).alias("scores"))
    return t.join(answers.select("query_id", F.substring("answer", 1, 300).alias("answer")), "query_id", "left")


def web_log(results: DataFrame, session: str) -> DataFrame:
    """Search results as log rows; unknown values take defaults."""
    return results.select(F.lit(session).alias("session_id"), F.coalesce("provider", F.lit("unknown")).alias("provider"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("score", F.lit(0.0)).alias("score"), preview(F.col("snippet"), 500).alias("snippet"))


def metric_rows(messages: DataFrame, column: str = "metadata") -> DataFrame:
    """Assistant messages that carry timings."""
    ms = F.get_json_object(column, "$.total_time_ms").try_cast("double")
    return messages.withColumn("total_time_ms", ms).where((F.col("role") == "assistant") & F.col("total_time_ms").isNotNull())


def knowledge_links(fragments: DataFrame, atoms: DataFrame, ids: str = "related_ids") -> DataFrame:
    """extracted_from edges between fragments and the atoms they name, where those exist."""
    pairs = fragments.select(F.col("fragment_id").alias("src"), F.explode(ids).alias("atom_id")).join(atoms.select("atom_id"), "atom_id", "left_semi")
    return pairs.select("src", F.col("atom_id").alias("dst"), F.lit("extracted_from").alias("edge_type"), F.lit(1.0).alias("weight"))


def zipped(names: Column, results: Column) -> Column:
    """Providers with their result lists, by position."""
    return F.arrays_zip(names.alias("provider"), results.alias("results"))


def semantic_context(fragments: DataFrame, most: int = 5) -> DataFrame:
    """Each session's most important active fragments as one text of "- [type] content" lines."""
    w = Window.partitionBy("session_id").orderBy(F.desc("importance"), "fragment_id")
    top = fragments.where(~F.col("is_deleted")).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most)
    lines = F.array_sort(F.collect_list(F.struct("__r", F.concat(F.lit("- ["), F.coalesce("fragment_type", F.lit("knowledge")), F.lit("] "), "content").alias("t"))))
    return top.groupBy("session_id").agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("context"))
