"""Prompts as Column expressions over evidence, memory and queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How an answer is styled by intent.
STYLES = {
    "conversational": "Answer briefly and warmly.",
    "debugging": "Name the cause first, then the fix.",
    "procedural": "Give numbered steps.",
    "comparative": "Compare point by point.",
    "analytical": "Weigh causes and effects.",
    "creative": "Write freely, but stay with the evidence.",
    "explanatory": "Explain from the ground up.",
    "factual": "State the fact first.",
}


def system(intent: Column) -> Column:
    style = F.lit(STYLES["explanatory"])
    for name, text in STYLES.items():
        style = F.when(intent == name, text).otherwise(style)
    return F.concat(F.lit("You answer from a knowledge base and cite its sources. "), style)


def user(query: Column, evidence: Column, memory: Column | None = None) -> Column:
    head = F.when(F.coalesce(F.length(memory), F.lit(0)) > 0, F.concat(F.lit("Memory:\n"), memory, F.lit("\n\n"))).otherwise("") if memory is not None else F.lit("")
    return F.concat(head, F.lit("Evidence:\n"), F.coalesce(evidence, F.lit("")), F.lit("\n\nQuestion: "), query)


def judge(query: Column, response: Column, sources: Column) -> Column:
    named = F.array_join(F.slice(F.coalesce(sources, F.array().cast("array<string>")), 1, 10), ", ")
    return F.concat(F.lit("Query: "), F.substring(query, 1, 2000), F.lit("\nSources: "), named, F.lit("\nResponse: "), response)


def judge_again(query: Column, response: Column) -> Column:
    return F.concat(F.lit("Query: "), F.substring(query, 1, 500), F.lit("\nResponse: "), F.substring(response, 1, 4000))


def search_results(rank: Column, title: Column, url: Column, provider: Column, snippet: Column) -> Column:
    text = F.concat(F.lit("["), rank.cast("string"), F.lit("] "), title, F.lit("\n    Source: "), url, F.lit("\n    Provider: "), provider, F.lit("\n"))
    return F.concat(text, F.when(snippet != "", F.concat(F.lit("    Content: "), snippet, F.lit("\n"))).otherwise(""))


def status(cancelled: Column, n_results: Column, evidence: Column, answer_error: Column) -> Column:
    """Why a response has the form it has."""
    return (
        F.when(cancelled, "cancelled").when(answer_error.isNotNull(), "failed_retrieval").when(F.coalesce(n_results, F.lit(0)) == 0, "no_context")
        .when(F.coalesce(F.length(F.trim(evidence)), F.lit(0)) < 200, "insufficient_kb").otherwise("ok")
    )
