"""Search-result fusion and the preparation of URLs for scraping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atomloom.config import BLOCKED_PAGE_DOMAINS, BLOCKED_RESULT_DOMAINS
from atomloom.functions import urls
from atomloom.functions.text import search_tokens
from atomloom.operators.tables import first_by


def recency(date: Column, as_of: Column) -> Column:
    """1 for a week, .8 a month, .6 a quarter, .4 a year, .2 two years, else .1; 0 for no readable date."""
    d = F.substring(date, 1, 19)
    t = F.coalesce(F.try_to_timestamp(d, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(d, F.lit("yyyy-MM-dd")), F.try_to_timestamp(d, F.lit("MMMM d, yyyy")))
    days = F.floor((F.unix_micros(as_of) - F.unix_micros(t)) / 86_400_000_000)
    return F.when(t.isNull(), 0.0).when(days <= 7, 1.0).when(days <= 30, 0.8).when(days <= 90, 0.6).when(days <= 365, 0.4).when(days <= 730, 0.2).otherwise(0.1)


def term_score(query: Column, doc: Column) -> Column:
    """Mean over the query's terms of 1 + ln(1 + share of the document's terms), for terms that occur."""
    n = F.size(doc)
    part = F.transform(query, lambda t: F.size(F.filter(doc, lambda w: w == t)) / n)
    total = F.aggregate(part, F.lit(0.0), lambda s, x: s + F.when(x > 0, 1 + F.log1p(x)).otherwise(0.0))
    return F.when((F.size(query) == 0) | (n == 0), 0.0).otherwise(total / F.size(query))


def fuse(results: DataFrame, query: Column, as_of: Column, k: int | None = None, domains: list[str] | None = None) -> DataFrame:
    """Results (provider, pos, title, url, snippet, date) of all providers as one ranking.

    One row for each normalised URL (the first by provider and position) with the number of times it was found; blocked
    domains go; score = .6 relevance + .25 agreement + .15 recency.
    """
    rows = results.withColumn("norm_url", urls.for_search(F.col("url")))
    counts = rows.groupBy("norm_url").agg(F.count(F.lit(1)).alias("provider_count"))
    one = first_by(rows, ["norm_url"], ["provider", "pos"]).join(counts, "norm_url")
    one = one.where(~urls.blocked(F.split_part("norm_url", F.lit("/"), F.lit(1)), BLOCKED_RESULT_DOMAINS if domains is None else domains))
    doc = search_tokens(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))))
    # as columns, the terms are made once a row and not once for each term of the query
    one = one.withColumns({"__doc": doc, "__query": search_tokens(query)})
    one = one.withColumn("relevance", term_score(F.col("__query"), F.col("__doc"))).drop("__doc", "__query").withColumn("diversity", (F.col("provider_count") - 1) * 0.15).withColumn("recency", recency(F.col("date"), as_of))
    one = one.withColumn("final_score", F.col("relevance") * 0.6 + F.col("diversity") * 0.25 + F.col("recency") * 0.15)
    return one if k is None else one.orderBy(F.desc("final_score"), "norm_url").limit(k)


def provider_metrics(results: DataFrame) -> DataFrame:
    """(providers_with_results, total_raw, breakdown) of a search."""
    by = results.groupBy("provider").agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.count(F.lit(1)).alias("providers_with_results"), F.sum("n").alias("total_raw"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider", "n")))).alias("breakdown"))


def all_providers(sources: list[DataFrame], columns: list[str]) -> DataFrame:
    """The union of the providers' results; a provider that failed is an empty frame."""
    out = sources[0].select(columns)
    for s in sources[1:]:
        out = out.unionByName(s.select(columns))
    return out


def without_locales(pages: DataFrame, key: str, url: str = "url") -> DataFrame:
    """One row for each page over its locales: at the place of the first, with the first English URL if there is one.

    ``key`` orders the rows.
    """
    rows = pages.select(F.col(key).alias("pos"), F.col(url).alias("url"), urls.content_key(F.col(url)).alias("content_key"))
    return rows.groupBy("content_key").agg(F.min("pos").alias("pos"), F.coalesce(F.min_by(F.when(urls.english(F.col("url")), F.col("url")), F.when(urls.english(F.col("url")), F.col("pos"))), F.min_by("url", "pos")).alias("url"))


def scrape_order(pages: DataFrame, key: str, url: str = "url") -> DataFrame:
    """Pages in the order of scraping: by priority, then hinted ones, then as given."""
    rows = pages.select(F.col(key).alias("pos"), F.col(url).alias("url"))
    return rows.withColumn("priority", urls.priority(F.col("url"))).withColumn("hinted", urls.hinted(F.col("url"))).orderBy(F.desc("priority"), F.desc("hinted"), "pos")


def scrapable(pages: DataFrame, url: str = "url") -> DataFrame:
    return pages.where(~urls.blocked(urls.domain(F.col(url)), BLOCKED_PAGE_DOMAINS))


def distinct_urls(rows: DataFrame, order: str, most: int, url: str = "url") -> DataFrame:
    """The first ``most`` distinct URLs in order."""
    return rows.groupBy(url).agg(F.min(order).alias(order)).orderBy(order, url).limit(most)


def history_sources(logs: DataFrame, session: str = "session_id", order: str = "pos", most: int = 10) -> DataFrame:
    """The first ``most`` distinct URLs of each session's web history with their titles."""
    one = first_by(logs, [session, "url"], [order])
    return one.withColumn("__n", F.row_number().over(Window.partitionBy(session).orderBy(order))).where(F.col("__n") <= most).drop("__n")
