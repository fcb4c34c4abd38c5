"""Scraping as a pass over URLs: a fetcher given by the caller runs on executors; failures are rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomloom.functions.text import cap, html_text, html_title, word_count


def fetch(urls: DataFrame, fetcher: Callable[[], Callable[[str], str]], url: str = "url") -> DataFrame:
    """(url, html, success, error): ``fetcher`` makes, once a task, what turns a URL into a page."""

    def run(batches):
        get = fetcher()
        for b in batches:
            out = []
            for u in b.column("url").to_pylist():
                try:
                    out.append((u, get(u), True, None))
                except Exception as e:  # a failed page is a row, not a failed job
                    out.append((u, None, False, f"{type(e).__name__}: {e}"))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_(), pa.string()), strict=True)], names=["url", "html", "success", "error"])

    return urls.select(F.col(url).alias("url")).mapInArrow(run, "url string, html string, success boolean, error string")


def extracted(pages: DataFrame, limit: int = 20_000) -> DataFrame:
    """Pages with title, content and word count; short pages are failures with a reason."""
    rows = pages.withColumn("title", html_title(F.col("html"))).withColumn("content", html_text(F.col("html")))
    error = F.when(F.coalesce(F.length("html"), F.lit(0)) < 100, "empty page").when(F.coalesce(F.length("content"), F.lit(0)) < 50, "no content")
    rows = rows.withColumn("error", error).withColumn("success", F.col("error").isNull())
    return rows.withColumn("content", cap(F.col("content"), limit)).withColumn("word_count", word_count(F.col("content")))
