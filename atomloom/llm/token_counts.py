"""Token counts: the exact histogram of encoded lengths answers every question on context limits.

Method: documents are aggregated by encoded length (one row for each distinct length; partial counts before the
shuffle). Suffix sums over the histogram then give, for each limit, the documents that fit, the tokens when longer
documents are cut to the limit, and the quantile that the limit is. Distinct lengths are few: with N tokens in all there
are no more than sqrt(2 N). The sums still go in two levels (within bands of lengths, then over the bands), so no window
spans the whole histogram.

Defined cases: null and empty texts have length 0 and count as documents; an empty table gives an empty histogram;
answers for limits between two lengths follow from the row of the next smaller length (see ``at_limits``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BAND = 1024


def length_histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs) for each distinct length."""
    return lengths.groupBy(F.col(length).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def context_limits(histogram: DataFrame, band: int = BAND) -> DataFrame:
    """For each distinct length taken as the limit L: suffix sums over the histogram.

    n_tokens (L), n_docs (of just that length), docs_over, tokens_over (documents longer than L, and their tokens),
    docs_within, tokens_within, total_docs, total_tokens, truncated_tokens (each document cut to L), lost_tokens, and
    quantile (the share of documents of length L or less).
    """
    h = histogram.withColumn("band", F.floor(F.col("n_tokens") / band)).withColumn("mass", F.col("n_tokens") * F.col("n_docs"))
    bands = h.groupBy("band").agg(F.sum("n_docs").alias("b_docs"), F.sum("mass").alias("b_mass"))
    # bands: one row for each 1024 lengths
    up = Window.partitionBy(F.lit(0)).orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    bands = bands.select("band", *[F.coalesce(F.sum(c).over(up), F.lit(0)).alias(f"over_{c}") for c in ("b_docs", "b_mass")], F.sum("b_docs").over(every).alias("total_docs"), F.sum("b_mass").over(every).alias("total_tokens"))
    inside = Window.partitionBy("band").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    h = h.select("band", "n_tokens", "n_docs", F.coalesce(F.sum("n_docs").over(inside), F.lit(0)).alias("in_docs"), F.coalesce(F.sum("mass").over(inside), F.lit(0)).alias("in_mass"))
    j = h.join(bands, "band").withColumn("docs_over", F.col("in_docs") + F.col("over_b_docs")).withColumn("tokens_over", F.col("in_mass") + F.col("over_b_mass"))
    within, cut = F.col("total_tokens") - F.col("tokens_over"), F.col("docs_over") * F.col("n_tokens")
    return j.select(
        "n_tokens", "n_docs", "docs_over", "tokens_over",
        (F.col("total_docs") - F.col("docs_over")).alias("docs_within"), within.alias("tokens_within"),
        "total_docs", "total_tokens", (within + cut).alias("truncated_tokens"), (F.col("tokens_over") - cut).alias("lost_tokens"),
        ((F.col("total_docs") - F.col("docs_over")) / F.col("total_docs")).alias("quantile"),
    )


def at_limits(answers: DataFrame, limits: list[int]) -> DataFrame:
    """The same answers for any limits of a short list (limit, docs_within, truncated_tokens, lost_tokens)."""
    n, docs = F.col("n_tokens"), F.col("n_docs")
    rows = answers.select("n_docs", "n_tokens", F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("limit"))
    return rows.groupBy("limit").agg(
        F.sum(F.when(n <= F.col("limit"), docs).otherwise(0)).alias("docs_within"),
        F.sum(F.least("n_tokens", "limit") * docs).alias("truncated_tokens"),
        F.sum(F.greatest(n - F.col("limit"), F.lit(0)) * docs).alias("lost_tokens"),
    )


def quantile_length(answers: DataFrame, q: float) -> int | None:
    """The least length that a share ``q`` of the documents doesn't exceed."""
    return answers.where(F.col("quantile") >= q).agg(F.min("n_tokens")).first()[0]
