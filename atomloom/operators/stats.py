"""Counts over atoms, edges and service logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distributions(atoms: DataFrame) -> DataFrame:
    """(modality, resolution, n): counts by either, and the total, in one pass of grouping sets."""
    return atoms.groupingSets([[F.col("modality")], [F.col("resolution")], []], F.col("modality"), F.col("resolution")).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def sources(atoms: DataFrame) -> DataFrame:
    return atoms.select("source").where("source <> ''").distinct()


def overview(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, sources."""
    a = atoms.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct(F.nullif("source", F.lit(""))).alias("sources"))
    return a.join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges"))))  # one row each


def facets(values: DataFrame, column: str, palette: int = 10) -> DataFrame:
    """Distinct values with an index into a palette."""
    from pyspark.sql import Window

    d = values.select(column).where(F.col(column).isNotNull()).distinct()
    return d.withColumn("color", F.pmod(F.row_number().over(Window.orderBy(column)) - 1, F.lit(palette)))


def key_stats(keys: DataFrame) -> DataFrame:
    """Per provider: keys, active keys, requests, errors."""
    return keys.groupBy("provider").agg(F.count(F.lit(1)).alias("total_keys"), F.count_if("active").alias("active_keys"), F.sum("requests").alias("requests"), F.sum("errors").alias("errors"))
