"""Query registry: name -> function of (spark, sf_dir), and name -> DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atomloom.plans import graph_queries, intake_queries, memory_queries, retrieval_queries, service_queries, text_queries

_ALL = (text_queries.query, graph_queries.query, retrieval_queries.query, memory_queries.query, service_queries.query, intake_queries.query)
QUERIES = {name: f for r in _ALL for name, f in r.queries.items()}
ORACLE = {name: sql for r in _ALL for name, sql in r.oracle.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval for a batch of queries."""
    return retrieval_queries.q_hybrid(spark, sf_dir)
