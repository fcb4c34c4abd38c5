"""Upserts, deletes and updates as transformations from one snapshot of a table to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row for each key: the one with the latest ``version``; the new one on a tie."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("__new"))
    return rows.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r", "__new")


def append_with_parent(parents: DataFrame, children: DataFrame, key: str, defaults: dict[str, Column], touched: str, at: str) -> DataFrame:
    """The parents after children are appended: missing ones are made with ``defaults``, all are touched by the latest child."""
    latest = children.groupBy(key).agg(F.max(at).alias("__at"))
    made = latest.join(parents, key, "left_anti").select(key, *[v.alias(k) for k, v in defaults.items()], F.col("__at").alias(touched))
    kept = parents.join(latest, key, "left").withColumn(touched, F.greatest(F.col(touched), F.coalesce("__at", F.col(touched)))).drop("__at")
    return kept.unionByName(made, allowMissingColumns=True)


def without(table: DataFrame, gone: DataFrame, column: str, key: str) -> DataFrame:
    """``table`` without the rows whose ``column`` is among ``gone``'s ``key``."""
    g = gone.select(F.col(key).alias("__gone")).distinct()
    return table.join(g, table[column] == g["__gone"], "left_anti")


def by_keys(table: DataFrame, keys: DataFrame, column: str, key: str) -> DataFrame:
    """The rows of ``table`` whose ``column`` is among ``keys``; keys that aren't there give nothing."""
    k = keys.select(F.col(key).alias("__key")).distinct()
    return table.join(k, table[column] == k["__key"], "left_semi")


def delete_fragments(fragments: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fragments, edges) without the fragments in ``gone`` (fragment_id) and the edges at either end of them."""
    return without(fragments, gone, "fragment_id", "fragment_id"), without(without(edges, gone, "src", "fragment_id"), gone, "dst", "fragment_id")


def with_defaults(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Rows to insert: columns that are missing or null take their default."""
    return rows.withColumns({c: F.coalesce(F.col(c), d) if c in rows.columns else d for c, d in defaults.items()})


def dual(fragments: DataFrame, related: str = "related_ids", vector: str = "embedding") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(graph nodes, graph edges, metadata) of fragments: vectors and links go to one store, all other columns to the other."""
    edges = fragments.select(F.col("fragment_id").alias("src"), F.explode(related).alias("dst"), F.lit("extracted_from").alias("edge_type"), F.lit(1.0).alias("weight"))
    return fragments.select("fragment_id", "content", vector), edges, fragments.drop(related, vector)


def cascade_delete(parent: DataFrame, children: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Parent and child tables without the rows of the keys in ``gone``."""
    return {"": without(parent, gone, key, key)} | {n: without(c, gone, key, key) for n, c in children.items()}


def delete_source(atoms: DataFrame, edges: DataFrame, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(atoms, edges, deleted count) without a source's atoms and the edges at either end of them."""
    gone = atoms.where(F.col("source") == source).select("atom_id")
    return atoms.where((F.col("source") != source) | F.col("source").isNull()), without(without(edges, gone, "src", "atom_id"), gone, "dst", "atom_id"), gone.agg(F.count(F.lit(1)).alias("deleted"))


def soft_delete(fragments: DataFrame, which: Column) -> DataFrame:
    return fragments.withColumn("is_deleted", F.col("is_deleted") | F.coalesce(which, F.lit(False)))


def clear_session(traces: DataFrame, logs: DataFrame, fragments: DataFrame, session: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Traces and logs of the session go; its fragments are marked deleted."""
    other = F.col("session_id") != session
    return traces.where(other), logs.where(other), soft_delete(fragments, ~other)


def bumped(fragments: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """Access counts and times after hits (fragment_id, one row a hit)."""
    n = hits.groupBy("fragment_id").agg(F.count(F.lit(1)).alias("__n"))
    rows = fragments.join(n, "fragment_id", "left")
    return rows.withColumn("access_count", F.col("access_count") + F.coalesce("__n", F.lit(0))).withColumn("last_accessed", F.when(F.col("__n").isNotNull(), now).otherwise(F.col("last_accessed"))).drop("__n")


def set_importance(fragments: DataFrame, updates: DataFrame) -> DataFrame:
    u = updates.select("fragment_id", F.col("importance").alias("__i"))
    return fragments.join(u, "fragment_id", "left").withColumn("importance", F.coalesce("__i", "importance")).drop("__i")


def cloned(fragments: DataFrame, sessions: list[str], namespace: str, now: Column, only: list[str] | None = None) -> DataFrame:
    """Copies of the active fragments of sessions (or of ``only`` some) in another namespace, as new and never accessed."""
    which = F.col("session_id").isin(sessions) if only is None else F.col("fragment_id").isin(only)
    rows = fragments.where(which & ~F.col("is_deleted"))
    return rows.withColumn("fragment_id", F.md5(F.concat_ws("|", "fragment_id", F.lit(namespace)))).withColumn("namespace", F.lit(namespace)).withColumn("access_count", F.lit(0).cast("bigint")).withColumn("created_at", now).withColumn("last_accessed", F.lit(None).cast(fragments.schema["last_accessed"].dataType))


def update_columns(table: DataFrame, which: Column, values: dict[str, Column], allowed: set[str]) -> DataFrame:
    """Set allowed columns where ``which`` holds; others are left as they are."""
    for name, value in values.items():
        if name in allowed and name in table.columns:
            table = table.withColumn(name, F.when(which, value).otherwise(F.col(name)))
    return table


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def content_cache(items: DataFrame, cache: DataFrame, text: str = "content") -> DataFrame:
    """Distinct contents by md5 that ``cache`` (content_hash, ...) lacks: what has yet to be embedded."""
    distinct = items.select(F.md5(F.col(text)).alias("content_hash"), text).groupBy("content_hash").agg(F.min(text).alias(text))
    return distinct.join(cache.select("content_hash"), "content_hash", "left_anti")


def save_cache(rows: DataFrame, table: str, buckets: int = 64) -> None:
    """Add rows (content_hash, ...) to the cache table, which is bucketed and sorted by the hash; a file a bucket and call."""
    dealt = rows.repartition(buckets, "content_hash")
    dealt.write.mode("append").format("parquet").bucketBy(buckets, "content_hash").sortBy("content_hash").saveAsTable(table)


def missing_from_cache(items: DataFrame, table: str, text: str = "content", buckets: int = 64) -> DataFrame:
    """Distinct contents by md5 that the cache table lacks. Only the items are shuffled, once, to the table's buckets."""
    hashed = items.select(F.md5(F.col(text)).alias("content_hash"), text).repartition(buckets, "content_hash")
    distinct = hashed.groupBy("content_hash").agg(F.min(text).alias(text))
    # a merge over the buckets: neither side is moved or broadcast
    return distinct.join(items.sparkSession.table(table).select("content_hash").hint("merge"), "content_hash", "left_anti")


def with_default(keys: DataFrame, table: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """The row of each key, or a default row."""
    rows = keys.join(table, key, "left")
    return rows.select(key, *[F.coalesce(F.col(c), d).alias(c) for c, d in defaults.items()])


def json_column(c: Column, schema: str) -> Column:
    """A JSON text as a typed value; null and unreadable ones are empty."""
    empty = F.array().cast(schema) if schema.startswith("array") else F.from_json(F.lit("{}"), schema)
    return F.coalesce(F.from_json(c, schema), empty)
