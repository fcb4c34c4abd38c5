"""A written inverted index for keyword search: blocks of postings with the greatest score of each block.

Atoms are dealt into blocks of about ``PER_BLOCK`` by a hash of their id. ``docs`` has a row for each block: its ids and
lengths. ``postings`` has a row for each term and block: which places of the block hold the term, how often, and ``top``,
the greatest saturated frequency among them. It is sorted by term, so that a search reads the row groups of its terms and,
for bounds, only the columns without postings. A query's best atoms come from two steps: the blocks with the greatest
bounds (the sum of its terms' tops, weighted) are scored, which gives a score that k atoms reach; then only blocks whose
bound reaches it are read. Building shuffles the texts once, by block, and the postings once, by term.

Atom ids are distinct; rows without one are left out. A null or empty text has no postings.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atomloom.functions.text import bm25_tokens
from atomloom.operators.retrieval import K1, B, asked_terms, first_by_id
from atomloom.session import materialize, shared_dir

PER_BLOCK, PROBES, PER_TASK = 256, 2, 20_000
#: Bounds and scores are sums in different orders.
SLACK = 1 + 1e-9


@dataclass
class Index:
    docs: DataFrame  # block, items, lengths
    postings: DataFrame  # term, block, n, top, slots, counts
    stats: DataFrame  # n, mean

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        return cls(*[spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings", "stats")])


def build(atoms: DataFrame, item: str = "atom_id", text: str = "content", per_block: int = PER_BLOCK, path: str | None = None) -> Index:
    """Write the index of ``atoms`` below ``path`` (by default a new folder in the shared one)."""
    spark = atoms.sparkSession
    path = path or f"{shared_dir(spark)}/keyword-index-{uuid.uuid4().hex}"
    rows = atoms.select(F.col(item).alias("item"), F.col(text).alias("t")).where("item is not null")
    count = rows.count()
    blocks = max(1, math.ceil(count / per_block))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    tokenized = lambda d: d.select("block", "item", bm25_tokens(F.col("t")).alias("w"))
    tokens = tokenized(rows)
    # of many atoms a task sorts a bounded share
    parts = math.ceil(count / PER_TASK)
    share = [parts] if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else []

    lengths = tokens.select("block", "item", F.size("w").alias("length")).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("item", F.when(F.col("length") >= 0, F.col("length")).alias("length")))).alias("d"))
    lengths.select("block", F.col("d.item").alias("items"), F.col("d.length").alias("lengths")).write.parquet(f"{path}/docs")
    docs = spark.read.parquet(f"{path}/docs")
    stats = docs.select(F.explode("lengths").alias("l")).agg(F.count(F.lit(1)).alias("n"), F.avg("l").alias("mean"))
    stats.write.parquet(f"{path}/stats")
    mean = spark.read.parquet(f"{path}/stats").first()["mean"] or 1.0

    def invert(table: pa.Table) -> pa.Table:
        """The postings of one block; its places are in the order of ids, as in ``docs``."""
        table = table.take(pc.sort_indices(table.column("item")))
        words = table.column("w").combine_chunks()
        length, rows = np.asarray(words.value_lengths().fill_null(0)), len(table)
        codes = words.flatten().dictionary_encode()
        held, tf = np.unique(np.asarray(codes.indices).astype(np.int64) * rows + np.repeat(np.arange(rows), length), return_counts=True)
        term, slot = held // rows, held % rows
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        ends = pa.array(np.append(starts, len(term)).astype(np.int32))
        saturated = tf / (tf + K1 * (1 - B + B * length[slot] / mean))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (slot, tf)]
        block = pa.array(np.full(len(starts), table.column("block")[0].as_py()))
        return pa.table({"term": codes.dictionary.take(pa.array(term[starts])), "block": block, "n": np.diff(ends).astype(np.int32), "top": np.maximum.reduceat(saturated, starts) if len(starts) else saturated, "slots": lists[0], "counts": lists[1]})

    # one shuffle, by block; a block is a few hundred texts, which are dealt and sorted as texts: tokens take several times the room
    dealt = tokenized(rows.repartition(*share, "block").sortWithinPartitions("block"))
    lists = materialize(dealt.groupBy("block").applyInArrow(invert, "term string, block long, n int, top double, slots array<int>, counts array<int>"), "postings")
    lists.repartitionByRange(*share, "term", "block").sortWithinPartitions("term", "block").write.parquet(f"{path}/postings")
    return Index.open(spark, path)


def held_terms(index: Index, queries: DataFrame) -> DataFrame:
    """The postings of the queries' terms; where these are few the scan itself is told."""
    terms = asked_terms(queries)
    if terms is None:
        return index.postings.join(queries.select(F.explode(bm25_tokens(F.col("text"))).alias("term")).distinct(), "term", "left_semi")
    return index.postings.where(F.col("term").isin(terms) if terms else F.lit(False))


def full_text(index: Index, queries: DataFrame, limit: int | None = None, item: str = "atom_id") -> DataFrame:
    """(query_id, item): atoms that hold all tokens of a query (query_id, text); the first ``limit`` by id."""
    terms = queries.select("query_id", F.explode(F.array_distinct(bm25_tokens(F.col("text")))).alias("term"))
    wanted = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    met = held_terms(index, queries).select("term", "block", "slots").join(terms, "term").groupBy("query_id", "block").agg(F.collect_list("slots").alias("s"))
    met = met.join(wanted, "query_id").where(F.size("s") == F.col("wanted"))  # a query has few terms
    both = F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.get("s", 0), lambda a, b: F.array_intersect(a, b))
    met = met.select("query_id", "block", both.alias("slots")).where(F.size("slots") > 0)
    hits = met.join(index.docs.select("block", "items"), "block").select("query_id", F.explode(F.transform("slots", lambda s: F.get("items", s))).alias(item))
    return hits if limit is None else first_by_id(hits, limit, item)


@dataclass
class Search:
    """A batch of queries over an index: weights of their terms, bounds of their blocks."""

    index: Index
    postings: DataFrame
    weights: DataFrame  # query_id, term, weight
    bounds: DataFrame  # query_id, block, bound
    mean: float

    @classmethod
    def start(cls, index: Index, queries: DataFrame) -> Search:
        stats = index.stats.first()
        postings = held_terms(index, queries)
        asked = queries.select("query_id", F.explode(bm25_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
        df = postings.groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.log((stats["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        weights = materialize(asked.join(df, "term").select("query_id", "term", (F.col("times") * idf * (K1 + 1)).alias("weight")), "weights")
        bounds = postings.select("term", "block", "top").join(weights, "term").groupBy("query_id", "block").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"))
        return cls(index, postings, weights, materialize(bounds, "bounds"), stats["mean"] or 1.0)

    def scores(self, pairs: DataFrame, item: str) -> DataFrame:
        """(query_id, item, bm25) of all atoms of the blocks in ``pairs`` (query_id, block) that hold a term of the query."""
        held = self.postings.select("term", "block", "slots", "counts").join(self.weights, "term").join(pairs.select("query_id", "block"), ["query_id", "block"]).join(self.index.docs, "block")
        parts = F.transform(F.arrays_zip("slots", "counts"), lambda p: F.struct(F.get("items", p["slots"]).alias("i"), (F.col("weight") * p["counts"] / (p["counts"] + K1 * (1 - B + B * F.get("lengths", p["slots"]) / self.mean))).alias("s")))
        return held.select("query_id", F.inline(parts)).groupBy("query_id", F.col("i").alias(item)).agg(F.sum("s").alias("bm25"))

    def needed(self, k: int, item: str) -> DataFrame:
        """The blocks that may hold one of the best ``k``: those whose bound reaches a score that ``k`` atoms have."""
        first = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        probes = self.bounds.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= PROBES)
        order = Window.partitionBy("query_id").orderBy(F.desc("bm25"))
        reached = self.scores(probes, item).withColumn("__r", F.row_number().over(order)).where(F.col("__r") == k).select("query_id", F.col("bm25").alias("reached"))
        return self.bounds.join(reached, "query_id", "left").where(F.col("reached").isNull() | (F.col("bound") * SLACK >= F.col("reached"))).select("query_id", "block")


def bm25_top(index: Index, queries: DataFrame, k: int = 10, item: str = "atom_id") -> DataFrame:
    """(query_id, item, bm25, rank): the best ``k`` atoms of the whole index by its own statistics, ties by id."""
    search = Search.start(index, queries)
    best = Window.partitionBy("query_id").orderBy(F.desc("bm25"), item)
    return search.scores(search.needed(k, item), item).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
