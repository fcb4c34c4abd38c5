"""Several vectors an atom, and the bucketed content cache."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomloom.operators import tables, vector

SCHEMA = "atom_id string, vectors array<array<float>>"


def unit(v):
    v = np.array([x or 0 for x in v], float)
    return v / np.linalg.norm(v) if np.linalg.norm(v) else v


def plain_max_sim(items, queries, k):
    out = {}
    for q, asked in queries:
        scores = []
        for a, held in items:
            total = []
            for d in {len(v) for v in asked or [] if v}:
                own = [unit(v) for v in held or [] if v and len(v) == d]
                if own:
                    total += [max(float(unit(v) @ w) for w in own) for v in asked if v and len(v) == d]
            if total:
                scores.append((-round(sum(total), 9), a))
        out |= {(q, r + 1): (a, -s) for r, (s, a) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize("batch,query_bytes", [(4096, 16 << 20), (7, 600)])
def test_max_sim_is_that_of_all_pairs(spark, monkeypatch, batch, query_bytes):
    monkeypatch.setattr(vector, "BATCH_ROWS", batch)
    monkeypatch.setattr(vector, "QUERY_BYTES", query_bytes)
    rng = np.random.default_rng(2)
    items = [(f"a{k:03}", [rng.normal(size=6).astype(np.float32).tolist() for _ in range(rng.integers(0, 5))]) for k in range(90)]
    items += [("none", None), ("null", [None, []]), ("zero", [[0.0] * 6]), ("twin1", [[1.0] * 6]), ("twin2", [[2.0] * 6]), ("other", [[1.0, 2.0]])]
    queries = [(k, v) for k, (_, v) in enumerate(items[::9])] + [(100, [[1.0] * 6, [-1.0] * 6]), (101, None), (102, [[3.0, 6.0]])]
    got = vector.max_sim(spark.createDataFrame(items, SCHEMA).repartition(3), spark.createDataFrame(queries, "query_id long, vectors array<array<float>>"), 8).collect()
    want = plain_max_sim(items, queries, 8)
    assert {(r.query_id, r["rank"]) for r in got} == set(want)
    for r in got:
        assert r.score == pytest.approx(want[r.query_id, r["rank"]][1], abs=1e-6)
    assert sum(r.atom_id != want[r.query_id, r["rank"]][0] for r in got) <= 2  # sums that are equal but for their last bits


def test_long_columns_of_queries_stay_behind(spark):
    items = spark.createDataFrame([(k, [float(k % 5), 1.0]) for k in range(40)], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 1.0], "a text " * 1000, 2.5)], "query_id long, embedding array<float>, text string, weight double")
    sent = vector.best_scores(items, queries, 3, "vec_id", "query_id")
    assert "text" not in sent.columns and "weight" in sent.columns
    rows = vector.top_k(items, queries, 3).collect()
    assert len(rows) == 3 and all(r.text == "a text " * 1000 and r.weight == 2.5 for r in rows)


def test_only_the_items_go_to_the_cache(spark):
    items = spark.createDataFrame([(k, f"content {k % 50}") for k in range(400)] + [(900, None)], "id long, content string")
    hashes = lambda low, high: spark.range(low, high).select(F.md5(F.concat(F.lit("content "), F.col("id").cast("string"))).alias("content_hash"), F.col("id").alias("place"))
    spark.sql("DROP TABLE IF EXISTS contents")
    tables.save_cache(hashes(0, 20), "contents", buckets=8)
    tables.save_cache(hashes(20, 30), "contents", buckets=8)
    left = tables.missing_from_cache(items, "contents", buckets=8)
    same = tables.content_cache(items, spark.table("contents"))
    rows = sorted((r.content_hash or "", r.content or "") for r in left.collect())
    assert rows == sorted((r.content_hash or "", r.content or "") for r in same.collect()) and len(rows) == 21
    plan = left._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1 and "BroadcastExchange" not in final and "SortMergeJoin" in final
