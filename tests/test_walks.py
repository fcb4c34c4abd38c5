"""Walks without paths and searches dealt over tasks, against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomloom.operators import graph

EDGES = "edge_id long, src long, dst long, edge_type string, weight double"


def trails(edges, seeds, hops):
    """{node: (distance, greatest weight)} over all walks that use no edge twice, by trying them all."""
    out = {}

    def walk(node, used, weight):
        for k, a, b, _, w in edges:
            if k not in used and node in (a, b):
                other, total, d = (b if node == a else a), weight + w, len(used) + 1
                low, high = out.get(other, (d, total))
                out[other] = (min(low, d), max(high, total))
                if d < hops:
                    walk(other, used | {k}, total)

    for s in set(seeds):
        walk(s, frozenset(), 0.0)
    return out


@pytest.mark.parametrize("hops", [1, 2, 3, 4])
def test_traverse_is_all_trails(spark, hops):
    rng = random.Random(hops)
    edges = [(k, rng.randrange(9), rng.randrange(9), rng.choice(["NEXT", "PART_OF"]), rng.randrange(1, 40) / 8) for k in range(16)]
    edges += [(100, 1, 2, "NEXT", 0.5), (101, 1, 2, "NEXT", 0.5), (102, 2, 1, "NEXT", 0.25), (103, 3, 3, "NEXT", 4.0), (104, 20, 21, "NEXT", -1.0)]  # parallel, a loop, an island
    asked = {1: [0], 2: [1, 2, 1], 3: [3, 4, 5], 4: [20], 5: [99]}
    seeds = spark.createDataFrame([(q, s) for q, own in asked.items() for s in own], "query_id long, seed long")
    got = {q: {} for q in asked}
    for r in graph.traverse(spark.createDataFrame(edges, EDGES), seeds, hops).collect():
        got[r.query_id][r.node] = (r.distance, r.path_weight)
    for q, own in asked.items():
        want = trails(edges, own, hops)
        assert got[q].keys() == want.keys()
        assert all(got[q][n][0] == want[n][0] and got[q][n][1] == pytest.approx(want[n][1]) for n in want), q


def test_a_hub_costs_its_edges(spark):
    """100 000 leaves around one node: pairs of leaves would be ten thousand million paths."""
    n = 100_000
    edges = spark.range(1, n + 1).select(F.col("id").alias("edge_id"), F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit("NEXT").alias("edge_type"), (F.col("id") / n).alias("weight"))
    seeds = spark.range(1, 2001).select(F.lit(7).cast("long").alias("query_id"), F.col("id").alias("seed"))
    got = graph.traverse(edges, seeds, 2)
    # any leaf is reached from the heaviest seed but itself; the centre in one hop
    want = F.when(F.col("node") == 0, 2000 / n).otherwise(F.col("node") / n + F.when(F.col("node") == 2000, 1999 / n).otherwise(2000 / n))
    assert got.count() == n + 1
    assert got.where((F.abs(F.col("path_weight") - want) > 1e-9) | (F.col("distance") != F.when(F.col("node") == 0, 1).otherwise(2))).count() == 0
    assert [r.node for r in graph.traverse(edges, seeds, 2, limit=3).orderBy("distance", F.desc("path_weight")).collect()] == [0, n, n - 1]


def test_kept_paths_are_bounded(spark):
    """Many paths to one node: of two hops two are kept, of three the heaviest and those without its edges."""
    edges = [(k, 0, 1 + k % 50, "NEXT", float(k)) for k in range(200)] + [(1000 + k, 1 + k, 99, "NEXT", 1.0) for k in range(50)]
    view = graph.oriented(spark.createDataFrame(edges, EDGES))
    one = view.where("node = 0").select(F.lit(1).alias("query_id"), "other", F.col("weight").alias("w"), F.array("edge_id").alias("used"))
    two = one.join(view.withColumnRenamed("other", "far"), F.col("other") == F.col("node")).where(~F.array_contains("used", F.col("edge_id")))
    paths = two.select("query_id", F.col("far").alias("node"), (F.col("w") + F.col("weight")).alias("w"), F.array_append("used", F.col("edge_id")).alias("used"))
    kept = graph.representatives(paths, 1)
    counts = Counter(r.node for r in kept.collect())
    assert max(counts.values()) <= 3 and counts[99] >= 2 and max(r.w for r in kept.where("node = 99").collect()) == 200.0


@pytest.mark.parametrize("work", [1, 500, 1 << 22])
def test_structural_by_sources_is_the_whole(spark, work):
    rng = random.Random(3)
    edges = {tuple(sorted(rng.sample(range(40), 2))): rng.randrange(1, 9) / 4 for _ in range(90)}
    df = spark.createDataFrame([(k, a, b, "NEXT", w) for k, ((a, b), w) in enumerate(edges.items())], EDGES)
    asked = {1: list(range(40)), 2: list(range(0, 40, 3)), 3: [5], 4: [1, 2], 5: [700, 701, 702]}
    nodes = spark.createDataFrame([(q, v) for q, own in asked.items() for v in own], "query_id long, node long")
    got = {(r.query_id, r.node): r for r in graph.structural(df, nodes, work=work).collect()}
    assert len(got) == sum(map(len, asked.values()))
    for q, own in asked.items():
        inner = [(a, b, w) for (a, b), w in edges.items() if a in own and b in own]
        want = graph.betweenness(own, inner)
        for v in own:
            degree = sum(v in e[:2] for e in inner) / (len(own) - 1) if len(own) > 1 else 1.0
            assert got[q, v].betweenness == pytest.approx(want[v]) and got[q, v].degree == pytest.approx(degree)
            assert got[q, v].structural == pytest.approx(0.6 * degree + 0.4 * want[v])


def test_many_candidates_go_to_several_tasks(spark):
    """A path of 1200 nodes: betweenness of the k-th is known, and the searches are dealt to four tasks."""
    n = 1200
    edges = spark.range(n - 1).select(F.col("id").alias("edge_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("NEXT").alias("edge_type"), F.lit(1.0).alias("weight"))
    nodes = spark.range(n).select(F.lit(1).cast("long").alias("query_id"), F.col("id").alias("node"))
    found = graph.structural(edges, nodes, work=n * (2 * n) // 4)
    k = F.col("node")
    want = 2.0 * k * (n - 1 - k) / ((n - 1) * (n - 2))
    # each pair is counted from both ends, as sources are
    assert found.where(F.abs(F.col("betweenness") - want) > 1e-9).count() == 0 and found.count() == n


def graphs():
    rng = random.Random(11)
    for n, m, weights in ((60, 90, [k / 8 for k in range(1, 9)]), (60, 150, [1.0]), (200, 230, None), (90, 70, [0.5, 1.5])):
        pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
        yield n, [(a, b, rng.choice(weights) if weights else rng.uniform(0.1, 1)) for a, b in pairs]
    yield 49, [(7 * r + c, 7 * r + c + step, 1.0) for r in range(7) for c in range(7) for step in (1, 7) if (step == 7 and r < 6) or (step == 1 and c < 6)]  # a grid: many paths of one length
    yield 50, [(0, k, 1.0) for k in range(1, 50)]
    yield 40, [(k, k + 1, 1e-20) for k in range(20)] + [(k, k + 1, 1.0) for k in range(20, 39)]  # weights that a distance can't tell from 0


@pytest.mark.parametrize("cells", [1 << 21, 300])
def test_searches_in_blocks_are_single_searches(monkeypatch, cells):
    monkeypatch.setattr(graph, "SEARCH_CELLS", cells)
    monkeypatch.setattr(graph, "STEP_CELLS", cells)
    for n, edges in graphs():
        a, b, w = (np.array(c) for c in zip(*edges, strict=True))
        for own in (np.arange(n), np.arange(1, n, 3)):
            want = graph.dependencies(graph.neighbourhoods(list(range(n)), edges), own.tolist())
            assert graph.block_dependencies(n, a, b, w, own) == pytest.approx([want[k] for k in range(n)])


def test_searches_of_a_large_component_go_in_blocks(monkeypatch):
    """None of its sources is searched on its own."""
    n, rng = 3000, random.Random(2)
    a = np.array([rng.randrange(k) for k in range(1, n)] + [rng.randrange(n) for _ in range(n)])
    b = np.array([*range(1, n), *[rng.randrange(n) for _ in range(n)]])
    keep = a != b
    a, b, w = a[keep], b[keep], np.array([rng.uniform(0.3, 1) for _ in range(int(keep.sum()))])
    first = np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_index=True)[1]
    a, b, w = a[first], b[first], w[first]
    with monkeypatch.context() as m:
        m.setattr(graph, "dependencies", None)  # one search at a time is not for these
        found = graph.block_dependencies(n, a, b, w, np.arange(0, n, 10))
    want = graph.dependencies(graph.neighbourhoods(list(range(n)), list(zip(a.tolist(), b.tolist(), w.tolist(), strict=True))), list(range(0, n, 10)))
    assert found == pytest.approx([want[k] for k in range(n)])
