"""Graph, retrieval and vector operators on small graphs."""

import pytest
from pyspark.sql import functions as F

from atomloom.config import RetrievalWeights
from atomloom.operators import graph, retrieval, vector


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(1, 2, "NEXT", 0.5), (2, 3, "NEXT", 0.25), (1, 3, "SIMILAR_TO", 0.75), (3, 4, "NEXT", 1.0)], "src long, dst long, edge_type string, weight double")


def test_part_of_takes_the_nearest(spark):
    rows = [("s", "m1", "mid", 0.0), ("s", "m2", "mid", 10.0), ("s", "f1", "fine", 5.0), ("s", "f2", "fine", 6.0), ("s", "f3", "fine", -9.0), ("t", "f4", "fine", 1.0)]
    atoms = spark.createDataFrame(rows, "source string, atom_id string, resolution string, ts double")
    assert {(r.src, r.dst) for r in graph.part_of(atoms, "fine", "mid").collect()} == {("f1", "m1"), ("f2", "m2"), ("f3", "m1")}


def test_traverse(spark, edges):
    seeds = spark.createDataFrame([(0, 1)], "query_id long, seed long")
    got = {r.node: (r.distance, r.path_weight) for r in graph.traverse(edges, seeds, 2).collect()}
    assert got == {2: (1, 1.0), 3: (1, 0.75), 4: (2, 1.75)}
    assert [r.node for r in graph.traverse(edges, seeds, 2, limit=1).collect()] == [2]


def plain_pagerank(edges, seeds, alpha, rounds, tolerance):
    out = {}
    for s, d, w in edges:
        out.setdefault(s, []).append((d, w))
    score = {s: 1 / len(seeds) for s in seeds}
    for _ in range(rounds):
        got = {}
        for n, v in score.items():
            for d, w in out.get(n, []):
                got[d] = got.get(d, 0) + v * w / len(out[n])
            if n not in out:
                for s in seeds:
                    got[s] = got.get(s, 0) + v / len(seeds)
        new = {n: alpha * (1 / len(seeds) if n in seeds else 0) + (1 - alpha) * m for n, m in got.items()}
        if max(abs(new.get(n, 0) - score.get(n, 0)) for n in {*new, *score}) < tolerance:
            return score
        score = new
    return score


def test_pagerank(spark, edges):
    seeds = spark.createDataFrame([(0, 1), (0, 4)], "query_id long, seed long")
    plain = [(1, 2, 0.5), (2, 3, 0.25), (1, 3, 0.75), (3, 4, 1.0)]
    for rounds in (2, 6):
        got = {r.node: r.score for r in graph.personalized_pagerank(edges, seeds, iterations=rounds, tolerance=1e-3).collect()}
        want = plain_pagerank(plain, [1, 4], 0.15, rounds, 1e-3)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_pagerank_of_several_queries(spark, edges):
    plain = [(1, 2, 0.5), (2, 3, 0.25), (1, 3, 0.75), (3, 4, 1.0)]
    asked = {0: [1, 2], 1: [77, 78], 2: [4, 99], 3: [1]}  # 77, 78 and 99 are in no edge, 4 has none that leave it
    seeds = spark.createDataFrame([(q, s) for q, own in asked.items() for s in own], "query_id long, seed long")
    got = {q: {} for q in asked}
    for r in graph.personalized_pagerank(edges, seeds, iterations=5, tolerance=None).collect():
        got[r.query_id][r.node] = r.score
    for q, own in asked.items():
        want = plain_pagerank(plain, own, 0.15, 5, -1.0)
        assert got[q].keys() == want.keys() and all(abs(got[q][k] - want[k]) < 1e-12 for k in want)


def test_betweenness():
    path = graph.betweenness([1, 2, 3, 4], [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)])
    assert path == pytest.approx({1: 0, 2: 2 / 3, 3: 2 / 3, 4: 0})
    star = graph.betweenness([0, 1, 2, 3], [(0, 1, 1.0), (0, 2, 1.0), (0, 3, 1.0)])
    assert star == pytest.approx({0: 1, 1: 0, 2: 0, 3: 0})
    square = graph.betweenness([1, 2, 3, 4], [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 1, 1.0)])
    assert square == pytest.approx(dict.fromkeys([1, 2, 3, 4], 1 / 6))
    detour = graph.betweenness([1, 2, 3], [(1, 2, 0.1), (2, 3, 0.1), (1, 3, 0.9)])
    assert detour == pytest.approx({1: 0, 2: 1, 3: 0})


def test_structural(spark, edges):
    nodes = spark.createDataFrame([(0, n) for n in (1, 2, 3, 4)] + [(1, 9)], "query_id long, node long")
    got = {(r.query_id, r.node): (round(r.degree, 6), r.betweenness) for r in graph.structural(edges, nodes).collect()}
    assert got[0, 3] == (1.0, pytest.approx(2 / 3)) and got[1, 9] == (1.0, 0.0)


def test_aligned_spans(spark):
    rows = [("s", "audio", 1, 0.0, 10.0), ("s", "text", 2, 5.0, 20000.0), ("s", "text", 3, 10.0, 11.0), ("t", "text", 4, 0.0, 9.0), ("s", "audio", 5, 3.0, 3.0)]
    spans = spark.createDataFrame(rows, "source string, kind string, id long, start double, stop double")
    assert {(r.src, r.dst, r.weight) for r in graph.aligned(spans).collect()} == {(1, 2, 0.5), (2, 1, 0.5)}


def test_knn_in_blocks(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(99, None)]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    key = lambda df: sorted((r.src, r.dst, round(r.weight, 9)) for r in df.collect())
    assert key(vector.knn(items, 5, 0.6, block_rows=9)) == key(vector.knn(items, 5, 0.6))
    assert vector.knn(items.limit(0)).count() == 0


def test_betweenness_of_many_candidates(spark):
    """A star of 520 leaves: every shortest path goes through its centre."""
    e = spark.createDataFrame([(0, i, "NEXT", 1.0) for i in range(1, 521)], "src long, dst long, edge_type string, weight double")
    got = {r.node: r.betweenness for r in graph.structural(e, spark.createDataFrame([(1, i) for i in range(521)], "query_id long, node long")).collect()}
    assert len(got) == 521 and got[0] == pytest.approx(1.0) and not any(got[i] for i in range(1, 521))


def test_pooling(spark):
    df = spark.createDataFrame([(1, [3.0, 0.0]), (1, [0.0, 4.0]), (2, None)], "video_id long, embedding array<float>")
    got = {r.video_id: r.embedding for r in vector.pooled(df, size=3).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == [0.0, 0.0, 0.0]


def test_mmr(spark):
    rows = [(0, n, n, 1.0 - n / 100, [1.0, 0.0] if n < 20 else [0.0, 1.0]) for n in range(22)]
    c = spark.createDataFrame(rows, "query_id long, node long, pos long, score double, embedding array<double>")
    picked = [r.node for r in retrieval.mmr(c, k=4, penalty=0.25).orderBy("rank").collect()]
    assert picked == [0, 20, 1, 21]
    assert [r.node for r in retrieval.mmr(c.where("node < 20"), k=20).orderBy("rank").collect()] == list(range(20))


def test_bm25_with_a_term_in_every_hit(spark):
    hits = spark.createDataFrame([(1, 10, "a b"), (1, 11, "a a c"), (1, 12, "a d")], "query_id long, atom_id long, content string")
    got = {r.atom_id: r.bm25 for r in retrieval.bm25(hits, spark.createDataFrame([(1, "a")], "query_id long, text string")).collect()}
    import math

    idf = {t: math.log(3 - d + 0.5) - math.log(d + 0.5) for t, d in {"a": 3, "b": 1, "c": 1, "d": 1}.items()}
    low = 0.25 * sum(idf.values()) / 4
    assert got[10] == pytest.approx(low * 1 * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / (7 / 3))))


def test_min_max_of_equal_scores(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 0.0), (2, -1.0), (3, 1.0), (3, 3.0)], "query_id long, s double")
    assert sorted((r.query_id, r.s) for r in retrieval.min_max(df, "s").collect()) == [(1, 0.0), (1, 0.0), (2, -1.0), (2, 0.0), (3, 0.0), (3, 1.0)]


def test_weights():
    w = RetrievalWeights().updated(0.9)
    assert w.alpha == pytest.approx(0.35 / 1.05) and sum((w.alpha, w.beta, w.gamma, w.delta, w.epsilon)) == pytest.approx(1)
    assert retrieval.learned_weights(w, [1.0] * 9) is w


def test_views(spark, edges):
    atoms = spark.createDataFrame([("a", "", "", None, "")], "atom_id string, content string, source string, modality string, resolution string")
    r = graph.view_nodes(atoms).first()
    assert (r.name, r.label, r.group, r.source, r.resolution) == ("Knowledge Node", "Empty Content", "text", "unknown", "unknown")
    e = spark.createDataFrame([("nodes/1", "nodes/2", "NEXT", 1.0)], "src string, dst string, edge_type string, weight double")
    assert graph.view_edges(e).first()[:2] == ("1", "2")
    assert graph.touching(edges, spark.createDataFrame([(4,)], "fragment_id long")).count() == 1
    assert graph.normalized(edges).where("weight <= 0 or weight >= 1").count() == 0
