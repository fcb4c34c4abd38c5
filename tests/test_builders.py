"""Graph builders, vector search and retrieval against plain versions."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomloom.config import RESOLUTION_WEIGHTS, RetrievalWeights, SearchConfig
from atomloom.functions import messy_json
from atomloom.operators import graph, research, retrieval, vector


@pytest.fixture
def many_ranges(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def test_next_edges_over_ranges(spark, many_ranges):
    rows = [("hot" if i % 5 else None, f"a{i:03}", float(i // 3 * 60)) for i in range(300)] + [("one", "x", 5.0)]
    df = spark.createDataFrame(rows, "source string, atom_id string, ts double").repartition(5)
    got = {(r.src, r.dst, round(r.weight, 9)) for r in graph.next_edges(df, ("source",)).collect()}
    want = set()
    for key in {r[0] for r in rows}:
        own = sorted((t, a) for s, a, t in rows if s == key)
        want |= {(a, b, round(math.exp(-(u - t) / 3600), 9)) for (t, a), (u, b) in zip(own, own[1:], strict=False)}
    assert got == want


def test_part_of_over_ranges(spark, many_ranges):
    rng = np.random.default_rng(4)
    rows = [("hot", f"c{i:03}", "fine", float(rng.integers(0, 500))) for i in range(250)] + [("hot", f"p{i:02}", "mid", float(rng.integers(100, 400))) for i in range(30)]
    rows += [("hot", "pz", "mid", rows[-1][3]), (None, "c", "fine", 1.0), (None, "p", "mid", 9.0), ("none", "d", "fine", 1.0)]
    df = spark.createDataFrame(rows, "source string, atom_id string, resolution string, ts double")
    got = {r.src: r.dst for r in graph.part_of(df, "fine", "mid").collect()}
    want = {}
    for s, c, kind, t in rows:
        near = [(abs(t - u), p) for q, p, k, u in rows if q == s and k == "mid"]
        if kind == "fine" and near:
            want[c] = min(near)[1]
    assert got == want


def test_entity_shared_with_equal_sets(spark):
    sets = {1: "ab", 2: "ab", 3: "abc", 4: "ba", 5: "xyz", 6: "cx", 7: "", 8: "q", 9: "q"}
    df = spark.createDataFrame([(k, list(v)) for k, v in sets.items()], "atom_id long, entities array<string>")
    got = {(r.src, r.dst, round(r.weight, 9)) for r in graph.entity_shared(df, threshold=0.3).collect()}
    want = set()
    for a, x in sets.items():
        for b, y in sets.items():
            if a != b and set(x) & set(y) and (w := len(set(x) & set(y)) / len(set(x) | set(y))) > 0.3:
                want.add((a, b, round(w, 9)))
    assert got == want


def plain_cos(a, b):
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb) if na and nb else 0.0


def vectors(n, d, seed):
    return [[float(x) for x in row] for row in np.random.default_rng(seed).normal(size=(n, d)).round(3)]


def test_grounded_in_blocks(spark):
    v = vectors(60, 4, 1)
    rows = [(k % 2, f"n{k}", v[k]) for k in range(60)] + [(0, "none", None), (1, "long", [1.0] * 5), (None, "x", v[0])]
    df = spark.createDataFrame(rows, "source long, atom_id string, clip array<float>")
    images, texts = df.where("atom_id < 'n4'"), df.where("atom_id >= 'n4'")
    got = {(r.src, r.dst, round(r.weight, 5)) for r in graph.grounded(images, texts, threshold=0.4, block_rows=7).collect()}
    want = set()
    for s, a, x in rows:
        for t, b, y in rows:
            if a < "n4" <= b and s == t and s is not None and x and y and len(x) == len(y) and (c := plain_cos(x, y)) >= 0.4:
                want |= {(a, b, round(min(1, c), 5)), (b, a, round(min(1, c), 5))}
    assert got == want and got


@pytest.mark.parametrize("query_bytes", [16 << 20, 400])
def test_top_k_in_blocks_of_queries(spark, monkeypatch, query_bytes):
    monkeypatch.setattr(vector, "QUERY_BYTES", query_bytes)
    monkeypatch.setattr(vector, "BATCH_ROWS", 16)
    v = vectors(80, 6, 2)
    v[40:50] = [v[3]] * 10  # ties
    items = spark.createDataFrame([(k, x, "t") for k, x in enumerate(v)] + [(90, None, "t"), (91, [1.0, 2.0], "t"), (92, [], "t"), (93, [0.0] * 6, "t")], "vec_id long, embedding array<double>, kind string")
    asked = spark.createDataFrame([(k, v[k]) for k in range(0, 80, 20)] + [(200, v[3]), (201, None), (202, [2.0, 1.0])], "query_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, round(r.cos, 9), r.kind) for r in vector.top_k(items, asked, 5).collect()}
    want = {}
    for q, x in [(k, v[k]) for k in range(0, 80, 20)] + [(200, v[3]), (202, [2.0, 1.0])]:
        scored = sorted((-round(plain_cos(x, y), 12), k) for k, y in [*enumerate(v), (91, [1.0, 2.0]), (93, [0.0] * 6)] if len(x) == len(y))
        want |= {(q, n + 1): (k, round(-c, 9) + 0.0, "t") for n, (c, k) in enumerate(scored[:5])}
    assert got == want
    assert {r.cos >= 0.5 for r in vector.top_k(items, asked, 5, threshold=0.5).collect()} == {True}
    assert vector.top_k(items, asked.limit(0), 5).count() == 0


def test_knn_by_modality(spark):
    v, kinds = vectors(90, 3, 3), ["text", "image", "other"]
    df = spark.createDataFrame([(k, x, kinds[k % 3]) for k, x in enumerate(v)], "vec_id long, embedding array<float>, modality string")
    least = {"text": 0.5, "image": 0.8}
    want = set()
    for i, x in enumerate(v):
        near = sorted((-c, j) for j, y in enumerate(v) if i != j and i % 3 == j % 3 and (c := plain_cos(x, y)) >= least.get(kinds[i % 3], 2))
        want |= {(i, j, round(-c, 4)) for c, j in near[:4]}
    for found in (vector.knn(df, 4, least, modality="modality"), vector.knn(df, 4, least, modality="modality", block_rows=8)):
        assert {(r.src, r.dst, round(r.weight, 4)) for r in found.collect()} == want


def test_near_knn_finds_nine_of_ten(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 32))
    v = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.4, 0.8)])
    df = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(v)], "vec_id long, embedding array<double>")
    exact = {(r.src, r.dst): r.weight for r in vector.knn(df, 10, 0.5).collect()}
    for options in ({}, {"block_rows": 9}):
        near = {(r.src, r.dst): r.weight for r in vector.knn_near(df, 10, 0.5, **options).collect()}
        assert len(near.keys() & exact.keys()) >= 0.9 * len(exact) > 100
        assert all(w >= 0.5 for w in near.values())


def test_betweenness_counts_shortest_paths():
    rng = np.random.default_rng(8)
    for _ in range(5):
        nodes, edges = list(range(9)), {}
        for _ in range(16):
            a, b = sorted(rng.choice(9, 2, replace=False).tolist())
            edges[a, b] = float(rng.choice([0.5, 1.0, 1.5]))
        dist, ways = [[math.inf] * 9 for _ in nodes], [[0] * 9 for _ in nodes]

        def walk(start, at, length, seen, edges=edges, dist=dist, ways=ways):
            if length < dist[start][at]:
                dist[start][at], ways[start][at] = length, 0
            ways[start][at] += length == dist[start][at]
            for (a, b), w in edges.items():
                if at in (a, b) and (to := a + b - at) not in seen:
                    walk(start, to, length + w, seen | {to})

        for s in nodes:
            walk(s, s, 0.0, {s})
        want = {v: sum(ways[s][v] * ways[v][t] / ways[s][t] for s in nodes for t in nodes if len({s, t, v}) == 3 and dist[s][t] < math.inf and dist[s][v] + dist[v][t] == dist[s][t]) / (8 * 7) for v in nodes}
        assert graph.betweenness(nodes, [(a, b, w) for (a, b), w in edges.items()]) == pytest.approx(want)


def plain_mmr(rows, k, penalty):
    """rows: (node, score, vector) in order."""
    if len(rows) <= k:
        return [n for n, _, _ in rows]
    out = []
    while len(out) < k:
        left = [r for r in rows if r[0] not in [o[0] for o in out]]
        out.append(max(left, key=lambda r: r[1] - penalty * sum(plain_cos(r[2], o[2]) if r[2] and o[2] else 0.0 for o in out)))
    return [n for n, _, _ in out]


def test_mmr_is_greedy(spark):
    rng = np.random.default_rng(9)
    v = vectors(30, 5, 9)
    rows = [(q, n, n, float(rng.random()), v[n] if n % 7 else None) for q in range(3) for n in range(30)]
    df = spark.createDataFrame(rows, "query_id long, node long, pos long, score double, embedding array<double>")
    got = {}
    for r in retrieval.mmr(df, k=12, penalty=0.3).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.node)
    assert got == {q: plain_mmr([(n, s, x) for p, n, _, s, x in rows if p == q], 12, 0.3) for q in range(3)}


def plain_hybrid(atoms, edges, query, config, weights):
    """(node, v, g, b, s, m, score) of a query in order of the result; atoms by id: (content, modality, resolution, vector)."""
    qtext, qvec, wanted = query
    v = Counter()
    for res in RESOLUTION_WEIGHTS:
        own = sorted((-plain_cos(qvec, a[3]), k) for k, a in atoms.items() if a[2] == res)[: config.top_k_vector // 3]
        for c, k in own:
            v[k] += -c * RESOLUTION_WEIGHTS[res]
    v = dict(sorted(v.items(), key=lambda x: (-x[1], x[0]))[: config.top_k_vector])
    out, both = {}, {}
    for e, (a, b, w) in enumerate(edges):
        out.setdefault(a, []).append((b, w))
        both.setdefault(a, []).append((e, b, w))
        both.setdefault(b, []).append((e, a, w))
    reached = {}
    for s in v:
        for e, x, w in both.get(s, []):
            reached[x] = max(reached.get(x, -1), w)
            for f, y, u in both.get(x, []):
                if f != e:
                    reached[y] = max(reached.get(y, -1), w + u)
    rank = {s: 1 / len(v) for s in v}
    for _ in range(config.ppr_iterations):
        got = {}
        for n, x in rank.items():
            for d, w in out.get(n, []):
                got[d] = got.get(d, 0) + x * w / len(out[n])
            if n not in out:
                for s in v:
                    got[s] = got.get(s, 0) + x / len(v)
        new = {n: config.ppr_alpha * (1 / len(v) if n in v else 0) + (1 - config.ppr_alpha) * m for n, m in got.items()}
        if max(abs(new.get(n, 0) - rank.get(n, 0)) for n in {*new, *rank}) < config.ppr_tolerance:
            break
        rank = new
    g = {n: 0.6 * rank.get(n, 0) + 0.4 * w for n, w in reached.items() if n not in v}
    g = dict(sorted(g.items(), key=lambda x: (-x[1], x[0]))[: config.top_k_graph])
    terms = qtext.lower().split()
    hits = [k for k in sorted(atoms) if set(terms) <= set(atoms[k][0].lower().split())][: config.top_k_bm25]
    docs = {k: atoms[k][0].lower().split() for k in hits}
    df = Counter(t for d in docs.values() for t in set(d))
    idf = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf) if idf else 0
    mean = sum(map(len, docs.values())) / len(docs) if docs else 1
    b = {k: sum((idf[t] if idf[t] >= 0 else low) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in terms) for k, d in docs.items()}
    if b and max(b.values()) > 0:
        lo, hi = min(b.values()), max(b.values())
        b = {k: (x - lo) / (hi - lo) if hi > lo else 0.0 for k, x in b.items()}
    nodes = sorted({*v, *g, *b})
    inner = {}
    for a, c, w in edges:
        if a in nodes and c in nodes and a != c:
            inner[min(a, c), max(a, c)] = w
    between = graph.betweenness(nodes, sorted((a, c, w) for (a, c), w in inner.items()))
    rows = []
    for n in nodes:
        degree = sum(n in p for p in inner) / (len(nodes) - 1)
        kind, media = atoms[n][1], ("image", "video", "audio")
        m = 1.0 if kind in wanted else 0.7 if ("text" in wanted and kind in media) or (kind == "text" and set(wanted) & set(media)) else 0.4
        s = 0.6 * degree + 0.4 * between[n]
        parts = (v.get(n, 0.0), g.get(n, 0.0), b.get(n, 0.0), s, m)
        score = sum(w * p for w, p in zip((weights.alpha, weights.beta, weights.gamma, weights.delta, weights.epsilon), parts, strict=True))
        rows.append((n, *parts, score))
    rows.sort(key=lambda r: (-r[-1], r[0]))
    order = plain_mmr([(r[0], r[-1], atoms[r[0]][3]) for r in rows], config.mmr_size, config.diversity_lambda)
    by = {r[0]: r for r in rows}
    return [by[n] for n in order]


def test_hybrid_retrieval_against_a_plain_version(spark):
    rng = np.random.default_rng(12)
    words = "red green blue dark light old new small".split()
    v = vectors(60, 6, 12)
    atoms = {k: (" ".join(rng.choice(words, 6)), ["text", "image", "audio", "table"][k % 4], ["fine", "mid", "coarse"][k % 3], v[k]) for k in range(60)}
    pairs = {tuple(sorted(rng.choice(60, 2, replace=False).tolist())) for _ in range(140)}
    edges = [(a, b, float(rng.integers(1, 100)) / 100 + k / 1e6) for k, (a, b) in enumerate(sorted(pairs))]
    asked = {0: ("red blue", v[7], ["text"]), 20: ("old", v[30], ["image", "table"]), 40: ("missing word", v[51], ["audio"])}
    df = spark.createDataFrame([(k, c, m, r, f"s{k % 5}", x) for k, (c, m, r, x) in atoms.items()], "atom_id long, content string, modality string, resolution string, source string, embedding array<double>")
    e = spark.createDataFrame([(a, b, "SIMILAR_TO", w) for a, b, w in edges], "src long, dst long, edge_type string, weight double")
    q = spark.createDataFrame([(k, *x) for k, x in asked.items()], "query_id long, text string, embedding array<double>, modalities array<string>")
    config, weights = SearchConfig(), RetrievalWeights()
    got = {}
    for r in retrieval.hybrid(df, e, q).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.node, r.v, r.g, r.b, r.s, r.m, r.score))
        near = sorted({x for a, b, _ in edges for x in (a, b) if r.node in (a, b) and x != r.node})[: config.context_neighbors]
        assert r.context == [atoms[x][0] for x in near]
    for k, query in asked.items():
        want = plain_hybrid(atoms, edges, query, config, weights)
        assert [r[0] for r in got[k]] == [r[0] for r in want]
        assert np.allclose(np.array(got[k], float), np.array(want, float))
    some = retrieval.hybrid(df, e, q, sources=["s1", "s2"], modality="text").collect()
    assert some and all(r.source in ("s1", "s2") and r.modality == "text" for r in some)


def test_distinct_findings_in_order(spark):
    rng = np.random.default_rng(3)
    words = [f"{a}word" for a in "abcdefghij"]
    rows = [(k % 2, k, " ".join(rng.choice(words, 5))) for k in range(120)] + [(0, 500, None), (0, 501, "12 ab")]
    df = spark.createDataFrame(rows, "source long, id long, text string")
    want = set()
    for key in (0, 1):
        kept = []
        for _, k, t in sorted(r for r in rows if r[0] == key):
            own = set(re.findall("[a-z]{3,}", (t or "")[:120].lower()))
            if not any(own | x and len(own & x) / len(own | x) > 0.65 for x in kept):
                kept.append(own)
                want.add((key, k))
    assert {tuple(r) for r in research.distinct_findings(df, "source", "id", "text").collect()} == want


def test_synthesis_chain(spark):
    nodes = spark.createDataFrame([("b", "synthesis", 1), ("a", "synthesis", 1), ("c", "synthesis", 0), ("f", "finding", 9)], "id string, type string, depth int")
    assert [(r.id, r.position, r.final) for r in research.synthesis_chain(nodes).orderBy("position").collect()] == [("c", 1, False), ("a", 2, False), ("b", 3, True)]
    assert research.synthesis_chain(nodes.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "want"), [
    ('[note: {"a": 1}', '{"a": 1}'), ('say {"a": [1, 2]} and [3]', '{"a": [1, 2]}'), ('x ] {"a": "}"} y', '{"a": "}"}'), ("{{{{", None), ('"quoted {" {"b": 2}', '{"b": 2}'), ("[1, [2, 3]", "[2, 3]"),
    ('{"a": "\\" ]"}', '{"a": "\\" ]"}'), ('{"a": 1, ] "b": [2]}', '{"a": 1, ] "b": [2]}'), ("[" * 200_000, None), ("[" * 50_000 + '{"k": 0}', '{"k": 0}'),
])
def test_brackets_that_match(text, want):
    assert messy_json.balanced(text) == want


def test_searches_are_split_by_source(spark):
    df = spark.createDataFrame([(1, "a", "text", "fine"), (2, "b", "text", "mid"), (3, None, "image", "fine")], "atom_id long, source string, modality string, resolution string")
    ids = lambda **k: {r.atom_id for r in retrieval.restricted(df, **k).collect()}
    assert ids() == {1, 2, 3} and ids(sources=["a", "b"]) == {1, 2} and ids(sources=[]) == set() and ids(modality="text", resolution="mid") == {2}
    assert df.where(F.col("source").isNull()).count() == 1
