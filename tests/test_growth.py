"""What is shuffled and written as tables grow, and what large blocks must not change."""

from __future__ import annotations

import math
import random
from functools import reduce

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from atomloom.operators import graph, postings, vector


def shuffled(spark, run) -> int:
    """Bytes that the jobs of ``run`` shuffled."""
    gateway = spark.sparkContext._gateway

    def total() -> int:
        store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
        stages = store.stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = total()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


def vectors(spark, m: np.ndarray):
    return spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(m)), "embedding": list(m)}), "vec_id long, embedding array<float>")


def test_each_vector_goes_out_once_for_each_of_few_blocks(spark):
    n, width = 20000, 16
    rows = vectors(spark, np.random.default_rng(1).standard_normal((n, width)).astype(np.float32)).repartition(4).localCheckpoint()
    # eight blocks, neighbours and classes; with blocks of 2048 rows each vector went out twenty times as doubles
    assert shuffled(spark, lambda: vector.knn(rows, 2, 0.9).count()) < n * width * 4 * 14


def test_blocks_of_vectors_stay_as_many_up_to_a_million(spark):
    sizes = [102_564, 307_692, 615_384, 1 << 20]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", vector.block_count(F.col("n")).alias("blocks")).collect()
    # with blocks of 65536 rows they were 8, 8, 10 and 16, so that each vector went out more often
    assert {r.n: r.blocks for r in rows} == dict.fromkeys(sizes, 8)


@pytest.mark.parametrize("shape,share", [((37, 53), 0.02), ((64, 128), 0.001), ((64, 128), 1.0), ((8, 3), 0.0), ((1, 1), 1.0)])
def test_few_true_cells_are_found_by_row_and_column(shape, share):
    cells = np.random.default_rng(4).random(shape) < share
    assert [x.tolist() for x in vector._places(cells)] == [x.tolist() for x in np.nonzero(cells)]


@pytest.mark.parametrize("block_rows", [5, 1 << 16])
def test_neighbours_of_copies_and_multiples_are_those_of_plain_sums(spark, block_rows):
    rng = random.Random(3)
    base = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(12)]
    m = np.array([[x * f for x in v] for f in (1.0, 3.0, 1.0, 0.7, 1.0) for v in base], np.float32)
    lists = m.astype(float).tolist()
    product = lambda a, b: reduce(lambda total, xy: total + xy[0] * xy[1], zip(a, b, strict=True), 0.0)  # noqa: E731 - the built-in sum compensates
    norm = [math.sqrt(product(v, v)) for v in lists]
    want = set()
    for i, v in enumerate(lists):
        near = sorted((-product(v, w) / (norm[i] * norm[j]), j) for j, w in enumerate(lists) if j != i)
        want |= {(i, j) for c, j in near[:3] if -c >= 0.5}
    got = vector.knn(vectors(spark, m).repartition(4), 3, 0.5, block_rows=block_rows).collect()
    assert {(r.src, r.dst) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("threshold,block_rows", [(0.05, 1 << 16), (0.05, 9), (0.4, 9), (1.0, 9)])
def test_links_are_counted_as_all_pairs_have_them(spark, threshold, block_rows):
    rng = random.Random(5)
    sets = [rng.sample([f"e{int(30 * rng.random() ** 2)}" for _ in range(12)], rng.randint(0, 12)) for _ in range(60)]
    sets += [sets[i] for i in (1, 1, 2, 3)] + [None, []]
    df = spark.createDataFrame(list(enumerate(sets)), "atom_id long, entities array<string>").repartition(3)
    want = []
    for i, s in enumerate(sets):
        mine = set(s or [])
        alike = [j for j, t in enumerate(sets) if j != i and mine and t and len(mine & set(t)) / len(mine | set(t)) > threshold]
        want.append((i, min((j for j, t in enumerate(sets) if t and set(t) == mine), default=None), len(alike)))
    got = sorted((r.atom_id, r.class_id, r.n_links) for r in graph.entity_links(df, threshold=threshold, block_rows=block_rows).collect())
    assert got == want


def test_an_index_is_built_from_texts_dealt_as_texts(spark):
    n = 2000
    words = [f"w{i % 7}" for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).sample(words, 300))) for i in range(n)], "atom_id long, content string").repartition(4).localCheckpoint()
    plan = []
    keep = postings.materialize

    def seen(df, label):
        plan.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, label)

    postings.materialize = seen
    try:
        index = postings.build(docs)
    finally:
        postings.materialize = keep
    # what goes through the exchange (below it in the plan) holds the text; tokens are made above
    above, below = plan[0].split("Exchange", 1)
    assert "split(" in above and "split(" not in below and below.count("Exchange") == 0
    assert index.postings.where("term = 'w3'").agg({"n": "sum"}).first()[0] == n


def test_what_shared_entities_shuffle_grows_with_the_sets_and_not_with_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(graph, "SET_ROWS", 100, raising=False)

    def run(n: int) -> tuple[int, int]:
        rows = [(i, [f"e{k}" for k in random.Random(i).sample(range(40), 8)]) for i in range(n)]
        df = spark.createDataFrame(rows, "atom_id long, entities array<string>").repartition(4).localCheckpoint()
        found = []
        return shuffled(spark, lambda: found.append(graph.entity_shared(df, heavy=64).count())), found[0]

    run(100)
    (small, few), (large, many) = run(1500), run(3000)
    # most pairs are alike; blocks of a fixed size, and joins of the pairs with their atoms, made it 4 times as much
    assert many > 3.8 * few > 1500**2 and large < 2.5 * small


def test_a_graph_is_built_without_writing_its_pairs(spark, monkeypatch):
    n, rows, keep = 60, [], graph.materialize

    def seen(df, label):
        out = keep(df, label)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "materialize", seen)
    atoms = [(i, "s", "fine", "text", float(i), [float(i == k) for k in range(n)], ["ada", f"e{i % 30}"]) for i in range(n)]
    got = graph.build(spark.createDataFrame(atoms, "atom_id long, source string, resolution string, modality string, ts double, embedding array<float>, entities array<string>"))
    assert got.where("edge_type = 'ENTITY_SHARED'").count() == n * (n - 1) and max(rows) <= 4 * n
