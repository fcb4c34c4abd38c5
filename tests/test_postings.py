"""The keyword index against the passes over whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from atomloom.operators import postings, retrieval


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choice(words[: rng.choice([3, 30, 300])]).title() for _ in range(rng.randrange(60)))) for k in range(3000)]
    rows += [(5000, None), (5001, ""), (5002, "w1 " * 4000), (5003, "\t W2 \n w2 x "), *[(6000 + k, "same text w7 w7") for k in range(30)]]
    return spark.createDataFrame(rows, "atom_id long, content string").cache()


@pytest.fixture(scope="module")
def index(corpus):
    return postings.build(corpus, per_block=64)


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(1, "w1"), (2, "w250 w2 w2"), (3, "same text"), (4, "nowhere"), (5, ""), (6, None), (7, "W7 w1 w299 w40"), (8, "w0 w1 w2"), (9, "w1 nowhere")]
    return spark.createDataFrame(rows, "query_id long, text string")


@pytest.mark.parametrize("k", [1, 10, 200])
def test_best_atoms_are_those_of_the_whole_pass(corpus, index, asked, k):
    want = {(r.query_id, r["rank"]): (r.atom_id, r.bm25) for r in retrieval.bm25_corpus(corpus, asked, k).collect()}
    got = {(r.query_id, r["rank"]): (r.atom_id, r.bm25) for r in postings.bm25_top(index, asked, k).collect()}
    assert got.keys() == want.keys() and len(got) > k
    # equal scores may differ in the last bit, so that ties are compared by score
    assert all(got[key][1] == pytest.approx(want[key][1], rel=1e-9) for key in want)
    assert sum(got[key][0] != want[key][0] for key in want) <= len(want) // 50


def test_full_text_is_that_of_the_whole_pass(corpus, index, asked):
    for limit in (None, 5):
        pairs = lambda df: sorted((r.query_id, r.atom_id) for r in df.collect())
        assert pairs(postings.full_text(index, asked, limit)) == pairs(retrieval.full_text(corpus, asked, limit))


def test_blocks_are_skipped(index, spark):
    search = postings.Search.start(index, spark.createDataFrame([(1, "same w7"), (2, "w299 w1")], "query_id long, text string"))
    assert search.needed(1, "atom_id").count() < search.bounds.count() * 0.7
    top = search.bounds.join(search.scores(search.bounds, "i").groupBy("query_id").agg(F.max("bm25").alias("m")), "query_id")
    assert top.groupBy("query_id", "m").agg(F.max("bound").alias("b")).where("b * 1.000000001 < m").count() == 0


def test_a_search_reads_its_terms_only(index, asked):
    plan = postings.held_terms(index, asked).select("term", "block", "top")._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan and "slots" not in plan.split("ReadSchema")[1]


def test_empty_index(spark):
    none = postings.build(spark.createDataFrame([], "atom_id string, content string"))
    queries = spark.createDataFrame([(1, "x")], "query_id long, text string")
    assert postings.bm25_top(none, queries).count() == 0 and postings.full_text(none, queries).count() == 0
