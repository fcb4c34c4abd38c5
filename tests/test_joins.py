"""Joins of spans and of sets against plain versions, with long spans and hot entities."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from atomloom.operators import graph, research

SPANS = "source string, kind string, id long, start double, stop double"


def plain_overlaps(rows):
    out = set()
    for s, k, a, s1, e1 in rows:
        for t, m, b, s2, e2 in rows:
            if (k, m) == ("audio", "text") and s is not None and s == t and s1 < e1 and s2 < e2 and s1 < e2 and s2 < e1:
                w = round((min(e1, e2) - max(s1, s2)) / (e1 - s1), 9)
                out |= {(a, b, w), (b, a, w)}
    return out


@pytest.mark.parametrize("grain", [0.5, 60.0, 1e7])
def test_spans_overlap_as_by_comparing_all(spark, grain):
    rng = random.Random(5)
    rows = []
    for k in range(160):
        start = rng.choice([float(rng.randrange(-50, 400)), rng.uniform(-1e6, 1e6)])
        length = rng.choice([0, -5, 1, 7.5, 60, 3600, 1e5, 10 * 365 * 86400])
        rows.append((rng.choice(["hot", "hot", "b", None]), rng.choice(["audio", "text"]), k, start, start + length))
    rows += [("c", "audio", 900, 0.0, 10.0), ("c", "text", 901, 10.0, 20.0), ("c", "text", 902, -5.0, 0.0), ("c", "text", 903, 0.0, 10.0), ("c", "audio", 904, 0.0, 10.0)]
    got = [(r.src, r.dst, round(r.weight, 9)) for r in graph.aligned(spark.createDataFrame(rows, SPANS), grain=grain).collect()]
    assert set(got) == plain_overlaps(rows) and len(got) == len(set(got))


def test_covers_are_small_and_exact(spark):
    rng = random.Random(2)
    rows = [(a, a + rng.randrange(0, 10 ** rng.randrange(1, 9))) for a in (rng.randrange(-(10**9), 10**9) for _ in range(200))] + [(0, 0), (-1, 0), (0, 7), (1, 6), (5 * 10**9, 5 * 10**9 + 3)]
    found = spark.createDataFrame(rows, "a long, b long").select("a", "b", graph.dyadic_cover("a", "b", 31).alias("c")).collect()
    for r in found:
        held = sorted((x.place << x.level, (x.place + 1) << x.level) for x in r.c)
        assert held[0][0] == r.a and held[-1][1] == r.b + 1
        assert all(x[1] == y[0] for x, y in zip(held, held[1:], strict=False)) and len(held) <= 2 * (r.b - r.a + 1).bit_length()


def test_a_span_of_years_is_a_few_rows(spark):
    years = 10 * 365 * 86400.0
    spans = spark.createDataFrame([("s", "audio", 1, 0.0, years), ("s", "text", 2, years - 5, years + 5), ("s", "text", 3, years, years + 9)], SPANS)
    assert {(r.src, r.dst) for r in graph.aligned(spans, grain=1.0).collect()} == {(1, 2), (2, 1)}
    cover = spark.range(1).selectExpr("cast(1 as bigint) as a", f"cast({int(years)} as bigint) as b").select(F.size(graph.dyadic_cover("a", "b", 40)).alias("n")).first().n
    assert cover < 60


def plain_jaccards(rows, threshold):
    out = set()
    for a, x in rows:
        for b, y in rows:
            if a < b and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) > threshold:
                w = round(len(set(x) & set(y)) / len(set(x) | set(y)), 9)
                out |= {(a, b, w), (b, a, w)}
    return out


@pytest.mark.parametrize("threshold,heavy,block_rows", [(0.0, 256, 512), (0.05, 256, 512), (0.05, 3, 7), (0.4, 3, 7), (0.7, 2, 20), (1.0, 3, 7)])
def test_shared_entities_are_those_of_all_pairs(spark, threshold, heavy, block_rows):
    rng = random.Random(1)
    names = [f"e{k}" for k in range(60)]
    rows = [(f"a{k:03}", ["hot"] * (k % 2) + [rng.choice(names[: rng.choice([5, 60])]) for _ in range(rng.randrange(0, 30))]) for k in range(120)]
    rows += [("x1", None), ("x2", []), ("x3", ["alone"]), ("x4", ["hot"]), ("x5", ["hot"]), ("x6", ["hot", "hot"])]
    df = spark.createDataFrame(rows, "atom_id string, entities array<string>")
    got = [(r.src, r.dst, round(r.weight, 9)) for r in graph.entity_shared(df, threshold=threshold, heavy=heavy, block_rows=block_rows).collect()]
    assert set(got) == plain_jaccards(rows, threshold) and len(got) == len(set(got))


@pytest.mark.parametrize("members", [1, 3, 512])
def test_shared_entities_of_copies_are_those_of_all_pairs(spark, monkeypatch, members):
    monkeypatch.setattr(graph, "MEMBERS", members)
    rng = random.Random(4)
    # sets of common entities only, and some with a rare one, each in up to nine copies
    sets = [[f"c{k}" for k in rng.sample(range(6), rng.randrange(1, 5))] + [f"r{n // 2}"] * (n % 3 == 0) for n in range(14)]
    rows = [(k, s) for k, s in enumerate(s for n, s in enumerate(sets) for _ in range(1 + n % 9))]
    df = spark.createDataFrame(rows, "atom_id long, entities array<string>").repartition(3)
    got = [(r.src, r.dst, round(r.weight, 9)) for r in graph.entity_shared(df, threshold=0.3, heavy=4, block_rows=6).collect()]
    assert set(got) == plain_jaccards(rows, 0.3) and len(got) == len(set(got))


def test_an_entity_in_half_of_100_000_sets(spark):
    """Sets of 20 entities of their own, every other one with the hot entity: only the twins are alike."""
    n = 100_000
    own = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.concat(F.lit("e"), (F.col("id") % 99_990 * 20 + k).cast("string")))
    sets = spark.range(n).select(F.col("id").alias("atom_id"), F.when(F.col("id") % 2 == 0, F.array_append(own, F.lit("hot"))).otherwise(own).alias("entities"))
    got = {(r.src, r.dst) for r in graph.entity_shared(sets.repartition(8)).collect()}
    assert got == {p for k in range(10) for p in ((k, 99_990 + k), (99_990 + k, k))}


def plain_distinct(rows, threshold, head=120):
    """Going through each group in order."""
    import re

    kept = {}
    for g, k, t in sorted(rows, key=lambda r: r[1]):
        words = set(re.findall("[a-z]{3,}", (t or "")[:head].lower()))
        own = kept.setdefault(g, [])
        if not any(words and w and len(words & w) / len(words | w) > threshold for _, w in own):
            own.append((k, words))
    return sorted((str(g), k) for g, own in kept.items() for k, _ in own)


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.65, 1.0])
def test_distinct_findings_are_those_of_going_in_order(spark, threshold):
    rng = random.Random(8)
    names = ["one", "two", "three", "four", "five", "six", "seven", "eight"]
    rows = [(rng.choice(["g", "g", "h", None]), k, " ".join(rng.choice(names) for _ in range(rng.randrange(0, 7)))) for k in rng.sample(range(1000), 300)] + [("g", 2000, None), ("g", 2001, "12 x"), ("i", 1, "lone words")]
    got = research.distinct_findings(spark.createDataFrame(rows, "grp string, pos long, content string"), "grp", "pos", "content", threshold)
    assert sorted((str(r.grp), r.pos) for r in got.collect()) == plain_distinct(rows, threshold)


def test_one_group_of_100_000_findings(spark):
    """Chains of three versions of each statement, the middle one like both: the first and the last stay."""
    n = 33_333
    versions = [F.concat(*[F.lit(w) if w else F.concat(F.lit("x"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit(end)) for w, end in made]) for made in (
        [("alpha beta gamma ", ""), (None, "one "), (None, "two")], [("beta gamma ", ""), (None, "one "), (None, "two "), (None, "tri")], [("gamma ", ""), (None, "one "), (None, "two "), (None, "tri "), (None, "four")])]
    rows = spark.range(n).select(F.lit("g").alias("grp"), F.col("id"), F.posexplode(F.array(*versions)).alias("v", "content")).select("grp", (F.col("v") * n + F.col("id")).alias("pos"), "content")
    got = research.distinct_findings(rows, "grp", "pos", "content", threshold=0.45)
    assert got.count() == 2 * n and got.where((F.col("pos") >= n) & (F.col("pos") < 2 * n)).count() == 0


def _late_names(spark, tmp_path):
    """Documents (and vectors) of which the first two share a name, all after the first 1000 characters."""
    texts = ["word " * 400 + "Ada Lovelace", "other " * 300 + "Lovelace", "Babbage " + "more " * 300, None]
    spark.createDataFrame([(i, t, "src0") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, [1.0 * (i == k) for k in range(4)]) for i in range(4)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def test_links_of_documents_are_those_of_whole_texts(spark, tmp_path):
    got = {tuple(r) for r in entry.queries()["q_entity_shared"](spark, _late_names(spark, tmp_path)).select("doc_id", "class_id", "n_links").collect()}
    assert got == {(0, 0, 1), (1, 1, 1), (2, 2, 0), (3, None, 0)}


def test_edges_of_a_graph_are_those_of_whole_texts(spark, tmp_path):
    got = entry.queries()["q_graph_build"](spark, _late_names(spark, tmp_path)).where("edge_type = 'ENTITY_SHARED'").select("src", "dst").collect()
    assert sorted(map(tuple, got)) == [(0, 1), (1, 0)]
