"""Sessions, tables, web results, research runs, judge, files, streams."""

import json

import pytest
from pyspark.sql import functions as F

from atomloom import schemas
from atomloom.operators import judge, research, sessions, tables, websearch
from atomloom.sources import files, scrape, sinks
from atomloom.streaming import progress


def test_chats(spark):
    """Two chats keep their messages apart; deleting one leaves the other."""
    m = spark.createDataFrame([("c1", 0, "user", "Hello Chat 1"), ("c1", 1, "assistant", "Response 1"), ("c2", 0, "user", "Hello Chat 2")], "chat_id string, turn long, role string, content string")
    chats = tables.append_with_parent(spark.createDataFrame([("c1", "Chat One", 0)], "chat_id string, title string, updated_at long"), m, "chat_id", {"title": F.lit("New Chat")}, "updated_at", "turn")
    assert {(r.chat_id, r.title, r.updated_at) for r in chats.collect()} == {("c1", "Chat One", 1), ("c2", "New Chat", 0)}
    renamed = tables.update_columns(chats, F.col("chat_id") == "c1", {"title": F.lit("Updated Chat One"), "secret": F.lit(1)}, {"title"})
    assert renamed.where("title = 'Updated Chat One'").count() == 1
    left = tables.cascade_delete(chats, {"messages": m}, chats.where("chat_id = 'c2'"), "chat_id")
    assert left[""].count() == 1 and left["messages"].where("chat_id = 'c2'").count() == 0


def test_budget_stops_at_the_first_overflow(spark):
    m = spark.createDataFrame([(1, 0, "x" * 4), (1, 1, "x" * 400), (1, 2, "x" * 40)], "conv_id long, turn long, text string")
    assert [r.turn for r in sessions.within_budget(m, 20).collect()] == [2]


def test_defaults_and_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, v int, t string")
    new = spark.createDataFrame([("a", 1, "z"), ("b", 2, "w"), ("c", 1, "n")], "k string, v int, t string")
    assert {(r.k, r.t) for r in tables.upsert(old, new, ["k"], "v").collect()} == {("a", "z"), ("b", "y"), ("c", "n")}
    got = tables.with_default(spark.createDataFrame([("q",)], "k string"), old, "k", {"t": F.lit("none")}).first()
    assert got.t == "none"
    assert spark.range(1).select(tables.json_column(F.lit("[1"), "array<int>").alias("x")).first().x == []
    assert schemas.evolve(old, "k string, v bigint, extra string").columns == ["k", "v", "extra"]
    assert schemas.empty(spark, schemas.ATOMS).count() == 0


def test_importance(spark):
    as_of = F.to_timestamp(F.lit("2024-04-15 00:00:00"))

    def score(count, most, accessed, relevance):
        t = F.to_timestamp(F.lit(accessed)) if accessed else F.lit(None).cast("timestamp")
        return spark.range(1).select(sessions.importance(F.lit(count), F.lit(most), t, F.lit(None).cast("timestamp"), F.lit(relevance), as_of).alias("x")).first().x

    assert score(2, 4, "2024-04-15 00:00:00", 0.5) == pytest.approx(0.15 + 0.4 + 0.15)
    assert score(0, 0, None, 0.0) == pytest.approx(0.2)


def test_recency_buckets(spark):
    as_of = F.to_timestamp(F.lit("2024-04-15 00:00:00"))
    want = {"2024-04-08": 1.0, "2024-04-07": 0.8, "2024-03-16": 0.8, "2024-03-15": 0.6, "2024-01-16": 0.6, "2024-01-15": 0.4, "2023-04-16": 0.4, "2023-04-15": 0.2, "2022-04-16": 0.2, "2022-04-15": 0.1, "2030-01-01": 1.0, "nonsense": 0.0, "April 14, 2024": 1.0, "2024-04-14T10:00:00Z": 1.0}
    rows = spark.createDataFrame([(k,) for k in want], "d string").select("d", websearch.recency(F.col("d"), as_of).alias("x")).collect()
    assert {r.d: r.x for r in rows} == want


def test_locales(spark):
    u = spark.createDataFrame([(0, "https://ibm.com/ja-jp/topics/xai"), (1, "https://ibm.com/en-us/topics/xai"), (2, "https://ibm.com/de-de/topics/xai"), (3, "https://b.com/x")], "pos long, url string")
    assert {(r.pos, r.url) for r in websearch.without_locales(u, "pos").collect()} == {(0, "https://ibm.com/en-us/topics/xai"), (3, "https://b.com/x")}


def test_findings_chain(spark):
    """a is like b, b is like c, a isn't like c: greedy keeps a and c."""
    words = ["one two three four five six".split(), "one two three four five seven".split(), "eight two three four five seven".split()]
    f = spark.createDataFrame([("g", i, " ".join(w)) for i, w in enumerate(words)], "g string, i long, t string")
    assert [r.i for r in research.distinct_findings(f, "g", "i", "t", threshold=0.65).orderBy("i").collect()] == [0, 2]


def test_decision_trace_of_a_deep_chain(spark):
    """A chain of 60 syntheses with a short cut, a cycle back to its top, and a finding at its end."""
    nodes = spark.createDataFrame([(f"s{i}", "synthesis", i) for i in range(61)] + [("f", "finding", 0), ("g", "finding", 0)], "id string, type string, depth long")
    pairs = [(f"s{i}", f"s{i - 1}") for i in range(1, 61)] + [("s60", "s57"), ("s0", "s60"), ("s0", "f"), ("s58", "g"), ("s3", "s3")]
    edges = spark.createDataFrame([(a, b, "synthesized_from") for a, b in pairs], "src string, dst string, type string")
    want = {f"s{i}": 58 - i for i in range(58)} | {"s60": 0, "s59": 1, "s58": 2, "f": 59, "g": 3}
    assert sorted((r.id, r.distance) for r in research.decision_trace(nodes, edges).collect()) == sorted(want.items())


def test_provenance(spark):
    nodes = spark.createDataFrame([("s2", "synthesis", 2), ("s1", "synthesis", 1), ("f1", "finding", 0), ("f2", "finding", 0), ("w", "web_source", 0)], "id string, type string, depth long")
    found = spark.createDataFrame([("f1", "t", 0.5, "w", "st"), ("f2", "t", 0.5, "w", None)], "id string, content string, importance double, source_id string, step_id string")
    made = spark.createDataFrame([("s1", 1, "c", ["f1"]), ("s2", 2, "c", ["s1", "s2"])], "id string, depth long, content string, input_ids array<string>")
    edges = research.finding_rows(found)[1].unionByName(research.synthesis_rows(made)[1])
    assert {(r.id, r.distance) for r in research.decision_trace(nodes, edges).collect()} == {("s2", 0), ("s1", 1), ("f1", 2)}
    assert research.source_counts(nodes, edges).first().findings_count == 2
    assert [r.id for r in research.step_findings(nodes, edges, "st").collect()] == ["f1"]
    out = research.graph_json(nodes, edges)
    back = research.graph_from_json(out, "id string, type string, depth long", "src string, dst string, type string")
    assert sorted(back[0].collect()) == sorted(nodes.collect()) and back[1].count() == edges.count()
    p = spark.createDataFrame([("[x",), ("real",)], "content string")
    assert research.real_syntheses(p).count() == 1 and research.real_syntheses(p.where("content <> 'real'")).count() == 1


def test_plan(spark):
    rows = research.fallback_plan(spark.createDataFrame([(1, "a b c d e f")], "query_id long, text string")).collect()
    assert len({r.step_index for r in rows}) == 10 and all(r.search_query.startswith("a b c d e ") for r in rows)


def test_judge(spark):
    dims = dict.fromkeys(judge.DIMENSIONS, None) | {"relevance": 8, "accuracy": 6}
    df = spark.createDataFrame([tuple(dims.values())], ", ".join(f"{d} int" for d in dims))
    filled = df.select(*[c.alias(d) for d, c in judge.filled().items()])
    assert filled.first().safety == 7.0
    assert df.select(judge.overall().alias("x")).first().x == pytest.approx(round((8 * 1.5 + 6 * 2) / 3.5, 1))
    assert not df.select(judge.valid().alias("x")).first().x
    raw = spark.createDataFrame([('"relevance": 8, Accuracy = 11, clarity: 3, "depth": 2',)], "t string")
    got = judge.recovered(F.col("t"))
    r = raw.select(*[c.alias(d) for d, c in got.items()], judge.recovered_enough(got).alias("ok")).first()
    assert (r.relevance, r.accuracy, r.clarity, r.depth, r.ok) == (8, None, 3, 2, True)


def test_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("Hello there.\nTwo.")
    (tmp_path / "b.png").write_bytes(b"123")
    (tmp_path / "c.zip").write_bytes(b"1")
    kinds = {r["name"]: r.kind for r in files.listing(spark, str(tmp_path)).collect()}
    assert kinds == {"a.TXT": "text", "b.png": "image", "c.zip": None}
    assert files.images(spark, str(tmp_path)).first().content == "Image: b.png"
    (tmp_path / "t.csv").write_text("x,y\n1,a\n2,\n")
    t = files.read_csv(spark, str(tmp_path / "t.csv"))
    assert [r.content for r in files.csv_rows(t, ["x"]).collect()] == ["x: 1, y: a", "x: 2, y: nan"]
    assert files.csv_schema(t, "t").first().content == "Columns: x, y\nShape: (2, 2)"
    assert "Hello there" in files.texts(spark, str(tmp_path / "a.TXT")).first().text


def test_transcripts(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 2.0, "hi", 100.0), (1, 1, 2.0, 5.0, "you", 100.0)], "audio_id long, idx int, start double, stop double, text string, ts double")
    got = {(r.resolution, r.content, r.ts, r.duration) for r in files.transcripts(s).collect()}
    assert got == {("fine", "hi", 100.0, 2.0), ("fine", "you", 102.0, 3.0), ("coarse", "hi you", 100.0, 5.0)}


def test_scraping_failures_are_rows(spark):
    def fetcher():
        return lambda u: "<html><body><article>" + "good text here " * 20 + "</article></body></html>" if "good" in u else 1 / 0

    got = {r.url: r for r in scrape.fetch(spark.createDataFrame([("http://good",), ("http://bad",)], "url string"), fetcher).collect()}
    assert got["http://good"].success and "ZeroDivisionError" in got["http://bad"].error
    pages = scrape.extracted(spark.createDataFrame([(got["http://good"].html,), ("<p>x</p>",)], "html string")).collect()
    assert pages[0].word_count == 60 and pages[1].error == "empty page"


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = progress.tumbling(progress.read(spark, str(tmp_path / "in"), e.schema, 1), "1 day", late="40 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r.start, r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert key(spark.table("tumbled")) == key(progress.tumbling(e, "1 day"))
    log = progress.read(spark, str(tmp_path / "in"), e.schema).writeStream.foreachBatch(sinks.append_once(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    log.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.count()


def test_state_machine(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rows = [("a", 0, "planning"), ("a", 1, "researching"), ("a", 2, "complete"), ("a", 3, "synthesizing"), ("a", 4, "complete"), ("b", 0, "cancelled"), ("b", 1, "planning")]
    e = spark.createDataFrame(rows, "session_id string, event_index long, status string")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = progress.run_machine(progress.read(spark, str(tmp_path / "in"), e.schema)).writeStream.outputMode("update").format("memory").queryName("machine").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert {tuple(r) for r in spark.table("machine").collect()} == {("a", "complete", 4, 1), ("b", "cancelled", 1, 1)}


def test_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60
    json.dumps(entry.oracle_sql())


def test_small_session_operators(spark):
    m = spark.createDataFrame([("assistant", '{"total_time_ms": 5}'), ("assistant", "{}"), ("user", '{"total_time_ms": 5}')], "role string, metadata string")
    assert [r.total_time_ms for r in sessions.metric_rows(m).collect()] == [5.0]
    f = spark.createDataFrame([("f1", "s", "entity", "A", 0.9, False, ["a", "zz"]), ("f2", "s", None, "B", 0.8, False, []), ("f3", "s", None, "C", 0.99, True, ["a"])], "fragment_id string, session_id string, fragment_type string, content string, importance double, is_deleted boolean, related_ids array<string>")
    assert sessions.semantic_context(f).first().context == "- [entity] A\n- [knowledge] B"
    assert {(r.src, r.dst) for r in sessions.knowledge_links(f, spark.createDataFrame([("a",)], "atom_id string")).collect()} == {("f1", "a"), ("f3", "a")}
    assert spark.range(1).select(sessions.zipped(F.array(F.lit("p")), F.array(F.lit(3))).alias("z")).first().z[0] == ("p", 3)
    e = spark.createDataFrame([("a", 1), ("b", 2)], "session_id string, event_index long")
    assert [r.session_id for r in progress.without_cancelled(e, e.where("session_id = 'a'")).collect()] == ["b"]
    assert progress.after_cursor(e, 1).count() == 1
    live, stored = spark.createDataFrame([("a", "planning")], "session_id string, status string"), spark.createDataFrame([("a", "idle"), ("c", "complete")], "session_id string, status string")
    assert {tuple(r) for r in progress.known_status(live, stored).collect()} == {("a", "planning"), ("c", "complete")}
