"""Parsers of provider answers, content parts of pages, failover and retries, findings and runs."""

import pytest
from pyspark.sql import functions as F

from atomloom.functions import models, text
from atomloom.operators import judge, research, retrieval, tables
from atomloom.sources import providers


def test_provider_answers_of_another_form_have_no_rows(spark):
    parsers = {"a": providers.list_items, "b": providers.result_blocks, "c": providers.redirect_links, "d": providers.encyclopedia_json, "e": providers.metasearch_json}
    bodies = [None, "", "<html></html>", "{broken", "[]", '{"results": null}']
    rows = spark.createDataFrame([(p, b) for p in [*parsers, "unknown"] for b in bodies], "provider string, body string")
    assert providers.result_rows(rows, parsers).count() == 0


def test_list_items_take_the_first_text_there_is(spark):
    head = '<li class="b_algo"><h2><a href="{u}">T</a></h2>'
    body = (
        head.format(u="http://a") + '<div class="b_caption"><p>one</p></div></li>' + head.format(u="http://b") + "<p>two</p></li>"
        + head.format(u="http://c") + '<div class="b_caption">three</div></li>' + head.format(u="/own") + "</li>" + '<li class="b_algo"><h2>no link</h2></li>'
    )
    rows = spark.createDataFrame([(body,)], "body string").select(F.explode(providers.list_items(F.col("body"))).alias("h")).select("h.*").collect()
    assert [(r.url, r.snippet) for r in rows] == [("http://a", "one"), ("http://b", "two"), ("http://c", "three")]


def test_redirect_links_take_each_target_once(spark):
    link = '<a href="/url?q={u}&sa=1">{t}</a>'
    body = "".join(link.format(u=u, t=t) for u, t in [("http://a", "abc"), ("http://a", "again"), ("http://b", "x"), ("http://www.google.com/z", "own"), ("/rel", "rel"), ("http://c%2Fd", "<b>deep</b>")])
    rows = spark.createDataFrame([(body,)], "body string").select(F.explode(providers.redirect_links(F.col("body"))).alias("h")).select("h.*").collect()
    assert [(r.url, r.title) for r in rows] == [("http://a", "abc"), ("http://c/d", "deep")]


def test_content_ends_where_its_element_does(spark):
    pages = {
        '<body>menu menu<div class="post content"><div>first part</div><div><div>second part</div></div>third part</div>after it</body>': "first part\nsecond part\nthird part",
        "<body>menu menu<article>outer text<article>inner text</article>more text</article>after it</body>": "outer text\ninner text\nmore text",
        '<body><main>main text<div class="post"><div>deep text</div></div></main>after it</body>': "main text\ndeep text",
        "<body>only a body<nav>navigation</nav></body>": "only a body",
        '<body><div class="content"><div>never closed</body>': "never closed",
    }
    rows = spark.createDataFrame([(p,) for p in pages], "html string").select("html", text.html_text(F.col("html")).alias("t")).collect()
    assert {r.html: r.t for r in rows} == pages
    assert spark.createDataFrame([(None,)], "html string").select(text.html_text(F.col("html")).alias("t")).first().t is None


class Key:
    """A completer that fails with some texts before it answers."""

    def __init__(self, answer, *failures):
        self.answer, self.failures, self.calls = answer, list(failures), 0

    def __call__(self, prompts):
        self.calls += 1
        if self.failures:
            raise ValueError(self.failures.pop(0))
        return [self.answer for _ in prompts]


def test_failover_goes_by_key_then_provider():
    always = ["rate_limit"] * 9
    a1, a2, b1 = Key("a1", *always), Key("a2"), Key("b1")
    ask = models.Failover([("a", "1", a1), ("a", "2", a2), ("b", "1", b1)])
    assert ask(["x", "y"]) == ["a2", "a2"] and a1.calls == 2 and b1.calls == 0
    assert ask.errors == {("a", "1"): 2} and ask.requests == {("a", "2"): 2}
    assert models.Failover([("a", "1", a2), ("b", "1", b1)], preferred="b")(["x"]) == ["b1"]
    long_ = [("a", "1", Key("a1", "Maximum context reached")), ("a", "2", Key("a2")), ("b", "1", Key("b1"))]
    assert models.Failover(long_)(["x"]) == ["b1"]  # the provider's other key isn't asked
    long_[0] = ("a", "1", Key("a1", "prompt TOO LONG"))
    assert models.Failover(long_, roomy=("a",))(["x"]) == ["a2"]
    with pytest.raises(RuntimeError, match="no provider"):
        models.Failover([("a", "1", Key("", *always))])(["x"])


def test_retries_wait_longer_and_end_in_null():
    waits = []
    assert models.retrying(Key("ok", "e", "e"), pause=waits.append)(["x"]) == ["ok"] and waits == [1.0, 1.5]
    assert models.retrying(Key("ok", "e", "e", "e"), pause=waits.append)(["x", "y"]) == [None, "ok"]
    waits.clear()
    refused = Key("bad")
    assert models.retrying(refused, lambda a: a != "bad", pause=waits.append)(["x"]) == [None] and waits == [0.5, 0.5] and refused.calls == 3


def test_failover_runs_on_executors(spark):
    def limited(prompts):
        raise ValueError("429")

    rows = spark.createDataFrame([("x",), (None,)], "prompt string")
    got = models.complete(rows, "prompt", model=lambda: models.Failover([("a", "1", limited), ("b", "1", lambda p: ["b"] * len(p))]))
    assert [r.answer for r in got.collect()] == ["b", "b"]


def test_findings_that_are_kept(spark):
    long_ = "a finding that is long enough"
    kind = "unit_id int, findings array<struct<content:string,extraction_type:string,importance:double>>"
    rows = spark.createDataFrame([(1, [(f"  {long_} ", None, 7.0), ("short", "fact", 0.1), (None, None, None)] + [(long_, "stat", None)] * 9), (2, []), (3, None)], kind)
    got = research.valid_findings(rows).orderBy("unit_id", "pos").collect()
    assert [(r.pos, r.content, r.extraction_type, r.importance) for r in got] == [(0, long_, "fact", 1.0)] + [(k, long_, "stat", 0.5) for k in range(3, 10)]


def test_runs_without_report_or_sources(spark):
    runs = spark.createDataFrame([(1, "s", 0, "q", None, [])], "run_id int, session_id string, turn_index int, query string, report string, sources array<struct<url:string,title:string,score:double>>")
    traces, logs, fragments = research.run_rows(runs)
    assert traces.first().answer == "" and logs.count() == 0 and fragments.first().content == "Deep Research: q\n\n"


def test_small_defaults(spark):
    q = spark.createDataFrame([(1, "t")], "query_id int, text string")
    assert retrieval.decomposed(q).first().modalities == ["text"]
    e = judge.evaluation_rows(spark.createDataFrame([(1, None, 3)], "message_id int, response string, updated_at int")).first()
    assert (e.relevance, e.overall_score, e.verdict, e.response) == (5.0, 5.0, "fair", "")
    f = spark.createDataFrame([("f", "c", ["a", "b"], [1.0], "s")], "fragment_id string, content string, related_ids array<string>, embedding array<double>, session_id string")
    nodes, edges, rest = tables.dual(f)
    assert nodes.columns == ["fragment_id", "content", "embedding"] and edges.count() == 2 and rest.columns == ["fragment_id", "content", "session_id"]
