"""Text, URL and query functions and the chunker, with values worked out by hand or by plain versions."""

import re

import pytest
from pyspark.sql import functions as F

from atomloom.functions import messy_json, prompts, search_text, text, urls
from atomloom.functions.models import complete, embed, embedding_size
from atomloom.operators import chunking


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


def plain_chunks(content, size=60, overlap=10):
    if len(content) <= size:
        return [content]
    chunks, cur = [], ""
    for para in re.split(r"\n\s*\n", content):
        if len(cur) + len(para) + 2 <= size:
            cur += para + "\n\n"
            continue
        if cur:
            chunks.append(cur.strip())
        if len(para) <= size:
            cur = para + "\n\n"
            continue
        cur = ""
        for s in re.split(r"(?<=[.!?])\s+", para):
            if len(cur) + len(s) + 1 <= size:
                cur += s + " "
                continue
            if cur:
                chunks.append(cur.strip())
            if len(s) > size:
                chunks += [s[i : i + size] for i in range(0, len(s), size - overlap)]
                cur = ""
            else:
                cur = s + " "
    if cur.strip():
        chunks.append(cur.strip())
    return chunks or [content[:size]]


def test_extraction_units_of_all_documents(spark):
    """What findings are extracted from: a short text whole, of a long one the sampled chunks, each with its depth."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {}
    for r in chunking.extraction_units(docs, size=2000, most=5).collect():
        got.setdefault(r.doc_id, []).append((r.idx, r.depth, r.content))
    for r in docs.collect():
        chunks = plain_chunks(r.text, 2000, 400)
        if len(chunks) > 5:
            at = len(chunks) // 2 - 1
            chunks = chunks[:2] + chunks[at : at + 2] + chunks[-1:]
        assert sorted(got[r.doc_id]) == [(k, int(len(r.text) > 2000), c[:12_000]) for k, c in enumerate(chunks)], r.doc_id


@pytest.mark.parametrize("content", ["short", "x" * 60, "x" * 61, "a. b! " * 30, "para one\n\npara two is here\n \npara three " + "word " * 30 + "\n\nlast", "One. " * 20 + "y" * 130 + ". End.\n\nnext para", "\n\n" * 40])
def test_chunker(spark, content):
    assert one(spark, content, lambda c: chunking.recursive_chunks(c, 60, 10)) == plain_chunks(content)


def test_chunk_sample(spark):
    got = one(spark, [str(i) for i in range(20)], chunking.sampled, "array<string>")
    assert got == ["0", "1", "2", "8", "9", "10", "11", "19"]
    assert one(spark, ["a"] * 8, chunking.sampled, "array<string>") == ["a"] * 8


def test_cleaning(spark):
    assert one(spark, "a long line\n\n\n\nnav\n  b  second\t\tline ", text.clean_text) == "a long line\n\nb second line"
    assert one(spark, "12\n----\nkept\n1234", text.clean_pdf_text) == "kept\n1234"
    assert one(spark, "x" * 501, text.snippet) == "x" * 500 + "..."
    assert one(spark, None, text.snippet) is None
    assert one(spark, "sk-12345678", text.masked) == "sk-1...5678" and one(spark, "short", text.masked) == "****"
    assert one(spark, 'Title: "a fine talk"', text.title) == "A Fine Talk" and one(spark, "x", text.title) == "New Chat"
    assert one(spark, "a b c d e f g h i", text.title) == "A B C D E F"
    assert one(spark, "my key/1", text.safe_key) == "my_key_1"


def test_gate(spark):
    page = "vjepa " + "filler " * 60
    assert one(spark, page, lambda c: text.relevant(c, F.lit("VJEPA paper")))
    assert not one(spark, page, lambda c: text.relevant(c, F.lit("quantum gravity")))
    assert one(spark, "tiny", lambda c: text.relevant(c, F.lit("quantum gravity")))
    assert not one(spark, "tiny", lambda c: text.relevant(c, F.lit("quantum gravity"), F.lit("black holes radiation entropy")))
    assert one(spark, "", lambda c: text.relevant(c, F.lit("q")))


def test_urls(spark):
    assert one(spark, " example.com/a/?utm_x=1&p=2&ref=y", urls.for_scraping) == "https://example.com/a/&p=2"
    assert one(spark, "", urls.for_scraping) is None
    assert one(spark, "https://duck.com/l/?uddg=https%3A%2F%2Fwww.A.com%2Fb%3Fq&rut=1", urls.for_search) == "a.com/b"
    assert one(spark, "https://www.x.org:80/p?q#f", urls.domain) == "x.org:80"
    assert one(spark, "https://ibm.com/ja-jp/topics/xai/", urls.content_key) == one(spark, "https://ibm.com/en-us/topics/xai", urls.content_key)
    assert one(spark, "https://arxiv.org/abs/1", urls.arxiv_pdf) == "https://arxiv.org/pdf/1.pdf"
    assert [one(spark, u, urls.priority) for u in ("https://www.arxiv.org/x", "http://a.com/paper", "http://a.com/")] == [10, 5, 0]


def test_queries(spark):
    assert one(spark, "site:arxiv.org detection filetype:pdf", search_text.strip_operators) == "arxiv detection"
    assert one(spark, "site:medium.com", search_text.strip_operators) == "site:medium.com"
    assert one(spark, "site:neurips.cc attention", search_text.sanitize) == "attention neurips paper"
    assert one(spark, "please search the web for cats", search_text.strip_command) == "cats"
    assert one(spark, "a b c d e 2023", search_text.fallbacks) == ["a b c d", "a b c d e"]
    assert one(spark, "jl for k-means", lambda c: search_text.anchored(c, F.lit("Johnson Lindenstrauss algorithm"))) == "Johnson Lindenstrauss jl for k-means"
    assert [one(spark, q, search_text.intent) for q in ("history of art", "fix my code", "How to bake", "a vs b", "why so", "write it", "what is x", "list all", "zzz")] == ["conversational", "debugging", "procedural", "comparative", "analytical", "creative", "explanatory", "factual", "explanatory"]


def test_sufficiency(spark):
    def told(q, n, e, s):
        return spark.range(1).select(search_text.sufficiency(F.lit(q), F.lit(n), F.lit(e), F.lit(s)).alias("y")).first().y

    long_ = "paris is a city " * 20
    assert [told("live", 1, long_, 0.9), told("about Paris", 0, long_, 0.9), told("about Paris", 2, "x", 0.9), told("about Rome", 2, long_, 0.9), told("about Paris", 2, long_, 0.5), told("about Paris", 2, long_, 0.9)] == ["forced_web", "no_results", "short_evidence", "missing_entity", "low_score", "sufficient"]


def test_messy_json():
    assert messy_json.repaired('Sure:\n```json\n{"a": [1, 2,],}\n```') == '{"a": [1, 2]}'
    assert messy_json.repaired('see {"a": "}"} there') == '{"a": "}"}'
    assert messy_json.repaired("{'a': 'b'}") == '{"a": "b"}'
    assert messy_json.repaired("none") is None and messy_json.repaired(None) is None


def test_html(spark):
    page = "<html><head><title> T </title></head><body><nav>menu here</nav><article><p>First part &amp; more</p><script>x</script><p>Second part</p></article><footer>foot</footer></body></html>"
    assert one(spark, page, text.html_text) == "First part & more\nSecond part" and one(spark, page, text.html_title) == "T"


def test_models_and_prompts(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,)], "t string")
    rows = embed(df, "t").collect()
    assert abs(sum(x * x for x in rows[0].embedding) - 1) < 1e-9 and not any(rows[1].embedding)
    got = complete(df, "t", model=lambda: lambda prompts: [p.upper() for p in prompts]).collect()
    assert [r.answer for r in got] == ["A B", "", ""]
    assert one(spark, "image", embedding_size) == 512 and one(spark, "x", embedding_size) == 1024
    assert "Question: q" in one(spark, "q", lambda c: prompts.user(c, F.lit("e"), F.lit("m")))
