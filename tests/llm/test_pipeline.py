"""The pipeline's stages one by one, each against a plain version on its own input."""

import base64

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from test_words import contamination_truth, group_truth, line_truth

from atomloom.llm import quality, queries
from atomloom.llm.common import Texts


def plain_stage(name, spark, sf_dir, docs, rows):
    """(doc_id, text) after the stage, in order; for the encoding the ids in place of the text."""
    if name == "quality":
        model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), queries.grade())
        out = []
        for d, text in rows:
            _, buckets = quality.features(Texts(pa.array([text], pa.string())))
            tail = 1 - 1 / (1 + 2.718281828459045 ** (sum(float(model.weights[b]) for b in buckets) - model.thresholds[model.grades.index(2) - 1]))
            if tail >= 0.6:
                out.append((d, text))
        return out
    if name == "line_dedup":
        left = {d: text for _, d, _, text in line_truth(rows, 10)}
        return [(d, left[d]) for d, _ in rows]
    if name == "near_dedup":
        group = group_truth([(d, t) for d, t in rows], 5)
        return [(d, t) for d, t in rows if group[d] == d]
    if name == "decontamination":
        items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
        hit = {d for _, d, _, _, _, is_hit in contamination_truth(rows, items, 10) if is_hit}
        return [(d, t) for d, t in rows if d not in hit]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [(d, encoder.encode_ordinary(t)) for d, t in rows]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "encoding"]
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        want = plain_stage(name, spark, sf_dir, docs, rows)
        docs = stage(spark, docs, sf_dir).cache()
        rows = sorted((r.doc_id, r.ids if name == "encoding" else r.text) for r in docs.collect())
        assert rows == want and rows, name
        if name != "encoding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert docs.where("n_chars <> length(text)").count() == 0
    assert docs.where("n_tokens <> size(ids)").count() == 0


@pytest.mark.parametrize("case", ["nulls", "empty", "clash"])
def test_stages_on_odd_documents(spark, sf_dir, case):
    """Null columns, repeated rows, an empty table and extra columns named like those that stages make."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    if case == "nulls":
        odd = spark.createDataFrame([(10**6, None, None, None, None), (None, "some text here", "en", "x", 1), (10**6 + 1, "", "en", "x", 0), (10**6 + 1, "", "en", "x", 0)], docs.schema)
        docs = docs.unionByName(odd)
    elif case == "empty":
        docs = docs.limit(0)
    else:
        docs = docs.selectExpr("*", "'x' AS kept", "'x' AS n_words", "'x' AS component_id", "'x' AS tail", "'x' AS n_lines", "'x' AS block", "'x' AS unit", "'x' AS key")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        assert name == "encoding" or docs.columns == columns
        assert (docs.count() == 0) == (case == "empty")


def test_queries_have_the_columns_asked_for(spark, sf_dir):
    want = {
        "op2_decontaminate": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
        "op4_language_id": {"doc_id", "held_out", "lang_pred", "score"},
        "op6_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
        "op9_line_dedup": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
        "op10_simhash": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    }
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name, columns in want.items():
        got = queries.QUERIES[name](spark, sf_dir)
        assert columns <= set(got.columns) and got.count() == n
