"""BPE, token counts, SimHash, language ID, quality and WARC."""

import base64
import hashlib
import math
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atomloom.llm import bpe, language_id, quality, simhash, token_counts, warc
from atomloom.llm.common import Texts

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(RANKS, public_tokenizers.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_encoder_is_tiktoken(texts):
    offsets, ids = ENCODER.encode_batch(texts)
    for t, a, b in zip(texts, offsets, offsets[1:], strict=False):
        assert ids[a:b].tolist() == TIKTOKEN.encode_ordinary(t)


def test_encode_decode(docs, rows, none):
    both = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert len(both) == len(rows)
    for r in both:
        assert r.ids == TIKTOKEN.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(none, PATH, public_tokenizers.PATTERN).count() == 0


def test_long_pieces_are_not_kept():
    own = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    own.encode_batch(["some words stay"])
    before = own.flat.nbytes, own.lens.nbytes, len(own.codes)
    for k in range(12):
        text = chr(0x4E00 + k) * 3000 + "a" * (201 + k)
        offsets, ids = own.encode_batch([text, "some words stay", text])
        assert ids[: offsets[1]].tolist() == ids[offsets[2] :].tolist() == TIKTOKEN.encode_ordinary(text)
        assert (own.flat.nbytes, own.lens.nbytes, len(own.codes)) == before


def test_held_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "HELD_IDS", 500)
    own = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for k in range(30):
        text = " ".join(f"zq{k}x{j}" for j in range(40))
        assert own.encode_batch([text])[1].tolist() == TIKTOKEN.encode_ordinary(text)
        assert len(own.flat) <= 500 + 40 * 12


def test_decode_of_nulls_and_unknown_ids(spark):
    df = spark.createDataFrame([(1, [40, None, 99_999_999, -1]), (2, None), (3, [])], "k int, ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(df, PATH).orderBy("k").collect()] == [TIKTOKEN.decode_bytes([40]), b"", b""]


def test_token_counts(spark, docs, rows, none):
    lens = [len(TIKTOKEN.encode_ordinary(t or "")) for _, t, *_ in rows]
    answers = token_counts.context_limits(token_counts.length_histogram(bpe.count_tokens(docs, PATH, public_tokenizers.PATTERN)), band=16)
    got = answers.collect()
    assert sorted(r.n_tokens for r in got) == sorted(set(lens))
    for r in got:
        limit = r.n_tokens
        assert (r.n_docs, r.docs_over, r.tokens_over) == (lens.count(limit), sum(x > limit for x in lens), sum(x for x in lens if x > limit))
        assert (r.truncated_tokens, r.lost_tokens) == (sum(min(x, limit) for x in lens), sum(max(0, x - limit) for x in lens))
    for r in token_counts.at_limits(answers, [0, 5, 100, 10**9]).collect():
        assert r.truncated_tokens == sum(min(x, r.limit) for x in lens) and r.docs_within == sum(x <= r.limit for x in lens)
    assert token_counts.quantile_length(answers, 0.5) == sorted(lens)[math.ceil(len(lens) / 2) - 1]
    assert token_counts.context_limits(token_counts.length_histogram(bpe.count_tokens(none, PATH, public_tokenizers.PATTERN))).count() == 0


def plain_mix(x: int) -> int:
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


def plain_fingerprint(text: str) -> list[int]:
    """Votes of word pairs, from the text on with whole numbers only."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    hashes = [plain_mix((sum(plain_mix((256 * k + b + 1) * 0x9E3779B97F4A7C15 % 2**64) for k, b in enumerate(w)) + len(w) * 0xC2B2AE3D27D4EB4F) % 2**64) for w in words]
    terms = [plain_mix((plain_mix((a * 0xC2B2AE3D27D4EB4F + b) % 2**64) + 2) % 2**64) for a, b in zip(hashes, hashes[1:], strict=False)] if len(hashes) != 1 else hashes
    votes = [0] * simhash.BITS
    for h in terms:
        for word in range(simhash.BITS // 64):
            signed = plain_mix(h ^ (word + 1) * 0xA0761D6478BD642F % 2**64).to_bytes(8, "little")
            for k in range(64):
                votes[64 * word + k] += 1 if signed[k // 8] >> (7 - k % 8) & 1 else -1
    return [int(v > 0) for v in votes]


def test_fingerprints_are_votes():
    texts = ["", "one", "A b", "the cat sat on the mat " * 300, "x y z " * 2 + "q", None, "É é \t" + "long" * 40 + " end", " \n"]
    got = simhash.fingerprints(Texts(pa.array(texts)))
    for t, row in zip(texts, got, strict=True):
        assert np.unpackbits(row).tolist() == plain_fingerprint(t or "")


def test_compare_with_next(docs, rows, none):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    got = sorted(simhash.compare_with_next(docs).collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    for k, (r, (d, t, *_)) in enumerate(zip(got, order, strict=True)):
        text, following = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 2
        edited = text[: len(text) - n] + following[:n]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (d, len(text), hashlib.sha256(edited.encode()).hexdigest())
        own, changed, after = map(plain_fingerprint, (text, edited, following))
        assert [r.fingerprint, r.edited_fingerprint] == [f"{int(''.join(map(str, x)), 2):064x}" for x in (own, changed)]
        for near, other in ((r.near_edited, changed), (r.near_next, after)):
            assert abs(near - max(0.0, math.cos(math.pi * sum(a != b for a, b in zip(own, other, strict=True)) / 256))) < 1e-9
    same = {}
    for r, (_, t, *_) in zip(got, order, strict=True):
        assert same.setdefault(t or "", r.fingerprint) == r.fingerprint
    assert simhash.compare_with_next(none).count() == 0


def test_compare_with_next_of_one_hot_id(spark):
    """Most rows have one id, many of them one text too: ranges part them, and none is lost or compared out of order."""
    rows = [(7, f"text number {k % 300} of the hot id") for k in range(1500)] + [(7, "copy of a text")] * 900 + [(k, f"other {k}") for k in range(20, 40)] + [(None, "no id")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    order = [r.text for r in df.select("text", F.xxhash64("text").alias("h"), "doc_id").orderBy(F.desc_nulls_last("doc_id"), "h").collect()]
    want = {}
    for text, after in zip(order, [*order[1:], order[0]], strict=True):
        n = len(text) // 2
        key = hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest()
        want[key] = want.get(key, 0) + 1
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = simhash.compare_with_next(df).groupBy("edited_sha256").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert {r.edited_sha256: r["count"] for r in got} == want


@pytest.mark.parametrize("limit", [1, 700])
@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_compare_with_next_in_slices(spark, docs, rows, limit, coalesce):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    prints = simhash.fingerprints(Texts(pa.array([r[1] for r in order])))
    key, want = "spark.sql.adaptive.coalescePartitions.enabled", []
    for k, (d, t, *_) in enumerate(order):
        text, after = t or "", (k + 1) % len(order)
        n = len(text) // 2
        edited = text[: len(text) - n] + (order[after][1] or "")[:n]
        changed = simhash.fingerprints(Texts(pa.array([edited])))
        near = [float(simhash.likeness(prints[k : k + 1], x)[0]) for x in (changed, prints[after : after + 1])]
        want.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[k].tobytes().hex(), changed[0].tobytes().hex(), *near))
    before = spark.conf.get(key)
    spark.conf.set(key, coalesce)
    try:
        got = [tuple(r) for r in simhash.compare_with_next(docs, limit=limit).collect()]
    finally:
        spark.conf.set(key, before)
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize(("radius", "blocks"), [(3, 4), (3, 6), (0, 1), (5, 8)])
def test_within_radius_finds_all(spark, radius, blocks):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (40, 32), dtype=np.uint8)
    base[20] = base[7]
    near = base.copy()
    for k in range(40):
        for b in rng.choice(256, k % 8, replace=False):
            near[k, b // 8] ^= 1 << (b % 8)
    rows = [(i, r.tobytes().hex()) for i, r in enumerate(np.concatenate((base, near)))] + [(100, None), (120, "0" * 64)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    found = [(r[0], r[1], r[2]) for r in simhash.within_radius(df, df.where("doc_id % 20 = 0"), radius, blocks).collect()]
    prints = {d: int(x, 16) for d, x in rows if x}
    want = {(f"{a:064x}", f"{b:064x}", (a ^ b).bit_count()) for d, a in prints.items() if d % 20 == 0 for b in prints.values() if (a ^ b).bit_count() <= radius}
    assert len(found) == len(set(found)) and set(found) == want
    counted = {r[0]: r[1] for r in simhash.count_within(df, df.where("doc_id % 20 = 0"), radius, blocks).collect()}
    assert counted == {f"{a:064x}": sum((a ^ b).bit_count() <= radius for b in prints.values()) for d, a in prints.items() if d % 20 == 0}
    assert simhash.count_within(df, df.limit(0), radius, blocks).count() == 0
    with pytest.raises(ValueError):
        simhash.within_radius(df, df, 6, 6)


def plain_length(text: bytes, learned: list[bytes], order: int) -> float:
    counts: dict = {}
    for t in learned:
        t = t.lower()
        for i in range(len(t)):
            for k in range(min(order, i) + 1):
                counts.setdefault(t[i - k : i], {}).setdefault(t[i], 0)
                counts[t[i - k : i]][t[i]] += 1
    total, text = 0.0, text.lower()
    for i in range(len(text)):
        p = 1.0
        for k in range(min(order, i), -1, -1):
            seen = counts.get(text[i - k : i])
            if seen is None:
                continue
            n, d = sum(seen.values()), len(seen)
            if text[i] in seen:
                p *= seen[text[i]] / (n + d)
                break
            p *= d / (n + d)
        else:
            p /= 256
        total -= math.log2(p)
    return total


def test_language_code_lengths():
    learned = {"a": [b"the cat and the hat", b"then"], "b": ["le chat était là".encode()]}
    model = language_id.Model(learned)
    texts = ["the chat", "", "x", "là où", "日本", "THE"]
    got = model.lengths(Texts(pa.array(texts)))
    for t, row in zip(texts, got, strict=True):
        assert np.allclose(row, [plain_length(t.encode(), learned[k], 3) for k in model.languages], rtol=1e-4, atol=1e-3)


def test_language_model_leaves_nothing_out():
    """200 byte classes and 70 languages with rare contexts: every code length is that of the language's tree."""
    rng = np.random.default_rng(3)
    learned = {f"l{k:02}": [bytes(rng.integers(30 + k, 230, 300, dtype=np.uint8))] for k in range(70)}
    model = language_id.Model(learned)
    assert model.languages == sorted(learned)
    texts = ["plain text", "Ünï", *(learned[k][0].decode("latin-1")[:40] for k in ("l00", "l69"))]
    got = model.lengths(Texts(pa.array(texts)))
    for t, row in zip(texts, got, strict=True):
        assert np.allclose(row, [plain_length(t.encode(), learned[k], 3) for k in model.languages], rtol=1e-4, atol=1e-3)
    # what is learned once is known again to its full depth, in each language
    texts = [f"{k} x{k * k} y{k}z" for k in range(70)]
    model = language_id.Model({f"l{k:02}": [t.encode()] * 2 for k, t in enumerate(texts)})
    assert np.argmin(model.lengths(Texts(pa.array(texts))), axis=1).tolist() == list(range(70))


def test_more_languages_than_64(spark):
    rows = [(100 * k + i, chr(0x4E00 + 40 * k + i % 3) * 5 + chr(0x4E00 + 40 * k + 7), f"l{k:02}") for k in range(70) for i in range(6 if k < 64 else 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.identify(d, language_id.learn(d)).where("lang <> lang_pred").count() == 0


def test_language_id(spark, sf_dir, docs, none):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.learn(d.where("doc_id % 3 <> 1"), rows_per_language=40)
    held = language_id.identify(d.where("doc_id % 3 = 1"), model)
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count()
    for r in language_id.identify(docs, model).collect():
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    nothing = language_id.identify(docs, language_id.learn(none))
    assert nothing.where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(none, model).count() == 0


def test_repeated_rows_do_not_thin_out_what_is_learned(spark, sf_dir, monkeypatch):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", "text", "lang")
    learned = []

    class Kept(language_id.Model):
        def __init__(self, labelled, **options):
            learned.append(labelled)
            super().__init__(labelled, **options)

    monkeypatch.setattr(language_id, "Model", Kept)
    one = d.where("lang = 'es'").orderBy("doc_id").limit(1)
    language_id.learn(d, rows_per_language=40)
    language_id.learn(d.unionByName(one.join(spark.range(200_000).select(F.lit(1).alias("k"))).drop("k")), rows_per_language=40)
    assert learned[0] == learned[1] and len(learned[0]["es"]) > 10


def test_many_and_too_many_languages(spark, monkeypatch):
    # values of a dirty column are learned like others, up to bounds that are checked
    rows = [(k, f"text {k}", f"value {k % 2500}") for k in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language_id.learn(d, rows_per_language=2).languages) == 2500
    monkeypatch.setattr(language_id, "MOST_BYTES", 1000)
    with pytest.raises(ValueError, match="MB"):
        language_id.learn(d.limit(50))
    monkeypatch.setattr("atomloom.llm.common.MOST_GROUPS", 3)
    with pytest.raises(ValueError, match="groups"):
        language_id.learn(d.limit(50))


def test_quality(spark, docs, none):
    good = [(i, f"plain words number {i} stand here", 2) for i in range(60)]
    bad = [(100 + i, f"junk%%% ### words{i} $$$", 0) for i in range(60)]
    rude = [(200 + i, f"plain words number {i} you idiot", 1) for i in range(60)]
    d = spark.createDataFrame([x[:2] for x in good + bad + rude], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in good + bad + rude] + [(None, 1), (5, None)], "doc_id long, grade int")
    model = quality.train(d, labels.where("doc_id % 3 <> 0 or doc_id is null"), F.col("grade"))
    assert model.grades == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    held = quality.score(d, model, select=2).where("doc_id % 3 = 0").collect()
    assert all(r.kept == (r.doc_id < 100) for r in held)
    by = {r.doc_id: r.expected_grade for r in held}
    assert by[102] < by[201] < by[3]
    assert quality.score(docs, model, select=2).count() == docs.count()
    assert quality.score(none, model, select=2).count() == 0
    assert quality.score(docs, quality.train(docs, labels.limit(0), F.col("grade")), select=2).where("kept").count() == docs.count()
    one = quality.train(d, labels.where("grade = 1"), F.col("grade"))
    assert quality.score(d, one, select=2).where("kept").count() == 0


def ordinal_loss(model, rows, grade, weight, l1):
    """The penalised loss, term by term."""
    total = 0.0
    for own, g, w in zip(rows, grade, weight, strict=True):
        score = sum(float(model.weights[b]) for b in own)
        at = [-math.inf, *model.thresholds, math.inf]
        k = model.grades.index(g)
        below = [0.0 if t == -math.inf else 1.0 if t == math.inf else 1 / (1 + math.exp(score - t)) for t in at]
        total -= w * math.log(below[k + 1] - below[k])
    return total / sum(weight) + l1 * sum(abs(float(w)) for w in model.weights[model.weights != 0])


def test_ordinal_fit_is_at_the_optimum():
    rng = np.random.default_rng(5)
    rows, grade = [], []
    for _ in range(300):
        own = [b for b in (3, 8, 11) if rng.random() < 0.5]
        rows.append(own)
        grade.append(int(np.searchsorted([-0.5, 1.0], (1.5 if 3 in own else 0) - (1 if 8 in own else 0) + rng.logistic())))
    weight = rng.choice([1.0, 3.0], 300)
    offsets, buckets = np.cumsum([0, *map(len, rows)]), np.concatenate([np.array(x, np.int32) for x in rows])
    l1 = 1e-3
    model = quality.fit(offsets, buckets, np.array(grade), weight, l1=l1, steps=2000)
    best = ordinal_loss(model, rows, grade, weight, l1)
    assert model.weights[3] > 0.5 > -0.3 > model.weights[8] and (np.diff(model.thresholds) > 0).all()
    for k in (3, 8, 11):
        for step in (-0.05, 0.05):
            moved = model.weights.copy()
            moved[k] += step
            assert ordinal_loss(quality.Ordinal(model.grades, moved, model.thresholds), rows, grade, weight, l1) > best
    for k in (0, 1):
        for step in (-0.05, 0.05):
            moved = model.thresholds.copy()
            moved[k] += step
            assert ordinal_loss(quality.Ordinal(model.grades, model.weights, moved), rows, grade, weight, l1) > best
    tails = model.tails(offsets, buckets)
    for own, row in zip(rows, tails, strict=True):
        score = sum(float(model.weights[b]) for b in own)
        assert np.allclose(row, [1 / (1 + math.exp(t - score)) for t in model.thresholds])


def test_repeated_labels_weigh_but_do_not_fill_the_sample(spark):
    d = spark.createDataFrame([(i, f"fine text {i}" if i % 2 else f"bad text {i}") for i in range(80)], "doc_id long, text string")
    once = [(i, i % 2) for i in range(80)]
    labels = spark.createDataFrame(once + [(0, 0)] * 500 + [(1, 1)] * 500, "doc_id long, grade int")
    model = quality.train(d, labels, F.col("grade"), rows_per_grade=40)
    assert quality.score(d, model, select=1, threshold=0.5).where("kept = (doc_id % 2 = 1)").count() == 80


def test_repeated_documents_do_not_fill_the_sample(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"fine text {i}" if i % 2 else f"bad text {i}") for i in range(80)] + [(81, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(82)], "doc_id long, grade int")
    sizes = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a, **k: (sizes.append(len(a[2])), fit(*a, **k))[1])
    once = quality.train(d, labels, F.col("grade"))
    often = quality.train(d.unionByName(d.where("doc_id = 3").join(spark.range(200_000)).drop("id")), labels, F.col("grade"))
    assert sizes == [81, 81] and np.allclose(once.weights, often.weights, atol=1e-6) and np.allclose(once.thresholds, often.thresholds)
    # of several texts of one id the least counts
    quality.train(d.unionByName(d.where("doc_id < 9").withColumn("text", F.lit("zzz"))), labels, F.col("grade"))
    assert sizes[-1] == 81


PAGE = "<html><head><title>A &amp; B</title><style>x</style></head><body><!-- no --><script>var a='<p>';</script><p>One <b>two</b></p><ul><li><a href='/x?a=1&amp;b=2'>link</a></li></ul>&eacute; &lt;</body></html>"


def test_warc_records(spark):
    pages = spark.createDataFrame([(1, "http://a/", PAGE), (2, None, None), (3, "http://b/", ""), (4, "http://c/", "<p>" + "long " * 50_000)], "page_id long, url string, html string")
    made = warc.derive(warc.responses_from_pages(pages, "2024-01-01T00:00:00Z"), keep=("page_id",)).collect()
    by = {(r.page_id, r.record_type): r for r in made}
    assert set(by) == {(1, "metadata"), (1, "conversion"), (2, "metadata"), (3, "metadata"), (4, "metadata"), (4, "conversion")}
    assert by[1, "conversion"].text == "One two\nlink\né <" and by[1, "conversion"].n_links == 1
    assert "title: A & B" in by[1, "metadata"].text and "outlink: /x?a=1&b=2" in by[1, "metadata"].text
    assert len({r.record_id for r in made}) == len(made)
    for r in made:
        (header, block), = warc.parse(bytes(r.warc))
        assert header["WARC-Refers-To"] == r.refers_to == r.source_id and header["WARC-Type"] == r.record_type
        assert header["WARC-Block-Digest"] == warc.digest(block) == r.block_digest
        assert f"source-WARC-Record-ID: {r.refers_to}" in by[r.page_id, "metadata"].text
    assert warc.derive(warc.responses_from_pages(pages.limit(0), "d")).count() == 0


def test_warc_payload_codings_and_files(spark, tmp_path):
    import gzip

    body = b"<p>zipped text</p>"
    zipped = gzip.compress(body)
    chunked = b"%x\r\n%s\r\n0\r\n\r\n" % (len(zipped), zipped)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked
    records = warc.derive_one("<urn:uuid:1>", "u", "d", {}, block)
    assert records[1]["text"] == "zipped text" and f"payload-digest: {warc.digest(body)}" in records[0]["text"]
    broken = warc.derive_one(None, None, None, {}, block[:-30])
    assert "problem" in broken[0]["text"]
    image = warc.derive_one("i", "u", "d", {}, b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG")
    assert [r["record_type"] for r in image] == ["metadata"]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.record_bytes({"WARC-Type": "response", "WARC-Record-ID": f"<{k}>", "WARC-Target-URI": "u", "WARC-Date": "d", "Content-Length": str(len(block))}, block) for k in range(3)))
    found = warc.read_responses(spark.read.format("binaryFile").load(str(tmp_path)))
    assert {r.record_id for r in warc.derive(found).select(F.col("source_id").alias("record_id")).collect()} == {"<0>", "<1>", "<2>"}


@pytest.mark.parametrize("piece", ["<a ", "<script ", "<p", "<title>", "<!--", "&#", "<a href='", "</script ", "<a href=\"x>", "<script>", "&#x0", "1\r\n"])
def test_pages_take_time_in_proportion_to_their_length(piece):
    import time

    def took(n):
        page = piece * (n // len(piece))
        began = time.process_time()
        warc.derive_one("<1>", "u", "d", {}, b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + page.encode())
        warc.decoded_payload([("Transfer-Encoding", "chunked")], page.encode())
        return time.process_time() - began

    assert took(1_000_000) < 3


def test_texts_of_odd_pages():
    assert warc.plain_text("a < b <i>c</i> > d") == "a < b c > d"
    assert warc.plain_text("one<script>var x = 1 < 2") == "one"
    assert warc.plain_text("one <b two") == "one"
    assert warc.plain_text("x ><b") == "x >"
    assert warc.plain_text("&#" + "9" * 5000 + ";&#x" + "0" * 5000 + "41;&#65abcdefab &#0000000065;") == "\ufffdAAabcdefab A"
    assert warc.title("<title>A\n B</title>") == "A B" and warc.title("<title>A") == ""
    assert warc.outlinks("<a href=x><a name=y><A HREF = 'z&amp;'><a href=") == ["x", "z&"]
    for charset in ("hex", "idna", "punycode", "unicode_escape", "no-such", "rot13", "utf-8"):
        assert warc.decoded_text("né \\x41".encode(), charset) == "né \\x41"


def http(body: bytes, *fields: str) -> bytes:
    return "\r\n".join(["HTTP/1.1 200 OK", "Content-Type: text/html", *fields]).encode() + b"\r\n\r\n" + body


@pytest.mark.parametrize(("fields", "body"), [
    (["Content-Encoding: gzip"], b"\x1f\x8b not gzip"), (["Content-Encoding: br"], b"<p>x"), (["Content-Encoding: deflate"], b"\x78\x9c\x00"),
    (["Transfer-Encoding: chunked"], b"-5\r\nabc"), (["Transfer-Encoding: chunked"], b"ff\r\nabc"), (["Transfer-Encoding: chunked"], b"zz\r\nabc"),
])
def test_payloads_that_cannot_be_decoded(fields, body):
    (only,) = warc.derive_one("<1>", "u", "d", {}, http(body, *fields))
    assert only["record_type"] == "metadata" and "problem: payload coding" in only["text"]


def test_a_payload_that_unpacks_without_end():
    import gzip

    body = gzip.compress(b"x" * 10**6) * 3
    assert warc.decoded_payload([("Content-Encoding", "gzip")], body)[0] == b"x" * 3 * 10**6
    assert warc.decoded_payload([("Content-Encoding", "gzip")], body, most=2 * 10**6) == (body, "payload coding: too large")


def test_broken_files_are_rows_with_a_problem(spark, tmp_path):
    import gzip

    def record(k, length=None, kind="response", block=http(b"<p>one\n\ntwo")):
        return warc.record_bytes({"WARC-Type": kind, "WARC-Record-ID": f"<{k}>", "WARC-Target-URI": "u\r\nX: y", "Content-Length": length or str(len(block))}, block)

    whole = record(1) + record(2, kind="request") + record(3)
    files = {
        "whole": whole, "length": record(1, "ten") + record(2), "negative": record(1, "-4") + record(2), "long": record(1) + record(2, "99999"), "cut": whole[:-20],
        "junk": gzip.compress(b"not a record at all\r\n") + record(2), "short": record(1, "20") + record(2), "rubbish": record(1) + b"\x1f\x8b" + b"\x00" * 40, "empty": b"",
    }
    for name, data in files.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(data)
    (tmp_path / "plain.warc").write_bytes(gzip.decompress(whole))
    want = {"whole": ["<1>", "<3>"], "length": ["<2>"], "negative": ["<2>"], "long": ["<1>"], "cut": ["<1>"], "junk": ["<2>"], "short": ["<1>", "<2>"], "rubbish": ["<1>"], "empty": [], "plain": ["<1>", "<3>"]}
    for name in want:
        path = next(tmp_path.glob(f"{name}.*"))
        found = [warc.read_responses(spark.read.format("binaryFile").load(str(path)))]
        if name != "plain":
            found.append(warc.stream_responses(spark, str(path)))
        for k, one in enumerate(found):
            rows = one.collect()
            assert [r.record_id for r in rows if r.problem is None] == want[name], (name, k)
            assert any(r.problem for r in rows) == (name not in ("whole", "empty", "plain")), (name, k)
            assert all(bytes(r.block) == http(b"<p>one\n\ntwo") and r.target_uri == "u X: y" for r in rows if r.problem is None and name != "short")


def test_reading_goes_on_after_a_broken_member(spark, tmp_path, monkeypatch):
    block = http(b"<p>" + b"some words of a page " * 40)
    members = [warc.record_bytes({"WARC-Type": "response", "WARC-Record-ID": f"<{k}>", "Content-Length": str(len(block))}, block) for k in range(1, 6)]
    for chunk in (1 << 20, 37):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        for at in range(len(members[1])):
            bad = bytearray(members[1])
            bad[at] ^= 0x55
            found = list(warc.records(warc.cut(members[0] + bytes(bad) + b"".join(members[2:]))))
            good = [h["WARC-Record-ID"] for h, _, problem in found if problem is None]
            problems = [p for _, _, p in found if p]
            if problems:
                assert good == ["<1>", "<3>", "<4>", "<5>"] and len(problems) == 1, at
            else:  # a byte of the gzip header that holds no content
                assert good == ["<1>", "<2>", "<3>", "<4>", "<5>"] and at < 10, at
    bad = members[1][:60] + b"\x00\xff\x13" * 9 + members[1][87:]
    (tmp_path / "five.warc.gz").write_bytes(members[0] + bad + b"".join(members[2:]))
    (tmp_path / "tail.warc.gz").write_bytes(members[0] + bad)
    for read in (warc.stream_responses(spark, str(tmp_path)), warc.read_responses(spark.read.format("binaryFile").load(str(tmp_path)))):
        rows = read.collect()
        assert sorted(r.record_id for r in rows if r.problem is None) == ["<1>", "<1>", "<3>", "<4>", "<5>"]
        assert sum("no record was found behind it" in r.problem for r in rows if r.problem) == 1 and sum(r.problem is not None for r in rows) == 2


def test_records_larger_than_pieces_and_members_of_many(spark):
    block = http(b"x" * (3 << 20))
    one = [f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{k}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n" for k in range(4)]
    import gzip

    for data in (gzip.compress(b"".join(one)), gzip.compress(one[0]) + b"\0" * 9 + gzip.compress(b"".join(one[1:])), b"".join(one)):
        assert [(h["WARC-Record-ID"], b == block, p) for h, b, p in warc.records(warc.cut(data))] == [(f"<{k}>", True, None) for k in range(4)]
    broken = bytearray(gzip.compress(b"".join(one)))
    broken[-6] ^= 1  # the member's checksum: what came last is in doubt, the record being read and the one before
    assert [p is None for _, _, p in warc.records(warc.cut(bytes(broken)))] == [True, True, False, False]


def test_kept_columns_that_clash_give_way(spark):
    pages = spark.createDataFrame([(1, "http://a/", PAGE)], "page_id long, url string, html string")
    responses = warc.responses_from_pages(pages, "2024-01-01T00:00:00Z").withColumn("Text", F.lit("mine")).withColumn("n_links", F.lit("x"))
    made = warc.derive(responses, keep=("page_id", "Text", "date", "n_links"))
    assert made.columns.count("date") == 1 and "Text" not in made.columns
    assert {(r.page_id, r.n_links) for r in made.collect()} == {(1, 1)}
