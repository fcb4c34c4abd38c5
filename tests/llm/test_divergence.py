"""The source audit against a plain version, and the radix selection against sorting."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from atomloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def plain(rows, min_docs, top):
    """{(lang, source, part): [(item, value), ...]} from (lang, source, text)."""
    seen, counts, groups = defaultdict(set), defaultdict(Counter), set()
    for k, row in enumerate(rows):
        lang, source, text = (x or "" for x in row)
        groups.add((lang, source))
        for term in TERM.findall(text.translate(ASCII)):
            seen[lang, term].add(k)
            counts[lang, source][term] += 1
    out = {}
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), docs in seen.items() if x == lang and len(docs) >= min_docs)
        sources = sorted(s for x, s in groups if x == lang)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(counts[lang, s]) for s in sources}, share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(t, sum(abs(p[s][w] - p[t][w]) for w in kept)) for t in sources if t != s]
            terms = [(w, p[s][w] - q[w]) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            order = lambda x: (-x[1], x[0].encode())
            out |= {k: v for k, v in (((lang, s, "pair"), sorted(pairs, key=order)), ((lang, s, "term"), sorted(terms, key=order)[:top])) if v}
    return out


def grouped(df):
    out = defaultdict(list)
    for r in df.orderBy("rank").collect():
        assert r["rank"] == len(out[r.lang, r.source, r.part]) + 1
        out[r.lang, r.source, r.part].append((r["item"], r.value))
    return dict(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = [f"w{chr(97 + k % 26)}{'x' * (k // 26)}" for k in range(90)] + ["Éa", "éa", "ñ", "日本", "naïve"]
    rows = []
    for _ in range(400):
        lang, source = rng.choice(["en", "fr", None]), rng.choice(["hot"] * 5 + [f"s{k}" for k in range(7)] + [None])
        rows.append((lang, source, " ".join(rng.choice(words[: 20 + len(source or "") * 9]).upper() + rng.choice([" ", "1", "-", "\n"]) for _ in range(rng.randrange(30)))))
    return rows + [("en", "empty", None), ("en", "blank", " 12 \n"), ("rare", "a", "one two"), ("rare", "b", None), ("lone", "a", "x"), ("en", "hot", "long " * 50_000)] + [("fr", "twin", "wa wb")] * 40


def test_audit_is_the_plain_one(spark, corpus):
    docs = spark.createDataFrame(corpus, "lang string, source string, text string").withColumns({c: F.lit("x") for c in ("term", "n", "docs", "P", "place")})
    assert grouped(divergence.audit(docs, min_docs=6, top=9)) == plain(corpus, 6, 9)


def test_blocks_and_shards_give_the_same_pairs(spark, corpus):
    found = divergence.Shares(spark.createDataFrame(corpus, "lang string, source string, text string"), 6)
    want = {(k[0], k[1], t): v for k, pairs in plain(corpus, 6, 9).items() if k[2] == "pair" for t, v in pairs}
    for sources, terms in ((2, 7), (3, 200), (100, 1)):
        got = divergence.pair_distances(found, sources, terms).collect()
        assert {(r.lang, r.source, r["item"]): r.value for r in got} == want and len(got) == len(want)


def test_nothing_to_audit(spark):
    schema = "lang string, source string, text string"
    assert divergence.audit(spark.createDataFrame([], schema)).count() == 0
    got = grouped(divergence.audit(spark.createDataFrame([("en", "a", "x y"), ("en", "b", None), (None, None, None)], schema)))
    assert got == {("en", "a", "pair"): [("b", 0)], ("en", "b", "pair"): [("a", 0)]}


def test_slices_hand_on_sums(spark, corpus, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_ROWS", 1)
    docs = spark.createDataFrame([tuple(x or "" for x in r) for r in corpus], "lang string, source string, text string")
    got = divergence.term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("docs")).collect()
    want, docs_of = Counter(), Counter()
    for row in corpus:
        lang, source, text = (x or "" for x in row)
        found = Counter(TERM.findall(text.translate(ASCII)))
        for t, n in found.items():
            want[lang, source, t] += n
            docs_of[lang, source, t] += 1
    assert {tuple(r[:3]): (r[3], r[4]) for r in got} == {k: (n, docs_of[k]) for k, n in want.items()}


def test_radix_top_is_a_sort(spark, tmp_path):
    rng = random.Random(2)
    rows = [("ties", 7, f"{'long prefix ' * (k % 3)}{k % 10}é{k}") for k in range(500)] + [("ties", 8, "above"), ("ties", 6, "below")]
    rows += [("few", rng.randrange(1 << 30), f"i{k}") for k in range(5)] + [("exact", k * 1_000_003 % (1 << 30), f"i{k}") for k in range(20)]
    rows += [("wide", rng.randrange(1 << 30), f"i{k}") for k in range(3000)] + [("close", (1 << 20) + k % 3, f"i{k}") for k in range(300)]
    rows += [("nested", 1, "a" * k) for k in range(100)] + [("zero", 0, f"z{k}") for k in range(60)] + [(None, 4, f"n{k}") for k in range(30)]
    path = str(tmp_path / "rows")
    spark.createDataFrame([(a or "", *b) for a, *b in rows], "g string, value long, item string").write.parquet(path)
    for k in (1, 20, 150):
        got = defaultdict(list)
        for r in divergence.radix_top(spark.read.parquet(path), ["g"], "value", "item", k).orderBy("rank").collect():
            got[r.g].append((r.value, r["item"]))
        want = defaultdict(list)
        for g, value, item in sorted(rows, key=lambda r: (-r[1], r[2].encode())):
            want[g or ""].append((value, item))
        assert got == {g: v[:k] for g, v in want.items()}
