"""Line dedup, decontamination, substring dedup and near-dedup against plain versions."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from atomloom.llm import common, decontaminate, line_dedup, near_dedup, substring_dedup

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_perfect_hash_is_minimal_and_survives_a_dump():
    keys = common.mix64(np.arange(5000, dtype=np.uint64))
    mph = common.PerfectHash.load(common.PerfectHash.build(keys).dump())
    assert sorted(mph.index(keys)) == list(range(5000))
    assert len(common.PerfectHash.build(keys[:0]).index(keys[:3])) == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té ,1", max_size=30), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    import pyarrow as pa

    words = common.Words(common.Texts(pa.array(texts, pa.string())), common.separators("space"), True)
    assert words.counts.tolist() == [len(SPACE.findall(t)) for t in texts]
    named = {}
    flat = [w.translate(LOWER) for t in texts for w in SPACE.findall(t)]
    for w, h in zip(flat, words.hash.tolist(), strict=True):
        assert named.setdefault(w, h) == h
    assert len(set(named.values())) == len(named)


def plain_word_hash(word: bytes) -> int:
    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 % 2**64
        x ^= x >> 27
        x = x * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)

    total = sum(mix((256 * k + b + 1) * common.BYTE_BASE % 2**64) for k, b in enumerate(word))
    return mix((total + len(word) * common.WORD_BASE) % 2**64)


def test_word_hashes_place_by_place():
    import pyarrow as pa

    found = ["a", "abc", "x" * 64, "y" * 65, "né" * 100, "日本"]
    words = common.Words(common.Texts(pa.array([" ".join(found), "ABC Z" + "q" * 300])), common.separators("space"), True)
    assert words.hash.tolist() == [plain_word_hash(w.encode()) for w in [*found, "abc", "z" + "q" * 300]]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 10, 13, 16, 31])
def test_window_hashes_tell_windows_apart(size):
    words = common.mix64(np.random.default_rng(size).integers(0, 2, 3000).astype(np.uint64))
    named = {}
    for k, h in enumerate(common.window_hashes(words, size).tolist()):
        assert named.setdefault(words[k : k + size].tobytes(), h) == h
    assert len(set(named.values())) == len(named)
    assert len(common.window_hashes(words[: size - 1], size)) == 0


def thue_morse(n: int, a: str, b: str) -> str:
    """2**n letters; polynomial hashes modulo 2**64 give it and its complement the same value from n = 10 on."""
    return "".join((a, b)[k.bit_count() & 1] for k in range(2**n))


def test_words_that_meet_in_polynomial_hashes(spark):
    one, two = thue_morse(11, "a", "b"), thue_morse(11, "b", "a")
    rest = " ".join(f"w{k}" for k in range(12))
    df = spark.createDataFrame([(1, one), (2, two), (3, f"{one} {rest}"), (4, f"{two} {rest}")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_groups(df.where("doc_id < 3"), shingle=2).collect()} == {(1, 1), (2, 2)}
    assert {r.n_removed for r in substring_dedup.remove_repeats(df, size=13).collect()} == {0}


def line_truth(rows, least):
    keys = [[x.strip(" \t\n\r\x0b\x0c").translate(LOWER) for x in (t or "").split("\n")] for _, t, *_ in rows]
    found = Counter(k for ks in keys for k in set(ks) if k)
    return sorted((d is None, d or 0, len(ks), "\n".join(x for x, k in zip((t or "").split("\n"), ks, strict=True) if found[k] < least)) for (d, t, *_), ks in zip(rows, keys, strict=True))


@pytest.mark.parametrize("options", [{}, {"unit_bytes": 64, "shard_lines": 3}])
def test_line_dedup(spark, docs, rows, options):
    got = line_dedup.drop_common_lines(docs, min_docs=2, **options)
    assert {c.lower() for c in got.columns} == {c.lower() for c in docs.columns}
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_lines, r.text) for r in got.select("doc_id", "n_lines", "text").collect())
    assert found == line_truth(rows, 2)


def test_line_dedup_of_nothing(none):
    assert line_dedup.drop_common_lines(none).count() == 0


def test_line_index_holds_keys_that_share_their_first_half():
    keys = np.array([[1, 5], [1, 6], [1, 7], [2, 5], [-3, 9]], np.int64)
    index = line_dedup.LineIndex(*line_dedup.distinct_keys(np.concatenate((keys, keys[1:3])), np.arange(1, 8)))
    wanted = np.array([[1, 7], [1, 6], [1, 5], [1, 8], [2, 5], [2, 6], [-3, 9], [4, 4]], np.int64)
    assert index.probe(wanted).tolist() == [3 + 7, 2 + 6, 1, 0, 4, 0, 5, 0]
    assert line_dedup.LineIndex(keys[:0], np.zeros(0, np.int64)).probe(wanted).tolist() == [0] * 8


def test_lines_that_share_half_a_hash_keep_apart(spark, monkeypatch):
    """All lines of a length share the first 64 bits; the arrays' counts still decide for each line."""
    whole = line_dedup.xxhash.xxh3_128_digest
    monkeypatch.setattr(line_dedup.xxhash, "xxh3_128_digest", lambda k: bytes([len(k)] * 8) + whole(k)[:8])
    common_lines, rare = distinct = ["aaa", "bbb"]
    index = line_dedup.LineIndex(*line_dedup.distinct_keys(np.frombuffer(b"".join(line_dedup.xxhash.xxh3_128_digest(x.encode()) for x in [common_lines, common_lines, rare]), np.int64).reshape(-1, 2), np.ones(3, np.int64)))
    digests = np.frombuffer(b"".join(line_dedup.xxhash.xxh3_128_digest(x.encode()) for x in distinct), np.int64).reshape(-1, 2)
    assert index.probe(digests).tolist() == [2, 1]


ITEMS = [(1, "Lamda Mu, Nu xi!", None), (2, None, None), (3, "", None), (4, "one", None), (None, "tail OF it", None)]


def contamination_truth(rows, items, size):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add("" if i is None else str(i))
    out = []
    for d, t, *_ in rows:
        w, hit, named = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    named |= windows[tuple(w[k : k + n])]
        out.append((d is None, d or 0, len(w), len(hit), sorted(named), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination(spark, docs, rows, block_bytes):
    base = rows[0][1].split()
    items = [(7, " ".join(base[10:25])), (8, " ".join(base[12:20])), (9, " ".join(base[40:60]).upper()), *[x[:2] for x in ITEMS]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(docs, bench, size=10, block_bytes=block_bytes, clean=True)
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in got.collect())
    assert found == contamination_truth(rows, items, 10)
    kept = decontaminate.decontaminate(docs, bench, size=10)
    assert kept.dtypes == docs.dtypes and kept.count() == sum(not x[-1] for x in found)
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, remove="spans", size=10).collect()}
    assert spans[7] == "" and base[0] in spans[1] and base[11] not in spans[1].split()


def test_windows_of_one_hash_are_told_apart(monkeypatch, rows):
    import pyarrow as pa

    whole = common.window_hashes
    monkeypatch.setattr(decontaminate, "window_hashes", lambda words, n: whole(words, n) % np.uint64(3))
    items = [("b", "one two three four"), ("a", "two three four five"), ("c", "one two"), ("a", "two three four five")]
    windows = decontaminate.WindowSet([(i, t.encode()) for i, t in items], 3)
    texts = ["x two three four y", "one two", "three four five six one", "", "ONE-two"]
    hit, words, found = windows.find(common.Texts(pa.array(texts)))
    assert found == [["a", "b"], ["c"], ["a"], [], ["c"]]
    assert [hit[a:b].tolist() for a, b in zip(words.bounds, words.bounds[1:], strict=False)] == [[False, True, True, True, False], [True, True], [True, True, True, False, False], [], [True, True]]


def test_window_set_keeps_a_few_bytes_for_each_of_its_items():
    import pickle
    import random

    rng = random.Random(2)
    items = [(str(k), " ".join(f"w{rng.randrange(10**6)}" for _ in range(100)).encode()) for k in range(1500)]
    assert len(pickle.dumps(decontaminate.WindowSet(items, 10))) < 10 * sum(len(t) for _, t in items)


def test_decontamination_of_and_by_nothing(spark, docs, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert not decontaminate.find_contamination(docs, bench).where("contaminated").count()
    assert decontaminate.find_contamination(none, bench).count() == 0


def repeat_truth(rows, size):
    least, out = {}, []
    for d, t, *_ in rows:
        w, key = SPACE.findall(t or ""), float("inf") if d is None else d
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            least[x] = min(least.get(x, key), key)
    for d, t, *_ in rows:
        w, key, gone = SPACE.findall(t or ""), float("inf") if d is None else d, set()
        for k in range(len(w) - size + 1):
            if least[tuple(w[k : k + size])] < key:
                gone |= set(range(k, k + size))
        out.append((d is None, d or 0, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize(("block", "shard"), [(1 << 20, 1 << 20), (600, 40)])
def test_substring_dedup(docs, rows, block, shard):
    got = substring_dedup.remove_repeats(docs, size=13, block_bytes=block, shard_windows=shard).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in got) == repeat_truth(rows, 13)


def test_substring_dedup_of_nothing(none):
    assert substring_dedup.remove_repeats(none).count() == 0


def test_count_min_never_misses():
    rng = np.random.default_rng(0)
    lists = [np.unique(rng.integers(0, 1 << 27, 2000)) for _ in range(20)]
    lists[3] = np.unique(np.concatenate((lists[3], lists[9][:500])))
    sketch = substring_dedup.CountMin(40_000)
    for x in lists:
        sketch.add(x, np.zeros(len(x), bool))
    assert sketch.repeated(lists[9][:500]).all()
    assert sketch.repeated(np.setdiff1d(lists[0], np.concatenate(lists[1:]))).mean() < 0.3


def group_truth(rows, n, percent=80):
    sets, ids = {}, sorted({d for d, *_ in rows if d is not None})
    for d, t, *_ in rows:
        w = SPACE.findall((t or "").translate(LOWER))
        if d is not None:
            sets.setdefault(d, []).append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 2, "cluster_shingles": 150}, {"bucket_rows": 2, "cluster_rows": 3}])
def test_near_groups(docs, rows, options):
    got = near_dedup.near_groups(docs, shingle=2, **options).collect()
    assert len(got) == len(rows)
    truth = group_truth(rows, 2)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == truth
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("percent", [30, 65, 100])
def test_near_groups_at_other_similarities(spark, percent):
    rng = np.random.default_rng(percent)
    base = [[f"v{i}" for i in rng.integers(0, 30, n)] for n in (2, 4, 5, 8, 30, 80)]
    rows = [(1, "a b c d", None), (2, "a b c e", None), (3, "a b c", None), (4, "a b c", None)]
    for k, words in enumerate(base * 4):
        edited = list(words)
        for at in rng.integers(0, len(words), k % 5):
            edited[at] = f"e{k}"
        rows.append((10 + k, " ".join(edited), None))
    df = spark.createDataFrame(rows, "doc_id long, text string, x string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(df, shingle=1, percent=percent).collect()}
    assert got == group_truth(rows, 1, percent)


def test_plans_miss_one_pair_in_millions():
    """Pairs of just the similarity asked for: by the numbers, and by drawing sketches."""
    assert (near_dedup.Plan(80).bands, near_dedup.Plan(80).rows) == (40, 5)
    rng = np.random.default_rng(0)
    for percent in (10, 50, 80, 95):
        plan = near_dedup.Plan(percent)
        assert (1 - (percent / 100) ** plan.rows) ** plan.bands <= near_dedup.MISSED
        one = rng.integers(0, 2**32, (4000, plan.count), dtype=np.uint32)
        two = np.where(rng.random(one.shape) < percent / 100, one, rng.integers(0, 2**32, one.shape, dtype=np.uint32))
        bits = np.bitwise_count((near_dedup.odd_sketches(one) ^ near_dedup.odd_sketches(two)).view(np.uint64)).sum(axis=1)
        assert bits.max() <= plan.most_bits and 5.3 < (plan.most_bits - bits.mean()) / bits.std() < 8


def test_pairs_just_above_the_threshold_are_all_linked(spark):
    """400 pairs of similarity 0.8 to 0.81, and 400 of just below 0.8 that stay apart."""
    rows, k = [], 0
    for pair in range(800):
        n = 81 + pair % 40
        same = -(-160 * (n + 1) // 180)  # the least overlap for 0.8 of two sets of n + 1
        if pair >= 400:
            same -= 1
        for side in "ab":
            rows.append((k, " ".join([f"p{pair}s{i}" for i in range(same)] + [f"p{pair}{side}{i}" for i in range(n + 1 - same)])))
            k += 1
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1).collect()}
    assert got == {d: d - d % 2 if d < 800 else d for d in range(1600)}


def test_near_copies_chain(spark):
    """A chain of edits: neighbours are alike, its ends aren't; blocks of a split cluster still meet."""
    words = [f"w{i}" for i in range(100)]
    texts = []
    for k in range(30):
        words[3 * k % 100] = f"e{k}"
        texts.append((k, " ".join(words), None))
    df = spark.createDataFrame(texts, "doc_id long, text string, x string")
    for options in ({}, {"cluster_shingles": 700, "bucket_rows": 3}, {"cluster_rows": 9, "bucket_rows": 3}):
        assert {r.component_id for r in near_dedup.near_groups(df, shingle=2, **options).collect()} == {0}
    assert near_dedup.drop_near_copies(df, shingle=2).count() == 1


def test_near_groups_of_nothing(none):
    assert near_dedup.near_groups(none).count() == 0
