"""Files of token ids and codes of vectors, against plain versions."""

import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from atomloom.llm import id_files, vector_codes
from atomloom.llm.common import Texts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True
PIECES = id_files.Pieces(open(PATH, encoding="utf-8").read())
ODD = [
    "a  b  c  d　e　 f\n g\t h  ", "é ñ x y　z  a\x0bb\n\n\nc", " lead", "trail ", "\x1c a\x1d b\x85 c", "I'm it's  'll x a's,b'", "x" * 500 + " " + "y" * 400,
    "  ​ a   b", "a\x7f b", "٣ ४ 五 六", "\U0001f642 \U0001f642\U0001f642 a", "café, café. ×, ÷; à, é\nb\n c\n", "a <|endoftext|> b", "\n", "\na", "a\n", "a\n\nb", "a\n b", "-\n-", "b \nc", " \nx",
]


# Elias-Fano


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 40) | st.integers(0, 3), max_size=200))
def test_elias_fano(values):
    values = np.array(sorted(values), np.int64)
    made, end = id_files.EliasFano.load(b"abc" + id_files.EliasFano.build(values).dump(), 3)
    assert made.select(np.arange(len(values))).tolist() == values.tolist()
    for x in [0, 2, *values[:3].tolist(), 1 << 41]:
        assert made.rank(x) == np.searchsorted(values, x, "right")


def test_elias_fano_is_small_and_crosses_blocks():
    rng = np.random.default_rng(3)
    for values in (np.concatenate(([0], np.cumsum(rng.geometric(0.001, 200_000)))), np.array([0] * 5000 + [10**12]), np.array([0] * 70_000 + [9] * 70_000)):
        made = id_files.EliasFano.build(values)
        pick = rng.permutation(len(values))
        assert np.array_equal(made.select(pick), values[pick])
        assert np.array_equal(np.concatenate(list(made.runs(999))), values)
    made = id_files.EliasFano.build(np.concatenate(([0], np.cumsum(rng.geometric(0.001, 200_000)))))
    assert 8 * len(made.dump()) / 200_001 < np.log2(1000) + 3


# encoding


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text(alphabet=" \n\t  é×a,'1s̀\x85", max_size=30), max_size=5))
def test_pieces_are_the_library(texts):
    bounds, ids = PIECES.encode(Texts(pa.array(texts, pa.string())))
    for t, a, b in zip(texts, bounds, bounds[1:], strict=False):
        assert ids[a:b].tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_odd_texts_are_the_library():
    bounds, ids = PIECES.encode(Texts(pa.array(ODD)))
    for t, a, b in zip(ODD, bounds, bounds[1:], strict=False):
        assert ids[a:b].tolist() == LIBRARY.encode(t, add_special_tokens=False).ids, t


def test_kept_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(id_files, "HELD", 300)
    own = id_files.Pieces(open(PATH, encoding="utf-8").read())
    for k in range(12):
        text = " ".join(f"z{chr(97 + k)}q{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(200)) + " the same words" + " v" + "w" * (300 + k)
        assert own.encode(Texts(pa.array([text])))[1].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
        assert len(own.codes) <= 300 + 210 and len(own.codes) == len(own.lens) == len(own.seen)
    assert " the" in own.codes


# files


def plain(rows):
    """(doc_id, start, n_tokens, crc) by one pass over the sorted rows; ids and texts of ties are compared as sets."""
    made = [(k, [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2]) for k, t in rows]
    return made


def test_write_and_read(docs, rows, none, tmp_path):
    manifest = id_files.write(docs, str(tmp_path), PATH, end_id=2)
    got = sorted(id_files.read(manifest).collect(), key=lambda r: r.start)
    want = plain([(r[0], r[1]) for r in rows])
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(k), ids) for k, ids in want)
    at, order = 0, []
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
        order.append(-1 if r.doc_id is None else r.doc_id)
    assert order == sorted(order) and at == sum(r.n_ids for r in manifest.collect())
    empty = id_files.write(none, str(tmp_path), PATH, end_id=2)
    assert empty.count() == 0 and id_files.read(empty).count() == 0 and id_files.read(empty).columns == ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]


def test_reader_finds_documents(spark, tmp_path):
    texts = [(3 * k - 500, "" if k % 7 == 0 else f"text {k} " * (k % 11)) for k in range(800)]
    manifest = id_files.write(spark.createDataFrame(texts, "doc_id long, text string"), str(tmp_path), PATH, end_id=2).orderBy("part").collect()
    ids = [[*LIBRARY.encode(t, add_special_tokens=False).ids, 2] for _, t in texts]
    at = 0
    for r in manifest:
        reader = id_files.Reader(r.path)
        assert reader.width == 2 and os.path.getsize(r.path + ".ids") == 2 * r.n_ids
        assert reader.doc_ids(0, reader.n_docs).to_pylist() == [k for k, _ in texts[at : at + r.n_docs]]
        for k in (0, r.n_docs // 2, r.n_docs - 1):
            assert reader.document(k).tolist() == ids[at + k]
            start = int(reader.starts.select(np.array([k]))[0])
            assert reader.holder(start) == reader.holder(start + len(ids[at + k]) - 1) == k
        at += r.n_docs
    assert at == 800


def test_long_texts_and_one_hot_id(spark, tmp_path):
    long = " ".join(f"word{k % 997}" for k in range(300_000))
    rows = [(5, long), (5, None), *[(7, f"copy {k % 3}") for k in range(3000)]]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    got = id_files.read(id_files.write(docs, str(tmp_path), PATH, end_id=70_000)).orderBy("start").collect()
    assert len(got) == len(rows) and got[0].doc_id == 5
    assert sorted(r.n_tokens for r in got)[-1] == len(LIBRARY.encode(long, add_special_tokens=False).ids) + 1
    assert all(r.ids[-1] == 70_000 for r in got)


def test_other_files_are_refused(tmp_path):
    (tmp_path / "x.idx").write_bytes(b"0" * 200)
    with pytest.raises(ValueError):
        id_files.Reader(str(tmp_path / "x"))


# vector codes


def plain_codes(vectors, parts, entries, rounds):
    """(codes, errors, books) in Python integers."""
    ints = {k: [int(np.floor(256 * float(x))) for x in v] for k, v in vectors}
    width = len(next(iter(ints.values()))) // parts
    cut = {k: [v[p * width : (p + 1) * width] for p in range(parts)] for k, v in ints.items()}
    first = sorted(k for k in cut)[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return {k: [min((far(v[p], c), e) for e, c in enumerate(books[p])) for p in range(parts)] for k, v in cut.items()}

    for _ in range(rounds):
        made = assign()
        for p in range(parts):
            for e in range(len(first)):
                mine = [cut[k][p] for k in cut if made[k][p][1] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    made = assign()
    return {k: "".join(f"{e:02x}" for _, e in m) for k, m in made.items()}, {k: sum(d for d, _ in m) for k, m in made.items()}, books


def test_codes_are_the_plain_ones(spark):
    rng = np.random.default_rng(5)
    vectors = [(int(k), (rng.integers(-40, 40, 8) / 128).astype(np.float32).tolist()) for k in rng.permutation(300)]
    vectors += [(1000 + k, vectors[k][1]) for k in range(40)]  # copies and ties
    odd = [(2000, None), (2001, [1.0, None] * 4), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2004, []), (2005, [0.5] * 4), (2006, [3e38] * 8), (-9, [0.5] * 7)]
    rows = [(k, v, None if k % 3 == 0 else k % 2, "x", "y") for k, v in vectors + odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, CODE string, n string")
    coded, books = vector_codes.compress(df, parts=4, entries=16, rounds=2)
    codes, errors, want = plain_codes(vectors, 4, 16, 2)
    assert books.tolist() == want
    assert vector_codes.digest(books) == hashlib.sha256(",".join(str(x) for b in want for e in b for x in e).encode()).hexdigest()
    total = {}
    for k, e in errors.items():
        label = None if k % 3 == 0 else k % 2
        total[label] = total.get(label, 0) + e
    got = coded.collect()
    assert {r.vec_id: r.code for r in got} == codes and {r.vec_id: r.error for r in got} == errors
    assert all(r.label_error == total[r.label] and r.n == "y" for r in got) and len(got) == len(codes)
    back = vector_codes.decode(coded.select("vec_id", F.when(F.col("vec_id") != 5, F.col("code")).alias("code")), books).collect()
    for r in back:
        assert r.decoded == (None if r.vec_id == 5 else [x for p in range(4) for x in want[p][int(codes[r.vec_id][2 * p : 2 * p + 2], 16)]])


def test_codes_of_repeats_null_ids_and_nothing(spark):
    schema = "vec_id long, embedding array<double>, label string"
    rows = [(None, [9.0, 9.0], None)] * 3 + [(1, [2.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [0.0, -0.001], "b")]
    coded, books = vector_codes.compress(spark.createDataFrame(rows, schema), parts=2, entries=4, rounds=0)
    assert books.tolist() == [[[256], [0]], [[0], [-1]]] and coded.count() == len(rows)
    for odd in ([], [(None, [1.0, 2.0], "a")], [(1, None, "a")]):
        coded, books = vector_codes.compress(spark.createDataFrame(odd, schema), parts=2)
        assert coded.count() == 0 and books.size == 0 and coded.columns == ["vec_id", "label", "code", "error", "label_error"]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([2, 50, 1000, 1 << 20, 1 << 27]), st.integers(1, 9))
def test_screening_is_exact(seed, top, width):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-top, top + 1, (300, width)), rng.integers(-top, top + 1, (32, width))
    c[7], c[20], x[:32] = c[3], c[3] + 1, c  # ties, near ties and hits
    index, d = vector_codes.nearest(x, c)
    full = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (index == full.argmin(1)).all() and (d == full.min(1)).all()
