"""Codes of pre-tokens: numbered in one pass, long ones only for their batch; merges against plain ones."""

import random

import numpy as np

from atomloom.llm import bpe


def vocabulary():
    ranks = {bytes((x,)): x for x in range(256)}
    for t in (b"ab", b"bc", b"abc", b" a", b"cc", b"abcc", b"\xc3\xa9", b"cab", b"aa", b"aaaa"):
        ranks[t] = len(ranks)
    return ranks


def plain(ranks, piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_merges_are_plain_merges():
    ranks, rng = vocabulary(), random.Random(1)
    encoder = bpe.Encoder(ranks, r" ?[^ ]+| ")
    pieces = [b"", b"a", b"ab", b"a" * 700] + [bytes(rng.choices(b"abc \xc3\xa9", k=rng.randint(0, 40))) for _ in range(400)]
    assert all(encoder.merge(p) == plain(ranks, p) for p in pieces)


def test_tokens_are_numbered_in_one_pass_and_long_ones_go_with_their_batch(monkeypatch):
    monkeypatch.setattr(bpe, "LONGEST_HELD", 5)
    ranks = vocabulary()
    encoder = bpe.Encoder(ranks, r" ?[^ ]+| ")
    assert isinstance(encoder.codes, bpe.Codes)
    texts = ["abc abcabcabc ab", None, "", "abcabcabc cab aaaaaaaa abcabcabc", "é ab"]
    for batch in (texts, texts[::-1], ["cc aaaaaaaaaa", "abc"]):
        offsets, ids = encoder.encode_batch(batch)
        for k, x in enumerate(batch):
            want = [i for t in encoder.split(x or "") for i in plain(ranks, t.encode())]
            assert ids[offsets[k] : offsets[k + 1]].tolist() == want
        assert all(len(t) <= 5 for t in encoder.codes) and len(encoder.codes) == len(encoder.lens) == encoder.codes.held
        assert int(encoder.lens.sum()) == len(encoder.flat) and np.all(encoder.starts + encoder.lens <= len(encoder.flat))
