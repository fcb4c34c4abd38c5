"""Byte-level BPE encoding and decoding.

Method: two-tier lookup. Tier one resolves whole pre-tokens that are in the vocabulary by a minimal perfect hash (index,
then a comparison of the token's bytes). Tier two merges the others: the bytes of a pre-token are linked nodes, and a
heap holds the mergeable neighbours by (rank, position), so the lowest rank, leftmost, merges first. Each worker keeps
the codes of about ``HELD`` pre-tokens and ``HELD_IDS`` ids at most; those of pre-tokens longer than ``LONGEST_HELD`` go
with their batch.

The vocabulary file (lines of base64 token and rank) is read on the driver and broadcast; its size is that of the
vocabulary and is checked against ``MAX_VOCABULARY_BYTES``. Defined cases: null and empty texts have no ids; special
tokens are ordinary text; when decoding, null arrays give empty bytes and null or unknown ids nothing; a result column
replaces an input column of the same name.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atomloom.llm.common import PerfectHash, map_texts, quoted

HELD, HELD_IDS, LONGEST_HELD, MAX_VOCABULARY_BYTES = 500_000, 4 << 20, 200, 64 << 20


def read_vocabulary(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token -> rank, by way of Spark's readers for paths in a store, else of the driver's files."""
    if "://" in path:
        lines = [r[0] for r in spark.read.text(path).collect()]
    else:
        with open(path) as f:
            lines = f.read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    if sum(map(len, ranks)) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary has over {MAX_VOCABULARY_BYTES} bytes and can't be broadcast")
    return ranks


class Codes(dict):
    """Codes of pre-tokens, which are numbered as they are first asked for; long ones, from -1 down, on their own."""

    def __init__(self):
        super().__init__()
        self.held, self.fresh, self.long = 0, [], []

    def __missing__(self, token: str) -> int:
        if len(token) > LONGEST_HELD:
            self.long.append(token)
            code = -len(self.long)
        else:
            self.fresh.append(token)
            code, self.held = self.held, self.held + 1
        self[token] = code
        return code


class Encoder:
    """Both tiers over one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        keys = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in ranks), np.uint64, len(ranks))
        self.mph = PerfectHash.build(keys)
        self.slots: list[tuple[bytes, int]] = [(b"", -1)] * len(ranks)
        for at, item in zip(self.mph.index(keys).tolist(), ranks.items(), strict=True):
            self.slots[at] = item
        # ranks of single bytes and of pairs, -1 where there is none
        self.bytes = [ranks.get(bytes((x,)), -1) for x in range(256)]
        self.pairs = [-1] * (1 << 16)
        for t, r in ranks.items():
            if len(t) == 2:
                self.pairs[t[0] << 8 | t[1]] = r
        self._reset()

    def _reset(self):
        # a pre-token's code is its place in starts and lens, which delimit its ids in flat
        self.codes = Codes()
        self.flat, self.starts, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, fresh: list[str]) -> None:
        if not fresh:
            return
        pieces = [t.encode("utf-8", "surrogatepass") for t in fresh]
        found = [[r] if r >= 0 else self.merge(p) for p, r in zip(pieces, self.whole(pieces), strict=True)]
        lens = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lens) - lens))
        self.lens = np.concatenate((self.lens, lens))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(found), np.int32, int(lens.sum()))))

    def whole(self, pieces: list[bytes]) -> list[int]:
        """Tier one: the rank of each piece, or -1."""
        at = self.mph.index(np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), np.uint64, len(pieces)))
        found = ((-1 if k < 0 else self.slots[k][1] if self.slots[k][0] == p else -1) for k, p in zip(at.tolist(), pieces, strict=True))
        return list(found)

    def merge(self, piece: bytes) -> list[int]:
        """Tier two: a heap of mergeable neighbours over linked bytes.

        A node is where its bytes begin, and ``end`` is also the next node. An entry is rank and node in one number, and
        counts while it is the one that ``now`` has of the node.
        """
        rank, n = self.ranks.get, len(piece)
        if n < 2:
            return [self.ranks[piece]] if n else []
        shift = n.bit_length()
        mask, pairs, push, pop = (1 << shift) - 1, self.pairs, heapq.heappush, heapq.heappop
        ids, end, before = [self.bytes[x] for x in piece], list(range(1, n + 1)), list(range(-1, n - 1))
        # -1 stays below 0 when it is shifted
        now = [pairs[x << 8 | y] << shift | i for i, (x, y) in enumerate(pairwise(piece))]
        now.append(-1)
        heap = [k for k in now if k >= 0]
        heapq.heapify(heap)
        while heap:
            k = pop(heap)
            i = k & mask
            if now[i] != k:
                continue
            j = end[i]
            ids[i], end[i], now[j] = k >> shift, end[j], -1
            to, h = end[j], before[i]
            if to < n:
                before[to] = i
                r = rank(piece[i : end[to]])
                if r is None:
                    now[i] = -1
                else:
                    now[i] = r << shift | i
                    push(heap, now[i])
            else:
                now[i] = -1
            if h >= 0:
                r = rank(piece[h:to])
                if r is None:
                    now[h] = -1
                else:
                    now[h] = r << shift | h
                    push(heap, now[h])
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = end[i]
        return out

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of texts."""
        if len(self.codes) > HELD or len(self.flat) > HELD_IDS:
            self._reset()
        tokens = [self.split(x) if x else [] for x in texts]
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(tokens)), np.int64, int(counts.sum()))
        fresh, long, self.codes.fresh, self.codes.long = self.codes.fresh, self.codes.long, [], []
        self._learn(fresh)
        kept, kept_ids = len(self.lens), len(self.flat)
        if long:
            self._learn(long)
            codes[codes < 0] = kept - 1 - codes[codes < 0]
        size = self.lens[codes]
        total = np.cumsum(size)
        ids = self.flat[np.arange(int(total[-1]) if len(total) else 0) + np.repeat(self.starts[codes] - (total - size), size)]
        words = np.concatenate(([0], np.cumsum(counts)))
        if long:
            for text in long:
                del self.codes[text]
            self.starts, self.lens, self.flat = self.starts[:kept].copy(), self.lens[:kept].copy(), self.flat[:kept_ids].copy()
        return np.concatenate(([0], total))[words], ids


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids``: the token ids of the whole text, an array of int."""
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(docs.sparkSession, vocabulary))
    held: dict = {}

    def run(batch):
        if not held:
            held["encoder"] = Encoder(sent.value, pattern)
        offsets, out = held["encoder"].encode_batch(batch.column(text).to_pylist())
        return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))]

    return map_texts(docs, text, [T.StructField(ids, T.ArrayType(T.IntegerType()))], run)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with ``decoded``: the bytes that the ids stand for."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(encoded.sparkSession, vocabulary))
    kept = [c for c in encoded.columns if c.lower() != decoded.lower()]
    schema = T.StructType([encoded.schema[c] for c in kept] + [T.StructField(decoded, T.BinaryType())])
    held: dict = {}

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out = pa.array(_decoded(batch.column(ids), sent.value, held), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [out], names=[*kept, decoded])

    return encoded.select(*[quoted(c).alias(c) for c in dict.fromkeys([*kept, ids])]).mapInArrow(run, schema)


def _decoded(column: pa.Array, ranks: dict[bytes, int], held: dict) -> list[bytes]:
    if not held:
        size = max(ranks.values(), default=-1) + 2  # the last stands for unknown ids
        tokens = [b""] * size
        for t, r in ranks.items():
            tokens[r] = t
        lens = np.fromiter(map(len, tokens), np.int64, size)
        held |= {"data": np.frombuffer(b"".join(tokens), np.uint8), "lens": lens, "starts": np.cumsum(lens) - lens}
    lens, starts = held["lens"], held["starts"]
    flat = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat[(flat < 0) | (flat >= len(lens))] = len(lens) - 1
    counts = np.array([len(x) if x.is_valid else 0 for x in column], np.int64)
    size = lens[flat]
    total = np.cumsum(size)
    data = held["data"][np.arange(int(total[-1]) if len(total) else 0) + np.repeat(starts[flat] - (total - size), size)].tobytes()
    ends = np.concatenate(([0], total))[np.concatenate(([0], np.cumsum(counts)))].tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, without bringing the ids back to the JVM."""
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(docs.sparkSession, vocabulary))
    held: dict = {}

    def run(batch):
        if not held:
            held["encoder"] = Encoder(sent.value, pattern)
        return [pa.array(np.diff(held["encoder"].encode_batch(batch.column(text).to_pylist())[0]))]

    return map_texts(docs, text, [T.StructField("n_tokens", T.LongType())], run)


def ids_text(ids):
    """Column: the ids in decimal, joined by one space."""
    return F.array_join(ids, " ")
