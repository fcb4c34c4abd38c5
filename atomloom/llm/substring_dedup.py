"""Substring dedup: words of passages that already stand in an earlier document are removed.

A window is ``size`` consecutive words of one document. A word goes if a window over it has a word sequence that also
starts in a document with a smaller id; windows are judged on the input.

Method: count-min prefilter, then exact groups.
1. Each block of documents sends the distinct fingerprints of its windows, packed, to hash shards: a sparse sketch.
   A shard merges them into a count-min sketch (``DEPTH`` rows of saturating counters), which overestimates how often a
   window occurs, and answers which of a block's windows may occur twice. None that does is missed.
2. For those windows only, blocks send the 64-bit hash and their smallest document id to the shard, which groups them
   exactly and answers whether the block's smallest is the smallest of all.
3. Each block removes what its documents don't own.
Shards have about ``shard_windows`` windows, so their number follows the input while their memory doesn't.

Windows are told apart by 64 bits of hash within a shard chosen by an independent hash. Defined cases: null, empty and
short texts have no window and keep all; a document with a null id counts as later than all known ids and not earlier
than others with a null id; rows that share an id never remove each other's words; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomloom.llm.blocks import BLOCK_BYTES, Block, answers_by_block, delta16, joined_bits, pack, rows_of, undelta16
from atomloom.llm.common import U64, Words, separators, window_hashes, window_starts
from atomloom.session import materialize

SHARD_WINDOWS, PRINT_BITS, DEPTH = 2 << 20, 27, 2
SEP = separators("space")
OUT = "doc_id long, n_words long, n_removed long, kept string"


class Windows:
    """The windows of a block: position, document, exact hash, and the block's sorted distinct (shard, print) keys."""

    def __init__(self, block: Block, size: int, shards: int):
        self.words = Words(block.texts, SEP, False)
        self.start, self.doc = window_starts(self.words.bounds, size)
        self.hash = window_hashes(self.words.hash, size)[self.start]
        other = window_hashes(self.words.hash, size, seed=1)[self.start]
        self.shard = ((other >> U64(32)) % U64(shards)).astype(np.int64)
        key = (self.shard << PRINT_BITS) | (other & U64((1 << PRINT_BITS) - 1)).astype(np.int64)
        self.keys, self.at, self.times = np.unique(key, return_inverse=True, return_counts=True)
        self.sizes = np.bincount(self.keys >> PRINT_BITS, minlength=shards)


class CountMin:
    """Rows of counters that stop at 2. Adding a list of distinct prints adds at least one to each print's counters."""

    def __init__(self, entries: int, depth: int = DEPTH):
        self.bits = max(10, (4 * entries).bit_length())
        self.rows = np.zeros((depth, 1 << self.bits), np.uint8)

    def _cells(self, prints: np.ndarray):
        for k, row in enumerate(self.rows):
            yield row, ((prints.astype(U64) + U64(1)) * U64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[k % 3] + 2 * (k // 3)) >> U64(64 - self.bits)).astype(np.int64)

    def add(self, prints: np.ndarray, twice: np.ndarray) -> None:
        for row, cells in self._cells(prints):
            row[cells] = np.minimum(row[cells] + 1, 2)
            row[cells[twice]] = 2

    def repeated(self, prints: np.ndarray) -> np.ndarray:
        out = np.ones(len(prints), bool)
        for row, cells in self._cells(prints):
            out &= row[cells] >= 2
        return out


def _sketch_lists(blocks: DataFrame, size: int, shards: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                w = Windows(Block(row), size, shards)
                out, end = [], np.cumsum(w.sizes)
                for k in np.flatnonzero(w.sizes).tolist():
                    own = slice(end[k] - w.sizes[k], end[k])
                    out.append((k, row["block"], int(w.sizes[k]), delta16(w.keys[own] & ((1 << PRINT_BITS) - 1)), np.packbits(w.times[own] > 1).tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["shard", "block", "n", "prints", "twice"])

    return blocks.mapInArrow(run, "shard long, block long, n long, prints binary, twice binary")


def _answer_sketch(table: pa.Table) -> pa.Table:
    n = table.column("n").to_pylist()
    sketch, lists = CountMin(sum(n)), []
    for prints, twice, k in zip(table.column("prints").to_pylist(), table.column("twice").to_pylist(), n, strict=True):
        lists.append(undelta16(prints).astype(np.int32))
        sketch.add(lists[-1], np.unpackbits(np.frombuffer(twice, np.uint8), count=k).astype(bool))
    found = [sketch.repeated(x) for x in lists]
    some = [k for k, x in enumerate(found) if x.any()]
    pick = pa.array(some, pa.int64())
    return pa.table({"block": table.column("block").take(pick), "shard": table.column("shard").take(pick), "bits": pa.array([np.packbits(found[k]).tobytes() for k in some], pa.binary())})


class Suspects:
    """The windows of a block that may be repeated, and its distinct (shard, hash) entries with their smallest id."""

    def __init__(self, block: Block, windows: Windows, repeated: np.ndarray, shards: int):
        self.windows = np.flatnonzero(repeated[windows.at])
        shard, hash_, doc = windows.shard[self.windows], windows.hash[self.windows], block.ids[windows.doc[self.windows]]
        order = np.lexsort((doc, hash_, shard))
        new = np.ones(len(order), bool)
        s, h = shard[order], hash_[order]
        new[1:] = (s[1:] != s[:-1]) | (h[1:] != h[:-1])
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.hash, self.least = h[new], doc[order][new]
        self.sizes = np.bincount(s[new], minlength=shards)


def _exact_lists(blocks: DataFrame, size: int, shards: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                block = Block(row)
                w = Windows(block, size, shards)
                s = Suspects(block, w, joined_bits(row["repeated"], w.sizes), shards)
                out, end = [], np.cumsum(s.sizes)
                for k in np.flatnonzero(s.sizes).tolist():
                    own = slice(end[k] - s.sizes[k], end[k])
                    out.append((k, row["block"], s.hash[own].tobytes(), s.least[own].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["shard", "block", "hashes", "least"])

    return blocks.mapInArrow(run, "shard long, block long, hashes binary, least binary")


def _answer_exact(table: pa.Table) -> pa.Table:
    lists = [np.frombuffer(x, U64) for x in table.column("hashes").to_pylist()]
    hashes, least = np.concatenate(lists), np.concatenate([np.frombuffer(x, np.int64) for x in table.column("least").to_pylist()])
    order = np.lexsort((least, hashes))
    h, low = hashes[order], least[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    owner = np.empty(len(h), bool)
    owner[order] = low == low[np.flatnonzero(new)][np.cumsum(new) - 1]
    ends = np.cumsum([len(x) for x in lists])
    bits = [np.packbits(owner[e - len(x) : e]).tobytes() for x, e in zip(lists, ends, strict=True)]
    return pa.table({"block": table.column("block"), "shard": table.column("shard"), "bits": pa.array(bits, pa.binary())})


def remove_repeats(docs: DataFrame, size: int = 13, doc_id: str = "doc_id", text: str = "text", shard_windows: int = SHARD_WINDOWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): for each row the words left, joined by one space."""
    blocks = pack(docs, doc_id, text, block_bytes)
    # no more windows than bytes / 2; one in six bytes is what prose has, and only the size of shards depends on it
    shards = max(1, -(-(blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0] // 6) // shard_windows))
    answer = "block long, shard long, bits binary"
    sketch = _sketch_lists(blocks, size, shards).groupBy("shard").applyInArrow(_answer_sketch, answer)
    repeated = materialize(answers_by_block(sketch, "repeated"), "repeated-windows")
    first = blocks.join(repeated, "block", "left")
    exact = _exact_lists(first, size, shards).groupBy("shard").applyInArrow(_answer_exact, answer)
    owners = answers_by_block(exact, "owned")

    def finish(batches):
        for batch in batches:
            for row in rows_of(batch):
                block = Block(row)
                w = Windows(block, size, shards)
                s = Suspects(block, w, joined_bits(row["repeated"], w.sizes), shards)
                owned = joined_bits(row["owned"], s.sizes)
                gone = ~owned[s.entry] | (block.ids[w.doc[s.windows]] > s.least[s.entry])
                step = np.zeros(len(w.words.start) + 1, np.int64)
                at = w.start[s.windows[gone]]
                np.add.at(step, at, 1)
                np.add.at(step, at + size, -1)
                cut = np.cumsum(step)[:-1] > 0
                yield _kept(block, w.words, cut)

    return first.join(repeated.select("block").join(owners, "block", "left"), "block", "left").mapInArrow(finish, OUT)


def _kept(block: Block, words: Words, cut: np.ndarray) -> pa.RecordBatch:
    total = np.concatenate(([0], np.cumsum(cut)))
    removed = total[words.bounds[1:]] - total[words.bounds[:-1]]
    off, out = block.texts.offsets, []
    raw = block.texts.bytes.tobytes()
    for k in range(len(block.texts)):
        parts = raw[off[k] : off[k + 1]].split()
        if removed[k]:
            own = cut[words.bounds[k] : words.bounds[k + 1]]
            parts = [p for p, c in zip(parts, own.tolist(), strict=True) if not c]
        out.append(b" ".join(parts))
    return pa.RecordBatch.from_arrays([block.id_array(), pa.array(words.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

