"""Shared kernels: Arrow text buffers, vectorised word and window hashes, a minimal perfect hash.

Texts are handled as UTF-8 bytes. A record batch is cut into slices of bounded bytes, so that the memory of a Python
worker depends on the slice (or on one very long text), not on the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U64 = np.uint64
MASK64 = (1 << 64) - 1
#: Odd multipliers of the hashes over bytes and over words.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Places in a word whose byte values are kept in a table.
PLACES = 64
#: Groups that a sample may have.
MOST_GROUPS = 10_000


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64; a bijection on 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def placed_bytes(key: np.ndarray) -> np.ndarray:
    """A 64-bit value for each place * 256 + byte."""
    return mix64((key.astype(U64) + U64(1)) * U64(BYTE_BASE))


NEAR_BYTES = placed_bytes(np.arange(PLACES * 256))
FOLD = np.arange(256, dtype=np.int64)
FOLD[65:91] += 32


def word_hashes(data: np.ndarray, size: np.ndarray, lower: bool) -> np.ndarray:
    """64 bits for each of the words that ``data`` holds one after the other; with ``lower`` A-Z count as a-z.

    Each place of a word has its own value for each byte, drawn apart from all others; a word's hash is their sum, mixed
    with its length. No pattern of bytes makes two words meet more often than chance does.
    """
    if not len(size):
        return np.zeros(0, U64)
    first = np.cumsum(size) - size
    key = np.arange(len(data)) - np.repeat(first, size)
    far = np.flatnonzero(key >= PLACES) if int(size.max()) > PLACES else None
    key <<= 8
    key |= FOLD[data] if lower else data
    if far is None:
        value = NEAR_BYTES[key]
    else:
        value = NEAR_BYTES[np.minimum(key, len(NEAR_BYTES) - 1)]
        value[far] = placed_bytes(key[far])
    return mix64(np.add.reduceat(value, first) + size.astype(U64) * U64(WORD_BASE))


def separators(pattern: str) -> np.ndarray:
    """True for bytes that are outside words. ``space``: the class [\\x20\\x09-\\x0D]; ``nonword``: ASCII but 0-9A-Za-z."""
    sep = np.zeros(256, bool)
    if pattern == "space":
        sep[[32, 9, 10, 11, 12, 13]] = True
    else:
        sep[:128] = True
        sep[48:58] = sep[65:91] = sep[97:123] = False
    return sep


class Texts:
    """The texts of an Arrow column as one byte array with offsets; null is empty."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        self.valid = np.asarray(column.is_valid())
        column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
        if column.null_count:
            column = column.fill_null("")
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.bytes = whole[off[0] : off[-1]] if len(off) else whole[:0]
        self.offsets = off - off[0] if len(off) else np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.offsets) - 1


def of_bytes(data: np.ndarray, offsets: np.ndarray) -> Texts:
    """Texts from bytes and offsets that are at hand."""
    t = Texts.__new__(Texts)
    t.bytes, t.offsets, t.valid = data, offsets, np.ones(len(offsets) - 1, bool)
    return t


class Words:
    """Word spans of texts: ``start``/``end`` in bytes, ``doc`` bounds in words, ``hash`` 64 bits for each word."""

    def __init__(self, texts: Texts, sep: np.ndarray, lower: bool):
        data, off = texts.bytes, texts.offsets
        inside = ~sep[data]
        begins, ends = inside.copy(), inside.copy()
        if len(data):
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            filled = off[:-1] < off[1:]
            first, last = off[:-1][filled], off[1:][filled] - 1
            begins[first] |= inside[first]
            ends[last] |= inside[last]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.start, off)
        self.hash = word_hashes(data[inside], self.end - self.start, lower)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a sequence whose first part has hash a and whose second has hash b."""
    return mix64(a * U64(WORD_BASE) + b)


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``size`` words from each position on; the last size-1 positions have none.

    Hashes of 1, 2, 4, ... words are joined pairwise, and a window is joined from those that make up its size.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    part, span, done, out = mix64(words + U64(seed)) if seed else words, 1, 0, None
    while True:
        if size >> (span.bit_length() - 1) & 1:
            piece = part[done : done + n]
            out, done = piece if out is None else joined(out, piece), done + span
        if 2 * span > size:
            return mix64(out + U64(size))
        part, span = joined(part[:-span], part[span:]), 2 * span


def window_starts(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions from which ``size`` words lie in one text, and the number of that text for each."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    return np.arange(len(doc)) - first + bounds[:-1][doc], doc


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, in pieces whose texts have ``limit`` bytes at most, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.concatenate(([0], np.cumsum(size))), 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys, by levels of collision-free bits.

    On a level each key sets one of ``gamma`` * keys bits; keys alone at their bit stay, the others go on to the next
    level. A key's index is the number of bits set before its own. Keys outside the set get some index or -1.
    """

    def __init__(self, levels: list[np.ndarray], ranks: list[np.ndarray], size: int):
        self.levels, self.ranks, self.size = levels, ranks, size

    @staticmethod
    def _bit(keys: np.ndarray, level: int, m: int) -> np.ndarray:
        return (mix64(keys + U64((level * BYTE_BASE + 1) & MASK64)) % U64(m)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        keys, levels, left = np.unique(keys.astype(U64)), [], len(keys)
        size = left
        while left:
            m = max(64, int(gamma * left + 63) // 64 * 64)
            at = cls._bit(keys, len(levels), m)
            seen = np.bincount(at, minlength=m)
            levels.append(np.packbits(seen == 1, bitorder="little"))
            keys = keys[seen[at] != 1]
            left = len(keys)
        return cls.from_levels(levels, size)

    @classmethod
    def from_levels(cls, levels: list[np.ndarray], size: int) -> PerfectHash:
        ranks, before = [], 0
        for bits in levels:
            counts = np.bitwise_count(bits).astype(np.int64)
            ranks.append(before + np.cumsum(counts) - counts)
            before += int(counts.sum())
        return cls(levels, ranks, size)

    def index(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(U64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = self._bit(keys[open_], k, len(bits) * 8)
            byte, low = bits[at >> 3], (at & 7).astype(np.uint8)
            hit = (byte >> low) & 1 == 1
            below = np.bitwise_count(byte[hit] & ((1 << low[hit].astype(np.int64)) - 1).astype(np.uint8))
            out[open_[hit]] = self.ranks[k][at[hit] >> 3] + below
            open_ = open_[~hit]
        return out

    def dump(self) -> bytes:
        head = np.array([self.size, len(self.levels), *map(len, self.levels)], np.int64)
        return head.tobytes() + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        size, n = np.frombuffer(data, np.int64, 2)
        lens = np.frombuffer(data, np.int64, int(n), 16)
        levels, at = [], 16 + 8 * int(n)
        for x in lens:
            levels.append(np.frombuffer(data, np.uint8, int(x), at))
            at += int(x)
        return cls.from_levels(levels, int(size))


def quoted(name: str):
    from pyspark.sql import functions as F

    return F.col("`" + name.replace("`", "``") + "`")


def map_texts(docs, column: str, fields: list, fn, keep: list[str] | None = None, reads: tuple = (), limit: int = SLICE_BYTES):
    """Columns made from a text column, beside the columns of ``docs`` (or ``keep``).

    ``fn(batch)`` gets slices of bounded bytes, with the columns in ``reads`` too, and returns an Arrow array for each
    of ``fields`` (StructFields). A new column takes the place of one of the same name, in whichever case it is written.
    """
    from pyspark.sql import types as T

    new = {f.name.lower() for f in fields}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    sent = list(dict.fromkeys([*kept, column, *reads]))
    schema = T.StructType([docs.schema[c] for c in kept] + fields)
    names = [f.name for f in schema.fields]

    def run(batches):
        for batch in slices(batches, column, limit):
            arrays = [batch.column(c) for c in kept] + list(fn(batch))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(*[quoted(c).alias(c) for c in sent]).mapInArrow(run, schema)


def hashed_sample(rows, group: str, keys: list[str], sizes: dict, n: int):
    """At most ``n`` rows of each group: those with the least hashes of ``keys``. ``sizes``: rows by group.

    ``rows`` are distinct in group and keys, and ``sizes`` counts them so. Hashes that are surely too large go before rows
    meet by group, so a task gets about 1.5 n + 200 rows of a group however many there are; fewer than n are left once in
    10**20 times. Groups are broadcast with their limits, so that there may be ``MOST_GROUPS``.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    if len(sizes) > MOST_GROUPS:
        raise ValueError(f"{group} has {len(sizes)} values; a sample takes {MOST_GROUPS} groups at most")
    limits = [(g, min(MASK64 >> 1, int((1.5 * n + 200) / max(1, size) * 2**64) - 2**63)) for g, size in sizes.items()]
    limit = rows.sparkSession.createDataFrame(limits, T.StructType([T.StructField("__g", rows.schema[group].dataType), T.StructField("__limit", T.LongType())]))
    hashed = rows.withColumn("__h", F.xxhash64(*[quoted(k) for k in keys])).join(F.broadcast(limit), quoted(group) == F.col("__g")).where("__h <= __limit")
    rank = Window.partitionBy(quoted(group)).orderBy("__h", *[quoted(k) for k in keys])
    return hashed.withColumn("__r", F.row_number().over(rank)).where(F.col("__r") <= n).drop("__h", "__r", "__g", "__limit")
