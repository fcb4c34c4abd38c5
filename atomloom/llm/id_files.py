"""Token-ID output: binary files of concatenated ids with Elias-Fano document boundaries.

Method: documents are sorted by id over all partitions; a task encodes its range and writes one pair of files. ``.ids``
holds all ids of its documents one after the other, little-endian, in two bytes each where the vocabulary allows it, else
four. ``.idx`` holds where each document starts as an Elias-Fano sequence: of each start the low bits packed, the high
bits in unary, and for each 512 bits of these a 32-bit count of the ones before. ``select`` finds the block of a start by
these counts and the bit in it, so that a document's offsets take some two bits and log2(mean length) each, and no table of
64-bit offsets is made. Document ids, which ascend too, are a second sequence. A written manifest names the files that
count, and gives each the number of ids in the files before it; files that a lost task left are in no manifest.

Texts are cut where the tokenizer's pattern never crosses (``Pieces.cuts``), so that the pieces' ids don't depend on their
neighbours. A worker keeps the ids of the pieces it has seen; new ones go through the ``tokenizers`` library, many at a time.
The cuts fit byte-level tokenizers with the usual pattern of contractions, letters, numbers, other characters and spaces.

Defined cases: null and empty texts have the end id alone; null ids come first; rows of one id follow each other, ordered
by a hash of their text. Strings of special tokens in texts are ordinary text. Ids must be integral and texts are read whole;
other columns don't matter. The folder may lie in any file system that pyarrow opens by its address.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atomloom.llm.common import Texts, quoted, slices
from atomloom.session import materialize

MAGIC, BLOCK, HEAD = b"ATIDS001", 512, "<8sIIqqq"
#: Bounds of what a worker keeps, the longest piece that it keeps, bytes that go to the library at once, ids read at
#: once, and bytes of texts encoded at once.
HELD, HELD_IDS, LONGEST, TOGETHER, READ_IDS, SLICE = 500_000, 8 << 20, 200, 1 << 16, 1 << 20, 4 << 20


# Elias-Fano sequences


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` bits each, packed from the low end, eight numbers to ``width`` bytes."""
    bits = (values.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little")


def unpack_bits(packed: np.ndarray, width: int, index: np.ndarray) -> np.ndarray:
    """The numbers at ``index`` of those that ``pack_bits`` made."""
    if not width:
        return np.zeros(len(index), np.int64)
    at = index.astype(np.int64)[:, None] * width + np.arange(width)
    bits = (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1
    return (bits.astype(np.int64) << np.arange(width)).sum(1)


class EliasFano:
    """An ascending sequence of numbers from 0 to ``top``; ``select`` gives the i-th without reading those before it."""

    def __init__(self, n: int, top: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.top, self.low, self.high, self.ones = n, top, low, high, ones
        self.width = self.low_bits(n, top)

    @staticmethod
    def low_bits(n: int, top: int) -> int:
        return max(0, (top // n).bit_length() - 1) if n else 0

    @classmethod
    def build(cls, values: np.ndarray, piece: int = 1 << 16) -> EliasFano:
        """``values`` ascend, repeats allowed."""
        values = values.astype(np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = cls.low_bits(n, top)
        size = n + (top >> width) + 1
        marks = np.zeros(-(-size // BLOCK) * BLOCK, np.uint8)
        marks[(values >> width) + np.arange(n)] = 1
        high, mask = np.packbits(marks, bitorder="little"), (1 << width) - 1
        counts = marks.reshape(-1, BLOCK).sum(1, dtype=np.int64)
        if n >= 1 << 32:
            raise ValueError("a sequence has fewer than 2**32 numbers")
        # pieces of a multiple of eight numbers end at a byte
        low = [pack_bits(values[at : at + piece] & mask, width) for at in range(0, n, piece)] if width else []
        return cls(n, top, np.concatenate(low) if low else np.zeros(0, np.uint8), high, (np.cumsum(counts) - counts).astype(np.uint32))

    def select(self, index: np.ndarray) -> np.ndarray:
        """The numbers at ``index``: search the counts of ones for the block, then find the bit in it."""
        index = np.asarray(index, np.int64)
        out = np.zeros(len(index), np.int64)
        for at in range(0, len(index), 4096):
            i = index[at : at + 4096]
            block = np.searchsorted(self.ones, i, "right") - 1
            bits = np.unpackbits(self.high.reshape(-1, BLOCK // 8)[block], axis=1, bitorder="little")
            rank = (i - self.ones[block]).astype(np.int64)
            place = (np.cumsum(bits, axis=1, dtype=np.int32) > rank[:, None]).argmax(1)
            out[at : at + 4096] = ((block * BLOCK + place - i) << self.width) | unpack_bits(self.low, self.width, i)
        return out

    def runs(self, step: int = 1 << 16) -> Iterator[np.ndarray]:
        """All numbers in order, ``step`` at a time."""
        for at in range(0, self.n, step):
            yield self.select(np.arange(at, min(self.n, at + step)))

    def rank(self, value: int) -> int:
        """How many of the numbers are at most ``value``."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if int(self.select(np.array([mid]))[0]) <= value else (low, mid)
        return low

    def dump(self) -> bytes:
        return struct.pack("<qqqqq", self.n, self.top, len(self.low), len(self.high), len(self.ones)) + self.low.tobytes() + self.high.tobytes() + self.ones.astype("<u4").tobytes()

    @classmethod
    def load(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """(the sequence at ``at``, where it ends)."""
        n, top, a, b, c = struct.unpack_from("<qqqqq", data, at)
        at += 40
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        return cls(n, top, low, high, np.frombuffer(data, "<u4", c, at + a + b)), at + a + b + 4 * c


# encoding


KIND = np.zeros(256, np.uint8)  #: 1 white space, 3 letters, 2 what else is printable in ASCII, 0 all other bytes
KIND[33:127] = 2
KIND[65:91] = KIND[97:123] = 3
KIND[[9, 10, 11, 12, 13, 32]] = 1


def joinable(piece: str) -> bool:
    """Whether pieces like this one keep their ids when they follow each other in one text."""
    return piece[0] == " " and not piece[-1].isspace()


class Pieces:
    """Ids of texts by way of the tokenizers library, with the ids of short pieces kept."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer)
        self.library.encode_special_tokens = True
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.bytes_of = np.zeros(size, np.int64)
        for token, k in self.library.get_vocab(with_added_tokens=True).items():
            self.bytes_of[k] = len(token)  # a byte-level vocabulary writes one character for each byte
        self._reset()

    def _reset(self) -> None:
        # a piece's code is its place in starts and lens, which delimit its ids in flat, and in seen, how often batches had it
        self.codes: dict[str, int] = {}
        self.flat, self.starts, self.lens, self.seen = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _shrink(self) -> None:
        """Keep the pieces that more than one batch had, or none where that leaves too many."""
        again = self.seen > 1
        if again.sum() > HELD // 2 or self.lens[again].sum() > HELD_IDS // 2:
            self._reset()
            return
        place = np.cumsum(again) - 1
        self.codes = {p: int(place[c]) for p, c in self.codes.items() if again[c]}
        starts, self.lens = self.starts[again], self.lens[again]
        ends = np.cumsum(self.lens)
        self.flat = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - self.lens), self.lens)]
        self.starts, self.seen = ends - self.lens, np.ones(len(ends), np.int64)

    @staticmethod
    def cuts(texts: Texts) -> np.ndarray:
        """Where pieces start: places that the tokenizer's pattern never crosses and never looks across.

        These are the starts of texts, ASCII white space after a character that is none, an ASCII character other than a
        letter after a letter of Latin-1, and the character after a single line feed between two that are no white space. The
        characters of white space beyond ASCII start with the bytes C2, E1, E2 or E3; none after these is a cut.
        """
        data = texts.bytes
        cut = np.zeros(len(data), bool)
        if len(data) > 3:
            kind = KIND[data]
            filled = kind == 2
            filled |= kind == 3
            wide = np.flatnonzero(kind[2:] == 0) + 2
            filled[wide[~((data[wide - 1] == 0xC2) | ((data[wide - 2] >= 0xE1) & (data[wide - 2] <= 0xE3)))]] = True
            cut[1:] = filled[:-1] & (kind[1:] == 1)
            letter = kind == 3
            letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            cut[1:] |= letter[:-1] & (kind[1:] == 2)
            feed = np.flatnonzero(data[1:-1] == 10) + 1
            cut[feed[filled[feed - 1] & (kind[feed + 1] >= 2)] + 1] = True
        starts = texts.offsets[:-1]
        cut[starts[starts < texts.offsets[1:]]] = True
        return np.flatnonzero(cut)

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece)."""
        sizes, texts, at = np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces)), [], 0
        joins = [joinable(p) for p in pieces]
        while at < len(pieces):
            to, total = at + 1, int(sizes[at])
            while to < len(pieces) and joins[to - 1] and joins[to] and total < TOGETHER:
                total += int(sizes[to])
                to += 1
            texts.append("".join(pieces[at:to]))
            at = to
        found = [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.zeros(0, np.int32)
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(sizes)) + 1
        return ids, np.diff(ends, prepend=0)

    def _learn(self, fresh: list[str]) -> None:
        if fresh:
            fresh = sorted(fresh, key=joinable)
            ids, lens = self._ids(fresh)
            self.codes.update(zip(fresh, range(len(self.lens), len(self.lens) + len(fresh)), strict=True))
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lens) - lens))
            self.lens, self.flat = np.concatenate((self.lens, lens)), np.concatenate((self.flat, ids))
            self.seen = np.concatenate((self.seen, np.zeros(len(lens), np.int64)))

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(where each text's ids start and end, ids)."""
        if len(self.codes) > HELD or len(self.flat) > HELD_IDS:
            self._shrink()
        starts, data = self.cuts(texts), np.ascontiguousarray(texts.bytes)
        bounds = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        names = pieces.dictionary.to_pylist()
        codes = np.fromiter(map(self.codes.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(codes < 0)
        fresh = [names[k] for k in new.tolist()]
        long = [p for p in fresh if len(p) > LONGEST]
        self._learn([p for p in fresh if len(p) <= LONGEST])
        kept, kept_ids = len(self.lens), len(self.flat)
        self._learn(long)
        codes[new] = np.fromiter(map(self.codes.__getitem__, fresh), np.int64, len(fresh))
        self.seen[codes] += 1
        codes = codes[pieces.indices.to_numpy()]
        size = self.lens[codes]
        total = np.cumsum(size)
        ids = self.flat[np.arange(int(total[-1]) if len(total) else 0) + np.repeat(self.starts[codes] - (total - size), size)]
        if long:
            for p in long:
                del self.codes[p]
            self.starts, self.lens, self.seen, self.flat = self.starts[:kept].copy(), self.lens[:kept].copy(), self.seen[:kept].copy(), self.flat[:kept_ids].copy()
        return np.concatenate(([0], total))[np.searchsorted(starts, texts.offsets)], ids


_HELD: dict[str, Pieces] = {}


def held(tokenizer: str) -> Pieces:
    """A worker's encoder, kept from task to task: one, as memory is bounded."""
    if tokenizer not in _HELD:
        _HELD.clear()
        _HELD[tokenizer] = Pieces(tokenizer)
    return _HELD[tokenizer]


def read_tokenizer(spark: SparkSession, path: str) -> str:
    """The tokenizer's JSON, by way of Spark's readers for paths in a store, else of the driver's files."""
    if "://" in path:
        return spark.read.text(path, wholetext=True).first()[0]
    with open(path, encoding="utf-8") as f:
        return f.read()


# files


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` in ascending ``doc_id`` order; the manifest (part, path, n_docs, n_ids, start), a row for each file."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(read_tokenizer(spark, tokenizer))
    highest = max(json.loads(sent.value)["model"]["vocab"].values(), default=0)
    kind = "<u2" if max(highest, end_id) < 1 << 16 else "<u4"
    where = f"{folder.rstrip('/')}/ids-{uuid.uuid4().hex}"

    def run(batches):
        part, pieces = TaskContext.get(), None
        path = f"{where}/part-{part.partitionId():06d}-{part.taskAttemptId()}"
        store = out = None
        ids, known, counts = [], [], []
        for batch in slices(batches, "text", SLICE):
            if out is None:
                store, at = opened(path)
                store.create_dir(os.path.dirname(at), recursive=True)
                out, pieces = store.open_output_stream(at + ".ids"), held(sent.value)
            bounds, found = pieces.encode(Texts(batch.column("text")))
            size = np.diff(bounds)
            flat = np.full(len(found) + len(size), end_id, kind)
            flat[np.arange(len(found)) + np.repeat(np.arange(len(size)), size)] = found
            out.write(flat.tobytes())
            ids.append(np.asarray(batch.column("doc_id").fill_null(0)))
            known.append(np.asarray(batch.column("doc_id").is_valid()))
            counts.append(size + 1)
        if out is not None:
            out.close()
            n, known, ids = np.concatenate(counts), np.concatenate(known), np.concatenate(ids)
            starts = np.concatenate(([0], np.cumsum(n)))
            ids = ids[known]
            first = int(ids[0]) if len(ids) else 0
            head = struct.pack(HEAD, MAGIC, int(kind[2]), 0, len(n), len(n) - len(ids), first)
            with store.open_output_stream(at + ".idx") as index:
                index.write(head + EliasFano.build(starts).dump() + EliasFano.build(ids - first).dump())
            yield pa.RecordBatch.from_pydict({"part": [part.partitionId()], "path": [path], "n_docs": [len(n)], "n_ids": [int(starts[-1])]})

    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text")).withColumns({"__h": F.xxhash64("text"), "__r": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), F.col("__h"), F.col("__r")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    made = materialize(dealt.mapInArrow(run, "part long, path string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return materialize(made.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "manifest")


class Reader:
    """One pair of files: which documents it holds, where each lies, and their ids."""

    def __init__(self, path: str):
        self.store, self.at = opened(path)
        with self.store.open_input_file(self.at + ".idx") as f:
            data = f.read()
        magic, self.width, _, self.n_docs, self.n_null, self.first = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError(f"{path}.idx is no index of ids")
        self.starts, end = EliasFano.load(data, struct.calcsize(HEAD))
        self.keys, _ = EliasFano.load(data, end)

    def ids(self, start: int, stop: int) -> np.ndarray:
        with self.store.open_input_file(self.at + ".ids") as f:
            return np.frombuffer(f.read_at((stop - start) * self.width, start * self.width), f"<u{self.width}")

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the file, its end id included."""
        return self.ids(*self.starts.select(np.array([k, k + 1])).tolist())

    def holder(self, position: int) -> int:
        """Which document of the file holds the id at ``position``."""
        return self.starts.rank(position) - 1

    def doc_ids(self, start: int, stop: int) -> pa.Array:
        """The document ids of the documents from ``start`` to ``stop``; null ones lie first."""
        k = np.arange(start, stop) - self.n_null
        found = np.zeros(len(k), np.int64)
        found[k >= 0] = self.keys.select(k[k >= 0]) + self.first
        return pa.array(found, mask=k < 0)

    def blocks(self) -> Iterator[tuple[int, int]]:
        """Ranges of documents that hold about READ_IDS ids, or one document."""
        at = 0
        for low in range(0, self.n_docs, 1 << 16):
            ends = self.starts.select(np.arange(low, min(self.n_docs, low + (1 << 16)) + 1))
            while at < low + len(ends) - 1:
                to = max(at + 1, low + int(np.searchsorted(ends, ends[at - low] + READ_IDS, "right")) - 1)
                yield at, to
                at = to


def read(manifest: DataFrame, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document, read back from the files of a manifest.

    ``ids_crc32`` is that of the ids as unsigned 32-bit little-endian numbers. Without ``ids`` that column is left out.
    """
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = Reader(path)
                for a, b in reader.blocks():
                    bounds = reader.starts.select(np.arange(a, b + 1))
                    flat = reader.ids(int(bounds[0]), int(bounds[-1])).astype("<u4")
                    inside = (bounds - bounds[0]).tolist()
                    sums = [zlib.crc32(flat[x:y]) for x, y in zip(inside, inside[1:], strict=False)]
                    columns = [reader.doc_ids(a, b), pa.array(start + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(sums, pa.int64())]
                    if ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.array(inside, np.int32)), pa.array(flat.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    files = manifest.select("path", "start")
    # one file is as large as a partition was: each goes to a task of its own; a number that is set isn't merged again
    return files.repartition(max(1, files.count())).mapInArrow(run, fields)
