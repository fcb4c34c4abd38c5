"""Documents packed into blocks, and questions that blocks put to hash shards.

A block is one row that holds some documents (ids, offsets, compressed text). Work over all windows or shingles of a
corpus goes in rounds: each block sends to each hash shard one packed list (sorted, distinct), the shard answers with one
bit for each entry, and the block reads the answers. A key that a third of all rows hold costs one entry a block, not
one a row, and no shard gets more of it than any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomloom.llm.common import Texts, of_bytes, quoted, slices
from atomloom.session import materialize

BLOCK_BYTES = 2 << 20
BLOCKS = "block long, n_docs long, n_bytes long, ids binary, known binary, offsets binary, body binary"


class Block:
    """The documents of a block row: ids (null ones count as last), which ids are known, texts."""

    def __init__(self, row: dict):
        self.block, n = row["block"], row["n_docs"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.known = np.unpackbits(np.frombuffer(row["known"], np.uint8), count=n).astype(bool)
        body = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(1, row["n_bytes"]))
        self.texts: Texts = of_bytes(np.frombuffer(body, np.uint8), np.frombuffer(row["offsets"], np.int64))

    def id_array(self) -> pa.Array:
        return pa.array(self.ids, mask=~self.known)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents as blocks, written to the shared folder: later passes see the same blocks even after a loss."""

    def run(batches):
        zip_, n = zstandard.ZstdCompressor(level=3), 0
        part = TaskContext.get().partitionId()
        for batch in slices(batches, text, block_bytes):
            texts, ids = Texts(batch.column(text)), batch.column(doc_id)
            known = np.asarray(ids.is_valid())
            packed = np.asarray(ids.fill_null(np.iinfo(np.int64).max))
            row = [(part << 32) | n, len(texts), len(texts.bytes), packed.tobytes(), np.packbits(known).tobytes(), texts.offsets.astype(np.int64).tobytes(), zip_.compress(texts.bytes.tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=[x.split()[0] for x in BLOCKS.split(", ")])
            n += 1

    rows = docs.select(quoted(doc_id).cast("long").alias(doc_id), quoted(text).alias(text))
    return materialize(rows.mapInArrow(run, BLOCKS), "blocks")


def rows_of(batch: pa.RecordBatch):
    """The rows of a batch one by one, so that only one is held as Python objects."""
    names = batch.schema.names
    for k in range(batch.num_rows):
        yield {n: batch.column(i)[k].as_py() for i, n in enumerate(names)}


def answers_by_block(answers: DataFrame, name: str) -> DataFrame:
    """(block, ``name``): the answers of all shards to a block, in the order of shards."""
    return answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("shard", "bits"))).alias(name))


def joined_bits(parts: list[dict] | None, sizes: np.ndarray) -> np.ndarray:
    """One flag for each entry that the block sent; ``sizes``: entries by shard."""
    out, ends = np.zeros(int(sizes.sum()), bool), np.cumsum(sizes)
    for x in parts or []:
        k = x["shard"]
        out[ends[k] - sizes[k] : ends[k]] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=int(sizes[k])).astype(bool)
    return out


def delta16(sorted_values: np.ndarray) -> bytes:
    """Sorted distinct numbers below 2**27 or so as 16-bit gaps; 65535 stands for a gap that goes on."""
    gaps = np.diff(sorted_values.astype(np.int64), prepend=0)
    more = gaps // 65535
    out = np.full(len(gaps) + int(more.sum()), 65535, np.uint16)
    out[np.cumsum(more + 1) - 1] = gaps % 65535
    return out.tobytes()


def undelta16(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint16).astype(np.int64)
    return np.cumsum(gaps)[gaps != 65535]
