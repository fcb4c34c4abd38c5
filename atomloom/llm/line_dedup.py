"""Line dedup: lines found in many documents are dropped everywhere.

Method: sharded minimal perfect hash. The documents are packed into units (some 32 MB of text, one row each), and each
unit has the distinct 128-bit hashes of its line keys with the number of its documents that hold them. A unit sends
every hash to the shard it belongs to, packed. A shard lays a minimal perfect hash over all its distinct line hashes,
with an array of fingerprints and one of document counts (``LineIndex``); then the units' lists probe the arrays, and
those whose count reaches ``min_docs`` go back to the unit. Lines are never joined and no array is broadcast.

A line that every document holds costs one entry a unit. Shards have about ``shard_lines`` entries, so their number
follows the input while their memory doesn't; a unit's memory follows ``unit_bytes``, or one document.

Defined cases: a null or empty text is one empty line, whose key is empty and never dropped (``min_chars`` is 1 at
least); each row is one document, even if doc_id repeats; a line twice in a document counts once; an empty table gives
an empty table; a result column replaces an input column of the same name. A key is told apart by 128 bits of hash;
keys that share the first 64 have entries of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atomloom.llm.blocks import rows_of
from atomloom.llm.common import U64, PerfectHash, quoted, slices
from atomloom.session import materialize

SHARD_LINES, UNIT_BYTES = 1 << 20, 32 << 20


def line_key(line: bytes) -> bytes:
    """ASCII white space off both ends, A-Z lower-cased (both are what ``bytes`` methods do)."""
    return line.strip().lower()


def _encoded(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars < 2 or len(key.decode("utf-8", "replace")) >= min_chars)


def distinct_keys(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (h1, h2) in order, each once, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
    return keys[first], np.add.reduceat(counts, first)


class LineIndex:
    """Document counts of distinct 128-bit line hashes, behind a minimal perfect hash of their first 64 bits."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        """``keys``: rows (h1, h2) in order, each once."""
        first = np.concatenate(([True], keys[1:, 0] != keys[:-1, 0])) if len(keys) else np.zeros(0, bool)
        self.extra = {tuple(k): int(n) for k, n in zip(keys[~first].tolist(), counts[~first].tolist(), strict=True)}
        keys, counts = keys[first], counts[first]
        self.mph = PerfectHash.build(keys[:, 0].view(U64))
        self.prints, self.counts = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.uint32)
        at = self.mph.index(np.ascontiguousarray(keys[:, 0]).view(U64))
        self.prints[at], self.counts[at] = keys[:, 1], np.minimum(counts, 2**32 - 1)

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key; 0 for keys that aren't held."""
        at, out = self.mph.index(np.ascontiguousarray(keys[:, 0]).view(U64)), np.zeros(len(keys), np.int64)
        good = np.flatnonzero((at >= 0) & (at < len(self.prints)))
        good = good[self.prints[at[good]] == keys[good, 1]]
        out[good] = self.counts[at[good]]
        if self.extra:
            for k in np.flatnonzero(out == 0).tolist():
                out[k] = self.extra.get((int(keys[k, 0]), int(keys[k, 1])), 0)
        return out


UNITS = "unit long, blocks array<binary>, n_keys long, keys binary, counts binary"


def pack_units(docs: DataFrame, text: str = "text", min_chars: int = 1, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """The documents, all columns, as units with their distinct line hashes; written to the shared folder."""

    def run(batches):
        part, n, room = TaskContext.get().partitionId(), 0, unit_bytes
        blocks: list[bytes] = []
        parts: list[np.ndarray] = []

        def unit():
            found = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
            keys, counts = distinct_keys(found, np.ones(len(found), np.int64))
            row = [(part << 32) | n, list(blocks), len(keys), keys.tobytes(), np.minimum(counts, 2**32 - 1).astype(np.uint32).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.list_(pa.binary()), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=[x.split()[0] for x in UNITS.split(", ")])

        for batch in slices(batches, text):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(batch)
            blocks.append(sink.getvalue().to_pybytes())
            digests = []
            for body in _encoded(batch.column(text)):
                room -= len(body) + 1
                digests += [xxhash.xxh3_128_digest(k) for k in {line_key(x) for x in body.split(b"\n")} if _long_enough(k, min_chars)]
            parts.append(np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2))
            if room <= 0:
                yield unit()
                n, room, blocks, parts = n + 1, unit_bytes, [], []
        if blocks:
            yield unit()

    return materialize(docs.select(*[quoted(c).alias(c) for c in docs.columns]).mapInArrow(run, UNITS), "line-units")


def _lists(units: DataFrame, shards: int) -> DataFrame:
    """(shard, unit, keys, counts): what each unit sends to each shard."""

    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                keys, counts = np.frombuffer(row["keys"], np.int64).reshape(-1, 2), np.frombuffer(row["counts"], np.uint32)
                home = keys[:, 0].view(U64) % U64(shards) if len(keys) else np.zeros(0, U64)
                order = np.argsort(home, kind="stable")
                names, first = np.unique(home[order], return_index=True)
                out = [(int(k), row["unit"], keys[own].tobytes(), counts[own].tobytes()) for k, own in zip(names, np.split(order, first[1:]), strict=True)] if len(keys) else []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["shard", "unit", "keys", "counts"])

    return units.select("unit", "keys", "counts").mapInArrow(run, "shard long, unit long, keys binary, counts binary")


def _answer(min_docs: int):
    def run(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()]).astype(np.int64)
        index = LineIndex(*distinct_keys(np.concatenate(lists), counts))
        found = [x[index.probe(x) >= min_docs] for x in lists]
        some = [k for k, x in enumerate(found) if len(x)]
        return pa.table({"unit": table.column("unit").take(pa.array(some, pa.int64())), "found": pa.array([found[k].tobytes() for k in some], pa.binary())})

    return run


def drop_common_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, unit_bytes: int = UNIT_BYTES, shard_lines: int = SHARD_LINES, prefix: str = "") -> DataFrame:
    """``docs`` with the lines of keys found in ``min_docs`` documents or more taken out of ``text``.

    Adds n_lines (before) and n_dropped (long), named with ``prefix``. What is left is joined by newlines.
    """
    units = pack_units(docs, text, min_chars, unit_bytes)
    shards = max(1, -(-units.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0] // shard_lines))
    answers = _lists(units, shards).groupBy("shard").applyInArrow(_answer(min_docs), "unit long, found binary")
    common = materialize(answers.groupBy("unit").agg(F.collect_list("found").alias("found")), "common-lines")
    added = [T.StructField(prefix + "n_lines", T.LongType()), T.StructField(prefix + "n_dropped", T.LongType())]
    kept = [c for c in docs.columns if c.lower() not in {f.name.lower() for f in added}]
    schema = T.StructType([docs.schema[c] for c in kept] + added)

    def finish(batches):
        for batch in batches:
            for row in rows_of(batch):
                found = b"".join(row["found"] or [])
                gone = {found[k : k + 16] for k in range(0, len(found), 16)}
                for block in row["blocks"]:
                    own = pa.ipc.open_stream(block).read_next_batch()
                    texts, lines, dropped = [], [], []
                    for body in _encoded(own.column(text)):
                        parts = body.split(b"\n")
                        left = [x for x in parts if xxhash.xxh3_128_digest(line_key(x)) not in gone] if gone else parts
                        texts.append(body if len(left) == len(parts) else b"\n".join(left))
                        lines.append(len(parts))
                        dropped.append(len(parts) - len(left))
                    new = {text: pa.array(texts, pa.binary()).cast(pa.string())}
                    arrays = [new.get(c, own.column(c)) for c in kept] + [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    # answers grow with the units, so they are never broadcast
    return units.select("unit", "blocks").hint("merge").join(common, "unit", "left").mapInArrow(finish, schema)
