"""Document fingerprints: SimHash over weighted term hashes, and a search within a Hamming radius.

Terms are the pairs of consecutive words (white-space words, A-Z lower-cased; a text of one word has that word as its
term). Each occurrence of a term votes on every bit of the fingerprint by the signed bits of the term's hash, so a term
weighs as often as it occurs. A bit is set if more votes are for it than against it.

``within_radius`` finds all pairs of fingerprints within a Hamming radius r by permuted block tables: the bits are cut
into b > r blocks; two fingerprints that differ in at most r bits agree on at least b - r blocks, so each choice of
b - r blocks makes a table keyed by those blocks, and every pair meets in one of them. Candidates are compared exactly.
Equal fingerprints are one class, which takes part once. By default (r = 3, b = 4) there are four tables, each keyed by
64 of the 256 bits.

Defined cases: null and empty texts, and those of white space only, have the fingerprint of all zeros; equal texts have
equal fingerprints; the likeness of two fingerprints is the cosine that their distance d stands for, cos(pi d / bits),
and 0 where that is negative; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atomloom.llm.common import SLICE_BYTES, U64, Texts, Words, map_texts, mix64, of_bytes, quoted, separators, slices, window_hashes, window_starts
from atomloom.session import materialize

BITS = 256
SEP = separators("space")
#: For a byte, a number with one of its bits in each of eight bytes: sums of up to 255 of them count votes bit by bit.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.uint8).view(U64)[:, 0]
STEP = 4096


def term_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each term occurrence, in the order of texts."""
    words = Words(texts, SEP, True)
    starts, doc = window_starts(words.bounds, 2)
    pairs = window_hashes(words.hash, 2)[starts] if len(starts) else np.zeros(0, U64)
    single = np.flatnonzero(words.counts == 1)
    if not len(single):
        return pairs, doc
    hashes, docs = np.concatenate((pairs, words.hash[words.bounds[single]])), np.concatenate((doc, single))
    order = np.argsort(docs, kind="stable")
    return hashes[order], docs[order]


def fingerprints(texts: Texts, bits: int = BITS) -> np.ndarray:
    """A row of bits / 8 bytes for each text."""
    hashes, doc = term_hashes(texts)
    n, width = len(texts), bits // 8
    votes = np.zeros((n, bits), np.int64)
    spread = (np.arange(1, bits // 64 + 1, dtype=U64) * U64(0xA0761D6478BD642F))[None, :]
    for at in range(0, len(hashes), STEP):
        h, d = hashes[at : at + STEP], doc[at : at + STEP]
        lanes = LANES[mix64(h[:, None] ^ spread).view(np.uint8)]
        new = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        ends = np.concatenate((new[1:], [len(d)]))
        # pieces of 255 terms of one text at most: a byte lane holds their sum
        cuts = np.unique(np.concatenate([new, *(np.arange(s, e, 255) for s, e in zip(new.tolist(), ends.tolist(), strict=True) if e - s > 255)]))
        sums = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(len(cuts), width * 8)
        np.add.at(votes, d[cuts], sums)
    total = np.bincount(doc, minlength=n)
    return np.packbits(2 * votes > total[:, None], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    distance = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return np.maximum(0.0, np.round(np.cos(np.pi * distance / (8 * a.shape[1])), 12))


def hexed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes().hex() for r in rows], pa.string())


def add_fingerprints(docs: DataFrame, text: str = "text", column: str = "fingerprint", bits: int = BITS) -> DataFrame:
    """``docs`` with the fingerprint as lower-case hex."""
    return map_texts(docs, text, [T.StructField(column, T.StringType())], lambda batch: [hexed(fingerprints(Texts(batch.column(text)), bits))])


NEXT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(text: str, following: str) -> str:
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _prints(texts: list[str]) -> np.ndarray:
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))))
    return fingerprints(of_bytes(np.frombuffer(b"".join(data), np.uint8), offsets))


def _compared(texts: list[str], following: list[str], own: np.ndarray, next_: np.ndarray) -> list[pa.Array]:
    """The columns of ``compare_with_next`` but the id."""
    edited = [_edited(a, b) for a, b in zip(texts, following, strict=True)]
    changed = _prints(edited)
    return [pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()), hexed(own), hexed(changed), pa.array(likeness(own, changed)), pa.array(likeness(own, next_))]


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """How fingerprints follow an edit: each text against itself edited, and against the next document.

    The next document follows by descending id (null last, ties by a hash of the text); after the last comes the first. The edited
    text has the last half of the code points (rounded down) replaced by the first as many, or all, of the next one's.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are dealt by ranges of the id and sorted in each; the last of a range meets the first of the next in a
    join of one row for each range. A range is worked through in slices of ``limit`` bytes of text, or one row.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "part long, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, head string, tail string"

    def batch_of(part, ids, columns, head, tail):
        return pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int64()), pa.array(ids, pa.int64()), *columns, pa.array(head, pa.string()), pa.array(tail, pa.string())], names=["part", *names, "head", "tail"])

    def run(batches):
        part, held, headed = TaskContext.get().partitionId(), None, False
        for batch in slices(batches, "text", limit):
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            own = _prints(texts)
            if held is not None:
                ids, texts, own = [held[0], *ids], [held[1], *texts], np.concatenate((held[2], own))
            held = ids[-1], texts[-1], own[-1:]
            if len(ids) > 1:
                # the head goes with the range's first row, in whichever slice that is written
                head, headed = [None if headed else texts[0]] + [None] * (len(ids) - 2), True
                yield batch_of(part, ids[:-1], _compared(texts[:-1], texts[1:], own[:-1], own[1:]), head, [None] * (len(ids) - 1))
        if held is not None:
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            yield batch_of(part, [held[0]], none, [None if headed else held[1]], [held[1]])

    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    # rows of one id, and copies among them, may be many: ranges may part them
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("__row")]
    dealt = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    done = materialize(dealt.mapInArrow(run, schema), "edited")
    # from here on one row for each range
    ends = done.where("tail is not null").select("part", "doc_id", "tail")
    heads = done.where("head is not null").select("part", "head")
    every = Window.partitionBy(F.lit(0))
    after = heads.select("part", F.coalesce(F.lead("part").over(every.orderBy("part")), F.min("part").over(every)).alias("next_part"))
    met = ends.join(after, "part").join(heads.select(F.col("part").alias("next_part"), "head"), "next_part").select("doc_id", "tail", "head")

    def finish(batches):
        for b in batches:
            texts, following = b.column("tail").to_pylist(), b.column("head").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_compared(texts, following, _prints(texts), _prints(following))], names=names)

    return done.where("tail is null").select(names).unionByName(met.mapInArrow(finish, NEXT))


def _words(fingerprint, bits: int):
    """The fingerprint as 64-bit numbers."""
    return [F.conv(F.substring(fingerprint, 16 * k + 1, 16), 16, -10).cast("long") for k in range(bits // 64)]


def _tables(radius: int, blocks: int, bits: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """(cuts between blocks in hex digits, the blocks of each table)."""
    if not 0 <= radius < blocks <= bits // 4:
        raise ValueError("there must be more blocks than the radius")
    return [round(bits // 4 * k / blocks) for k in range(blocks + 1)], list(combinations(range(blocks), blocks - radius))


def _met(index: DataFrame, queries: DataFrame, radius: int, blocks: int, column: str, bits: int) -> DataFrame:
    """(query_fingerprint, fingerprint, n, distance): each pair of classes within the radius once; n documents of the index."""
    cuts, tables = _tables(radius, blocks, bits)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        keys = [F.xxhash64(F.lit(t), *[F.substring(name, cuts[b] + 1, cuts[b + 1] - cuts[b]) for b in use]) for t, use in enumerate(tables)]
        words = [w.alias(f"{name[0]}{k}") for k, w in enumerate(_words(name, bits))]
        return df.select("*", *words).select("*", F.posexplode(F.array(*keys)).alias(f"{name}_table", "table_key"))

    known = [df.where(quoted(column).isNotNull()).select(quoted(column).alias(name)) for df, name in ((index, "fingerprint"), (queries, "query_fingerprint"))]
    own, asked = keyed(known[0].groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")), "fingerprint"), keyed(known[1].distinct(), "query_fingerprint")
    distance = sum(F.bit_count(F.col(f"q{k}").bitwiseXOR(F.col(f"f{k}"))).cast("long") for k in range(bits // 64))
    # a pair that several tables hold counts in the first of them
    agree = [F.substring("fingerprint", cuts[b] + 1, cuts[b + 1] - cuts[b]) == F.substring("query_fingerprint", cuts[b] + 1, cuts[b + 1] - cuts[b]) for b in range(blocks)]
    first = F.lit(-1)
    for t in reversed(range(len(tables))):
        first = F.when(reduce(lambda x, y: x & y, [agree[b] for b in tables[t]]), t).otherwise(first)
    pairs = own.join(asked, (own["table_key"] == asked["table_key"]) & (own["fingerprint_table"] == asked["query_fingerprint_table"]) & (distance <= radius) & (first == own["fingerprint_table"]))
    return pairs.select("query_fingerprint", "fingerprint", "n", distance.alias("distance"))


def within_radius(index: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 4, column: str = "fingerprint", bits: int = BITS) -> DataFrame:
    """(query_fingerprint, fingerprint, distance): distinct fingerprints of ``index`` within ``radius`` of one of ``queries``.

    Ids follow by joining both sides on their fingerprints (``members``); copies aren't expanded here.
    """
    return _met(index, queries, radius, blocks, column, bits).drop("n")


def count_within(index: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 4, column: str = "fingerprint", bits: int = BITS) -> DataFrame:
    """(fingerprint, n_within): for each distinct fingerprint of ``queries`` how many rows of ``index`` are within ``radius``.

    Pairs are compared inside the join and counted before they are shuffled.
    """
    met = _met(index, queries, radius, blocks, column, bits)
    return met.groupBy(F.col("query_fingerprint").alias("fingerprint")).agg(F.sum("n").alias("n_within"))


def members(fingerprinted: DataFrame, key: str = "doc_id", column: str = "fingerprint") -> DataFrame:
    """(fingerprint, doc_id): the documents of each class of equal fingerprints, one row each."""
    return fingerprinted.select(quoted(column).alias("fingerprint"), quoted(key).alias(key))
