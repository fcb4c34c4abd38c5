"""Benchmark decontamination: n-grams of test items are looked up in training documents.

Method: the distinct windows of the normalised test items become a hash set, which is broadcast; token windows of each
document are tested against it, hits are verified word by word, then spans or whole documents are removed. The set is
made of arrays (sorted hashes, where the window's words stand in the items, the items that hold it) of about eight bytes
for each byte of items. It is broadcast in blocks of items of about ``block_bytes`` text, or one item: for a larger test
collection each block has a pass of its own over the texts, which writes the spans found under a key of the text, and
the documents meet these findings in one join, so what is broadcast stays bounded and the corpus is not rewritten.

Words are runs of 0-9, a-z and non-ASCII characters after A-Z are lower-cased. A window has ``size`` words; an item of
fewer words is one window. Defined cases: null and empty texts have no words; items without words match nothing; a null
item_id is named by the empty string; repeated items count once by id; an empty table (of either side) gives no hits; a
result column replaces an input column of the same name.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atomloom.llm.common import SLICE_BYTES, U64, Texts, Words, map_texts, of_bytes, quoted, separators, slices, window_hashes, window_starts
from atomloom.session import materialize

BLOCK_BYTES = 16 << 20
SEP = separators("nonword")
#: Maps bytes to the normalised form: separators to a space, A-Z to a-z.
NORMAL = bytes(32 if SEP[b] else (b + 32 if 65 <= b <= 90 else b) for b in range(256))


def normal_words(text: bytes) -> list[bytes]:
    return [w for w in text.translate(NORMAL).split(b" ") if w]


class WindowSet:
    """Windows of test items by length: sorted hashes, the bytes of the window's words, and the items that hold it."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.names = sorted({item for item, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        found: dict[int, list] = {}
        texts, base, at = [], 0, 0
        while at < len(items):  # about SLICE_BYTES of items at a time
            own, owner, room = [], [], SLICE_BYTES
            while at < len(items) and (room > 0 or not own):
                own.append(b" ".join(normal_words(items[at][1])))
                owner.append(number[items[at][0]])
                room -= len(items[at][1]) + 1
                at += 1
            offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))))
            data = b"".join(own)
            words = Words(of_bytes(np.frombuffer(data, np.uint8), offsets), SEP, True)
            owners = np.array(owner, np.int32)
            for n in np.unique(np.minimum(words.counts, size)).tolist():
                if n:
                    starts, doc = window_starts(words.bounds, n)
                    if n < size:  # an item of fewer words is one window
                        whole = words.counts[doc] == n
                        starts, doc = starts[whole], doc[whole]
                    found.setdefault(n, []).append((window_hashes(words.hash, n)[starts], words.start[starts] + base, words.end[starts + n - 1] + base, owners[doc]))
            texts.append(data)
            base += len(data)
        self.text = b"".join(texts)
        self.lengths = {n: self._laid_out(*map(np.concatenate, zip(*parts, strict=True))) for n, parts in sorted(found.items())}

    def _laid_out(self, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray):
        """(hash, begin, end, owner offsets, owners, bits, shift): one entry for each distinct window, by hash."""
        order = np.lexsort((owner, hashes))
        hashes, begin, end, owner = hashes[order], begin[order], end[order], owner[order]
        new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        # windows of one hash have the same words, or else are entries of their own
        others, variant, named = np.flatnonzero(~new), np.zeros(len(hashes), np.int64), {}
        for i, j in zip(others.tolist(), first[others].tolist(), strict=True):
            words = self.text[begin[i] : end[i]]
            if words != self.text[begin[j] : end[j]]:
                variant[i] = named.setdefault(words, len(named) + 1)
        if named:
            order = np.lexsort((owner, variant, hashes))
            hashes, begin, end, owner, variant = hashes[order], begin[order], end[order], owner[order], variant[order]
            new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (variant[1:] != variant[:-1])))
        owns = new.copy()
        owns[1:] |= owner[1:] != owner[:-1]
        entry = np.flatnonzero(new)
        owner_at = np.concatenate((np.cumsum(owns)[entry] - 1, [int(owns.sum())]))
        bits = max(16, (len(entry) * 32).bit_length())
        table = np.zeros(1 << (bits - 3), np.uint8)
        cell = (hashes[entry] >> U64(64 - bits)).astype(np.int64)
        np.bitwise_or.at(table, cell >> 3, (1 << (cell & 7)).astype(np.uint8))
        return hashes[entry], begin[entry], end[entry], owner_at, owner[owns], table, 64 - bits

    def find(self, texts: Texts) -> tuple[np.ndarray, Words, list[list[str]]]:
        """For each word whether it is in a window's occurrence, the words, and for each text the items found, sorted."""
        words = Words(texts, SEP, True)
        hit, items = np.zeros(len(words.start) + 1, np.int32), [set() for _ in range(len(texts))]
        raw = texts.bytes
        for n, (hashes, begin, end, owner_at, owners, table, shift) in self.lengths.items():
            starts, doc = window_starts(words.bounds, n)
            h = window_hashes(words.hash, n)[starts] if len(starts) else np.zeros(0, U64)
            cell = (h >> U64(shift)).astype(np.int64)
            near = np.flatnonzero(table[cell >> 3] >> (cell & 7).astype(np.uint8) & 1)
            at = np.minimum(np.searchsorted(hashes, h[near]), len(hashes) - 1)
            near, at = near[hashes[at] == h[near]], at[hashes[at] == h[near]]
            seen: dict[int, set[int]] = {}
            for k, i in zip(near.tolist(), at.tolist(), strict=True):
                s = int(starts[k])
                own = b" ".join(normal_words(raw[words.start[s] : words.end[s + n - 1]].tobytes()))
                while i < len(hashes) and hashes[i] == h[k]:
                    if own == self.text[begin[i] : end[i]]:
                        hit[s] += 1
                        hit[s + n] -= 1
                        seen.setdefault(int(doc[k]), set()).add(i)
                    i += 1
            for k, entries in seen.items():
                for i in entries:
                    items[k].update(owners[owner_at[i] : owner_at[i + 1]].tolist())
        return np.cumsum(hit)[:-1] > 0, words, [[self.names[i] for i in sorted(x)] for x in items]


def _runs(hit: np.ndarray) -> np.ndarray:
    """(start, end) of the runs of true."""
    step = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.stack((np.flatnonzero(step == 1), np.flatnonzero(step == -1)), axis=1)


def _blocks(benchmark: DataFrame, text: str, item: str, limit: int) -> list[DataFrame]:
    """The items in blocks of about ``limit`` bytes of text."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length(quoted(text))), F.lit(0))).first()[0]
    n = max(1, -(-total // limit))
    rows = benchmark.select(F.coalesce(quoted(item).cast("string"), F.lit("")).alias("item"), quoted(text).alias("text")).where("text is not null")
    return [rows] if n == 1 else [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(2 * n)) == k) for k in range(2 * n)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", size: int = 10, block_bytes: int = BLOCK_BYTES, clean: bool = False, prefix: str = "") -> DataFrame:
    """``docs`` with n_words, n_hit (long), items (array of the item ids as strings, sorted), contaminated.

    With ``clean`` also clean_text: the text without the words that were hit (each run of them goes from its first byte
    to its last; what stands between runs stays). ``prefix`` goes in front of the names.
    """
    fields = [T.StructField(prefix + "n_words", T.LongType()), T.StructField(prefix + "n_hit", T.LongType()), T.StructField(prefix + "items", T.ArrayType(T.StringType())), T.StructField(prefix + "contaminated", T.BooleanType())]
    if clean:
        fields.append(T.StructField(prefix + "clean_text", T.StringType()))
    spark, blocks = docs.sparkSession, _blocks(benchmark, item_text, item_id, block_bytes)

    def columns(texts: Texts, words: Words, hit: np.ndarray, items: list[list[str]]) -> list[pa.Array]:
        total = np.concatenate(([0], np.cumsum(hit)))
        n_hit = total[words.bounds[1:]] - total[words.bounds[:-1]]
        cols = [pa.array(words.counts.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array(items, pa.list_(pa.string())), pa.array(n_hit > 0)]
        return cols + [_cleaned(texts, words, hit, n_hit)] * clean

    def sent(block: DataFrame):
        return spark.sparkContext.broadcast(WindowSet([(r["item"], r["text"].encode()) for r in block.collect()], size))

    if len(blocks) == 1:
        known = sent(blocks[0])

        def mark(batch):
            texts = Texts(batch.column(text))
            hit, words, items = known.value.find(texts)
            return columns(texts, words, hit, items)

        return map_texts(docs, text, fields, mark)

    rows, passes = docs.select(F.sha2(quoted(text), 256).alias("key"), quoted(text).alias("text")).where("key is not null"), []
    for block in blocks:
        known = sent(block)

        def scan(batches, known=known):
            for batch in slices(batches, "text"):
                hit, words, items = known.value.find(Texts(batch.column("text")))
                some = [k for k, x in enumerate(items) if x]
                spans = [_runs(hit[words.bounds[k] : words.bounds[k + 1]]).astype(np.int64).tobytes() for k in some]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(some, pa.int64())), pa.array(spans, pa.binary()), pa.array([items[k] for k in some], pa.list_(pa.string()))], names=["key", "spans", "items"])

        one = rows.mapInArrow(scan, "key string, spans binary, items array<string>").groupBy("key").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))
        passes.append(materialize(one, "contamination"))
        known.destroy()
    found = reduce(DataFrame.unionByName, passes).groupBy("key").agg(F.collect_list("spans").alias("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__found"))
    met = docs.withColumn("__key", F.sha2(quoted(text), 256)).join(found.withColumnRenamed("key", "__key"), "__key", "left")

    def merge(batch):
        texts = Texts(batch.column(text))
        words = Words(texts, SEP, True)
        hit = np.zeros(len(words.start), bool)
        for first, lists in zip(words.bounds[:-1].tolist(), batch.column("__spans").to_pylist(), strict=True):
            for x in lists or []:
                for a, b in np.frombuffer(x, np.int64).reshape(-1, 2).tolist():
                    hit[first + a : first + b] = True
        return columns(texts, words, hit, [x or [] for x in batch.column("__found").to_pylist()])

    return map_texts(met, text, fields, merge, keep=docs.columns, reads=("__spans", "__found"))


def _cleaned(texts: Texts, words: Words, hit: np.ndarray, n_hit: np.ndarray) -> pa.Array:
    out, raw = [], texts.bytes
    for k in range(len(texts)):
        a, b = int(texts.offsets[k]), int(texts.offsets[k + 1])
        if not n_hit[k]:
            out.append(raw[a:b].tobytes())
            continue
        i, j = words.bounds[k], words.bounds[k + 1]
        runs = _runs(hit[i:j])
        parts = []
        for s, e in zip(words.start[i + runs[:, 0]], words.end[i + runs[:, 1] - 1], strict=True):
            parts.append(raw[a:s].tobytes())
            a = int(e)
        out.append(b"".join([*parts, raw[a:b].tobytes()]))
    return pa.array(out, pa.binary()).cast(pa.string())


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with the words that were hit cut out."""
    found = find_contamination(docs, benchmark, text, clean=remove == "spans", prefix="__", **options)
    if remove == "spans":
        found = found.withColumn(text, F.when(F.col("__contaminated"), F.col("__clean_text")).otherwise(quoted(text)))
    else:
        found = found.where(~F.col("__contaminated"))
    return found.select(*[quoted(c) for c in docs.columns])
