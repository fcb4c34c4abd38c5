"""MinHash near-dedup with odd sketches.

Documents whose sets of word shingles have a Jaccard similarity of ``percent`` / 100 or more are linked; linked documents
form groups.

1. Signatures. Each set gives bands * rows MinHash values. Bands of ``rows`` values make bucket keys; all values are
   folded into an odd sketch: each flips one bit of SKETCH_BITS. Two sketches' XOR has few bits set if few samples differ,
   which tells high similarities precisely. Equal sets are one class from here on, by the smallest id.
2. Candidates. Buckets are counted first. A bucket of two is a pair; for one of up to ``bucket_rows`` documents a worker
   compares sketches and keeps a spanning forest of the likely pairs; a larger one is tied to its first document without
   a comparison, which only makes clusters larger and loses nothing. No bucket's pairs are written out.
3. Clusters are the connected components of these ties. No link leaves a cluster.
4. Links. Each cluster's full sets meet in groups of bounded size (shingles and rows): a small cluster in one, a large one
   as pairs of its blocks, so that any two of its documents meet. A search from document to document takes those not yet reached, compares
   sketches, then confirms 100 * |intersection| >= percent * |union| on the full sets.
5. Groups are the connected components of confirmed links, named by their smallest id.

``Plan`` derives bands, rows and the sketches' limit from ``percent``: a pair of just that similarity shares no band with
probability MISSED (1.3e-7; at 80 by 40 bands of 5) and is refused by its sketches with about 2e-8 (5.5 deviations of
the number of bits), 1.5e-7 together, and rarer the more alike it is. Sets hold 64-bit hashes of shingles.

Defined cases: words are white-space words, A-Z lower-cased; a text of fewer words than a shingle has one shingle, all of
it; texts without words and null texts have the empty set, which is linked with nothing; rows with a null id are linked
with nothing and have a null group; rows that share an id are one document; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomloom.llm.common import U64, Texts, Words, mix64, quoted, separators, slices, window_hashes, window_starts
from atomloom.session import materialize

SKETCH_BITS, MISSED, SAMPLES = 512, 1.3e-7, 240
BUCKET_ROWS, CLUSTER_SHINGLES, CLUSTER_ROWS = 4096, 2 << 20, 8192
SEP = separators("space")


class Plan:
    """What follows from the similarity in per cent: bands, their rows, the most bits that likely sketches differ in."""

    def __init__(self, percent: int):
        if not 1 <= percent <= 100:
            raise ValueError("percent is 1 to 100")
        self.percent, alike = percent, percent / 100
        needed = {r: math.ceil(math.log(MISSED) / math.log1p(-(alike**r))) if alike < 1 else 1 for r in range(8, 0, -1)}
        # the longest bands that need few samples; at low similarities single values, however many
        self.rows = next((r for r, n in needed.items() if n * r <= SAMPLES), 1)
        self.bands = needed[self.rows]
        self.count = self.bands * self.rows
        seeds = mix64(np.arange(1, 2 * self.count + 1, dtype=U64))
        self.multiply, self.add = (seeds[: self.count] >> U64(32)).astype(np.uint32) | np.uint32(1), (seeds[self.count :] >> U64(32)).astype(np.uint32)
        # each sample that differs flips two bits at random places
        differ, m = self.count * (1 - alike), SKETCH_BITS
        odd = math.exp(-4 * differ / m)
        spread = (2 * odd) ** 2 * differ * alike + m / 4 * (1 - odd * odd)
        self.most_bits = math.ceil(m / 2 * (1 - odd) + 5.5 * math.sqrt(spread))

    def can_be_alike(self) -> str:
        """SQL: sets of n shingles are at best n / (n + 1) similar to another."""
        return f"100 * n_shingles >= {self.percent} * (n_shingles + 1)"


def shingle_sets(texts: Texts, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the sorted distinct shingles of each text."""
    words = Words(texts, SEP, True)
    starts, doc = window_starts(words.bounds, shingle)
    hashes = window_hashes(words.hash, shingle)[starts] if len(starts) else np.zeros(0, U64)
    for n in range(1, shingle):  # texts of fewer words
        short = np.flatnonzero(words.counts == n)
        if len(short):
            doc, hashes = np.concatenate((doc, short)), np.concatenate((hashes, window_hashes(words.hash, n)[words.bounds[short]]))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return np.searchsorted(doc[new], np.arange(len(texts) + 1)), hashes[new]


def min_hashes(hashes: np.ndarray, plan: Plan) -> np.ndarray:
    out, h = np.full(plan.count, 0xFFFFFFFF, np.uint32), (hashes >> U64(32)).astype(np.uint32)
    for at in range(0, len(h), 1024):
        part = np.multiply.outer(h[at : at + 1024], plan.multiply)
        part += plan.add
        np.minimum(out, part.min(axis=0), out=out)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """For rows of MinHash values, SKETCH_BITS parities as 64-bit numbers."""
    at = (mix64(samples.astype(U64) + (np.arange(samples.shape[1], dtype=U64) << U64(32))) % U64(SKETCH_BITS)).astype(np.int64)
    at += np.arange(len(samples))[:, None] * SKETCH_BITS
    odd = np.bincount(at.ravel(), minlength=len(samples) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(samples), -1), axis=1, bitorder="little").view(np.int64)


def band_keys(samples: np.ndarray, plan: Plan) -> np.ndarray:
    m = samples.reshape(len(samples), plan.bands, plan.rows).astype(U64)
    key = np.broadcast_to(mix64(np.arange(1, plan.bands + 1, dtype=U64)), m.shape[:2])
    for k in range(plan.rows):
        key = mix64(key ^ (m[:, :, k] + U64(1)) * U64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def _lists(rows: np.ndarray, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows).ravel()))


def signatures(docs: DataFrame, shingle: int, plan: Plan, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, h1, h2, bands, sketch); h1 and h2 are the hash of the whole set."""

    def run(batches):
        for batch in slices(batches, "text"):
            off, hashes = shingle_sets(Texts(batch.column("text")), shingle)
            size, raw = np.diff(off), hashes.tobytes()
            samples = np.stack([min_hashes(hashes[a:b], plan) for a, b in zip(off, off[1:], strict=False)])
            print_ = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(off.tolist(), off[1:].tolist(), strict=False)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(print_[:, 0]), pa.array(print_[:, 1]), _lists(band_keys(samples, plan), plan.bands), _lists(odd_sketches(samples), SKETCH_BITS // 64)], names=["doc_id", "n_shingles", "h1", "h2", "bands", "sketch"])

    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch array<long>")


def _reach(ids: np.ndarray, linked) -> list[tuple[int, int]]:
    """(id, root) for the ids beside their component's smallest. ``linked(x, rest)``: which of ``rest`` x is linked to."""
    order = np.argsort(ids, kind="stable")
    open_, out = order, []
    while len(open_) > 1:
        root, queue = open_[0], [open_[0]]
        open_ = open_[1:]
        while queue and len(open_):
            hit = linked(queue.pop(), open_)
            if hit.any():
                queue += open_[hit].tolist()
                out += [(int(ids[y]), int(ids[root])) for y in open_[hit]]
                open_ = open_[~hit]
    return out


def _sketch_matrix(column) -> np.ndarray:
    flat = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten())
    return flat.reshape(-1, SKETCH_BITS // 64).view(U64)  # of signed numbers, bit counts would be those of their amounts


def _likely(sketches: np.ndarray, x: int, rest: np.ndarray, most_bits: int) -> np.ndarray:
    return np.bitwise_count(sketches[rest] ^ sketches[x]).sum(axis=1, dtype=np.int64) <= most_bits


def _bucket_forest(most_bits: int):
    def run(table: pa.Table) -> pa.Table:
        ids, sketches = np.asarray(table.column("doc_id")), _sketch_matrix(table.column("sketch"))
        found = _reach(ids, lambda x, rest: _likely(sketches, x, rest, most_bits))
        return pa.table({"a": pa.array([r for _, r in found], pa.int64()), "b": pa.array([y for y, _ in found], pa.int64())})

    return run


def candidate_ties(classes: DataFrame, plan: Plan, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b) pairs of ids, a < b, whose connected components hold every pair that shares a bucket and is likely."""
    rows = classes.where(plan.can_be_alike()).select("doc_id", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.expr("bit_xor(xxhash64(doc_id))").alias("x")).where("n > 1 and a < b")
    # buckets of the same documents, as near copies make, are one: alike in number, least, largest and 64 bits of hash
    buckets = materialize(buckets.groupBy("n", "a", "b", "x").agg(F.min("key").alias("key")), "buckets")
    sketches = classes.select("doc_id", "sketch")
    two = buckets.where("n = 2").select("a", "b").distinct()
    bits = F.aggregate(F.zip_with("p", "q", lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("int")), F.lit(0), lambda t, v: t + v)
    two = two.join(sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("p")), "a").join(sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("q")), "b").where(bits <= plan.most_bits).select("a", "b")
    more = rows.join(buckets.where("n > 2").select("key", "n", F.col("a").alias("hub")), "key")
    some = more.where(F.col("n") <= bucket_rows).select("key", "doc_id").join(sketches, "doc_id").groupBy("key").applyInArrow(_bucket_forest(plan.most_bits), "a long, b long")
    many = more.where(F.col("n") > bucket_rows).where("doc_id > hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))
    return two.unionByName(some).unionByName(many).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(doc_id, component): for each id in ``edges`` (a, b) the smallest id it is connected with.

    Alternates large-star and small-star steps, each of which keeps connectivity and brings every id closer to its
    smallest; the number of rounds grows with the logarithm of the graph. Each round is written to the shared folder.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = materialize(after, "edges")
        total = [F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")]
        if after.agg(*total).first() == edges.agg(*total).first():
            return after.select(F.col("u").alias("doc_id"), F.col("v").alias("component")).unionByName(after.select(F.col("v").alias("doc_id"), F.col("v").alias("component")).distinct())
        edges = after


def _confirm(plan: Plan):
    percent = plan.percent

    def run(table: pa.Table) -> pa.Table:
        ids, sketches = np.asarray(table.column("doc_id")), _sketch_matrix(table.column("sketch"))
        sets = [np.frombuffer(x, U64) for x in table.column("set").to_pylist()]
        size = np.array([len(s) for s in sets], np.int64)

        def linked(x: int, rest: np.ndarray) -> np.ndarray:
            hit, n = np.zeros(len(rest), bool), size[x]
            near = np.flatnonzero((100 * np.minimum(size[rest], n) >= percent * np.maximum(size[rest], n)) & _likely(sketches, x, rest, plan.most_bits))
            for at in range(0, len(near), 256):
                part = near[at : at + 256]
                joined = np.concatenate([sets[y] for y in rest[part]])
                found = sets[x][np.minimum(np.searchsorted(sets[x], joined), n - 1)] == joined
                both = np.add.reduceat(found.astype(np.int64), np.concatenate(([0], np.cumsum(size[rest[part]])[:-1])))
                hit[part] = 100 * both >= percent * (n + size[rest[part]] - both)
            return hit

        found = _reach(ids, linked)
        return pa.table({"a": pa.array([r for _, r in found], pa.int64()), "b": pa.array([y for y, _ in found], pa.int64())})

    return run


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS, cluster_shingles: int = CLUSTER_SHINGLES, cluster_rows: int = CLUSTER_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): each row's group, by its smallest id; kept is that id itself."""
    plan, known = Plan(percent), docs.where(quoted(doc_id).isNotNull())
    marks = materialize(signatures(docs, shingle, plan, doc_id, text), "signatures")
    # one class for each distinct set; classes of one document need no join
    classes = marks.where("doc_id is not null and n_shingles > 0").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    copies = materialize(classes.where("n > 1"), "copies")
    rows = marks.join(copies.select("h1", "h2", "first"), ["h1", "h2"], "left").withColumn("first", F.coalesce("first", "doc_id"))
    own = rows.where("doc_id = first and n_shingles > 0")
    own = materialize(own.select("doc_id", "n_shingles", "bands", "sketch"), "classes")

    clusters = connected_components(candidate_ties(own, plan, bucket_rows))
    clustered = materialize(clusters.join(own.select("doc_id", "n_shingles", "sketch"), "doc_id"), "clusters")
    # by how much a cluster is over what one task may hold: shingles for its memory, rows for its time
    size = F.greatest(F.sum("n_shingles") / cluster_shingles, F.count(F.lit(1)) / cluster_rows)
    large = clustered.groupBy("component").agg(size.alias("size")).where("size > 1").select("component", F.ceil(F.col("size") * 2).cast("int").alias("blocks"))
    dealt = clustered.join(large, "component", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"), F.lit(0)))
    texts = known.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))

    def with_sets(batches):
        for batch in slices(batches, "text"):
            off, hashes = shingle_sets(Texts(batch.column("text")), shingle)
            raw = hashes.tobytes()
            sets = pa.array([raw[8 * a : 8 * b] for a, b in zip(off.tolist(), off[1:].tolist(), strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "component", "blocks", "block", "sketch")), sets], names=["doc_id", "component", "blocks", "block", "sketch", "set"])

    full = texts.join(dealt.select("doc_id", "component", "blocks", "block", "sketch"), "doc_id").mapInArrow(with_sets, "doc_id long, component long, blocks int, block int, sketch array<long>, set binary")
    # a large cluster's blocks meet two by two: (i, j) for each other block
    meets = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.expr("filter(sequence(0, blocks - 1), k -> k <> block)"), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    )
    met = full.withColumn("meet", F.explode(meets)).select("component", "meet.i", "meet.j", "doc_id", "sketch", "set")
    links = met.groupBy("component", "i", "j").applyInArrow(_confirm(plan), "a long, b long")
    groups = connected_components(links)
    named = rows.select("doc_id", "n_shingles", "first").join(groups.select(F.col("doc_id").alias("first"), "component"), "first", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "first")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def drop_near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group, that of the smallest id."""
    gone = near_groups(docs, shingle, percent, doc_id, text).where(~F.col("kept")).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, quoted(doc_id) == F.col("__gone"), "left_anti")
