"""Vector code compression: product codes over integer codebooks.

Method: components become integers, vectors are cut into equal parts, and each part gets the index of its nearest
codebook entry. Distances are screened by a float32 matrix product; each carries an interval that holds the exact value
whatever the order of rounding. Every entry whose interval overlaps the best one is computed again in int64, and equal
distances go to the lower index. Sums and counts of a round are added up in the tasks, then by (part, entry); only the
codebooks (parts x entries x width integers) reach the driver and are broadcast.

Defined cases: vectors that are null, hold null or non-finite components or ones of over ``largest(size)`` in size (their
squares would leave 64 bits), or have another length than the vector of the least id, have no code and are dropped;
lengths that the parts don't divide count as another length. A null id is encoded, but starts no codebook entry; of rows
with one id the least vector does. With fewer ids than entries the codebooks are smaller; without vectors they are empty.
Labels may be null; null is a label of its own. A result column replaces an input column of the same name.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atomloom.llm.common import quoted
from atomloom.session import materialize

#: Rows that are compared with a codebook at once; the unit roundoff of float32; into how many a label's rows are dealt.
ROWS, ROUNDOFF, SALTS = 8192, 2.0**-24, 32


def largest(size: int) -> int:
    """The greatest component with which squared distances of ``size`` components stay below 2**62."""
    return math.isqrt((1 << 60) // max(1, size))


def quantised(rows: DataFrame, vector: str = "embedding", scale: int = 256, parts: int = 16) -> DataFrame:
    """The rows with a usable vector, and ``__v``: its components as integers, floor(scale * x)."""
    v = quoted(vector)
    fits = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) * scale < F.lit(float(largest(1)))))
    usable = rows.where(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & fits)
    out = usable.withColumn("__v", F.transform(v, lambda x: F.floor(x.cast("double") * scale).try_cast("int")))
    bound = F.floor(F.sqrt(F.lit(float(1 << 60)) / F.greatest(F.size("__v"), F.lit(1))))
    return out.where((F.array_max("__v") < bound) & (F.array_min("__v") > -bound))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Integer vectors of one length as an int64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest of ``entries`` to each row of ``x``, both int64; ties to the lower index.

    score = |c|^2 - 2 x.c in float32. Inputs, products and sums in any order, |c|^2 and the subtraction round at most
    k + 4 times in a row, so that |score - exact| <= g (|c|^2 + 2 |x||c|), g = (k + 4) u / (1 - (k + 4) u).
    """
    k = x.shape[1] + 4
    g = k * ROUNDOFF / (1 - k * ROUNDOFF) * (1 + 1e-6)  # the last factor covers the float64 arithmetic of the bounds
    squares = (entries * entries).sum(1)
    score = squares.astype(np.float32) - 2 * (x.astype(np.float32) @ entries.astype(np.float32).T)
    error = g * (squares + 2 * np.sqrt((x * x).sum(1).astype(np.float64))[:, None] * np.sqrt(squares.astype(np.float64)))
    best = (score + error).min(1)
    i, j = np.nonzero(score - error <= best[:, None])
    exact = ((x[i] - entries[j]) ** 2).sum(1)
    starts = np.searchsorted(i, np.arange(len(x)))
    least = np.minimum.reduceat(exact, starts) if len(x) else np.zeros(0, np.int64)
    hit = np.flatnonzero(exact == least[i])
    return j[hit[np.searchsorted(i[hit], np.arange(len(x)))]], least


def assigned(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each part, squared distance summed over parts) of integer vectors."""
    parts, _, width = books.shape
    codes, error = np.zeros((len(v), parts), np.int64), np.zeros(len(v), np.int64)
    for at in range(0, len(v), ROWS):
        for p in range(parts):
            codes[at : at + ROWS, p], d = nearest(v[at : at + ROWS, p * width : (p + 1) * width], books[p])
            error[at : at + ROWS] += d
    return codes, error


def first_vectors(vectors: DataFrame, vec_id: str, n: int) -> list[list[int]]:
    """The vectors of the ``n`` least ids; each task hands on its own ``n`` least."""

    def run(batches):
        kept = None
        for batch in batches:
            ids = pc.unique(batch.column(0) if kept is None else pa.concat_arrays([kept, batch.column(0)]))
            kept = ids.take(pc.array_sort_indices(ids)[:n])
        if kept is not None:
            yield pa.RecordBatch.from_arrays([kept], names=["id"])

    known = vectors.where(quoted(vec_id).isNotNull()).select(quoted(vec_id).alias("id"), "__v")
    least = [r[0] for r in known.select("id").mapInArrow(run, known.select("id").schema).distinct().orderBy("id").limit(n).collect()]
    found = known.where(F.col("id").isin(least)).groupBy("id").agg(F.min("__v").alias("v")).orderBy("id")
    return [r[1] for r in found.collect()]


def learn(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> np.ndarray:
    """Codebooks (parts, entries, width) after ``rounds`` of assignment and floored means over all vectors."""
    vectors = quantised(rows.select(quoted(vec_id), quoted(vector)), vector, scale, parts)
    size = vectors.agg(F.min(F.struct(quoted(vec_id).isNull(), quoted(vec_id), F.size("__v").alias("n")))["n"]).first()[0]
    if size is None:
        return np.zeros((parts, 0, 0), np.int64)
    vectors, width = vectors.where(F.size("__v") == size), size // parts
    start = np.array(first_vectors(vectors, vec_id, entries), np.int64).reshape(-1, parts, width)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    if not books.shape[1]:
        return np.zeros((parts, 0, 0), np.int64)
    sums = [f"s{k}" for k in range(width)]
    for _ in range(rounds):
        sent, count = vectors.sparkSession.sparkContext.broadcast(books), books.shape[1]

        def add(batches, sent=sent, count=count):
            books, total = sent.value, np.zeros((parts * count, width + 1), np.int64)
            for batch in batches:
                v = matrix(batch.column(0), size)
                codes, _ = assigned(v, books)
                for p in range(parts):
                    total[p * count : (p + 1) * count, 0] += np.bincount(codes[:, p], minlength=count)
                    for k in range(width):  # a batch's sums are exact in float64
                        total[p * count : (p + 1) * count, k + 1] += np.bincount(codes[:, p], v[:, p * width + k].astype(np.float64), count).astype(np.int64)
            used = np.flatnonzero(total[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(used)] + [pa.array(total[used, k]) for k in range(width + 1)], names=["slot", "n", *sums])

        part = vectors.select("__v").mapInArrow(add, ", ".join(f"{c} long" for c in ["slot", "n", *sums]))
        for r in part.groupBy("slot").agg(*[F.sum(c).alias(c) for c in ["n", *sums]]).collect():
            books[r[0] // count, r[0] % count] = [s // r[1] for s in r[2:]]
    return books


def encode(rows: DataFrame, books: np.ndarray, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """The rows with a usable vector, with ``code`` (two hex digits a part) and ``error`` (squared distance)."""
    parts, count, width = books.shape
    kept = [c for c in rows.columns if c.lower() not in ("code", "error")]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if count > 256:
        raise ValueError("a code has two hex digits: 256 entries at most")
    if not count:
        return rows.select(*[quoted(c) for c in kept]).withColumn("code", F.lit("")).withColumn("error", F.lit(0).cast("long")).where(F.lit(False))
    sent = rows.sparkSession.sparkContext.broadcast(books)
    vectors = quantised(rows, vector, scale, parts).where(F.size("__v") == parts * width)

    def run(batches):
        for batch in batches:
            codes, error = assigned(matrix(batch.column(batch.num_columns - 1), parts * width), sent.value)
            text = codes.astype(np.uint8).tobytes().hex()
            code = pa.array([text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(kept))] + [code, pa.array(error)], names=schema.names)

    return vectors.select(*[quoted(c) for c in kept], "__v").mapInArrow(run, schema)


def decode(coded: DataFrame, books: np.ndarray, code: str = "code", decoded: str = "decoded") -> DataFrame:
    """``coded`` with ``decoded``: the integers that the code stands for; null for a null code."""
    parts = len(books)
    sent = coded.sparkSession.sparkContext.broadcast(books)
    kept = [c for c in coded.columns if c.lower() != decoded.lower()]
    schema = T.StructType([coded.schema[c] for c in kept] + [T.StructField(decoded, T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            at = np.frombuffer(bytes.fromhex("".join(text.drop_null().to_pylist())), np.uint8).reshape(-1, parts)
            flat = sent.value[np.arange(parts), at].reshape(-1).astype(np.int32)
            ends = np.cumsum(np.asarray(text.is_valid()), dtype=np.int64) * (len(flat) // max(1, len(at)))
            out = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(flat), mask=text.is_null())
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(kept))] + [out], names=schema.names)

    return coded.select(*[quoted(c) for c in kept], quoted(code).alias("__code")).mapInArrow(run, schema)


def label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with ``label_error``: the error summed over all rows of its label. ``coded`` is a written table.

    A label may hold most rows: they are dealt out by their place in the table, and each total goes to every deal.
    """
    totals = coded.groupBy(quoted(label).alias("__l")).agg(F.sum("error").alias("label_error")).withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = coded.drop("label_error").withColumn("__s", (F.monotonically_increasing_id() % SALTS).cast("int"))
    return dealt.join(totals, quoted(label).eqNullSafe(F.col("__l")) & (F.col("__s") == F.col("__t"))).drop("__l", "__s", "__t")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", **settings: int) -> tuple[DataFrame, np.ndarray]:
    """(codes with their errors and their labels' errors, codebooks)."""
    books = learn(rows, vec_id, vector, **settings)
    coded = materialize(encode(rows, books, vector, settings.get("scale", 256)).drop(vector), "codes")
    return label_errors(coded, label), books
