"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k | text) = sigmoid(threshold_k - w . x): one weight vector over hashed text features is shared by all grades,
and the thresholds are ordered. Features are present or absent: words, runs of punctuation, and levels of a few shares
(upper-case words, words that repeat the one before, distinct words, punctuation). The expected grade and the tail
probabilities P(grade >= k) serve selection.

The fit takes at most ``rows_per_grade`` labelled rows of each grade (those with the least hashes, so the same every
time), weighted back to the grades' true shares; features are made on the executors, the convex loss is minimised on the
driver, whose memory depends on that bound. Features found in fewer than ``min_rows`` rows keep weight 0.

Defined cases: a label row with a null is left out; several label rows of a document all count (equal ones as one row of
the sample with their number as its weight); of several texts of one id
the fit takes the least, so that repeated documents don't fill the sample; null and empty texts have level features only and are scored like others; without any labels everything has tail probability 1; grades that
no label shows have probability 0; a result column replaces an input column of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atomloom.llm.common import U64, Texts, Words, hashed_sample, map_texts, mix64, quoted, separators, slices

ROWS_PER_GRADE, BUCKET_BITS = 4000, 18
WORD_SEP = separators("nonword")
#: Outside punctuation: white space, controls, 0-9, A-Z, a-z and all non-ASCII bytes.
MARK_SEP = ~WORD_SEP
MARK_SEP[:33] = MARK_SEP[127] = True
UPPER = np.zeros(256, np.int64)
UPPER[65:91] = 1
LEVELS = np.array([0.0001, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7])


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, buckets): the distinct hashed features of each text."""
    words, marks = Words(texts, WORD_SEP, True), Words(texts, MARK_SEP, False)
    n = len(texts)
    doc = np.repeat(np.arange(n), words.counts)
    upper = np.concatenate(([0], np.cumsum(UPPER[texts.bytes])))
    size = words.end - words.start
    shouted = (upper[words.end] - upper[words.start] == size) & (size > 1)
    same = np.zeros(len(doc), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
    buckets = np.concatenate((words.hash, mix64(marks.hash ^ U64(0x5DEECE66D)))) >> U64(64 - BUCKET_BITS)
    owner = np.concatenate((doc, np.repeat(np.arange(n), marks.counts)))
    key = np.unique((owner.astype(np.int64) << BUCKET_BITS) | buckets.astype(np.int64))
    total = np.maximum(words.counts, 1)
    distinct = np.bincount(key >> BUCKET_BITS, minlength=n)
    span = np.maximum(np.diff(texts.offsets), 1)
    marked = np.bincount(np.repeat(np.arange(n), marks.counts), marks.end - marks.start, n) if len(marks.start) else np.zeros(n)
    shares = [np.bincount(doc, shouted, n) / total, np.bincount(doc, same, n) / total, distinct / total, marked / span]
    own = np.arange(n, dtype=np.int64)
    for k, share in enumerate(shares):
        level = np.searchsorted(LEVELS, share, "right").astype(U64)
        b = mix64(level + U64(1000 * (k + 1))) >> U64(64 - BUCKET_BITS)
        key = np.concatenate((key, (own << BUCKET_BITS) | b.astype(np.int64)))
    key = np.unique(key)
    return np.searchsorted(key >> BUCKET_BITS, np.arange(n + 1)), (key & ((1 << BUCKET_BITS) - 1)).astype(np.int32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    """Shared weights and ordered thresholds; ``grades`` are the grades that labels show, in order."""

    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, offsets: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k]) for k = 1.. in columns."""
        total = np.concatenate(([0.0], np.cumsum(self.weights[buckets], dtype=np.float64)))
        score = total[offsets[1:]] - total[offsets[:-1]]
        return 1.0 - _sigmoid(self.thresholds[None, :] - score[:, None])


def fit(offsets: np.ndarray, buckets: np.ndarray, grade: np.ndarray, weight: np.ndarray, l1: float = 1e-4, min_rows: int = 5, steps: int = 500) -> Ordinal:
    """Minimise the weighted loss by Adam over the whole sample; ``l1`` keeps weights of uninformative features at 0."""
    grades = sorted(set(grade.tolist()))
    y, n, size = np.searchsorted(grades, grade), len(grade), 1 << BUCKET_BITS
    used = np.bincount(buckets, minlength=size) >= min_rows
    ids = np.flatnonzero(used)
    index = np.full(size, -1, np.int64)
    index[ids] = np.arange(len(ids))
    row = np.repeat(np.arange(n), np.diff(offsets))
    good = used[buckets]
    row, col = row[good], index[buckets[good]]
    weight = weight / weight.sum()
    share = np.clip(np.cumsum(np.bincount(y, weight, len(grades)))[:-1], 1e-6, 1 - 1e-6)
    start = np.log(share / (1 - share))
    # thresholds are a first one and the logs of the gaps, which keeps them in order
    free = np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 0.05)))) if len(start) else start
    p = np.concatenate((np.zeros(len(ids)), free))
    m, v, w = np.zeros_like(p), np.zeros_like(p), len(ids)

    def bounds(t: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate((t[:1], np.exp(t[1:])))) if len(t) else t

    if len(start):
        for step in range(1, steps + 1):
            theta = bounds(p[w:])
            s = np.bincount(row, p[col], n)
            upper = np.concatenate((theta, [40.0]))[y] - s
            lower = np.concatenate(([-40.0], theta))[y] - s
            a, b = _sigmoid(upper), _sigmoid(lower)
            mass = np.maximum(a - b, 1e-12)
            da, db = weight * a * (1 - a) / mass, weight * b * (1 - b) / mass
            ds = da - db
            g_theta = np.array([db[y == k + 1].sum() - da[y == k].sum() for k in range(len(theta))])
            tail = np.cumsum(g_theta[::-1])[::-1]
            g = np.concatenate((np.bincount(col, ds[row], w), np.concatenate((tail[:1], tail[1:] * np.exp(p[w + 1 :])))))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            rate = 0.05 / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            p -= rate * m / (1 - 0.9**step)
            p[:w] = np.sign(p[:w]) * np.maximum(np.abs(p[:w]) - l1 * rate[:w], 0)
    weights = np.zeros(size, np.float32)
    weights[ids] = p[:w]
    return Ordinal(grades, weights, bounds(p[w:]))


def train(docs: DataFrame, labels: DataFrame, grade, doc_id: str = "doc_id", text: str = "text", rows_per_grade: int = ROWS_PER_GRADE) -> Ordinal:
    """Fit on a bounded sample of ``labels`` (doc_id and a Column ``grade``, a small whole number)."""
    rated = labels.select(quoted(doc_id).alias("d"), grade.cast("int").alias("g")).where("d is not null and g is not null")
    # label rows that repeat are one row with a weight, so that no document fills the sample
    rated = rated.groupBy("d", "g").agg(F.count(F.lit(1)).alias("n"))
    found = rated.groupBy("g").agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("rows")).collect()
    picked = hashed_sample(rated, "g", ["d"], {r["g"]: r["pairs"] for r in found}, rows_per_grade)

    def run(batches):
        for batch in slices(batches, "t"):
            offsets, buckets = features(Texts(batch.column("t")))
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("n"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(buckets))], names=["g", "n", "f"])

    # picked has rows_per_grade rows for each grade at most, and each gets one text
    sample = docs.select(quoted(doc_id).alias("d"), quoted(text).alias("t")).join(F.broadcast(picked), "d").groupBy("d", "g", "n").agg(F.min("t").alias("t")).select("g", "n", "t")
    rows = sample.mapInArrow(run, "g int, n long, f array<int>").toArrow().combine_chunks()
    if not rows.num_rows:
        return Ordinal([], np.zeros(1 << BUCKET_BITS, np.float32), np.zeros(0))
    g, n, f = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns)
    grades, times, lens = np.asarray(g), np.asarray(n).astype(np.float64), np.diff(np.asarray(f.offsets))
    # each grade weighs as much as all its label rows
    taken = {k: times[grades == k].sum() for k in np.unique(grades).tolist()}
    true = {r["g"]: r["rows"] for r in found}
    weight = times * np.array([true[k] / taken[k] for k in grades.tolist()])
    return fit(np.concatenate(([0], np.cumsum(lens))), np.asarray(f.flatten()), grades, weight)


def score(docs: DataFrame, model: Ordinal, select: int, text: str = "text", threshold: float = 0.6, prefix: str = "") -> DataFrame:
    """``docs`` with expected_grade, tail (P(grade >= ``select``)) and kept (tail >= ``threshold``), named with ``prefix``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField(prefix + "expected_grade", T.DoubleType()), T.StructField(prefix + "tail", T.DoubleType()), T.StructField(prefix + "kept", T.BooleanType())]

    def run(batch):
        m, n = sent.value, batch.num_rows
        if not m.grades:
            return [pa.nulls(n, pa.float64()), pa.array(np.ones(n)), pa.array(np.ones(n, bool))]
        tails = m.tails(*features(Texts(batch.column(text))))
        expected = m.grades[0] + tails @ np.diff(np.array(m.grades, np.float64))
        over = [k for k, g in enumerate(m.grades) if g >= select]
        tail = np.zeros(n) if not over else np.ones(n) if over[0] == 0 else tails[:, over[0] - 1]
        return [pa.array(np.round(expected, 9)), pa.array(np.round(tail, 9)), pa.array(tail >= threshold)]

    return map_texts(docs, text, fields, run)
