"""Language ID by prediction by partial matching.

Each language has a tree of byte contexts of up to ``order`` bytes with counts, learned from a sample of labelled texts
and then frozen. The code length of a byte b after context c is -log2 P(b | c): if the context was seen, with n
occurrences of d distinct bytes, a seen b has count / (n + d) and the escape d / (n + d) leads to the next shorter
context; below the empty context every byte has 1 / 256 (method C, without exclusion). An unseen context leads to the
shorter one at no cost. A text goes to the language with the shortest code; the score is that language's share of
2 ** -length over all languages.

For scoring, the trees are laid out as tables of sorted codes: a table holds the code length, in each of its languages,
of every gram (context and byte) that one of them has seen, and the escapes of every context; a gram that none has seen
costs the escapes of its context and what the shorter gram costs. The lengths are those of the trees, exactly: no
language and no context is left out. With more than ``TABLE_LANGUAGES`` languages there are several tables, so that the
size grows with the languages and not with their square. ``rows_per_language`` texts for each language are learned from
(those with the least row hashes, so the sample is the same every time; rows that repeat count once); the tables' size
depends on this sample, not on the corpus, and is checked against ``MOST_BYTES`` before they are broadcast.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any labelled text every text is
``und``; ties go to the language first in order; a result column replaces an input column of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atomloom.llm.common import MOST_GROUPS, Texts, hashed_sample, map_texts, quoted
from atomloom.session import materialize

ROWS_PER_LANGUAGE, ORDER, TABLE_LANGUAGES, MOST_BYTES = 400, 3, 8, 1 << 30
LETTER = regex.compile(r"\p{L}").search
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def find(codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted ``codes``, whether it is there) of each wanted code."""
    if not len(codes):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return at, codes[at] == wanted


class Tree:
    """Counts of the contexts of one language: for k = 0..order the k+1 grams, as sorted codes with counts."""

    def __init__(self, texts: list[bytes], order: int = ORDER):
        self.grams, self.contexts = [], []
        arrays = [LOWER[np.frombuffer(t, np.uint8)].astype(np.int64) for t in texts]
        for k in range(order + 1):
            parts = []
            for a in arrays:
                if len(a) > k:
                    code = np.zeros(len(a) - k, np.int64)
                    for j in range(k + 1):
                        code = (code << 8) | a[j : len(a) - k + j]
                    parts.append(code)
            codes, counts = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            context, at, distinct = np.unique(codes >> 8, return_inverse=True, return_counts=True)
            n = np.bincount(at, counts, len(context))
            self.grams.append((codes, np.log2((n + distinct)[at] / counts)))
            self.contexts.append((context, np.log2((n + distinct) / distinct)))

    def escapes(self, k: int, contexts: np.ndarray) -> np.ndarray:
        """Code lengths of the escape from each context of k bytes; 0 where this language never saw it."""
        codes, length = self.contexts[k]
        at, known = find(codes, contexts)
        out = np.zeros(len(contexts))
        out[known] = length[at[known]]
        return out

    def lengths(self, k: int, grams: np.ndarray) -> np.ndarray:
        """Code lengths of the last byte of each gram after its first k bytes."""
        out, left = np.zeros(len(grams)), np.arange(len(grams))
        for j in range(k, -1, -1):
            codes, length = self.grams[j]
            gram = grams[left] & ((1 << 8 * (j + 1)) - 1)
            at, seen = find(codes, gram)
            out[left[seen]] += length[at[seen]]
            left, gram = left[~seen], gram[~seen]
            out[left] += self.escapes(j, gram >> 8)
        out[left] += 8.0
        return out


class Table:
    """Code lengths in a few languages of every gram that one of them has seen, and of the escapes of its contexts."""

    def __init__(self, trees: list[Tree], order: int):
        self.order, self.width, self.grams, self.contexts = order, len(trees), [], []
        for k in range(order + 1):
            grams = np.unique(np.concatenate([t.grams[k][0] for t in trees]))
            contexts = np.unique(grams >> 8)
            self.grams.append((grams, np.stack([t.lengths(k, grams) for t in trees], axis=1).astype(np.float32)))
            self.contexts.append((contexts, np.stack([t.escapes(k, contexts) for t in trees], axis=1).astype(np.float32)))

    def lengths(self, codes: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """A row for each code of the last ``order`` bytes and the byte itself, of which ``depth`` are in its text."""
        out, left = np.zeros((len(codes), self.width), np.float32), np.zeros(0, np.int64)
        for k in range(self.order, -1, -1):
            left = np.concatenate((left, np.flatnonzero(depth == k)))
            gram = codes[left] & ((1 << 8 * (k + 1)) - 1)
            at, seen = find(self.grams[k][0], gram)
            out[left[seen]] += self.grams[k][1][at[seen]]
            # no language saw this byte here: those that know the context escape, all go on to the shorter one
            left, gram = left[~seen], gram[~seen]
            at, known = find(self.contexts[k][0], gram >> 8)
            out[left[known]] += self.contexts[k][1][at[known]]
        out[left] += np.float32(8)
        return out


class Model:
    """Tables for scoring many texts at once, each of ``TABLE_LANGUAGES`` languages."""

    def __init__(self, labelled: dict[str, list[bytes]], order: int = ORDER):
        self.order, self.languages = order, sorted(k for k, v in labelled.items() if any(v))
        self.tables = [Table([Tree(labelled[k], order) for k in self.languages[at : at + TABLE_LANGUAGES]], order) for at in range(0, len(self.languages), TABLE_LANGUAGES)]

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for table in self.tables for pair in (*table.grams, *table.contexts) for a in pair)

    def lengths(self, texts: Texts) -> np.ndarray:
        """Code length in bits of each text in each language."""
        codes = LOWER[texts.bytes].astype(np.int64)
        n = len(codes)
        out = np.zeros((len(texts), len(self.languages)))
        if not n:
            return out
        depth = np.minimum(np.arange(n) - np.repeat(texts.offsets[:-1], np.diff(texts.offsets)), self.order)
        data = codes.copy()
        for j in range(1, self.order + 1):
            codes[j:] |= data[:-j] << (8 * j)
        filled = np.flatnonzero(np.diff(texts.offsets) > 0)
        for k, table in enumerate(self.tables):
            a = k * TABLE_LANGUAGES
            out[filled, a : a + table.width] = np.add.reduceat(table.lengths(codes, depth), texts.offsets[:-1][filled], axis=0, dtype=np.float64)
        return out


def learn(labelled: DataFrame, lang: str = "lang", doc_id: str = "doc_id", text: str = "text", rows_per_language: int = ROWS_PER_LANGUAGE, **options) -> Model:
    """A frozen model from a bounded sample of labelled rows."""
    rows = labelled.select(quoted(doc_id).alias("d"), quoted(lang).cast("string").alias("l"), quoted(text).alias("t")).where("l is not null and t is not null")
    # the pick needs no text: rows are named by a hash of theirs, and the texts come by a join of the bounded pick; rows that
    # repeat are one, so that they take one place in the sample
    named = materialize(rows.select("l", F.xxhash64("d", "l", "t").alias("h")).distinct(), "labelled")
    sizes = {r["l"]: r["count"] for r in named.groupBy("l").count().limit(MOST_GROUPS + 1).collect()}
    picked = hashed_sample(named, "l", ["h"], sizes, rows_per_language).select("h").distinct()
    sample = rows.withColumn("h", F.xxhash64("d", "l", "t")).join(F.broadcast(picked), "h", "left_semi").dropDuplicates(["h"]).select("l", "t").collect()
    by: dict[str, list[bytes]] = {}
    for r in sample:
        by.setdefault(r["l"], []).append(r["t"].encode())
    model = Model({k: sorted(v) for k, v in by.items()}, **options)
    if model.nbytes > MOST_BYTES:
        raise ValueError(f"the model has {model.nbytes >> 20} MB, over {MOST_BYTES >> 20}: learn from fewer rows a language or drop values of {lang}")
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, and code_bits (the length of the best code)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("code_bits", T.DoubleType())]

    def run(batch):
        m, texts = sent.value, Texts(batch.column(text))
        named = np.array([x is not None and LETTER(x) is not None for x in batch.column(text).to_pylist()], bool)
        if not m.languages:
            return [pa.array(["und"] * len(named)), pa.array(np.zeros(len(named))), pa.array(np.zeros(len(named)))]
        lengths = m.lengths(texts)
        best = np.argmin(lengths, axis=1) if len(lengths) else np.zeros(0, np.int64)
        least = lengths[np.arange(len(best)), best]
        score = 1.0 / np.exp2(np.maximum(least[:, None] - lengths, -1000)).sum(axis=1)
        langs = [m.languages[k] if ok else "und" for k, ok in zip(best.tolist(), named.tolist(), strict=True)]
        return [pa.array(langs, pa.string()), pa.array(np.where(named, score, 0.0)), pa.array(np.where(named, least, 0.0))]

    return map_texts(docs, text, fields, run)
