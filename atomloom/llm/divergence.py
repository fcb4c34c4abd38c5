"""Source divergence audit: smoothed term shares by language and source, sources' distances, and each source's own terms.

Shares are integers: p = 1 + floor(10**9 (count + 5) / (N + 5 V)) over the V terms that at least ``min_docs`` documents of a
language hold. Methods:

* ``radix_top``: histograms over ten value bits at a time find the value of each group's k-th row; where rows of that value
  are more than are wanted, histograms over the items' UTF-8 bytes go on until the k-th is found. Only rows up to it are sorted.
* ``pair_distances``: a term that a source lacks has the source's share of count 0, its baseline. The distance of two
  sources is V times that of their baselines, corrected for the terms that either has (by sorted shares and their sums)
  and for those that both have; the terms that neither has are never visited. Sources come in blocks and terms in shards,
  so that a task holds two blocks of sources and one shard of terms, and adds up its pairs before they are shuffled.

A task counts terms by slices and hands on sums. Defined cases: null text, language and source are ''; documents without
terms count as groups; a group or language without kept terms has distance 0 to all others and no terms of its own; each
row is a document, also where ids repeat. Other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atomloom.llm.common import Texts, quoted, slices
from atomloom.session import materialize

SCALE, SMOOTH = 1_000_000_000, 5
#: Rows and bytes of counts that a task adds up before it hands them on; sources in a block, terms in a shard, pairs at once.
HELD_ROWS, HELD_BYTES, SOURCES, TERMS, PAIRS = 400_000, 64 << 20, 256, 512, 1 << 20
DIGIT, BITS, FEW_GROUPS = 10, 30, 10_000

LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def terms_of(texts: Texts) -> tuple[pa.Array, np.ndarray]:
    """(the terms of texts one after the other, the text of each): runs of ASCII letters and all beyond ASCII, A-Z lower-cased."""
    data, off = texts.bytes, texts.offsets
    inside = LETTERS[data]
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        filled = off[:-1] < off[1:]
        first, last = off[:-1][filled], off[1:][filled] - 1
        begins[first] |= inside[first]
        ends[last] |= inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    bounds = np.concatenate(([0], np.cumsum(end - start)))
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(LOWER[data[inside]]))
    return words, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, off)))


def slice_counts(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of the documents of a slice."""
    words, doc = terms_of(Texts(batch.column("text")))
    words = words.dictionary_encode()
    langs, sources = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
    wide = len(sources.dictionary)
    group = langs.indices.to_numpy().astype(np.int64) * wide + sources.indices.to_numpy()
    n_docs, n_groups = len(batch), len(langs.dictionary) * wide
    held, times = np.unique(words.indices.to_numpy().astype(np.int64) * n_docs + doc, return_counts=True)
    key, place = np.unique(held // n_docs * n_groups + group[held % n_docs], return_inverse=True)
    of = key % n_groups
    return pa.table({
        "lang": langs.dictionary.take(pa.array(of // wide)), "source": sources.dictionary.take(pa.array(of % wide)), "term": words.dictionary.take(pa.array(key // n_groups)),
        "n": np.bincount(place, times, len(key)).astype(np.int64), "docs": np.bincount(place, minlength=len(key)).astype(np.int64),
    })


def term_counts(docs: DataFrame) -> DataFrame:
    """Partial sums (lang, source, term, n, docs) of ``docs`` (lang, source, text): occurrences, and documents that hold the term."""
    names = ["lang", "source", "term", "n", "docs"]

    def added(tables: list[pa.Table]) -> pa.Table:
        both = pa.concat_tables(tables).group_by(names[:3], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return both.select([*names[:3], "n_sum", "docs_sum"]).rename_columns(names)

    def run(batches):
        tables, rows, size = [], 0, 0
        for batch in slices(batches, "text"):
            tables.append(slice_counts(batch))
            rows, size = rows + len(tables[-1]), size + tables[-1].nbytes
            if rows > HELD_ROWS or size > HELD_BYTES:
                tables = [added(tables)]
                rows, size = len(tables[0]), tables[0].nbytes
                if rows > HELD_ROWS // 2 or size > HELD_BYTES // 2:
                    yield from out(tables)
                    tables, rows, size = [], 0, 0
        if tables:
            yield from out([added(tables)])

    def out(tables: list[pa.Table]):
        schema = pa.schema([(c, pa.string()) for c in names[:3]] + [(c, pa.int64()) for c in names[3:]])
        yield from tables[0].cast(schema).to_batches(max_chunksize=10_000)

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: str, total: str, terms: str) -> Column:
    """p of a count among ``total`` over ``terms`` terms, exact below 10**19."""
    return F.expr(f"1 + (CAST({count} + {SMOOTH} AS DECIMAL(20, 0)) * {SCALE}) div CAST({total} + {SMOOTH} * {terms} AS DECIMAL(20, 0))")


class Shares:
    """Written tables: ``groups`` (lang, source, place, n, v, n_lang, base) and ``shares`` (lang, source, place, v, term, p, q)."""

    def __init__(self, docs: DataFrame, min_docs: int = 30, lang: str = "lang", source: str = "source", text: str = "text"):
        rows = docs.select(*[F.coalesce(quoted(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source"), (text, "text"))])
        counts = term_counts(rows).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        term = Window.partitionBy("lang", "term")
        held = counts.withColumns({"df": F.sum("docs").over(term), "n_lang": F.sum("n").over(term), "first": F.col("source") == F.min("source").over(term)})
        kept = materialize(held.where(F.col("df") >= min_docs).select("lang", "source", "term", "n", "n_lang", "first"), "terms")
        langs = kept.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count_if("first").alias("v"))
        groups = rows.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(langs, "lang", "left")
        groups = groups.fillna(0, ["n", "v", "n_lang"]).withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
        self.groups = materialize(groups.withColumn("base", F.when(F.col("v") > 0, share("0", "n", "greatest(v, 1)")).otherwise(0)), "groups")
        totals = self.groups.select("lang", "source", "place", "v", F.col("n").alias("total"), F.col("n_lang").alias("total_lang"))
        made = kept.join(totals, ["lang", "source"]).withColumns({"p": share("n", "total", "v"), "q": share("n_lang", "total_lang", "v")})
        self.shares = materialize(made.select("lang", "source", "place", "v", "term", "p", "q"), "shares")


def radix_top(rows: DataFrame, group: list[str], value: str, item: str, k: int, bits: int = BITS) -> DataFrame:
    """The ``k`` rows of each group with the greatest values, ties by the UTF-8 bytes of their item, with ``rank`` from 1.

    ``rows`` is a written table; values are whole numbers from 0 to below 2**bits, items distinct within their group.
    """
    # thresholds are a row for each group: broadcast where groups are known to be few
    few = rows.select(*group).distinct().limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    small = F.broadcast if few else lambda df: df
    state = None
    for shift in range(-(-bits // DIGIT) * DIGIT - DIGIT, -1, -DIGIT):
        digit = F.shiftright(value, shift) if state is None else F.shiftright(value, shift).bitwiseAND((1 << DIGIT) - 1)
        at = rows if state is None else rows.join(small(state), group).where(F.shiftright(value, shift + DIGIT) == F.col("__prefix"))
        at = at.withColumns({"__digit": digit, "__prefix": F.lit(0).cast("long") if state is None else F.col("__prefix"), "__left": F.lit(k).cast("long") if state is None else F.col("__left")})
        counts = at.groupBy(*group, "__prefix", "__left", "__digit").agg(F.count(F.lit(1)).alias("__n"))
        before = Window.partitionBy(*group).orderBy(F.desc("__digit")).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        # groups of k rows or fewer have no such digit: they leave the state and are taken whole
        hit = counts.where((F.col("__before") < F.col("__left")) & (F.col("__left") <= F.col("__before") + F.col("__n")))
        state = hit.select(*group, (F.col("__prefix") * (1 << DIGIT) + F.col("__digit")).alias("__prefix"), (F.col("__left") - F.col("__before")).alias("__left"), "__n")
    state = materialize(state.withColumnRenamed("__prefix", "__value"), "thresholds")
    marked = rows.join(small(state), group, "left")
    taken = marked.where("__value is null").select(*rows.columns).unionByName(marked.where((F.col(value) > F.col("__value")) | ((F.col(value) == F.col("__value")) & (F.col("__n") == F.col("__left")))).select(*rows.columns))
    tied = state.where("__n > __left").withColumns({"__prefix": F.lit(b""), "__done": F.lit(False)})
    own, at, width = rows.join(small(tied.select(*group, "__value")), group).where(F.col(value) == F.col("__value")).withColumn("__bytes", quoted(item).cast("binary")), 0, 8
    if not tied.isEmpty():
        own = materialize(own.drop("__value"), "ties")
        while not tied.where("not __done").isEmpty():
            # ever longer pieces, so that rounds grow with the logarithm of the items' lengths
            piece = F.substring("__bytes", at + 1, width)
            open_ = own.join(small(tied.where("not __done").select(*group, "__prefix", "__left")), group).where(F.substring("__bytes", 1, at) == F.col("__prefix"))
            counts = open_.groupBy(*group, "__prefix", "__left", piece.alias("__piece")).agg(F.count(F.lit(1)).alias("__n"))
            before = Window.partitionBy(*group).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
            counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
            hit = counts.where((F.col("__before") < F.col("__left")) & (F.col("__left") <= F.col("__before") + F.col("__n")))
            hit = hit.select(*group, F.concat("__prefix", "__piece").alias("__prefix"), (F.col("__left") - F.col("__before")).alias("__left"), (F.col("__n") == F.col("__left") - F.col("__before")).alias("__done"), F.length("__piece").alias("__l"))
            # nothing is longer than a piece that fell short: only equal items are left
            hit = hit.withColumn("__done", F.col("__done") | (F.col("__l") < width)).drop("__l")
            tied = materialize(hit.unionByName(tied.where("__done").select(*hit.columns)), "ties")
            at, width = at + width, width * 4
        last = own.join(small(tied.select(*group, "__prefix")), group)
        taken = taken.unionByName(last.where(F.substring("__bytes", 1, F.length("__prefix")) <= F.col("__prefix")).select(*rows.columns))
    best = Window.partitionBy(*group).orderBy(F.desc(value), item)
    return taken.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def tile(block: pa.Table, sources: int) -> pa.Table:
    """The part of each pair's distance that one shard of terms gives, between two blocks of sources (or within one)."""
    place, p, base, v = (block.column(c).to_numpy() for c in ("place", "p", "base", "v"))
    first = block.column("i")[0].as_py() == block.column("j")[0].as_py()
    heads = np.flatnonzero(base >= 0)
    heads = heads[np.argsort(place[heads], kind="stable")]
    places, bases, m = place[heads], base[heads], len(heads)
    side = places // sources
    gap = np.abs(bases[:, None] - bases[None])
    out = gap * v[heads][:, None] if block.column("shard")[0].as_py() == 0 else np.zeros((m, m), np.int64)
    own = np.flatnonzero(base < 0)
    term = block.column("term").take(pa.array(own)).combine_chunks().dictionary_encode().indices.to_numpy() if len(own) else np.zeros(0, np.int64)
    a, p = np.searchsorted(places, place[own]), p[own]
    # terms of one source: sum of |p - x| - |own baseline - x| over its terms, for the baseline x of each other source
    single = np.zeros((m, m), np.int64)
    order = np.lexsort((p, a))
    edges = np.searchsorted(a[order], np.arange(m + 1))
    for k in range(m):
        mine = p[order[edges[k] : edges[k + 1]]]
        if len(mine):
            sums = np.concatenate(([0], np.cumsum(mine)))
            below = np.searchsorted(mine, bases)
            single[k] = bases * below - sums[below] + (sums[-1] - sums[below]) - bases * (len(mine) - below) - len(mine) * gap[k]
    out = out + single + single.T
    # terms of both
    order = np.lexsort((a, term))
    term, a, p = term[order], a[order], p[order]
    partners = np.searchsorted(term, term, "right") - np.arange(len(term)) - 1
    ends, at = np.cumsum(partners), 0
    while at < len(term):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = partners[at:to]
        x = np.repeat(np.arange(at, to), n)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        if not first:
            cross = side[a[x]] != side[a[y]]
            x, y = x[cross], y[cross]
        s, t = a[x], a[y]
        both = np.abs(p[x] - p[y]) - np.abs(p[x] - bases[t]) - np.abs(bases[s] - p[y]) + gap[s, t]
        out += np.bincount(s * m + t, both.astype(np.float64), m * m).astype(np.int64).reshape(m, m)  # exact: below 2**53
        at = to
    s, t = np.nonzero(np.triu(np.ones((m, m), bool), 1) & (first | (side[:, None] != side[None])))
    names = block.column("source").take(pa.array(heads)).combine_chunks()
    return pa.table({"lang": block.column("lang").slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(s), np.int64))), "source": names.take(pa.array(s)), "item": names.take(pa.array(t)), "value": out[s, t]})


def pair_distances(found: Shares, sources: int = SOURCES, terms: int = TERMS) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language, in both directions."""
    blocks, shards = F.col("blocks"), F.ceil(F.greatest(F.col("v"), F.lit(1)) / terms)
    sizes = found.groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / sources).cast("int").alias("blocks"))
    own = F.floor(F.col("place") / sources).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    nothing = F.lit(-1).cast("long")
    heads = found.groups.withColumns({"shard": F.explode(F.sequence(F.lit(0).cast("long"), shards - 1)), "term": F.lit(""), "p": nothing})
    held = found.shares.withColumns({"shard": F.pmod(F.xxhash64("term"), shards), "base": nothing})
    columns = ["lang", "source", "place", "v", "shard", "term", "p", "base"]
    rows = heads.select(columns).unionByName(held.withColumn("source", F.lit("")).select(columns)).join(sizes, "lang").withColumn("other", other)
    rows = rows.select(*columns, F.least(own, "other").alias("i"), F.greatest(own, "other").alias("j"))
    parts = rows.groupBy("lang", "i", "j", "shard").applyInArrow(lambda t: tile(t, sources), "lang string, source string, item string, value long")
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return pairs.select("lang", both.alias("b"), "value").select("lang", "b.source", "b.item", "value")


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, **columns: str) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources by distance, and the ``top`` terms with p above the language's."""
    found = Shares(docs, min_docs, **columns)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_distances(found).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    over = materialize(found.shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "terms")
    terms = radix_top(over, ["lang", "source"], "value", "item", top).withColumn("part", F.lit("term"))
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(names).unionByName(terms.select(names))
