"""Typed weighted edges between atoms, and walks over them. A graph is a DataFrame of edges (src, dst, edge_type, weight)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from atomloom.config import OTHER_THRESHOLD, SIMILARITY_THRESHOLDS
from atomloom.operators.vector import BLOCK_ROWS, LEAST_BLOCKS, LEAST_ROWS, as_double, knn, knn_near, unit_rows
from atomloom.session import materialize


def edge(src: str | Column, dst: str | Column, kind: str, weight: Column) -> list[Column]:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return [col(src).alias("src"), col(dst).alias("dst"), F.lit(kind).alias("edge_type"), weight.cast("double").alias("weight")]


def reversed_too(edges: DataFrame) -> DataFrame:
    """With each edge's copy in the other direction; pairs that are mutual already give parallel edges."""
    swapped = {"src": F.col("dst"), "dst": F.col("src")}
    # one pass, as a union would find the edges twice
    both = F.array(F.struct(*edges.columns), F.struct(*[swapped.get(c, F.col(c)).alias(c) for c in edges.columns]))
    return edges.select(F.explode(both).alias("e")).select("e.*")


def by_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` dealt by ranges of ``order``, with the range's number as __part; written, as ranges are drawn from samples."""
    return materialize(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")


def part_of(atoms: DataFrame, child: str, parent: str, within: str = "source") -> DataFrame:
    """PART_OF from each atom of a resolution to the parent nearest in time within its source; ties go to the lower id.

    As-of from both sides: the last parent at or before, and the first at or after, by running windows over ranges of
    source and time. A source may span many ranges; what lies beyond a range comes from one row for each source and range.
    """
    # of parents at the same time only the lowest id can be nearest
    parents = atoms.where(F.col("resolution") == parent).groupBy(within, "ts").agg(F.min("atom_id").alias("atom_id")).withColumn("is_parent", F.lit(True))
    children = atoms.where(F.col("resolution") == child).select(within, "ts", "atom_id", F.lit(False).alias("is_parent"))
    rows = by_ranges(parents.unionByName(children), within, "ts", "atom_id")
    at, first = F.when(F.col("is_parent"), F.struct("ts", "atom_id")), F.when(F.col("is_parent"), 0).otherwise(1)
    before = Window.partitionBy(within, "__part").orderBy("ts", first).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(within, "__part").orderBy(F.desc("ts"), first).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("p", F.last(at, ignorenulls=True).over(before)).withColumn("n", F.last(at, ignorenulls=True).over(after)).where("not is_parent")
    ends = rows.groupBy(within, "__part").agg(F.min(at).alias("low"), F.max(at).alias("high"))
    parts = Window.partitionBy(within)
    ends = ends.withColumn("earlier", F.last("high", ignorenulls=True).over(parts.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.withColumn("later", F.last("low", ignorenulls=True).over(parts.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)))
    near = near.join(ends.select(F.col(within).alias("__w"), F.col("__part").alias("__e"), "earlier", "later"), F.col(within).eqNullSafe(F.col("__w")) & (F.col("__part") == F.col("__e")), "left")
    near = near.withColumn("p", F.coalesce("p", "earlier")).withColumn("n", F.coalesce("n", "later"))
    dp, dn = F.abs(F.col("ts") - F.col("p.ts")), F.abs(F.col("n.ts") - F.col("ts"))
    pick = F.when(F.col("n").isNull() | (dp < dn) | ((dp == dn) & (F.col("p.atom_id") <= F.col("n.atom_id"))), F.col("p.atom_id")).otherwise(F.col("n.atom_id"))
    return near.where("p is not null or n is not null").select(*edge("atom_id", F.coalesce(pick, F.col("n.atom_id"), F.col("p.atom_id")), "PART_OF", F.lit(1.0)))


def next_edges(atoms: DataFrame, keys: tuple[str, ...] = ("source", "resolution"), ts: str = "ts", atom: str = "atom_id") -> DataFrame:
    """NEXT between neighbours in time, weighted by exp(-hours between).

    Neighbours are found in ranges of keys and time; the last of a range meets the first of the next one that its keys
    have, so a key may span many ranges.
    """
    rows = by_ranges(atoms.select(*keys, F.col(ts).alias("ts"), F.col(atom).alias("atom")), *keys, "ts", "atom")
    here = F.struct("ts", "atom")
    near = rows.withColumn("n", F.lead(here).over(Window.partitionBy(*keys, "__part").orderBy("ts", "atom")))
    heads = rows.groupBy(*keys, "__part").agg(F.min(here).alias("head"))
    heads = heads.withColumn("later", F.lead("head").over(Window.partitionBy(*keys).orderBy("__part")))
    heads = heads.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], F.col("__part").alias("__e"), "later")
    same = F.col("__part") == F.col("__e")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__{i}"))
    near = near.join(heads, same, "left").withColumn("n", F.coalesce("n", "later")).where("n is not null")
    return near.select(*edge("atom", F.col("n.atom"), "NEXT", F.exp(-(F.col("n.ts") - F.col("ts")) / 3600.0)))


def similar(atoms: DataFrame, k: int = 10, atom: str = "atom_id", vector: str = "embedding", near: bool = False) -> DataFrame:
    """SIMILAR_TO in both directions between atoms of a modality, by its threshold; ``near`` compares only in buckets."""
    found = (knn_near if near else knn)(atoms, k, {**SIMILARITY_THRESHOLDS, None: OTHER_THRESHOLD}, atom, vector, modality="modality")
    return reversed_too(found.select(*edge("src", "dst", "SIMILAR_TO", F.col("weight"))))


#: Sets that hold an entity, from which on they meet as pairs of blocks; the sets of a block, how many blocks there are at
#: least of many sets, and about how many atoms of equal sets go out in a row.
HEAVY, SET_BLOCK, SET_BLOCKS, SET_ROWS, MEMBERS = 256, 1 << 16, 8, 4096, 512
#: How many sets of a block a set meets in the time of one that it is joined with.
JOINED = 64


def _blocks(n: Column, block_rows: int) -> Column:
    """How many blocks ``n`` rows are dealt to: as many as fill them, of fewer rows up to ``SET_BLOCKS``."""
    return F.greatest(F.ceil(n / block_rows), F.least(F.ceil(n / SET_ROWS), F.lit(SET_BLOCKS))).cast("int")


def _each_two(rows: DataFrame, key: str, n: Column) -> DataFrame:
    """``rows`` dealt to blocks by ``key``, once for each other block: with ``mine``, and ``i`` <= ``j``, the two that meet."""
    dealt = rows.withColumn("mine", F.pmod(F.xxhash64(key), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("other")


def _member_pairs(ids: pa.Array, first: np.ndarray, many: np.ndarray, p: np.ndarray, q: np.ndarray, w: np.ndarray, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """(a, b, w) in batches: all members of sets ``p`` with those of ``q``; the members of a set are ``many`` of ``ids``."""
    ends, start = np.cumsum(many[p] * many[q]), 0
    while start < len(p):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        count, wide = many[p[start:stop]] * many[q[start:stop]], many[q[start:stop]]
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        x, y = (np.repeat(first[side[start:stop]], count) + at for side, at in ((p, k // np.repeat(wide, count)), (q, k % np.repeat(wide, count))))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(np.repeat(w[start:stop], count))], names=["a", "b", "w"])
        start = stop


def _met_sets(classes: DataFrame, threshold: float, heavy: int, block_rows: int, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs of distinct sets (rep, e) whose Jaccard similarity is over ``threshold``, in two parts.

    Pairs with a set that is joined, as (a, b, w) with a < b. Of the others all pairs of their ``members`` (rep, ids), as
    (a, b, w) in any order.

    With entities in order of how many sets hold them, rare ones first, two similar sets share one of their first
    n - floor(threshold n) entities, so that common entities join few sets. A pair counts where its first shared entity is
    joined, and only if the sizes allow the similarity. Sets that have a heavy entity among their first, or whose first are
    held by so many in all that to meet every set costs less (``JOINED``), meet each other as pairs of blocks, a task for
    each two. Each set goes out once for each block, and pairs leave the task as they are found, so that nothing that is
    shuffled or held grows with the pairs.
    """
    held = classes.select("rep", F.explode("e").alias("entity"))
    ranked = held.join(held.groupBy("entity").agg(F.count(F.lit(1)).alias("df")), "entity").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "entity"))).alias("t"))
    ranked = ranked.withColumn("n", F.size("t"))
    first = F.greatest(F.col("n") - F.floor(F.col("n") * threshold).cast("int"), F.lit(1))
    ranked = materialize(ranked.withColumn("first", first), "set-index")
    possible = F.least("na", "nb") > threshold * F.greatest("na", "nb")
    met = F.aggregate(F.slice("t", F.lit(1), F.col("first")), F.lit(0).cast("long"), lambda total, x: total + x["df"])
    blocked = (F.element_at("t", F.col("first"))["df"] >= heavy) | (met * JOINED > ranked.count())
    ranked = ranked.withColumn("blocked", blocked)

    light = ranked.select("rep", F.col("t.entity").alias("names"), "n", "blocked", F.explode(F.slice("t", F.lit(1), F.col("first"))).alias("at")).where((F.col("at.df") > 1) & (F.col("at.df") < heavy))
    light = light.withColumn("at", F.col("at.entity"))
    # one side is a joined set; of what the others hold only that set's entities are needed
    free = light.where("not blocked")
    others = light.join(free.select("at").distinct(), "at", "left_semi").select("at", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("names").alias("tb"), F.col("blocked").alias("kb"))
    both = free.select("at", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("names").alias("ta")).join(others, "at")
    both = both.where((F.col("kb") & (F.col("a") != F.col("b")) | (F.col("a") < F.col("b"))) & possible).withColumn("both", F.array_intersect("ta", "tb"))
    jaccard = F.size("both") / (F.col("na") + F.col("nb") - F.size("both"))
    pairs = both.where((F.element_at("both", 1) == F.col("at")) & (jaccard > threshold)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), jaccard.alias("w"))

    busy = ranked.where("blocked")
    n = busy.agg(_blocks(F.count(F.lit(1)), block_rows)).first()[0]
    busy = busy.select("rep", F.col("t.entity").alias("names")).join(members, "rep")
    busy = _each_two(busy, "rep", F.lit(max(1, n)))
    kind = dict(members.dtypes)["ids"].removeprefix("array<").removesuffix(">")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        mine, i, j = np.asarray(table.column("mine")), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        names, ids = table.column("names").combine_chunks(), table.column("ids").combine_chunks()
        rep = np.asarray(table.column("rep").combine_chunks().dictionary_encode().indices)
        size, many = (np.asarray(x.value_lengths()).astype(np.int64) for x in (names, ids))
        codes = np.asarray(names.flatten().dictionary_encode().indices)
        one, two = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        for part, both, alike in _tiles(np.repeat(np.arange(len(size)), size), codes, size, one, two, threshold, 1 << 22):
            x, y = np.nonzero(alike)
            p, q, shared = part[x], two[y], both[x, y]
            if i == j:  # a block with itself: each pair once, and a set's own atoms not
                once = (p < q) & (rep[p] != rep[q])
                p, q, shared = p[once], q[once], shared[once]
            yield from _member_pairs(ids.flatten(), np.cumsum(many) - many, many, p, q, shared / (size[p] + size[q] - shared).astype(np.float64))

    return pairs, busy.groupBy("i", "j").applyInArrow(meet, f"a {kind}, b {kind}, w double")


def set_pairs(classes: DataFrame, threshold: float, heavy: int = HEAVY, block_rows: int = SET_BLOCK) -> DataFrame:
    """(a, b, w): the pairs a < b of distinct sets (rep, e) whose Jaccard similarity is over ``threshold``; a written table."""
    pairs, others = _met_sets(classes, threshold, heavy, block_rows, classes.select("rep", F.array("rep").alias("ids")))
    return pairs.unionByName(others.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w"))


def equal_pairs(own: DataFrame, members: DataFrame, block_rows: int = SET_BLOCK) -> DataFrame:
    """(x, y): all pairs of the atoms (rep, id) of a class, each once; ``members``: how many atoms a class (rep) has.

    Classes of up to ``MEMBERS`` atoms are paired as lists, larger ones as pairs of blocks, a task for each two.
    """
    own = own.join(members.where("members > 1"), "rep")
    small = own.where(F.col("members") <= MEMBERS).groupBy("rep").agg(F.collect_list("id").alias("ids"))
    small = small.select("ids", F.explode("ids").alias("x")).select("x", F.explode("ids").alias("y")).where("x < y")
    large = _each_two(own.where(F.col("members") > MEMBERS), "id", _blocks(F.col("members"), block_rows))
    kind = dict(own.dtypes)["id"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        mine, ids = np.asarray(table.column("mine")), table.column("id").combine_chunks()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        one, two = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        step = max(1, (1 << 19) // max(1, len(two)))
        for k in range(0, len(one), step):
            part = one[k : k + step]
            p, q = np.repeat(part, len(two)), np.tile(two, len(part))
            if i == j:
                p, q = p[p < q], q[p < q]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(p)), ids.take(pa.array(q))], names=["x", "y"])

    found = large.select("rep", "i", "j", "mine", "id").groupBy("rep", "i", "j").applyInArrow(meet, f"x {kind}, y {kind}")
    return small.unionByName(found)


def entity_shared(atoms: DataFrame, atom: str = "atom_id", entities: str = "entities", threshold: float = 0.05, heavy: int = HEAVY, block_rows: int = SET_BLOCK) -> DataFrame:
    """ENTITY_SHARED in both directions between atoms whose entity sets have a Jaccard similarity over ``threshold``.

    Distinct sets are compared, and atoms come in where pairs of sets are found, so that atoms of equal sets are not. The
    edges may be a share of all pairs; they are written out as they are found, and none is shuffled but those of sets that
    share a rare entity, by set.
    """
    sets = atoms.select(F.col(atom).alias("id"), F.array_sort(F.array_distinct(entities)).alias("e")).where(F.size("e") > 0)
    classes = materialize(sets.groupBy("e").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members")), "sets")
    own = materialize(sets.join(classes, "e").select("rep", "id", "members"), "set-atoms")
    deal = F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / MEMBERS))
    lists = materialize(own.groupBy("rep", deal.alias("deal")).agg(F.collect_list("id").alias("ids")).drop("deal"), "set-members")
    pairs, others = _met_sets(classes.select("rep", "e"), threshold, heavy, block_rows, lists)
    met = pairs.join(lists.select(F.col("rep").alias("a"), F.col("ids").alias("x")), "a").join(lists.select(F.col("rep").alias("b"), F.col("ids").alias("y")), "b")
    met = met.select("w", "y", F.explode("x").alias("x")).select("x", F.explode("y").alias("y"), "w").unionByName(others.select(F.col("a").alias("x"), F.col("b").alias("y"), "w"))
    if threshold < 1:
        met = met.unionByName(equal_pairs(own.select("rep", "id"), classes.select("rep", "members"), block_rows).withColumn("w", F.lit(1.0)))
    return reversed_too(met.select(*edge(F.least("x", "y"), F.greatest("x", "y"), "ENTITY_SHARED", F.col("w"))))


#: Sets of a block whose links are counted, and how many blocks there are at least of many sets.
LINK_BLOCK, LINK_BLOCKS, LINK_ROWS = 1 << 16, 8, 4096


def _tiles(rows: np.ndarray, codes: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, cells: int = 1 << 24) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(part, both, alike): for a part of the sets ``a`` at a time what each shares with those of ``b``, and whether it is enough.

    ``rows`` and ``codes``: which set holds which entity. What two sets share is counted in tiles: common entities by a
    product, others by their coincidences.
    """
    total, held = len(size), np.bincount(codes)
    common = np.flatnonzero(held > total / 20)
    column = np.full(len(held), -1)
    column[common] = np.arange(len(common))
    dense = np.zeros((total, len(common)), np.float32)
    at = column[codes]
    dense[rows[at >= 0], at[at >= 0]] = 1
    rare = (at < 0) & (held[codes] > 1)
    rows, codes = rows[rare], codes[rare]
    # sets of a in order of size, so that the rows of a tile that need as many common entities lie together
    a = a[np.argsort(size[a], kind="stable")]
    place = np.full(total, -1)
    place[b] = np.arange(len(b))
    inside = place[rows] >= 0
    order = np.argsort(codes[inside], kind="stable")
    b_place, b_codes = place[rows[inside]][order], codes[inside][order]
    starts = np.searchsorted(b_codes, np.arange(len(held) + 1))
    place = np.full(total, -1)
    place[a] = np.arange(len(a))
    inside = place[rows] >= 0
    order = np.argsort(place[rows[inside]], kind="stable")
    a_place, a_codes = place[rows[inside]][order], codes[inside][order]
    most = int(2 * size.max(initial=0))
    need = np.full(most + 1, most + 1)
    for n in range(most + 1):
        shared = np.arange(1, n // 2 + 1)
        enough = shared[shared / (n - shared) > threshold]
        need[n] = enough[0] if len(enough) else most + 1
    b_dense, step = dense[b].T.copy(), max(1, cells // max(1, len(b)))
    for i in range(0, len(a), step):
        part = a[i : i + step]
        both = dense[part] @ b_dense if len(common) else np.zeros((len(part), len(b)), np.float32)
        low, high = np.searchsorted(a_place, [i, i + len(part)])
        mine, count = a_codes[low:high], starts[a_codes[low:high] + 1] - starts[a_codes[low:high]]
        hit = np.repeat(starts[mine] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        np.add.at(both.reshape(-1), np.repeat(a_place[low:high] - i, count) * len(b) + b_place[hit], np.float32(1))
        alike = np.empty(both.shape, bool)
        sizes, first = np.unique(size[part], return_index=True)
        for n, x, y in zip(sizes, first, [*first[1:], len(part)], strict=True):
            np.greater_equal(both[x:y], need[n + size[b]].astype(np.float32)[None], out=alike[x:y])
        yield part, both, alike


def _count_links(rows: np.ndarray, codes: np.ndarray, size: np.ndarray, members: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each set of ``a`` the members of the sets of ``b`` that are alike, and the other way round."""
    links, right = np.zeros(len(size), np.int64), np.zeros(len(b), np.int64)
    b_many = np.flatnonzero(members[b] > 1)
    b_extra = (members[b][b_many] - 1).astype(float)
    for part, _, alike in _tiles(rows, codes, size, a, b, threshold):
        if same:
            alike &= part[:, None] != b[None]
        links[part] = np.count_nonzero(alike, axis=1) + (alike[:, b_many].astype(float) @ b_extra).astype(np.int64)
        if not same:
            many = members[part] > 1
            right += alike.sum(axis=0, dtype=np.int64) + ((members[part][many] - 1).astype(float) @ alike[many]).astype(np.int64)
    return links[a], right


def entity_links(atoms: DataFrame, atom: str = "atom_id", entities: str = "entities", threshold: float = 0.05, block_rows: int = LINK_BLOCK) -> DataFrame:
    """(atom, class_id, n_links): atoms of equal entity sets are a class, named by its least atom; with how many other atoms
    each has a Jaccard similarity over ``threshold``. Atoms without entities have neither class nor links.

    The links themselves may be a share of all pairs, and none is written. Distinct sets meet as pairs of blocks, a task
    for each two, that count; what is shuffled grows with the blocks, of which there are ``LINK_BLOCKS`` until they are full.
    """
    sets = atoms.select(F.col(atom).alias("id"), F.array_sort(F.array_distinct(entities)).alias("e"))
    full = sets.where(F.size("e") > 0)
    classes = materialize(full.groupBy("e").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members")), "sets")
    kind, n = dict(classes.dtypes)["rep"], classes.count()
    blocks = max(-(-n // block_rows), min(-(-n // LINK_ROWS), LINK_BLOCKS), 1)
    mine = F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")
    dealt = classes.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "members", "e")

    def meet(table: pa.Table) -> pa.Table:
        own, members = np.asarray(table.column("mine")), np.asarray(table.column("members"))
        names = table.column("e").combine_chunks()
        size = np.asarray(names.value_lengths()).astype(np.int64)
        codes = np.asarray(names.flatten().dictionary_encode().indices)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        left, right = _count_links(np.repeat(np.arange(len(size)), size), codes, size, members, a, b, i == j, threshold)
        at, links = (a, left) if i == j else (np.concatenate([a, b]), np.concatenate([left, right]))
        return pa.table({"rep": table.column("rep").combine_chunks().take(pa.array(at)), "links": links})

    links = dealt.groupBy("i", "j").applyInArrow(meet, f"rep {kind}, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    # equal sets have a similarity of 1
    known = classes.join(links, "rep").select("e", F.col("rep").alias("class_id"), (F.col("links") + (F.col("members") - 1 if threshold < 1 else F.lit(0))).alias("n_links"))
    return sets.join(known, "e", "left").select(F.col("id").alias(atom), "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def dyadic_cover(first: str, last: str, top: int) -> Column:
    """The fewest intervals [i 2**l, (i + 1) 2**l) that make up the whole numbers from ``first`` to ``last``, as (l, i)."""
    # at each level the intervals within the span whose double-sized parent isn't: at most one at each end, or two
    low, high = (lambda level: f"(-shiftright(-{first}, {level}))"), (lambda level: f"shiftright({last} + 1, {level})")
    l0, h0, l1, h1 = low("l"), high("l"), f"2 * {low('l + 1')}", f"2 * {high('l + 1')}"
    ends = f"array(if({l0} < {l1}, {l0}, null), if({h1} < {h0}, {h0} - 1, null))"
    inner = f"if({l0} < {h0}, sequence({l0}, {h0} - 1), array())"
    held = f"filter(if({l1} < {h1}, {ends}, {inner}), x -> x is not null)"
    return F.expr(f"flatten(transform(sequence(0, {top}), l -> transform({held}, x -> struct(l as level, cast(x as bigint) as place))))")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], grain: float = 60.0) -> DataFrame:
    """Each pair of spans of ``left`` (keys, a, s1, e1) and ``right`` (keys, b, s2, e2) with equal keys that overlap.

    Two spans overlap where one's start lies in the other. Spans are covered by dyadic intervals, starts name the dyadic
    interval of each size that holds them, and each start meets a span in exactly one. A span of any length is a few rows,
    two for each power of two in it, whatever ``grain`` is; pairs that don't overlap meet only within a grain.
    """
    cell = lambda c: F.floor(F.col(c) / grain)
    left, right = (d.where(F.col(e) > F.col(s)).withColumns({"c1": cell(s), "c2": cell(e)}) for d, s, e in ((left, "s1", "e1"), (right, "s2", "e2")))
    longest = [d.agg(F.max(F.col("c2") - F.col("c1"))).first()[0] or 0 for d in (left, right)]
    out = None
    for spans, starts, longest_, inside in ((left, right, longest[0], "s2 >= s1 and s2 < e1"), (right, left, longest[1], "s1 > s2 and s1 < e2")):
        top = max(1, int(longest_ + 1).bit_length())
        covers = spans.withColumn("__at", F.explode(dyadic_cover("c1", "c2", top))).drop("c1", "c2")
        levels = F.expr(f"transform(sequence(0, {top}), l -> struct(l as level, shiftright(c1, l) as place))")
        met = covers.join(starts.withColumn("__at", F.explode(levels)).drop("c1", "c2"), [*keys, "__at"]).where(inside).select(*keys, "a", "s1", "e1", "b", "s2", "e2")
        out = met if out is None else out.unionByName(met)
    return out


def aligned(spans: DataFrame, within: str = "source", grain: float = 60.0) -> DataFrame:
    """ALIGNED_WITH between audio and text spans of a source that overlap, weighted by the share of the audio span."""
    a = spans.where("kind = 'audio'").select(within, F.col("id").alias("a"), F.col("start").alias("s1"), F.col("stop").alias("e1"))
    t = spans.where("kind = 'text'").select(within, F.col("id").alias("b"), F.col("start").alias("s2"), F.col("stop").alias("e2"))
    overlap = F.least("e1", "e2") - F.greatest("s1", "s2")
    return reversed_too(overlapping(a, t, [within], grain).select(*edge("a", "b", "ALIGNED_WITH", overlap / (F.col("e1") - F.col("s1")))))


def grounded(images: DataFrame, texts: DataFrame, within: str = "source", vector: str = "clip", threshold: float = 0.25, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """VISUAL_GROUNDED_IN in both directions between images (or video frames) and texts of a source alike in joint space.

    Exact within a source: blocks of its images meet blocks of its texts in matrix products, a task for each two blocks,
    which writes pairs out as they are found. Each vector goes out once for each block of the other side, of which there
    are ``LEAST_BLOCKS`` until they are full.
    """
    kinds = dict(images.dtypes)
    sides = [d.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(within).alias("w"), F.size(vector).alias("d"), F.col("atom_id").alias("id"), (F.col(vector) if kinds[vector] == dict(texts.dtypes)[vector] == "array<float>" else as_double(F.col(vector))).alias("v")) for d in (images, texts)]
    count = F.count(F.lit(1))
    sizes = [d.groupBy("w", "d").agg(F.greatest(F.ceil(count / block_rows), F.least(F.ceil(count / LEAST_ROWS), F.lit(LEAST_BLOCKS))).cast("int").alias(n)) for d, n in zip(sides, ("ni", "nt"), strict=True)]
    counts = materialize(sizes[0].join(sizes[1], ["w", "d"]), "source-blocks")
    dealt = []
    for k, (side, own, other) in enumerate(zip(sides, ("ni", "nt"), ("nt", "ni"), strict=True)):
        rows = side.join(counts, ["w", "d"])
        mine, every = F.pmod(F.xxhash64("id"), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        rows = rows.withColumn("b" if k == 0 else "c", mine).withColumn("c" if k == 0 else "b", every)
        dealt.append(rows.select("w", "d", "b", "c", "id", "v", F.lit(k).alias("side")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        side, ids, m = np.asarray(table.column("side")), table.column("id").combine_chunks(), unit_rows(table.column("v"))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        step, other = max(1, (1 << 21) // max(1, len(b))), m[b].T.copy()
        for at in range(0, len(a), step):
            cos = m[a[at : at + step]] @ other
            i, j = np.nonzero(cos >= threshold)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a[at + i])), ids.take(pa.array(b[j])), pa.array(np.minimum(1.0, cos[i, j]))], names=["a", "b", "cos"])

    met = dealt[0].unionByName(dealt[1]).groupBy("w", "d", "b", "c").applyInArrow(meet, f"a {kinds['atom_id']}, b {kinds['atom_id']}, cos double")
    return reversed_too(met.select(*edge("a", "b", "VISUAL_GROUNDED_IN", F.col("cos"))))


def build(atoms: DataFrame, near: bool = False) -> DataFrame:
    """All edges of a set of atoms with weights normalised by type, in one call.

    ``atoms``: atom_id, source, resolution, modality, ts, embedding, entities (array); with start and stop also ALIGNED_WITH
    between audio and text, with a joint-space vector ``clip`` also VISUAL_GROUNDED_IN between images or frames and texts.
    Weights need each type's mean first, so that pairs are found twice: once for that, once as they leave. Time grows with
    the pairs, what is on disk with the atoms.
    """
    atoms = materialize(atoms, "atoms")
    # a few edges an atom are written; edges that may be a share of all pairs are found again where they are read
    few = [part_of(atoms, "fine", "mid"), part_of(atoms, "mid", "coarse"), next_edges(atoms), similar(atoms, near=near)]
    parts = [materialize(reduce(DataFrame.unionByName, few), "edges"), entity_shared(atoms)]
    if {"start", "stop"} <= set(atoms.columns):
        parts.append(aligned(atoms.select("source", F.col("atom_id").alias("id"), F.col("modality").alias("kind"), "start", "stop")))
    if "clip" in atoms.columns:
        parts.append(grounded(atoms.where("modality in ('image', 'video')"), atoms.where("modality = 'text'")))
    return normalized(reduce(DataFrame.unionByName, parts))


def normalized(edges: DataFrame, keys: tuple[str, ...] = ("edge_type",)) -> DataFrame:
    """Weights as the sigmoid of their z-score within the edge type (and, with more keys, within the batch)."""
    stats = edges.groupBy(*keys).agg(F.avg("weight").alias("__m"), F.stddev_pop("weight").alias("__s"))
    z = (F.col("weight") - F.col("__m")) / (F.col("__s") + 1e-8)
    return edges.join(F.broadcast(stats) if keys == ("edge_type",) else stats, list(keys)).withColumn("weight", 1 / (1 + F.exp(-z))).drop("__m", "__s")  # one row for each edge type


def updated_weight(edges: DataFrame, usage: DataFrame, rho: float = 0.05) -> DataFrame:
    """Moving average of stored weight and usage (src, dst, used) where there is usage."""
    rows = edges.join(usage.select("src", "dst", "used"), ["src", "dst"], "left")
    return rows.withColumn("weight", F.when(F.col("used").isNull(), F.col("weight")).otherwise((1 - rho) * F.col("weight") + rho * F.col("used"))).drop("used")


def oriented(edges: DataFrame) -> DataFrame:
    """Edges seen from either end: (edge_id, node, other, edge_type, weight)."""
    e = edges if "edge_id" in edges.columns else edges.withColumn("edge_id", F.xxhash64("src", "dst", "edge_type", "weight"))
    out = e.select("edge_id", F.col("src").alias("node"), F.col("dst").alias("other"), "edge_type", "weight")
    return out.unionByName(e.select("edge_id", F.col("dst").alias("node"), F.col("src").alias("other"), "edge_type", "weight").where("node <> other"))


def neighbors(edges: DataFrame, nodes: DataFrame, direction: str = "any", node: str = "node") -> DataFrame:
    """(node, other, edge_type, weight) over one edge, OUTBOUND, INBOUND or ANY."""
    if direction == "any":
        view = oriented(edges).drop("edge_id")
    else:
        a, b = ("src", "dst") if direction == "outbound" else ("dst", "src")
        view = edges.select(F.col(a).alias("node"), F.col(b).alias("other"), "edge_type", "weight")
    return view.join(nodes.select(F.col(node).alias("node")).distinct(), "node")


def representatives(paths: DataFrame, left: int) -> DataFrame:
    """Of the paths (query_id, node, w, used) to each node those that ``left`` more edges can need.

    Whatever ``left`` edges a path goes on with, a heaviest one among those that don't hold them is kept: the heaviest
    path; for each of its edges the heaviest without that edge; and so on, ``left`` times. So rows are bounded by the
    reached nodes, however many paths lead to them.
    """
    if left == 0:
        return paths.groupBy("query_id", "node").agg(F.max("w").alias("w"))
    paths = materialize(paths, "paths")
    without = paths.select("query_id", "node", F.array().cast("array<bigint>").alias("without")).distinct()
    kept = None
    for k in range(left + 1):
        open_ = paths.join(without, ["query_id", "node"]).where(~F.arrays_overlap("used", "without"))
        best = open_.groupBy("query_id", "node", "without").agg(F.max(F.struct("w", "used")).alias("best"))
        if k < left:
            best = materialize(best, "best-paths")
            without = best.select("query_id", "node", F.explode(F.transform("best.used", lambda e: F.array_sort(F.array_append("without", e)))).alias("without")).distinct()
        found = best.select("query_id", "node", "best.w", "best.used")
        kept = found if kept is None else kept.unionByName(found)
    return kept.distinct()


def traverse(edges: DataFrame, seeds: DataFrame, hops: int = 2, edge_types: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(query_id, node, distance, path_weight) over up to ``hops`` edges from each query's seeds (query_id, seed).

    No path uses an edge twice. A node has its least distance and the greatest sum of weights over its paths. With
    ``limit`` the nearest, then heaviest, then least nodes of each query are kept (a top-k). Of the paths to a node only
    those are kept that further edges can need: two for two hops, so that a hub costs its edges and not their square.
    """
    view = oriented(edges if edge_types is None else edges.where(F.col("edge_type").isin(edge_types))).select("node", "other", "edge_id", "weight")
    front = seeds.select("query_id", F.col("seed").alias("node"), F.lit(0.0).alias("w"), F.array().cast("array<bigint>").alias("used")).distinct()
    reached = None
    for d in range(1, hops + 1):
        paths = front.join(view, "node").where(~F.array_contains("used", F.col("edge_id")))
        paths = paths.select("query_id", F.col("other").alias("node"), (F.col("w") + F.col("weight")).alias("w"), F.array_append("used", F.col("edge_id")).alias("used"))
        if d == 1 < hops:
            # first edges differ, so the heaviest ``hops`` of them are those that can be needed
            heaviest = Window.partitionBy("query_id", "node").orderBy(F.desc("w"), "used")
            front = materialize(paths.withColumn("__r", F.row_number().over(heaviest)).where(F.col("__r") <= hops).drop("__r"), "paths")
        else:
            front = representatives(paths, hops - d)
        hop = front.groupBy("query_id", "node").agg(F.max("w").alias("w")).withColumn("d", F.lit(d))
        reached = hop if reached is None else reached.unionByName(hop)
    out = reached.groupBy("query_id", "node").agg(F.min("d").alias("distance"), F.max("w").alias("path_weight"))
    if limit is None:
        return out
    best = Window.partitionBy("query_id").orderBy("distance", F.desc("path_weight"), "node")
    return out.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= limit).drop("__r")


def pagerank_step(state: DataFrame, out_edges: DataFrame, homes: DataFrame, alpha: float) -> DataFrame:
    """One round of personalised PageRank in which weights are not normalised and only receivers keep mass.

    A node sends score * weight / out-degree over each edge; the score of nodes without edges is summed for a query, then
    dealt evenly to its seeds; the teleport share ``t`` goes only to seeds that received mass. Also ``old``, the score
    before; ``score`` is null where nothing was received. ``state`` is a written table, as it is read three times.
    """
    live, nothing = state.where("score is not null"), F.lit(None).cast("double")
    sent = live.join(out_edges, live["node"] == out_edges["src"]).select("query_id", F.col("dst").alias("node"), (F.col("score") * F.col("weight") / F.col("degree")).alias("m"))
    ends = live.join(out_edges, live["node"] == out_edges["src"], "left_anti").groupBy("query_id").agg(F.sum("score").alias("pool"))
    back = ends.join(homes, "query_id").select("query_id", F.explode("homes").alias("node"), (F.col("pool") / F.size("homes")).alias("m"))
    rows = sent.unionByName(back).withColumn("t", nothing).withColumn("old", nothing)
    rows = rows.unionByName(state.select("query_id", "node", nothing.alias("m"), "t", F.col("score").alias("old")))
    got = rows.groupBy("query_id", "node").agg(*[f(c).alias(c) for c, f in (("m", F.sum), ("t", F.max), ("old", F.max))])
    score = F.when(F.col("m").isNotNull(), alpha * F.coalesce("t", F.lit(0.0)) + (1 - alpha) * F.col("m"))
    return got.select("query_id", "node", "t", "old", score.alias("score"))


def personalized_pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.15, iterations: int = 20, tolerance: float | None = 1e-6) -> DataFrame:
    """(query_id, node, score). Stops when no score moves by ``tolerance`` and returns the round before, or after ``iterations``.

    Each round that another one or the test reads is written to the shared folder, beside the scores before it.
    """
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    out_edges = materialize(edges.select("src", "dst", "weight").join(degree, "src"), "out-edges")
    homes = materialize(seeds.groupBy("query_id").agg(F.collect_list("seed").alias("homes")), "homes")  # a query has few seeds
    share = 1.0 / F.size("homes")
    state = homes.select("query_id", F.explode("homes").alias("node"), share.alias("t"), share.alias("score"))
    for k in range(iterations):
        after = pagerank_step(state, out_edges, homes, alpha)
        if tolerance is not None:
            # how far scores move is seen while they are written
            seen = Observation()
            after = after.observe(seen, F.max(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("moved"))
        if tolerance is not None or k + 1 < iterations:
            after = materialize(after, "pagerank")
        if tolerance is not None:
            moved = seen.get["moved"]
            if moved is not None and moved < tolerance:
                break
        state = after.drop("old").where("score is not null or t is not null")
    return state.select("query_id", "node", "score").where("score is not null")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, a, b, weight): undirected simple edges with both ends among a query's nodes (query_id, node); the last by id wins."""
    e = edges if "edge_id" in edges.columns else edges.withColumn("edge_id", F.xxhash64("src", "dst", "edge_type", "weight"))
    n = nodes.select("query_id", "node").distinct()
    inside = e.where("src <> dst").join(n.select("query_id", F.col("node").alias("src")), "src").join(n.select("query_id", F.col("node").alias("dst")), ["query_id", "dst"])
    return inside.groupBy("query_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max_by("weight", "edge_id").alias("weight"))


def degree_centrality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, node, degree): distinct neighbours in the induced graph over n - 1 (1 for a single node)."""
    e = induced(edges, nodes)
    ends = e.select("query_id", F.col("a").alias("node")).unionAll(e.select("query_id", F.col("b").alias("node")))
    n = nodes.select("query_id", "node").distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    count = ends.groupBy("query_id", "node").agg(F.count(F.lit(1)).alias("d"))
    return n.join(count, ["query_id", "node"], "left").select("query_id", "node", F.when(F.col("n") == 1, 1.0).otherwise(F.coalesce("d", F.lit(0)) / (F.col("n") - 1)).alias("degree"))


def dependencies(adjacent: dict, sources: list) -> dict:
    """How much shortest paths from ``sources`` depend on each node, weights being distances: one Dijkstra with path counts each."""
    import heapq

    total = dict.fromkeys(adjacent, 0.0)
    for s in sources:
        order, before, paths, dist, seen = [], {s: []}, {s: 1.0}, {}, {s: 0.0}
        queue, tick = [(0.0, 0, s)], 0
        while queue:
            d, _, v = heapq.heappop(queue)
            if v in dist:
                continue
            dist[v] = d
            order.append(v)
            for u, w in adjacent[v].items():
                far = d + w
                if u not in dist and (u not in seen or far < seen[u] - 1e-15):
                    seen[u], paths[u], before[u] = far, paths[v], [v]
                    tick += 1
                    heapq.heappush(queue, (far, tick, u))
                elif u not in dist and abs(far - seen[u]) <= 1e-15:
                    paths[u] += paths[v]
                    before[u].append(v)
        share = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in before[v]:
                share[u] += paths[u] / paths[v] * (1 + share[v])
            if v != s:
                total[v] += share[v]
    return total


def _roots(n: int, a: list[int], b: list[int]) -> np.ndarray:
    """For each of ``n`` nodes one node of its connected component."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(a, b, strict=True):
        root[top(x)] = top(y)
    return np.array([top(x) for x in range(n)], np.int64)


#: Cells (nodes x sources) of a block of searches and of a step of one; components up to ``SMALL`` are searched one source at a time.
SEARCH_CELLS, STEP_CELLS, SMALL = 1 << 21, 1 << 17, 24


class _Searches:
    """Shortest paths from many sources of one component at once, a column for each source."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray):
        # nodes in order of their number of neighbours, most first, so that of any rows those that have a k-th come first
        self.n, degree = n, np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        self.order = np.argsort(-degree, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        a, b = self.place[a], self.place[b]
        head, tail, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
        by_head = np.argsort(head, kind="stable")
        self.head, self.tail, self.w, self.degree = head[by_head], tail[by_head], w[by_head], degree[self.order]
        self.start = np.searchsorted(self.head, np.arange(n + 1))
        # with weights that a distance can't tell from 0 a distance isn't an order
        self.regular = bool(np.isfinite(w).all() and w.min() > max(1e-9, w.sum() * 2.0**-50))
        self.most_rounds = 64 + 8 * int(n**0.5)

    def neighbours(self, rows: np.ndarray):
        """For each k the number of ``rows`` that have a k-th neighbour, those neighbours, and the arcs' weights."""
        degree = self.degree[rows]
        for k in range(degree[0]):
            m = int(np.searchsorted(-degree, -k))
            arc = self.start[rows[:m]] + k
            yield m, self.tail[arc], self.w[arc][:, None]

    def distances(self, own: np.ndarray) -> np.ndarray | None:
        """Distances of all nodes (rows) from ``own``; None where paths are so long that searches one by one are faster."""
        dist = np.full((self.n, len(own)), np.inf)
        dist[own, np.arange(len(own))] = 0.0
        changed, step = np.zeros(self.n, bool), max(1, STEP_CELLS // len(own))
        changed[own] = True
        for _ in range(self.most_rounds):
            near_changed = np.zeros(self.n, bool)
            near_changed[self.tail[changed[self.head]]] = True
            todo = np.flatnonzero(near_changed)
            changed = np.zeros(self.n, bool)
            for i in range(0, len(todo), step):
                rows = todo[i : i + step]
                before = dist[rows]
                near = before.copy()
                for m, tail, w in self.neighbours(rows):
                    far = dist[tail]
                    far += w
                    np.minimum(near[:m], far, out=near[:m])
                changed[rows] = (near < before).any(axis=1)
                dist[rows] = near
            if not changed.any():
                return dist
        return None

    def depend(self, own: np.ndarray) -> np.ndarray | None:
        """The sum over ``own`` of how much their shortest paths depend on each node."""
        own = self.place[own]
        dist = self.distances(own)
        if dist is None:
            return None
        before, several, step = np.zeros(dist.shape, np.int32), np.zeros(len(own), bool), max(1, STEP_CELLS // len(own))
        for i in range(0, self.n, step):
            rows = np.arange(i, min(self.n, i + step))
            here, up = dist[rows], np.full((len(rows), len(own)), -1, np.int32)
            for m, tail, w in self.neighbours(rows):
                near = dist[tail]
                on = near < here[:m]
                near += w
                on &= near <= here[:m] + 1e-15
                several |= (on & (up[:m] >= 0)).any(axis=0)
                np.copyto(up[:m], tail[:, None], where=on, casting="same_kind")
            before[rows] = up
        single = np.flatnonzero(~several)
        out = self._trees(dist[:, single], before[:, single], own[single])
        for c in np.flatnonzero(several).tolist():
            far = dist[:, c]
            on = (far[self.tail] + self.w <= far[self.head] + 1e-15) & (far[self.tail] < far[self.head])
            out += self._paths(far, np.flatnonzero(on), int(own[c]))
        return out[self.place]

    def _trees(self, dist: np.ndarray, before: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Where each node has one predecessor, the nodes behind it are those of its subtree."""
        wide = len(own)
        if not wide:
            return np.zeros(self.n)
        column = np.arange(wide)
        order = np.ascontiguousarray(np.argsort(np.ascontiguousarray(dist.T), axis=1).T) * wide + column
        up = (before * wide + column).ravel()
        size = np.ones(self.n * wide)
        for at in order[:0:-1]:
            size[up[at]] += size[at]
        size = size.reshape(self.n, wide)
        size[own, column] = 1.0
        return size.sum(axis=1) - wide

    def _paths(self, dist: np.ndarray, on: np.ndarray, source: int) -> np.ndarray:
        """One source with several shortest paths to a node: ``on`` are the arcs of shortest paths, by head."""
        order = np.argsort(dist).tolist()
        first = np.searchsorted(self.head[on], np.arange(self.n + 1)).tolist()
        tail = self.tail[on].tolist()
        paths, share = [0.0] * self.n, [0.0] * self.n
        paths[source] = 1.0
        for v in order[1:]:
            paths[v] = sum(paths[u] for u in tail[first[v] : first[v + 1]])
        for v in order[:0:-1]:
            part = (1 + share[v]) / paths[v]
            for u in tail[first[v] : first[v + 1]]:
                share[u] += paths[u] * part
        share[source] = 0.0
        return np.array(share)


def block_dependencies(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """``dependencies`` of the nodes 0 to n - 1, many searches at once: edges a - b of weight w, whose ends are different.

    Components are searched on their own. All sources of a block take a step together, until no distance moves; small
    components, weights near 0 and paths of very many edges are searched one source at a time.
    """
    total, root = np.zeros(n), _roots(n, a.tolist(), b.tolist())
    nodes = np.argsort(root, kind="stable")
    ends = np.flatnonzero(np.diff(root[nodes])) + 1
    place = np.empty(n, np.int64)
    inner = np.argsort(root[a], kind="stable")
    asked = sources[np.argsort(root[sources], kind="stable")]
    for group in np.split(nodes, ends):
        r = root[group[0]]
        own = asked[np.searchsorted(root[asked], r) : np.searchsorted(root[asked], r, "right")]
        if len(group) < 3 or not len(own):
            continue
        e = inner[np.searchsorted(root[a], r, sorter=inner) : np.searchsorted(root[a], r, "right", sorter=inner)]
        place[group] = np.arange(len(group))
        own, x, y, v = place[own], place[a[e]], place[b[e]], w[e]
        search = _Searches(len(group), x, y, v) if len(group) > SMALL else None
        wide = max(8, min(512, SEARCH_CELLS // len(group)))
        for i in range(0, len(own), wide):
            found = search.depend(own[i : i + wide]) if search is not None and search.regular else None
            if found is None:
                one = dependencies(neighbourhoods(list(range(len(group))), list(zip(x.tolist(), y.tolist(), v.tolist(), strict=True))), own[i : i + wide].tolist())
                found = np.array([one[k] for k in range(len(group))])
            total[group] += found
    return total


def neighbourhoods(nodes: list, edges: list[tuple]) -> dict:
    """{node: {neighbour: weight}} of an undirected graph."""
    adjacent: dict = {v: {} for v in nodes}
    for a, b, w in edges:
        adjacent[a][b] = adjacent[b][a] = w
    return adjacent


def betweenness(nodes: list, edges: list[tuple]) -> dict:
    """Betweenness of an undirected graph whose weights are distances, normalised."""
    n = len(nodes)
    return {v: t / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v, t in dependencies(neighbourhoods(nodes, edges), nodes).items()}


#: Tasks of a query, each with the query's graph, until one has ``DEALS`` times its usual work.
DEALS = 64


def structural(edges: DataFrame, nodes: DataFrame, work: int = 1 << 22) -> DataFrame:
    """(query_id, node, degree, betweenness, structural): .6 degree + .4 betweenness in the graph of a query's candidates.

    The searches from a query's candidates are dealt to tasks of about ``work`` steps (sources x edges and nodes), or to
    ``DEALS`` larger ones, each with the query's graph; what they give each node is summed. A task's memory follows the
    query's graph. The steps grow with the square of the candidates; a task takes them for many sources at once.
    """
    e = materialize(induced(edges, nodes), "induced")
    d = materialize(degree_centrality(edges, nodes), "degrees")
    kinds = dict(d.dtypes)
    n = F.count(F.lit(1)).cast("double")
    sizes = d.groupBy("query_id").agg(n.alias("n")).join(e.groupBy("query_id").agg(n.alias("m")), "query_id", "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
    usual = F.ceil(F.col("n") * (F.col("n") + F.col("m")) / work)
    deals = F.least(F.col("n"), F.greatest(F.lit(1.0), F.least(usual, F.lit(DEALS)), F.ceil(usual / DEALS))).cast("int")
    rows = d.select("query_id", F.col("node").alias("a"), F.lit(None).cast(kinds["node"]).alias("b"), F.lit(0.0).alias("weight")).unionByName(e)
    rows = rows.join(sizes.select("query_id", deals.alias("deals")), "query_id").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))

    def run(table: pa.Table) -> pa.Table:
        single = pc.is_null(table.column("b"))
        names = table.column("a").filter(single).combine_chunks()
        names = names.take(pc.array_sort_indices(names))
        inner = table.filter(pc.invert(single)).sort_by([("a", "ascending"), ("b", "ascending")])
        a, b = (np.asarray(pc.index_in(inner.column(c), names)).astype(np.int64) for c in ("a", "b"))
        own = np.arange(table.column("deal")[0].as_py(), len(names), table.column("deals")[0].as_py())
        found = block_dependencies(len(names), a, b, np.asarray(inner.column("weight")), own)
        q = table.column("query_id")[0].as_py()
        return pa.table({"query_id": pa.array([q] * len(names), table.schema.field("query_id").type), "node": names, "part": found})

    parts = rows.groupBy("query_id", "deal").applyInArrow(run, f"query_id {kinds['query_id']}, node {kinds['node']}, part double")
    between_ = parts.groupBy("query_id", "node").agg(F.sum("part").alias("part")).join(sizes, "query_id")
    share = F.when(F.col("n") > 2, F.col("part") / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0)
    out = d.join(between_.select("query_id", "node", share.alias("betweenness")), ["query_id", "node"])
    return out.withColumn("structural", 0.6 * F.col("degree") + 0.4 * F.col("betweenness"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): ends of edges at each node."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def between(edges: DataFrame, nodes: DataFrame, node: str = "atom_id") -> DataFrame:
    """The edges with both ends among ``nodes``."""
    n = nodes.select(F.col(node).alias("__n")).distinct()
    return edges.join(n, edges["src"] == n["__n"], "left_semi").join(n, edges["dst"] == n["__n"], "left_semi")


def touching(edges: DataFrame, nodes: DataFrame, node: str = "fragment_id") -> DataFrame:
    """The edges with either end among ``nodes``."""
    n = nodes.select(F.col(node).alias("__n")).distinct()
    flagged = edges.join(n.select(F.col("__n").alias("__s")), F.col("src") == F.col("__s"), "left").join(n.select(F.col("__n").alias("__d")), F.col("dst") == F.col("__d"), "left")
    return flagged.where("__s is not null or __d is not null").drop("__s", "__d")


def connections(edges: DataFrame, nodes: DataFrame, k: int = 25) -> DataFrame:
    """The ``k`` heaviest connections of each node."""
    best = Window.partitionBy("node").orderBy(F.desc("weight"), "other", "edge_type")
    return neighbors(edges, nodes).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def view_nodes(atoms: DataFrame) -> DataFrame:
    """Nodes as a graph view shows them; null and empty values take defaults."""
    from atomloom.functions.text import preview

    def held(c: str, default: str) -> Column:
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))

    return atoms.select(F.col("atom_id").alias("id"), held("source", "Knowledge Node").alias("name"), F.coalesce(preview(F.nullif(F.col("content"), F.lit(""))), F.lit("Empty Content")).alias("label"), held("modality", "text").alias("group"), held("source", "unknown").alias("source"), held("resolution", "unknown").alias("resolution"))


def matching(nodes: DataFrame, text: str) -> DataFrame:
    """The nodes of a graph view whose name or label holds ``text``, in whichever case."""
    wanted = F.lower(F.lit(text))
    return nodes.where(F.lower("name").contains(wanted) | F.lower("label").contains(wanted))


def view_edges(edges: DataFrame) -> DataFrame:
    """Edges as a graph view shows them; ids lose their collection."""
    key = lambda c: F.element_at(F.split(c, "/"), -1)
    return edges.select(key("src").alias("source"), key("dst").alias("target"), F.col("edge_type").alias("label"), "weight")

