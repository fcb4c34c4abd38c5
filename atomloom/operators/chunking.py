"""Documents to chunks ("atoms") at three resolutions. Each function takes rows with an id and a text and explodes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atomloom.functions.text import strip


def _exploded(docs: DataFrame, parts: Column, least: int, key: str, resolution: str) -> DataFrame:
    """(key, idx, content): ``idx`` counts non-empty parts before the length filter."""
    kept = F.filter(F.transform(parts, strip), lambda x: x != "")
    return docs.select(key, F.posexplode(kept).alias("idx", "content")).where(F.length("content") > least).withColumn("resolution", F.lit(resolution))


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return _exploded(docs, F.split(F.col(text), r"\."), 10, key, "fine")


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return _exploded(docs, F.split(F.col(text), "\n\n"), 50, key, "mid")


def whole(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 5000) -> DataFrame:
    return docs.select(key, F.lit(0).alias("idx"), F.substring(text, 1, limit).alias("content"), F.lit("coarse").alias("resolution"))


def text_atoms(docs: DataFrame, base: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All three resolutions with atom ids and times: one second for each sentence, ten for each paragraph."""
    parts = sentences(docs, key, text).unionByName(paragraphs(docs, key, text)).unionByName(whole(docs, key, text))
    step = F.when(F.col("resolution") == "fine", 1).when(F.col("resolution") == "mid", 10).otherwise(0)
    return parts.select(F.concat_ws(":", "resolution", F.col(key).cast("string"), F.col("idx").cast("string")).alias("atom_id"), key, "resolution", "idx", "content", (base + step * F.col("idx")).cast("double").alias("ts"))


def page_sentences(pages: DataFrame, key: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """Sentences of paged documents; ``sentence`` counts the kept ones of a document over its pages."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(text, "\n", " "), r"\."), strip), lambda x: F.length(x) > 20)
    rows = pages.select(key, page, F.posexplode(parts).alias("pos", "content"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(page, "pos")) - 1
    return rows.select(key, page, n.alias("sentence"), F.concat("content", F.lit(".")).alias("content"), (n * 0.01).alias("offset"))


def page_paragraphs(pages: DataFrame, key: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """Paragraphs over 50 characters of paged documents; pages without blank lines give their long lines."""
    blocks = F.split(F.col(text), "\n\n")
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.length(strip(x)) > 50)
    parts = F.transform(F.when(F.size(blocks) <= 1, lines).otherwise(blocks), strip)
    rows = pages.select(key, page, F.posexplode(parts).alias("idx", "content")).where(F.length("content") > 50)
    return rows.withColumn("offset", F.col(page) + F.col("idx") * 0.1)


def page_atoms(pages: DataFrame, key: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    return pages.where(strip(F.col(text)) != "").select(key, page, F.col(text).alias("content"))


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4000, limit: int = 20_000) -> DataFrame:
    """Fixed windows over the first ``limit`` characters."""
    n = F.least(F.length(text), F.lit(limit))
    at = F.explode(F.sequence(F.lit(0), n - 1, F.lit(size)))
    rows = docs.where(F.length(text) > 0).select(key, text, at.alias("start"))
    stop = F.least(F.lit(limit), F.col("start") + size) - F.col("start")
    return rows.select(key, (F.col("start") / size).cast("int").alias("idx"), F.substr(F.col(text), F.col("start") + 1, stop).alias("content"))


def join_pages(pages: DataFrame, key: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """The pages of each document in order, joined by blank lines."""
    parts = F.array_sort(F.collect_list(F.struct(page, text)))
    return pages.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x[text]), "\n\n").alias(text))


def frame_times(videos: DataFrame, key: str = "video_id", duration: str = "duration", every: float = 5.0) -> DataFrame:
    """(key, frame, at): one frame every ``every`` seconds from 0 on, before the end."""
    n = F.ceil(F.col(duration) / every).cast("int")
    return videos.where(F.col(duration) > 0).select(key, F.explode(F.sequence(F.lit(0), n - 1)).alias("frame")).withColumn("at", F.col("frame") * every)


def recursive_chunks(c: Column, size: int = 6000, overlap: int = 400) -> Column:
    """Array of chunks: paragraphs packed up to ``size``; long paragraphs by sentences, long sentences by hard cuts.

    A fold over units. Each paragraph is one unit of its own kind, and a paragraph over ``size`` is its sentences. The
    buffer that a long paragraph leaves takes in what follows.
    """
    text, blank = F.lit(""), F.array().cast("array<string>")
    paragraph = "struct<s:string,k:int>"

    def units(p: Column) -> Column:
        one = F.array(F.struct(p.alias("s"), F.lit(0).alias("k")))
        many = F.transform(F.split(p, r"(?<=[.!?])\s+"), lambda s, i: F.struct(s.alias("s"), F.when(i == 0, 1).otherwise(2).alias("k")))
        return F.when(F.length(p) <= size, one).otherwise(many).cast(f"array<{paragraph}>")

    def flushed(state: Column) -> Column:
        return F.when(state["cur"] != "", F.array_append(state["out"], strip(state["cur"]))).otherwise(state["out"])

    def made(out: Column, cur: Column) -> Column:
        return F.struct(out.alias("out"), cur.alias("cur"))

    def pieces(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.length(s) - 1, F.lit(size - overlap)), lambda i: F.substr(s, i + 1, F.lit(size)))

    def step(state: Column, u: Column) -> Column:
        s = u["s"]
        plain = F.when(F.length(state["cur"]) + F.length(s) + 2 <= size, made(state["out"], F.concat(state["cur"], s, F.lit("\n\n")))).otherwise(made(flushed(state), F.concat(s, F.lit("\n\n"))))
        # the first sentence of a long paragraph starts a new buffer
        base = F.when(u["k"] == 1, made(flushed(state), text)).otherwise(state)
        room = F.length(base["cur"]) + F.length(s) + 1 <= size
        long_ = F.length(s) > size
        sentence = (
            F.when(room, made(base["out"], F.concat(base["cur"], s, F.lit(" "))))
            .when(long_, made(F.concat(flushed(base), pieces(s)), text))
            .otherwise(made(flushed(base), F.concat(s, F.lit(" "))))
        )
        return F.when(u["k"] == 0, plain).otherwise(sentence)

    every = F.flatten(F.transform(F.split(c, r"\n\s*\n"), units))
    folded = F.aggregate(every, made(blank, text), step, lambda s: F.when(strip(s["cur"]) != "", F.array_append(s["out"], strip(s["cur"]))).otherwise(s["out"]))
    return F.when(F.length(c) <= size, F.array(c)).when(F.size(folded) > 0, folded).otherwise(F.array(F.substring(c, 1, size)))


def sampled(chunks: Column, most: int = 8) -> Column:
    """The chunks, or of more than ``most`` two fifths from the start, the middle, one fifth from the end."""
    head, tail = most * 2 // 5, most // 5
    middle = most - head - tail
    at = F.floor(F.size(chunks) / 2).cast("int") - middle // 2 + 1
    cut = F.concat(F.slice(chunks, 1, head), F.slice(chunks, at, F.lit(middle)), F.slice(chunks, -tail, tail))
    return F.when(F.size(chunks) > most, cut).otherwise(chunks)


def extraction_units(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 6000, most: int = 8) -> DataFrame:
    """(key, depth, idx, content): the texts that findings are extracted from. Short ones at depth 0, else their chunks."""
    chunks = sampled(recursive_chunks(F.col(text), size), most)
    rows = docs.select(key, F.when(F.length(text) <= size, 0).otherwise(1).alias("depth"), F.posexplode(chunks).alias("idx", "content"))
    return rows.withColumn("content", F.substring("content", 1, 12_000))
