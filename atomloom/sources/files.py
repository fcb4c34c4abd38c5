"""File sources as rows of content: every reader goes through Spark, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File suffixes by kind.
KINDS = {
    "text": ["txt", "md"], "pdf": ["pdf"], "docx": ["docx", "doc"], "pptx": ["pptx", "ppt"],
    "image": ["jpg", "jpeg", "png", "gif", "webp"], "audio": ["mp3", "wav", "m4a", "ogg"],
    "video": ["mp4", "avi", "mov", "mkv"], "csv": ["csv", "tsv"], "excel": ["xlsx", "xls"],
}


def kind_of(path: Column) -> Column:
    """The kind of a file by its lower-case suffix; null for others."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = F.lit(None).cast("string")
    for name, suffixes in KINDS.items():
        out = F.when(suffix.isin(suffixes), name).otherwise(out)
    return out


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "[/\\\\]"), -1)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, kind, length, modified) of files, without their content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", file_name(F.col("path")).alias("name"), kind_of(F.col("path")).alias("kind"), "length", F.col("modificationTime").alias("modified"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, source, text) of whole text files."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.withColumn("source", file_name(F.col("path")))


def images(spark: SparkSession, path: str) -> DataFrame:
    """One atom for each image: its name, path, size and format."""
    rows = listing(spark, path).where("kind = 'image'")
    return rows.select(F.concat(F.lit("Image: "), "name").alias("content"), F.lit("image").alias("modality"), F.lit("fine").alias("resolution"), F.map_from_arrays(F.array(F.lit("path"), F.lit("bytes"), F.lit("format")), F.array("path", F.col("length").cast("string"), F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))).alias("metadata"), F.col("name").alias("source"))


def csv_schema(table: DataFrame, name: str) -> DataFrame:
    """The coarse atom of a table: its columns and shape."""
    n = len(table.columns)
    shape = F.concat(F.lit(f"Columns: {', '.join(table.columns)}\nShape: ("), F.count(F.lit(1)).cast("string"), F.lit(f", {n})"))
    return table.agg(shape.alias("content")).withColumn("source", F.lit(name)).withColumn("resolution", F.lit("coarse"))


def row_text(columns: list[str]) -> Column:
    """"column: value" for each column; null shows as nan."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("nan"))) for c in columns])


def csv_rows(table: DataFrame, order: list[str], rows: int | None = 100) -> DataFrame:
    """Row atoms of a table (idx, content), the first ``rows`` in order."""
    first = table.orderBy(*order).limit(rows) if rows is not None else table
    # at most ``rows`` rows are numbered in one task
    idx = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1 if rows is not None else F.lit(None).cast("int")
    return first.select(idx.alias("idx"), row_text(table.columns).alias("content"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, separator: str = ",") -> DataFrame:
    reader = spark.read.option("header", "true").option("sep", separator)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", "true").csv(path)


def transcripts(segments: DataFrame, key: str = "audio_id", base: str = "ts") -> DataFrame:
    """Speech segments (key, idx, start, stop, text) as fine atoms, and each transcript as a coarse one."""
    fine = segments.select(key, F.col("idx"), F.col("text").alias("content"), F.lit("fine").alias("resolution"), (F.col(base) + F.col("start")).alias("ts"), (F.col("stop") - F.col("start")).alias("duration"))
    parts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    whole = segments.groupBy(key).agg(F.lit(-1).alias("idx"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("content"), F.lit("coarse").alias("resolution"), F.min(base).cast("double").alias("ts"), F.max("stop").alias("duration"))
    return fine.unionByName(whole)


def pages_as_atoms(pages: DataFrame, url: str = "url", html: str = "html", limit: int = 5000) -> DataFrame:
    """One coarse atom for each page: the first characters of its text."""
    from atomloom.functions.text import html_text

    text = F.substring(html_text(F.col(html)), 1, limit)
    return pages.select(F.col(url).alias("source"), text.alias("content"), F.lit("coarse").alias("resolution"), F.lit("text").alias("modality")).where(F.length("content") > 0)
