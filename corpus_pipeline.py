"""Corpus pipeline: quality, line dedup, near-dedup, decontamination, encoding. A stage sees all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from atomloom.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from atomloom.llm.common import quoted
from atomloom.llm.queries import grade
from atomloom.session import materialize


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text where there is such a column."""
    if "n_chars" in like.columns and "text" in like.columns:
        df = df.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return df.select(*[quoted(c) for c in like.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability of the best grade is high enough; labels train the classifier."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), grade())
    return _columns(quality.score(docs, model, select=2, prefix="__").where("__kept"), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go; documents stay, even if nothing is left of their text."""
    return _columns(line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1, prefix="__"), docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of near copies (five words, 0.8)."""
    return _columns(near_dedup.drop_near_copies(docs, shingle=5, percent=80), docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or all of a shorter one) go."""
    return _columns(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents", size=10), docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with ids (array of int) and n_tokens."""
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: The classifier and the tokenizer can't be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
