"""The queries opN_<name> of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.llm import bpe, decontaminate, divergence, id_files, language_id, line_dedup, near_dedup, quality, simhash, substring_dedup, token_counts, vector_codes, warc
from atomloom.llm.oracles import ORACLE
from atomloom.session import materialize, shared_dir

__all__ = ["ORACLE", "QUERIES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = warc.responses_from_pages(table(spark, sf_dir, "pages"), date="2024-01-01T00:00:00Z")
    made = warc.derive(responses, keep=("page_id",))
    return made.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "block_digest", "n_links", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), size=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def grade():
    """Grades of the labels table: 0 low quality, 1 good but toxic, 2 good; null if a label is."""
    quality_, toxic = F.col("quality"), F.col("toxic")
    return F.when(quality_.isNull() | toxic.isNull(), None).when(quality_ == 0, 0).when(toxic == 1, 1).otherwise(2)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), grade())
    return quality.score(docs, model, select=2).select("doc_id", "expected_grade", "tail", "kept")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    model = language_id.learn(docs.where(part != 1))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (part == 1).alias("held_out"), "lang_pred", "score", "code_bits")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2, percent=80)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("text"), ranks)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe.ids_text("ids"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text")
    lengths = bpe.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_counts.context_limits(materialize(token_counts.length_histogram(lengths), "lengths"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), size=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also n_within, for ids divisible by 20: the documents within three bits of its fingerprint, itself included."""
    rows = simhash.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    asked = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    near = simhash.count_within(rows.select("fingerprint"), rows.where(asked).select("fingerprint"), radius=3)
    return rows.where(~asked).withColumn("n_within", F.lit(None).cast("long")).unionByName(rows.where(asked).join(near, "fingerprint"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"), min_docs=30, top=50)


def op12_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = id_files.write(docs, shared_dir(spark), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return id_files.read(manifest, ids=False)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    coded, books = vector_codes.compress(vectors, parts=16, entries=64, rounds=2)
    return coded.select("vec_id", "code", "error", "label_error").withColumn("codebooks_sha256", F.lit(vector_codes.digest(books)))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality": op3_quality,
    "op4_language_id": op4_language_id,
    "op5_minhash": op5_minhash,
    "op6_bpe": op6_bpe,
    "op7_token_counts": op7_token_counts,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_simhash": op10_simhash,
    "op11_source_divergence": op11_source_divergence,
    "op12_id_files": op12_id_files,
    "op13_vector_codes": op13_vector_codes,
}
