"""Queries over the shared tables, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprint, langid, licenses, lm, mixing, oracle, packing, quality, setjoin, sharding
from .common import table


def tokenizer_files() -> tuple[str, str]:
    """Path and pre-token pattern of the public byte-level BPE that packing counts with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), n_shards=8, law="rows")
    return out.select("doc_id", sharding.record_size(F.col("text")).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), "law", "shard", "slot", "grown_shard")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = setjoin.jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)
    return out.select("doc_id", "n_shingles", "component_id")


def op2_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join with the number of rows that each links to directly."""
    out = setjoin.jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90, count_links=True)
    return out.select("doc_id", "n_shingles", "component_id", "n_links")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, pieces = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.mixed_counts(rows, pieces).select("doc_id", "size", "source_size", "target", "taken")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer_files()
    return packing.pack(table(spark, sf_dir, "documents"), path, pattern).drop("ids")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    odd = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(turns.unionByName(extra)))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.compare_with_next(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.as_text(F.col("sig")).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op2_ngram_jaccard_links": op2_ngram_jaccard_links,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_source_mixing": op4_source_mixing,
        "op5_license_scan": op5_license_scan,
        "op6_language_id": op6_language_id,
        "op7_packing": op7_packing,
        "op8_quality_rules": op8_quality_rules,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_document_fingerprints": op10_document_fingerprints,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
