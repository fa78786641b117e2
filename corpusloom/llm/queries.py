"""The queries of the training-text operators, each over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import languages, lookalike, mixing, neardup, packing, quality, scans, sentences, splitting, tokens
from corpusloom.runtime import cut, table


def _model(spark: SparkSession, d: str) -> languages.KneserNey:
    return languages.fit_from(table(spark, d, "lang_samples"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.damaged_lines(table(spark, d, "documents"))[0].withColumnRenamed("key", "doc_id")


def p1_repair(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair(table(spark, d, "documents")).withColumnRenamed("key", "doc_id")


def p2_token_budget(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_budget(table(spark, d, "documents"), table(spark, d, "raw_corpus"))


def p2_document_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_counts(table(spark, d, "documents")).withColumnRenamed("key", "doc_id")


def _quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_quality(table(spark, d, "documents"), _model(spark, d), quality.common_words(table(spark, d, "lang_samples"))).withColumnRenamed("key", "doc_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d).filter("kind IS NOT NULL").select("doc_id", "kind").distinct()


def p3_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = _quality(spark, d)
    named = [F.col("stats")[i].alias(n) for i, n in enumerate(quality.STATISTICS)]
    parts = [F.col("contributions")[i].alias(f"{n}_contribution") for i, n in enumerate(quality.STATISTICS)]
    return s.select("doc_id", "lang", *named, "distance", *parts, "outlier_share", "kind")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, d, "raw_corpus"), "row_id", "text").select(F.col("a").alias("row_id_a"), F.col("b").alias("row_id_b"))


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_members(table(spark, d, "raw_corpus"), "row_id", "text").withColumnRenamed("key", "row_id")


def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Passages and documents in one consistent form; keys of documents stand below zero."""
    both = table(spark, d, "raw_corpus").select(F.col("row_id").alias("key"), "text").unionByName(table(spark, d, "documents").select((-F.col("doc_id")).alias("key"), "text"))
    return lookalike.canonical_texts(both, "key", "text")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "documents")).withColumnRenamed("key", "doc_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "documents")).filter("piece_no = 2").select(F.col("key").alias("doc_id")).distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, d, "documents")).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, d, "documents")).withColumnRenamed("key", "doc_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.relabel(table(spark, d, "documents"), _model(spark, d)).select(F.col("key").alias("doc_id"), "lang").distinct()


def p7_languages(spark: SparkSession, d: str) -> DataFrame:
    return languages.document_languages(table(spark, d, "documents"), _model(spark, d)).withColumnRenamed("key", "doc_id")


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    return languages.language_passages(table(spark, d, "documents"), _model(spark, d)).withColumnRenamed("key", "doc_id")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents")).withColumnRenamed("key", "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack(table(spark, d, "documents")))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).withColumnRenamed("key", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.share_report(cut(mixing.mix(table(spark, d, "documents"), targets), "mixture"), targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter(F.col("source").isin("preprint_hub", "abstract_feed"))
    return sentences.sentences(docs, with_text=False).select(F.col("key").alias("doc_id"), F.col("end_pos")).distinct()


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents")).withColumnRenamed("key", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": "SELECT doc_id FROM documents WHERE length(text) > 8000",
    }
