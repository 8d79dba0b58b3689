"""The registered training-data queries; their DuckDB twins are in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolytics.llm import (centroids, exact, jaccard, licenses, packing, pieces, pii, prefixes, quality, simhash,
                            substrings, suffixes, toxicity)
from aerolytics.llm.common import documents
from aerolytics.llm.oracle import ORACLE


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.removal_intervals(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("intervals").cast("long").alias("n_spans"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_report(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir)).drop("spans")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_report(documents(spark, sf_dir))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_spans(documents(spark, sf_dir)).drop("spans", "kept")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir)).withColumn("length", F.col("length").cast("long"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(documents(spark, sf_dir, "conversations"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(documents(spark, sf_dir, "embeddings"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir), shingle_words=3, percent=90)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_license_scans": op5_license_scans,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_pii": op8_pii,
    "op9_toxicity": op9_toxicity,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_conversation_prefix_trie": op11_conversation_prefix_trie,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_ngram_jaccard_join": op13_ngram_jaccard_join,
}

__all__ = ["QUERIES", "ORACLE"]
