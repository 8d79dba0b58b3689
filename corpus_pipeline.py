"""Corpus pipeline: five stages over ``documents``, each written and reread.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir), works
on all rows its predecessor kept, and returns the columns of ``documents``; the
last one returns the packed sequences. Rows with nulls in any column, repeated
rows and empty tables go through; what each stage does with them stands at its
operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolytics.llm import exact, packing, pii, simhash, toxicity
from aerolytics.llm.common import documents, stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; it is fitted on ``labels`` of these documents."""
    return toxicity.drop_toxic(docs, documents(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in ``text`` is replaced by its kind; all documents stay. n_chars follows a changed text."""
    clean = pii.redacted(F.col("text"))
    n_chars = F.when(clean != F.col("text"), F.length(clean).cast("long")).otherwise(F.col("n_chars"))
    return docs.withColumns({"text": clean, "n_chars": n_chars})


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its sequence and place in it."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

# SQL has no fitted classifier, components or tokenizer; tests hold the stages
# against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are stored and reread by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
