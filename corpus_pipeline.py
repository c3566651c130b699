"""The corpus pipeline: toxic documents go, then near copies and benchmark passages, secrets are
masked, and what is left is packed into training windows.

Each stage reads what the one before it wrote. `run` applies all of them to `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assay.llm import decontam, near, packing, secrets, toxicity
from assay.llm.tables import table
from assay.plans.stage import staged


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; trees fitted on the labelled rows."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash fingerprints met in the trie, and, for
    near copies beyond its two bits, five-word shingles of Jaccard 0.8 or more."""
    return near.drop_linked(docs, words=5, near=(4, 5))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and the length counted anew where one was."""
    return secrets.mask(docs, secrets.fit(secrets.labelled_strings(docs)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in a window."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL has no trained trees, tokenizer or retrieval; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
