"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, dialogues, lengths, licenses, merkle, minhash, packing, pages, quality, secrets, simhash, toxicity
from .tables import ORACLES, QUERIES, query, table


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    return QUERIES, ORACLES


@query("op1_token_lengths")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return lengths.with_suffix_sums(lengths.histogram(table(spark, folder, "documents")))


@query("op2_nearest", ann.ORACLE)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    indexed = ann.index(table(spark, folder, "embeddings"))
    return ann.search(indexed, indexed.rows.filter(F.col("id") % 20 == 0))


@query("op3_licenses", licenses.ORACLE)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query("op4_decontamination")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontam.digest(decontam.scan(docs, table(spark, folder, "benchmark")))


@query("op5_pages")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(table(spark, folder, "pages"))


@query("op6_packing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, folder, "documents")))


@query("op7_quality")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_secrets")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    models = secrets.fit(secrets.labelled_strings(docs))
    return secrets.digest(secrets.scan(docs, models))


@query("op10_simhash")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op11_minhash", minhash.ORACLE)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_copies(table(spark, folder, "documents"))


@query("op12_merkle", merkle.ORACLE)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.digest(merkle.audit(table(spark, folder, "documents")))


@query("op13_dialogues")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return dialogues.repair(dialogues.damaged(rows), rows)


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
