"""Landed JSON: index pages, event logs, full renders, and plain key lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import safe_long
from ..schemas import RENDER, page_schema


def read_pages(spark: SparkSession, path: str, score_field: str = "score") -> DataFrame:
    """One row per document of the pages in a folder, read with a fixed schema."""
    return flatten_pages(spark.read.schema(page_schema(score_field)).json(path), score_field)


def parse_pages(lines: DataFrame, column: str = "value", score_field: str = "score") -> DataFrame:
    parsed = lines.select(F.from_json(column, page_schema(score_field)).alias("p"))
    return flatten_pages(parsed.select("p.*"), score_field)


def _scan_block(prefix: str, scan: Column, score_field: str) -> list[Column]:
    verdict_map = scan["assertions"]
    # Sorted by key, so equal maps give equal text; NULL when there are none.
    ordered = F.map_from_entries(F.array_sort(F.map_entries(verdict_map)))
    return [
        scan["artifact_instance_id"].alias(f"{prefix}_instance"),
        iso_moment(scan["created"]).alias(f"{prefix}_created"),
        scan[score_field].alias(f"{prefix}_score"),
        scan["detections"]["malicious"].alias(f"{prefix}_malicious"),
        scan["detections"]["benign"].alias(f"{prefix}_benign"),
        scan["detections"]["total"].alias(f"{prefix}_definite"),
        F.coalesce(F.cardinality(verdict_map), F.lit(0))
        .cast("bigint")
        .alias(f"{prefix}_responded"),
        F.when(F.cardinality(verdict_map) > 0, F.to_json(ordered)).alias(f"{prefix}_assertions"),
    ]


def iso_moment(text: Column) -> Column:
    """An ISO-8601 moment as zoneless UTC, whatever the session zone.

    The offset is read off the text; a missing one means UTC.
    """
    body = F.regexp_extract(text, r"^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d+)?)", 1)
    sign = F.regexp_extract(text, r"([+-])\d\d:?\d\d$", 1)
    hours = F.regexp_extract(text, r"[+-](\d\d):?\d\d$", 1).try_cast("int")
    minutes = F.regexp_extract(text, r"[+-]\d\d:?(\d\d)$", 1).try_cast("int")
    shift = F.coalesce(hours * 60 + minutes, F.lit(0)) * F.when(sign == "-", 1).otherwise(-1)
    return F.nullif(body, F.lit("")).try_cast("timestamp_ntz") + F.make_dt_interval(mins=shift)


def flatten_pages(pages: DataFrame, score_field: str = "score") -> DataFrame:
    """Each document as the artifact, its first scan and its latest scan."""
    docs = pages.select(F.explode("result").alias("d"))
    art, scan = F.col("d.artifact"), F.col("d.scan")
    return docs.select(
        art["sha256"].alias("sha256"),
        iso_moment(art["created"]).alias("artifact_created"),
        art["size"].alias("size"),
        # Either plain text, or an object that names it.
        F.coalesce(F.get_json_object(scan["mimetype"], "$.mime"), scan["mimetype"]).alias("mimetype"),
        *_scan_block("first", scan["first_scan"], score_field),
        *_scan_block("latest", scan["latest_scan"], score_field),
    )


def last_record(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last record of each key; a partial maximum, so a long log of one key is no group."""
    rest = [c for c in log.columns if c != key]
    return (
        log.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        .select(key, "_r.*")
    )


def parse_renders(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(F.from_json(column, RENDER).alias("r")).select("r.*")


def render_rows(renders: DataFrame) -> DataFrame:
    """One row per render, without its assertions, for the status overlay."""
    return renders.select(
        F.col("id").cast("bigint").alias("instance"),
        iso_moment(F.col("created")).alias("created"),
        "state",
        F.coalesce("window_closed", F.lit(False)).alias("window_closed"),
        F.coalesce("failed", F.lit(False)).alias("failed"),
        F.coalesce("missing", F.lit(False)).alias("missing"),
        "score",
        F.coalesce(F.size("assertions"), F.lit(0)).alias("n_assertions"),
    )


def explode_renders(renders: DataFrame) -> DataFrame:
    """One verdict per row; an absent or unreadable bid is 0."""
    return renders.select(F.col("id").cast("bigint").alias("instance_number"), F.explode("assertions").alias("a")).select(
        "instance_number",
        F.col("a.author").alias("author"),
        F.col("a.author_name").alias("author_name"),
        F.col("a.verdict").alias("verdict"),
        safe_long(F.col("a.bid")).alias("bid"),
        F.col("a.mask").alias("mask"),
        F.col("a.metadata.malware_family").alias("malware_family"),
        F.col("a.metadata.scanner.version").alias("scanner_version"),
    )


def project_metadata(verdicts: DataFrame, column: str = "engine_metadata") -> DataFrame:
    """Two named fields of a JSON column; the rest is never parsed into columns."""
    return verdicts.select(
        *[c for c in verdicts.columns if c != column],
        F.get_json_object(column, "$.malware_family").alias("malware_family"),
        F.get_json_object(column, "$.scanner").alias("scanner_version"),
    )


def key_list(spark: SparkSession, path: str) -> DataFrame:
    """A text file of keys, one per line, blanks and repeats dropped."""
    return clean_keys(spark.read.text(path))


def clean_keys(lines: DataFrame, column: str = "value") -> DataFrame:
    trimmed = F.regexp_replace(column, r"^\s+|\s+$", "")
    return lines.select(trimmed.alias("sha256")).filter("sha256 != ''").distinct()
