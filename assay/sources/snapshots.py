"""Write-once snapshots with a manifest, and the fingerprint that ties stages together."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = ".manifest"


class SnapshotError(ValueError):
    """A snapshot does not hold what its manifest says."""


def row_text(names: list[str]) -> Column:
    """A row as text: every column's name and value, in order of names. Values carry their
    length, so no two rows read alike; a null has none."""
    parts = []
    for c in sorted(names):
        value = F.col(c).cast("string")
        parts.append(F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("null"))))
    return F.concat_ws(";", *parts)


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count, sum and xor of row digests: the same for any row or column order.

    A row's number is the first 60 bits of the md5 of its text, so any engine can recount it.
    """
    number = F.conv(F.substring(F.md5(row_text(df.columns)), 1, 15), 16, 10).cast("bigint")
    return df.select(number.alias("h")).agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash_xor"),
    )


def _print_of(df: DataFrame) -> dict[str, Any]:
    return fingerprint(df).first().asDict()


def write_snapshot(
    df: DataFrame, path: str, *, stage: str, overwrite: bool = False, partition_by: tuple[str, ...] = (), **meta: Any
) -> dict[str, Any]:
    """Writes Parquet and a one-row manifest; refuses to replace unless told to.

    The fingerprint is taken from the files as read back, which is what a reader will see.
    """
    spark = df.sparkSession
    mode = "overwrite" if overwrite else "errorifexists"
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    written = spark.read.parquet(path)
    manifest = {"stage": stage, "columns": df.columns, "content": _print_of(written), **meta}
    text = spark.createDataFrame([(json.dumps(manifest, default=str),)], "value string")
    text.coalesce(1).write.mode(mode).text(path + MANIFEST)
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path + MANIFEST).first()["value"])


def read_snapshot(
    spark: SparkSession, path: str, schema: StructType | None = None, verify: bool = True
) -> tuple[DataFrame, dict[str, Any]]:
    """The snapshot and its manifest; the content is compared with the recorded fingerprint."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df, manifest = reader.parquet(path), read_manifest(spark, path)
    if verify and manifest["content"] != _print_of(df):
        raise SnapshotError(f"{path} has changed since its manifest was written")
    return df, manifest


@dataclass(frozen=True)
class Run:
    cohort: DataFrame
    base: DataFrame
    long: DataFrame
    control: DataFrame | None
    manifest: dict[str, Any]


def write_run(cohort: DataFrame, folder: str, base_path: str, **meta: Any) -> dict[str, Any]:
    """Writes a cohort that records which base it was drawn from."""
    base = read_manifest(cohort.sparkSession, base_path)
    return write_snapshot(
        cohort, f"{folder}/cohort", stage="draw", base_path=base_path, base_content=base["content"], **meta
    )


def load_run(spark: SparkSession, folder: str, base_path: str | None = None) -> Run:
    """The cohort with its base, verdicts and control; refuses another base."""
    cohort, manifest = read_snapshot(spark, f"{folder}/cohort")
    where = base_path or manifest["base_path"]
    base, base_manifest = read_snapshot(spark, where)
    if base_manifest["content"] != manifest["base_content"]:
        raise SnapshotError(f"{folder} was drawn from a base other than {where}")
    long, _ = read_snapshot(spark, where + "_long")
    control = None
    if base_manifest.get("has_control"):
        control, _ = read_snapshot(spark, where + "_control")
    return Run(cohort, base, long, control, manifest)


def write_folds(split: DataFrame, path: str) -> None:
    """Both split variants under one table, partitioned by (variant, fold)."""
    kept = split.filter(~F.col("in_gap"))
    both = kept.withColumn("_v", F.explode(F.array(F.lit("grouped"), F.lit("random")))).withColumn(
        "_f", F.when(F.col("_v") == "grouped", F.col("fold")).otherwise(F.col("fold_random"))
    )
    out = both.drop("fold", "fold_random", "in_gap").withColumnsRenamed({"_v": "variant", "_f": "fold"})
    out.write.mode("errorifexists").partitionBy("variant", "fold").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines; reports are a few rows by construction."""
    df.coalesce(1).write.mode("errorifexists").json(path)


def write_periods(
    df: DataFrame, path: str, moment: str = "created", grain: str = "day", rows_per_file: int = 2_000_000
) -> None:
    """A store partitioned by period; re-running a period replaces that period only.

    A period's rows are spread over as many tasks and files as its count asks for, so neither a
    busy period nor a long grain is one task. The counts are one row per period.
    """
    dated = df.withColumn("period", F.date_trunc(grain, moment).cast("date"))
    files = dated.groupBy(F.col("period").alias("_period")).agg(F.ceil(F.count("*") / rows_per_file).alias("_files"))
    sized = dated.join(F.broadcast(files), F.col("period").eqNullSafe(F.col("_period"))).drop("_period")
    (
        sized.repartition("period", F.pmod(F.xxhash64("number"), F.col("_files")))
        .drop("_files")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("period")
        .parquet(path)
    )


def read_window(
    spark: SparkSession, path: str, start: str, end: str, moment: str = "created", grain: str = "day"
) -> DataFrame:
    """Rows with start <= moment < end; other periods are skipped before any file is opened."""
    low, high = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    inside = (F.col("period") >= F.date_trunc(grain, low).cast("date")) & (F.col("period") <= high.cast("date"))
    rows = (F.col(moment) >= low) & (F.col(moment) < high)
    return spark.read.parquet(path).filter(inside & rows).drop("period")


def read_store(
    spark: SparkSession, url: str, query: str, column: str, bounds: tuple[str, str], parts: int, **options: str
) -> DataFrame:
    """A range-partitioned read of an SQL store; each partition is one bounded query."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=f"({query}) AS q",
            partitionColumn=column,
            lowerBound=bounds[0],
            upperBound=bounds[1],
            numPartitions=str(parts),
            **options,
        )
        .load()
    )
