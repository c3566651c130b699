"""Forced re-observations: which landed, which are usable, and the base they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import days_between
from .draw import realized_pi
from .frame import long_verdicts, roles, verdict_counts

STATUSES = ("labelled", "no_assertions", "pending", "failed", "missing_render", "not_submitted")


def forced_frame(slice_rows: DataFrame, now: Column, min_age: int, max_age: int, size_cap: int) -> DataFrame:
    """Scanned files in an age range and not known to be over the size cap."""
    age = days_between(F.col("first_created"), now)
    over = (F.col("size") > size_cap).eqNullSafe(True)
    return slice_rows.withColumn("age_days", age).filter(
        (F.coalesce(F.col("first_definite"), F.lit(0)) > 0)
        & (F.col("age_days") >= min_age)
        & (F.col("age_days") < max_age)
        & ~over
    )


def overlay(drawn: DataFrame, submitted: DataFrame, renders: DataFrame) -> DataFrame:
    """Drawn rows with their submission and both renders, and the status that follows.

    `submitted` has (sha256, rescan_instance); `renders` one row per instance with
    `instance, created, window_closed, failed, missing, n_assertions`.
    """

    def side(prefix: str) -> DataFrame:
        return renders.select(
            *[F.col(c).alias(f"{prefix}_{c}") for c in ("instance", "created", "window_closed", "failed", "missing", "n_assertions")]
        )

    joined = (
        drawn.join(submitted.select("sha256", "rescan_instance"), "sha256", "left")
        .join(side("l"), F.col("rescan_instance") == F.col("l_instance"), "left")
        .join(side("t"), F.col("instance_number") == F.col("t_instance"), "left")
    )
    return joined.withColumn("status", status()).drop("l_instance", "t_instance")


def status() -> Column:
    """The first that holds; an absent render is neither missing nor closed."""

    def on(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    def none(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) == 0

    return (
        F.when(F.col("rescan_instance").isNull(), "not_submitted")
        .when(on("l_missing") | on("t_missing"), "missing_render")
        .when(on("l_failed"), "failed")
        .when(~on("l_window_closed"), "pending")
        .when(none("l_n_assertions") | none("t_n_assertions"), "no_assertions")
        .otherwise("labelled")
    )


def status_by_band(overlaid: DataFrame) -> DataFrame:
    return overlaid.groupBy("stratum").pivot("status", list(STATUSES)).count().fillna(0)


def dropped_after_draw(overlaid: DataFrame) -> DataFrame:
    return (
        overlaid.filter(F.col("status") != "labelled")
        .groupBy("stratum", "status")
        .agg(F.count("*").alias("n"))
    )


def collected_base(overlaid: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The labelled rows with counts from their verdicts, gap and realized probability."""
    counts = verdict_counts(verdicts, "instance_number")
    kept = realized_pi(overlaid, F.col("status") == "labelled")
    first = counts.select(
        "instance_number",
        F.col("n_definite").alias("t_definite"),
        F.col("n_malicious").alias("t_malicious"),
        F.col("n_responded").alias("t_responded"),
    )
    return (
        kept.join(first, "instance_number", "left")
        .fillna(0, subset=["t_definite", "t_malicious", "t_responded"])
        .withColumn("gap_days", days_between(F.col("scoring_moment"), F.col("l_created")))
        .withColumn("label_instance_number", F.col("rescan_instance"))
    )


def collected_run(overlaid: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cohort, long): a run made of what landed.

    The cohort has counts of both scans from their own verdict rows, and its `pi` is the
    realized share of the band, labelled over available; the design's stays as `pi_draw`. `long`
    has one row per (artifact, role, engine) of its rows.
    """
    kept = realized_pi(overlaid, F.col("status") == "labelled")
    counts = verdict_counts(verdicts, "instance_number")
    names = ("n_definite", "n_malicious", "n_responded")

    def side(key: str, prefix: str) -> DataFrame:
        return counts.select(F.col("instance_number").alias(key), *[F.col(c).alias(prefix + c[1:]) for c in names])

    drawn = kept.drop(*names, *["l" + c[1:] for c in names], "n_draw").withColumnsRenamed({"pi": "pi_draw", "n_kept": "n_draw"})
    both = drawn.join(side("instance_number", "n"), "instance_number", "left").join(side("rescan_instance", "l"), "rescan_instance", "left")
    cohort = (
        both.fillna(0, subset=[*names, *["l" + c[1:] for c in names]])
        .withColumn("gap_days", days_between(F.col("scoring_moment"), F.col("l_created")))
        .drop("label_instance_number")
        .withColumnsRenamed({"rescan_instance": "label_instance_number", "l_created": "label_moment", "pi_realized": "pi"})
    )
    return cohort, long_verdicts(roles(cohort), verdicts)
