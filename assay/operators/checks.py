"""Checks at stage boundaries, as tables of violations; `enforce` turns them into errors."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import ADJUDICATED_GRADE, DRAW_FIELDS, LABELS, LATE_FIELDS


class AsOfError(ValueError):
    """A field would carry information from after the scoring moment."""


class CheckError(ValueError):
    """A boundary check found violations."""


def refuse_names(names: Iterable[str], late_fields: Iterable[str] = LATE_FIELDS) -> None:
    """Refuse fields that are overwritten later, or that describe the draw."""
    given = set(names)
    late, drawn = sorted(given & set(late_fields)), sorted(given & set(DRAW_FIELDS))
    if late:
        raise AsOfError(f"overwritten after the scoring moment, so no model input: {late}")
    if drawn:
        raise AsOfError(f"describes the draw, so no model input: {drawn}")


def as_of_violations(fields: DataFrame) -> DataFrame:
    """Rows of (name, as_of, scoring_moment) that may not be used, with the reason."""
    reason = (
        F.when(F.col("name").isin(*LATE_FIELDS), "regenerated")
        .when(F.col("name").isin(*DRAW_FIELDS), "bookkeeping")
        .when(F.col("as_of") > F.col("scoring_moment"), "late")
    )
    return fields.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def stray_labels(labels: DataFrame) -> DataFrame:
    """Labels outside the taxonomy, with how many rows carry each."""
    return (
        labels.filter(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)))
        .groupBy("label")
        .agg(F.count("*").alias("n"))
    )


def low_grades(labels: DataFrame) -> DataFrame:
    """Grades that may not calibrate, with how many rows carry each."""
    return (
        labels.filter(F.col("grade") < ADJUDICATED_GRADE)
        .groupBy("grade")
        .agg(F.count("*").alias("n"))
    )


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def row_balance(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """One row comparing two row counts across a boundary."""
    n_left = left.agg(F.count("*").alias("n_before"))
    n_right = right.agg(F.count("*").alias("n")).scalar()
    return n_left.select(
        F.lit(name).alias("boundary"),
        "n_before",
        n_right.alias("n_after"),
        (F.col("n_before") == n_right).alias("ok"),
    )


def drifted(left: Column, right: Column) -> Column:
    """Rows whose two sources of one count disagree."""
    return F.count_if(~left.eqNullSafe(right))


def enforce(violations: DataFrame, what: str) -> None:
    """Raise on the first violations found; at most five are read back."""
    found = violations.limit(5).collect()
    if found:
        raise CheckError(f"{what}: {[r.asDict() for r in found]}")


def guarded(df: DataFrame, bad: Column, what: str, *shown: str) -> DataFrame:
    """`df` as it is, failing at the first row for which `bad` holds.

    The check is part of the plan, so it costs no pass of its own and cannot be forgotten.
    """
    named = F.concat_ws(" ", F.lit(f"{what}:"), *[F.col(c).cast("string") for c in shown])
    return df.filter(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(named).cast("boolean")).otherwise(True))


def one_to_one(left: DataFrame, right: DataFrame, *keys: str) -> None:
    """Raise unless each key stands once on either side and on both."""
    enforce(repeated_keys(left, *keys), "keys repeated on the left")
    enforce(repeated_keys(right, *keys), "keys repeated on the right")
    enforce(left.select(*keys).join(right, list(keys), "left_anti"), "keys without a match on the right")
    enforce(right.select(*keys).join(left, list(keys), "left_anti"), "keys without a match on the left")
