"""Signals beside the engines: presence, tiers, output rules, reputation, known-good."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import days_between, micros, ratio
from ..params import INJECTED, Params
from ..plans.ordering import prefix_sums, range_bucket
from ..plans.skew import salted_lookup

PRESENCE = ("not_applicable", "not_attempted", "attempted_failed", "observed")


def presence(applies: Column, attempted: Column, usable: Column) -> Column:
    """Four states; a missing flag counts as not attempted or not usable, never as clean."""
    return (
        F.when(~F.coalesce(applies, F.lit(False)), "not_applicable")
        .when(~F.coalesce(attempted, F.lit(False)), "not_attempted")
        .when(~F.coalesce(usable, F.lit(False)), "attempted_failed")
        .otherwise("observed")
    )


def coverage_tier(families: dict[str, Column]) -> Column:
    """The families observed, as one routing key."""
    parts = [F.when(state == "observed", F.lit(name)) for name, state in sorted(families.items())]
    return F.coalesce(F.nullif(F.concat_ws("+", *parts), F.lit("")), F.lit("none"))


def output_rules(score: Column, trusted: Column, vendor_signed: Column) -> Column:
    """struct(combined_score, rule): attested files are pinned, unsigned ones have a floor of 0.33."""
    yes, signed = F.coalesce(trusted, F.lit(False)), F.coalesce(vendor_signed, F.lit(False))

    def out(value: Column | float, rule: str | None) -> Column:
        number = F.lit(value) if isinstance(value, float) else value
        return F.struct(number.alias("combined_score"), F.lit(rule).cast("string").alias("rule"))

    return (
        F.when(yes, out(0.0, "trusted_source"))
        .when(signed, out(0.1, "vendor_signed"))
        .when(score < 0.33, out(0.33, "unsigned_floor"))
        .otherwise(out(score, None))
    )


def coverage_gate(score: Column, n_definite: Column, floor: int) -> Column:
    """struct(status, combined_score): too few answers means no score at all."""
    enough = F.coalesce(n_definite, F.lit(0)) >= floor
    return F.struct(
        F.when(enough, "scored").otherwise("insufficient evidence").alias("status"),
        F.when(enough, score).alias("combined_score"),
    )


def percent_rank(df: DataFrame, cohort: Sequence[str], score: str, key: str, params: Params) -> DataFrame:
    """Share of the named cohort that scores lower: (rank - 1) / (rows - 1).

    Ranks are found per distinct score and looked up, so no cohort is sorted in one task.
    """
    points = df.groupBy(*cohort, score).agg(F.count("*").alias("_n"))
    upto = prefix_sums(
        range_bucket(points, score, params.skew.buckets),
        by=list(cohort),
        order=[score],
        sums={"_upto": "_n"},
        wholes={"_all": "_upto"},
    )
    ranks = upto.select(
        *cohort,
        score,
        F.coalesce(ratio(F.col("_upto") - F.col("_n"), F.col("_all") - 1), F.lit(0.0)).alias("percentile"),
    )
    return salted_lookup(df, ranks, [*cohort, score], spread_on=key, skew=params.skew)


def reputation(signed: DataFrame, params: Params) -> DataFrame:
    """Per certificate use: earlier artifacts under it, and how many were malicious.

    `signed` has (thumbprint, sha256, scoring_moment, malicious). Counts only look at
    strictly earlier moments: uses at one moment are collapsed first, so they cannot see
    each other, and a certificate used everywhere is cut by time.
    """
    per_moment = signed.groupBy("thumbprint", "scoring_moment").agg(
        F.count("*").alias("_n"), F.count_if("malicious").alias("_bad")
    )
    timed = per_moment.withColumn("_t", micros(F.col("scoring_moment")))
    running = prefix_sums(
        range_bucket(timed, "_t", params.skew.buckets),
        by=["thumbprint"],
        order=["scoring_moment"],
        sums={"_upto": "_n", "_bad_upto": "_bad"},
    )
    before = running.select(
        "thumbprint",
        "scoring_moment",
        (F.col("_upto") - F.col("_n")).alias("seen_before"),
        (F.col("_bad_upto") - F.col("_bad")).alias("malicious_before"),
    )
    return salted_lookup(
        signed, before, ["thumbprint", "scoring_moment"], spread_on="sha256", skew=params.skew
    )


def temporal_features(frame: DataFrame, scans: DataFrame, as_of: Column) -> DataFrame:
    """Age, re-scans and hours to the first detection, all known at `as_of`."""
    known = scans.filter(F.col("completed") <= as_of)
    history = known.groupBy("sha256").agg(
        F.count("*").alias("_scans"),
        F.min(F.when(F.col("n_malicious") > 0, F.col("completed"))).alias("_detected"),
    )
    joined = frame.filter(F.col("scoring_moment") <= as_of).join(history, "sha256", "left")
    return joined.select(
        "sha256",
        days_between(F.col("scoring_moment"), as_of).alias("age_days"),
        (F.coalesce(F.col("_scans"), F.lit(1)) - 1).alias("n_rescans"),
        (days_between(F.col("scoring_moment"), F.col("_detected")) * 24).alias("hours_to_first_detection"),
    )


def with_known_good(cohort: DataFrame, corpus: DataFrame) -> DataFrame:
    """Flags cohort rows on an attested list of hashes."""
    listed = corpus.select("sha256").distinct().withColumn("known_good", F.lit(True))
    return cohort.join(listed, "sha256", "left").fillna(False, subset=["known_good"])


def inject(cohort: DataFrame, corpus: DataFrame) -> DataFrame:
    """Adds known-good rows whose inclusion probability is undefined (NULL)."""
    extra = corpus.select("sha256").join(cohort.select("sha256"), "sha256", "left_anti").distinct()
    rows = extra.select(
        "sha256",
        F.lit(INJECTED).alias("stratum"),
        F.lit(None).cast("double").alias("pi"),
        F.lit(INJECTED).alias("provenance"),
        F.lit(0).alias("y"),
    )
    return cohort.select("sha256", "stratum", "pi", "provenance", "y").unionByName(rows)


def weighted_prevalence(df: DataFrame) -> DataFrame:
    """Positive share weighted by 1/pi; rows without a probability stay out."""
    w = F.lit(1.0) / F.col("pi")
    known = F.col("pi").isNotNull()
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(known).alias("weighted_rows"),
        (F.sum(F.when(known, w * F.col("y"))) / F.sum(F.when(known, w))).alias("prevalence"),
    )


def gate_agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two membership lists compared: in both, only one, and the share that differs."""
    a = left.select("sha256").distinct().withColumn("a", F.lit(1))
    b = right.select("sha256").distinct().withColumn("b", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True).groupBy("sha256").agg(
        F.max("a").alias("a"), F.max("b").alias("b")
    )
    n_both = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    one_sided = F.count_if(F.col("a").isNull() | F.col("b").isNull())
    return both.agg(
        n_both.alias("in_both"),
        F.count_if(F.col("b").isNull()).alias("only_left"),
        F.count_if(F.col("a").isNull()).alias("only_right"),
        ratio(one_sided, F.count("*")).alias("disagreement"),
    )
