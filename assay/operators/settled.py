"""The settled-state view: scans long after the first, and whether verdicts converged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import days_between, micros, ratio, year_of
from ..params import Params
from ..plans.ordering import BUCKET, prefix_sums, range_bucket
from ..plans.skew import hot_keys
from .frame import later_scans, long_verdicts, roles
from .labels import label


def timed(later: DataFrame, params: Params) -> DataFrame:
    """`later` in buckets of time for artifacts of hot histories; others are one bucket each, so that
    they have one total."""
    hot = hot_keys(later.select("sha256"), ["sha256"], params.skew)
    cut = range_bucket(later.withColumn("_t", micros(F.col("completed"))), "_t", params.skew.buckets)
    marked = cut.join(F.broadcast(hot), "sha256", "left")
    return marked.withColumn(BUCKET, F.when(F.col("_salts").isNotNull(), F.col(BUCKET)).otherwise(0)).drop("_salts")


def recency_rank(later: DataFrame, params: Params) -> DataFrame:
    """Rank of every later scan from the newest back; long histories are cut by time."""
    return prefix_sums(
        timed(later, params),
        by=["sha256"],
        order=[F.col("completed").desc(), F.col("number").desc()],
        sums={"rn": F.lit(1).cast("bigint")},
        descending_buckets=True,
    ).drop("_t")


def settled_state(frame: DataFrame, scans: DataFrame, params: Params, *, with_number: bool = False) -> DataFrame:
    """Per artifact: later scans, elapsed days, and the states and span of the last K, with the
    number of the last scan if asked for.

    Totals are plain aggregates. The last K rows come from a ranked window whose limit Spark
    applies before the shuffle, so a task sends at most K rows per artifact.
    """
    k = params.settled_last_k
    later = later_scans(frame, scans, params, ("n_malicious", "n_definite"))
    totals = later.groupBy("sha256").agg(
        F.count("*").alias("n_later"), F.max("completed").alias("_latest")
    )
    newest = Window.partitionBy("sha256").orderBy(F.col("completed").desc(), F.col("number").desc())
    last = (
        later.withColumn("rn", F.row_number().over(newest))
        .filter(F.col("rn") <= k)
        .groupBy("sha256")
        .agg(
            F.count_distinct("n_malicious").alias("distinct_states"),
            days_between(F.min("completed"), F.max("completed")).alias("stable_span_days"),
            F.max_by("n_definite", F.struct("completed", "number")).alias("final_definite"),
            F.max_by("n_malicious", F.struct("completed", "number")).alias("final_malicious"),
            F.max(F.struct("completed", "number"))["number"].alias("final_number"),
        )
    )
    return (
        frame.select("sha256", "scoring_moment")
        .join(totals, "sha256", "left")
        .join(last, "sha256", "left")
        .select(
            "sha256",
            "scoring_moment",
            F.coalesce("n_later", F.lit(0)).alias("n_later"),
            days_between(F.col("scoring_moment"), F.col("_latest")).alias("elapsed_days"),
            F.coalesce("distinct_states", F.lit(0)).alias("distinct_states"),
            "stable_span_days",
            "final_definite",
            "final_malicious",
            *(["final_number"] if with_number else []),
        )
    )


def _steps(params: Params) -> tuple[Column, Column, Column, Column]:
    enough = F.col("n_later") >= params.settled_min_scans
    old = enough & F.coalesce(F.col("elapsed_days") >= params.settled_min_days, F.lit(False))
    converged = (
        old
        & (F.col("distinct_states") == 1)
        & F.coalesce(F.col("stable_span_days") >= params.settled_span_days, F.lit(False))
    )
    labellable = converged & F.coalesce(F.col("final_definite") >= params.settled_min_definite, F.lit(False))
    return enough, old, converged, labellable


def era_funnel(states: DataFrame, params: Params) -> DataFrame:
    """How many artifacts survive each convergence condition, per year of first scan."""
    enough, old, converged, labellable = _steps(params)
    return states.groupBy(year_of(F.col("scoring_moment")).alias("era")).agg(
        F.count("*").alias("candidates"),
        F.count_if(enough).alias("f1_enough_scans"),
        F.count_if(old).alias("f2_old_enough"),
        F.count_if(converged).alias("f3_converged"),
        F.count_if(labellable).alias("f4_labellable"),
        F.round(ratio(F.lit(100.0) * F.count_if(labellable), F.count("*")), 1).alias("pct_yield"),
    )


def settled_label(states: DataFrame, params: Params) -> DataFrame:
    """A label per artifact from its settled verdicts; what has not settled is undecidable."""
    _, old, _, labellable = _steps(params)
    reason = (
        F.when(labellable, "settled")
        .when(~old, "too_young")
        .otherwise("not_converged")
    )
    name = (
        F.when(~labellable, "undecidable")
        .when(F.col("final_malicious") == 0, "benign")
        .otherwise("malicious")
    )
    return states.select("sha256", "scoring_moment", name.alias("label"), reason.alias("reason"))


def settled_rule_labels(frame: DataFrame, scans: DataFrame, verdicts: DataFrame, params: Params) -> DataFrame:
    """The four labels of the label rule, taken from the last scan of each settled artifact.

    Families route there as they do at a label scan, so a settled file may be unwanted, and
    weak agreement leaves it undecidable. Artifacts that have not settled are not in it.
    """
    states = settled_state(frame, scans, params, with_number=True)
    _, _, _, labellable = _steps(params)
    last = states.filter(labellable).select("sha256", F.col("final_number").alias("label_instance_number"))
    base = frame.drop("label_instance_number").join(last, "sha256")
    return label(base, long_verdicts(roles(base), verdicts), params)
