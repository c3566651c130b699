"""How verdicts changed between two scans, and the label that follows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.families import family_class
from ..functions.scalar import ratio
from ..params import LABELS, LABEL_FOLD, Params, TIME_SEPARATED_GRADE

CHANGES = ("flips", "retractions", "joined", "left", "stable")
EVIDENCE = (
    "n_definite",
    "n_malicious",
    "weighted_malicious",
    "n_specific",
    "n_generic",
    "n_pup",
    "n_dual_use",
)


def _state() -> Column:
    """A verdict as a number, so that "answered unknown" and "did not answer" stay apart."""
    return F.when(F.col("verdict"), 1).when(~F.col("verdict"), 0).otherwise(-1)


def paired(long: DataFrame) -> DataFrame:
    """One row per (artifact, engine): its state at both scans, NULL where it was absent.

    Takes the place of a full outer self join: both sides come from one pass. Rows are
    partitioned by artifact so that per-artifact sums need no second shuffle; an artifact has
    at most two rows per engine.
    """
    at_t, at_l = F.col("scan_role") == "feature", F.col("scan_role") == "label"
    return (
        long.repartition("sha256")
        .groupBy("sha256", "author")
        .agg(
            F.max(F.when(at_t, _state())).alias("t_state"),
            F.max(F.when(at_l, _state())).alias("l_state"),
            F.max(F.when(at_l, F.col("malware_family"))).alias("l_family"),
        )
    )


def _change_columns() -> dict[str, Column]:
    t, l = F.col("t_state"), F.col("l_state")
    return {
        "flips": F.count_if(t != l),
        "retractions": F.count_if((t == 1) & (l == 0)),
        "joined": F.count_if(t.isNull() & l.isNotNull()),
        "left": F.count_if(t.isNotNull() & l.isNull()),
        "stable": F.count_if(t == l),
    }


def _aliased(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


def change(long: DataFrame) -> DataFrame:
    """Revision (flips, retractions) apart from attendance (joined, left), per artifact."""
    return paired(long).groupBy("sha256").agg(*_aliased(_change_columns()))


def with_turnover(changes: DataFrame) -> DataFrame:
    both = F.col("flips") + F.col("stable")
    moved = F.col("joined") + F.col("left")
    return changes.withColumn("both", both).withColumn(
        "turnover_rate", F.coalesce(ratio(moved, both + moved), F.lit(0.0))
    )


def evidence(long: DataFrame, discount: float) -> DataFrame:
    """Per artifact: label-scan counts by family class, and the change decomposition."""
    malicious = F.col("l_state") == 1
    weight = F.when(F.col("_class").isin("specific", "pup", "dual_use"), 1.0).otherwise(discount)
    classed = paired(long).withColumn("_class", family_class(F.col("l_family")))

    def of_class(*names: str) -> Column:
        return F.count_if(malicious & F.col("_class").isin(*names))

    return classed.groupBy("sha256").agg(
        F.count("l_state").alias("l_responded"),
        F.count_if(F.col("l_state") >= 0).alias("n_definite"),
        F.count_if(malicious).alias("n_malicious"),
        F.coalesce(F.sum(F.when(malicious, weight)), F.lit(0.0)).alias("weighted_malicious"),
        of_class("specific").alias("n_specific"),
        of_class("generic", "none").alias("n_generic"),
        of_class("pup").alias("n_pup"),
        of_class("dual_use").alias("n_dual_use"),
        *_aliased(_change_columns()),
    )


def outcome(params: Params) -> Column:
    """struct(label, reason): the first rule that holds."""
    c = F.col

    def out(label: str, reason: str | Column) -> Column:
        why = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(label).alias("label"), why.alias("reason"))

    detected = c("weighted_malicious") >= params.min_clusters
    return (
        F.when(F.coalesce(c("l_responded"), F.lit(0)) == 0, out("undecidable", "no_label_scan_assertions"))
        .when(c("n_definite") < params.label_min_definite, out("undecidable", "below_floor"))
        .when(
            c("n_malicious") == 0,
            out("benign", F.when(c("retractions") > 0, "retracted").otherwise("no_detection")),
        )
        .when(~detected, out("undecidable", "weak_consensus"))
        .when((c("n_pup") >= 2) & (c("n_pup") >= c("n_specific")), out("unwanted", "pup_family"))
        .when((c("n_dual_use") >= 2) & (c("n_dual_use") >= c("n_specific")), out("unwanted", "dual_use"))
        .otherwise(
            out(
                "malicious",
                F.when(c("n_specific") >= 2, "specific_families").otherwise("generic_volume"),
            )
        )
    )


def label(cohort: DataFrame, long: DataFrame, params: Params) -> DataFrame:
    """One labelled row per cohort row, with its evidence; nothing is dropped."""
    # Only the cohort's verdicts are classed, however large the base.
    facts = evidence(long.join(cohort.select("sha256"), "sha256", "left_semi"), params.generic_discount)
    carried = [c for c in ("gap_days", "stratum", "pi", "provenance", "scoring_moment") if c in cohort.columns]
    joined = cohort.select("sha256", *carried).join(facts, "sha256", "left")
    settled = joined.withColumn("_o", outcome(params))
    return settled.select(
        "sha256",
        F.col("_o.label").alias("label"),
        F.lit(TIME_SEPARATED_GRADE).alias("grade"),
        F.col("_o.reason").alias("reason"),
        *EVIDENCE,
        ratio(F.col("n_malicious"), F.col("n_definite")).alias("m"),
        *CHANGES,
        *[c for c in carried if c != "gap_days"],
        F.lit("label_scan").alias("source"),
        *([F.col("gap_days").alias("horizon_days")] if "gap_days" in carried else []),
        F.col("_o.label").isin("malicious", "benign").alias("trainable"),
        (F.col("_o.label") == "malicious").cast("int").alias("y"),
    )


def folded(label_column: Column) -> Column:
    """The finer taxonomy folded into the four labels; dropped ones become NULL."""
    out = label_column
    for finer, label_name in LABEL_FOLD.items():
        out = F.when(label_column == finer, F.lit(label_name)).otherwise(out)
    return out


def rates(labels: DataFrame) -> DataFrame:
    """Each label's share: raw, and weighted by 1/pi. One row per label, absent ones too."""
    weight = F.lit(1.0) / F.col("pi")
    columns: list[Column] = []
    for name in LABELS:
        hit = (F.col("label") == name).cast("double")
        columns += [
            F.avg(hit).alias(f"{name}__raw"),
            (F.sum(hit * weight) / F.sum(weight)).alias(f"{name}__weighted"),
        ]
    one = labels.agg(*columns)
    stacked = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("label"),
                    F.col(f"{n}__raw").alias("raw"),
                    F.col(f"{n}__weighted").alias("weighted"),
                )
                for n in LABELS
            ]
        )
    )
    return one.select(stacked.alias("r")).select("r.*")


def rates_by(labels: DataFrame, *keys: str) -> DataFrame:
    return labels.groupBy(*keys, "label").agg(F.count("*").alias("n"))


def disagreement(left: DataFrame, right: DataFrame, names: Sequence[str] = ("label_a", "label_b")) -> DataFrame:
    """Confusion counts of two label tables over the artifacts both carry."""
    a, b = names
    joined = left.select("sha256", F.col("label").alias(a)).join(
        right.select("sha256", F.col("label").alias(b)), "sha256"
    )
    return joined.groupBy(a, b).agg(F.count("*").alias("n"))


def gold_disagreement(labels: DataFrame, gold: DataFrame) -> DataFrame:
    """Derived against audited labels: raw and 1/pi-weighted share that differ."""
    joined = labels.select("sha256", "label", "pi").join(gold.select("sha256", "gold"), "sha256")
    wrong = (~F.col("label").eqNullSafe(F.col("gold"))).cast("double")
    w = F.lit(1.0) / F.col("pi")
    return joined.agg(
        F.count("*").alias("audited"),
        F.avg(wrong).alias("error_raw"),
        (F.sum(w * wrong) / F.sum(w)).alias("error_weighted"),
    )
