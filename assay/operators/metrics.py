"""Metrics as aggregates: exact weighted AUC, probability scores, reliability, stability."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from ..params import Params, Skew
from ..plans.ordering import (
    exact_quantiles,
    hash_key,
    hash_position,
    hash_uniform,
    prefix_sums,
    range_bucket,
)
from ..plans.small import small_table
from ..plans.skew import salted_lookup

_SMALLEST = 2.220446049250313e-16  # fixed value: double epsilon, the log-loss clip


def slices(stratum: str = "stratum", provenance: str = "provenance") -> Column:
    """The report slices a row belongs to; the customer slice is the headline."""
    parts = [
        F.lit("pooled"),
        F.when(F.col(provenance) == "customer", F.lit("customer")),
        F.concat(F.lit("stratum:"), F.col(stratum)),
        F.concat(F.lit("provenance:"), F.col(provenance)),
    ]
    return F.array_compact(F.array(*parts))


def roc_auc(
    df: DataFrame,
    score: str,
    y: str,
    skew: Skew,
    *,
    by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Exact AUC per group, raw and weighted; NULL where only one class is present.

    Rows collapse to one per distinct score before anything is ordered, ties count half.
    """
    by = list(by)
    w = F.lit(1.0) if weight is None else F.col(weight)
    positive, negative = F.col(y) == 1, F.col(y) == 0
    points = df.groupBy(*by, score).agg(
        F.count_if(positive).alias("_p"),
        F.count_if(negative).alias("_n"),
        F.coalesce(F.sum(F.when(positive, w)), F.lit(0.0)).alias("_wp"),
        F.coalesce(F.sum(F.when(negative, w)), F.lit(0.0)).alias("_wn"),
    )
    below = prefix_sums(
        range_bucket(points, score, skew.buckets),
        by=by,
        order=[score],
        sums={"_cn": "_n", "_cwn": "_wn"},
    )

    def area(pos: str, neg: str, upto: str) -> Column:
        wins = F.sum(F.col(pos) * (F.col(upto) - F.col(neg) / F.lit(2.0)))
        return wins / F.nullif(F.sum(pos).cast("double") * F.sum(neg), F.lit(0.0))

    return below.groupBy(*by).agg(
        F.sum(F.col("_p") + F.col("_n")).alias("n"),
        area("_p", "_n", "_cn").alias("auc_raw"),
        area("_wp", "_wn", "_cwn").alias("auc_weighted"),
    )


def metrics_table(df: DataFrame, scores: Mapping[str, Column], skew: Skew, y: str = "y") -> DataFrame:
    """AUC of several scores over every report slice, raw and weighted by 1/pi."""
    stacked = F.explode(
        F.array(
            *[F.struct(F.lit(n).alias("score_name"), c.cast("double").alias("score")) for n, c in scores.items()]
        )
    )
    rows = df.select(
        F.col(y).alias("y"), (F.lit(1.0) / F.col("pi")).alias("w"), slices().alias("_slices"), stacked.alias("_s")
    ).select("y", "w", "_s.*", F.explode("_slices").alias("slice"))
    found = roc_auc(rows, "score", "y", skew, by=["score_name", "slice"], weight="w")
    # The headline slice is reported even if nothing is in it: undefined, with n = 0.
    asked = small_table(df.sparkSession, [(n, "customer") for n in scores], "score_name string, slice string")
    return found.join(asked, ["score_name", "slice"], "full").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(w * x) / F.sum(w)


def prob_metrics(df: DataFrame, prob: Column, *by: str, y: str = "y") -> DataFrame:
    """Brier, the base-rate Brier it must beat, and log loss, weighted by 1/pi."""
    w = F.lit(1.0) / F.col("pi")
    truth = F.col(y).cast("double")
    kept = F.least(F.greatest(prob, F.lit(_SMALLEST)), F.lit(1 - _SMALLEST))
    loss = -(truth * F.ln(kept) + (1 - truth) * F.ln(1 - kept))
    rate = weighted_mean(truth, w)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        weighted_mean((truth - prob) * (truth - prob), w).alias("brier"),
        (rate * (1 - rate)).alias("brier_base_rate"),
        rate.alias("prevalence_reweighted"),
        F.when(F.min(truth) != F.max(truth), weighted_mean(loss, w)).alias("log_loss"),
    )


def bin_count(rows: int, wanted: int = 10, per_bin: int = 5) -> int:
    """How many bins of at least `per_bin` rows there can be, from two up to `wanted`."""
    return max(2, min(wanted, rows // per_bin))


def with_bins(df: DataFrame, prob: str, bins: int, skew: Skew) -> DataFrame:
    """Quantile bin of each row, 0-based; the outer edges are 0 and 1."""
    inner = {f"e{i}": i / bins for i in range(1, bins)}
    found = exact_quantiles(df, by=[], value=prob, quantiles=inner, buckets=skew.buckets)
    edges = found.select(F.array(*inner).alias("e")).scalar()
    placed = df.withColumn("_edges", edges)
    passed = sum(
        (F.when(F.col(prob) >= F.get("_edges", F.lit(i)), 1).otherwise(0) for i in range(bins - 1)),
        F.lit(0),
    )
    return placed.withColumn("bin", passed).drop("_edges")


def reliability(df: DataFrame, prob: str, bins: int, skew: Skew, *by: str, y: str = "y") -> DataFrame:
    """Predicted and observed weighted frequency per bin."""
    w = F.lit(1.0) / F.col("pi")
    return (
        with_bins(df, prob, bins, skew)
        .groupBy(*by, "bin")
        .agg(
            F.count("*").alias("n"),
            weighted_mean(F.col(prob), w).alias("predicted"),
            weighted_mean(F.col(y).cast("double"), w).alias("observed"),
        )
    )


# The cumulative distribution of a Poisson(1) count, 0 to 9.
_POISSON = (
    0.36787944117144233,
    0.7357588823428847,
    0.9196986029286058,
    0.9810118431238462,
    0.9963401531726563,
    0.9994058151824183,
    0.9999167588507119,
    0.9999897508033253,
    0.9999988747974020,
    0.9999998885745217,
)


def bootstrap_band(
    df: DataFrame,
    prob: str,
    key: str,
    bins: int,
    params: Params,
    replicates: int = 200,
    y: str = "y",
) -> DataFrame:
    """90% band of the observed frequency per bin, by a Poisson bootstrap.

    Each row draws its weight in a replicate from a digest of its key, so any partitioning
    gives the same band. Replicates multiply rows only inside the map side: what is
    shuffled is one partial sum per (replicate, bin).
    """
    w = F.lit(1.0) / F.col("pi")
    binned = with_bins(df, prob, bins, params.skew).select(
        "bin", w.alias("w"), F.col(y).cast("double").alias("y"), F.col(key).cast("string").alias("k")
    )
    copies = binned.select(
        "bin", "w", "y", "k", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")
    )
    u = hash_uniform(hash_key(F.concat("k", F.lit(":"), F.col("replicate").cast("string")), params.seed, "boot:"))
    drawn = copies.withColumn("_u", u)
    times = sum((F.when(F.col("_u") >= c, 1).otherwise(0) for c in _POISSON), F.lit(0))
    curves = (
        drawn.withColumn("_w", F.col("w") * times)
        .groupBy("replicate", "bin")
        .agg(ratio(F.sum(F.col("_w") * F.col("y")), F.sum("_w")).alias("observed"))
    )
    # One value per replicate and bin: bounded, so the built-in quantile is enough.
    return curves.groupBy("bin").agg(
        F.percentile("observed", F.lit(0.05)).alias("low"),
        F.percentile("observed", F.lit(0.95)).alias("high"),
    )


def mean_band_width(band: DataFrame) -> DataFrame:
    """How wide the band is on average over the bins that have one."""
    return band.agg(F.avg(F.col("high") - F.col("low")).alias("mean_width"), F.count("low").alias("bins"))


def auc_spread(per_run: DataFrame, auc: str = "auc_raw") -> DataFrame:
    """AUC over runs: mean, deviation and range; runs without one are only counted."""
    a = F.col(auc)
    return per_run.agg(
        F.count("*").alias("runs"),
        F.count(a).alias("defined"),
        F.avg(a).alias("auc_mean"),
        F.stddev_samp(a).alias("auc_sd"),
        (F.max(a) - F.min(a)).alias("auc_range"),
    )


def shuffled_auc(df: DataFrame, score: str, key: str, params: Params, y: str = "y") -> DataFrame:
    """AUC after labels are permuted: labels and scores meet at equal digest positions."""
    keyed = df.select(F.col(key).cast("string").alias("k"), F.col(score).alias("score"), F.col(y).alias("y"))
    digits = params.skew.hash_digits

    def placed(salt: str, column: str) -> DataFrame:
        hexed = keyed.withColumn("_h", hash_key("k", params.seed, prefix=f"{salt}:"))
        return hash_position(hexed, by=[], hexed="_h", tie="k", digits=digits).select("position", column)

    mixed = placed("score", "score").join(placed("label", "y"), "position")
    return roc_auc(mixed, "score", "y", params.skew).select("n", F.col("auc_raw").alias("auc"))


def average_ranks(df: DataFrame, by: Sequence[str], score: str, key: str, skew: Skew) -> DataFrame:
    """Tie-averaged rank of each row's score within `by`."""
    points = df.groupBy(*by, score).agg(F.count("*").alias("_n"))
    upto = prefix_sums(
        range_bucket(points, score, skew.buckets), by=by, order=[score], sums={"_upto": "_n"}
    )
    ranks = upto.select(*by, score, (F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)).alias("rank"))
    return salted_lookup(df, ranks, [*by, score], spread_on=key, skew=skew)


def stability(scores: DataFrame, runs: Sequence[str], skew: Skew) -> DataFrame:
    """Pairwise score differences and rank correlation of a named list of runs.

    `scores` holds (run, sha256, score). Runs become columns, so a pair is an expression
    over one row and no self join is needed.
    """
    ranked = average_ranks(scores, ["run"], "score", "sha256", skew)
    wide = ranked.groupBy("sha256").agg(
        *[F.max(F.when(F.col("run") == r, F.col("score"))).alias(f"s_{r}") for r in runs],
        *[F.max(F.when(F.col("run") == r, F.col("rank"))).alias(f"r_{r}") for r in runs],
    )
    pairs = list(combinations(runs, 2))
    one = wide.agg(
        *[F.avg(F.abs(F.col(f"s_{a}") - F.col(f"s_{b}"))).alias(f"mad_{a}_{b}") for a, b in pairs],
        *[F.corr(f"r_{a}", f"r_{b}").alias(f"rho_{a}_{b}") for a, b in pairs],
    )
    stacked = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("run_a"),
                    F.lit(b).alias("run_b"),
                    F.col(f"mad_{a}_{b}").alias("score_mad"),
                    F.col(f"rho_{a}_{b}").alias("spearman"),
                )
                for a, b in pairs
            ]
        )
    )
    return one.select(stacked.alias("p")).select("p.*")


def baseline_verdict(auc: Column) -> Column:
    """What the engine-count baseline's AUC says about the labels."""
    return (
        F.when(auc.isNull(), "undefined")
        .when(auc > 0.97, "stop")
        .when(auc.between(0.85, 0.95), "healthy")
        .when(F.abs(auc - 0.5) < 0.1, "disconnected")
        .otherwise("outside")
    )
