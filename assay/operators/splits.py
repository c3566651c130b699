"""Temporal, group-whole splits, and the random one they are compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import days_later, micros
from ..params import Params
from ..plans.ordering import hash_bucket, hash_key, hash_position, prefix_sums, running_by_value
from ..plans.skew import salted_lookup

FOLDS = ("train", "validate", "test")


def group_column(df: DataFrame) -> str | None:
    """The clustering column to use: the first with any value, else the modal family.

    One pass reads whether each has a value at all.
    """
    candidates = [c for c in ("tlsh_cluster", "imphash") if c in df.columns]
    if candidates:
        filled = df.agg(*[F.count(c).alias(c) for c in candidates]).first()
        for name in candidates:
            if filled[name]:
                return name
    return "modal_family" if "modal_family" in df.columns else None


def with_group(df: DataFrame, column: str | None) -> DataFrame:
    """Group key per row; a row without a value is its own group."""
    if column is None:
        return df.withColumn("group", F.col("sha256"))
    return df.withColumn("group", F.coalesce(F.nullif(F.col(column), F.lit("")), F.col("sha256")))


def _fold(share: Column, params: Params) -> Column:
    return (
        F.when(share > params.train_frac + params.validate_frac, "test")
        .when(share > params.train_frac, "validate")
        .otherwise("train")
    )


def group_folds(df: DataFrame, params: Params) -> DataFrame:
    """(group, fold): groups in order of their earliest row, cut whole at the fractions.

    Groups starting at one moment are ordered by digest, so a burst is cut into cells too.
    """
    groups = df.groupBy("group").agg(
        F.min(micros(F.col("scoring_moment"))).alias("_first"), F.count("*").alias("_size")
    )
    ordered = running_by_value(
        groups.withColumn("_key", F.md5("group")),
        value="_first",
        hexed="_key",
        tie="group",
        sums={"_upto": "_size"},
        buckets=params.skew.buckets,
        digits=params.skew.hash_digits,
    )
    share = F.col("_upto").cast("double") / F.col("_upto_whole")
    return ordered.select("group", _fold(share, params).alias("fold"))


def temporal_split(df: DataFrame, params: Params) -> DataFrame:
    """A fold per row; a family with very many rows is salted when its fold is joined back."""
    return salted_lookup(df, group_folds(df, params), ["group"], spread_on="sha256", skew=params.skew)


def horizon_gap(split: DataFrame, horizon_days: int) -> DataFrame:
    """Marks test rows within the horizon after the last training row."""
    train_end = split.filter(F.col("fold") == "train").agg(F.max("scoring_moment").alias("m")).scalar()
    early = F.col("scoring_moment") < days_later(train_end, horizon_days)
    return split.withColumn("in_gap", (F.col("fold") == "test") & F.coalesce(early, F.lit(False)))


def random_split(df: DataFrame, params: Params, digest: Column | None = None) -> DataFrame:
    """The optimistic split: a seeded order, exact counts, no groups and no gap.

    Where something shorter stands in `sha256`, `digest` makes the digest of it. Rows are then moved
    without digest and key, which are made again where they arrive.
    """
    total = df.agg(F.count("*").alias("n")).scalar()
    n_train = F.bround(total * F.lit(params.train_frac), 0)
    n_validate = F.bround(total * F.lit(params.validate_frac), 0)
    key = hash_key("sha256" if digest is None else digest, params.seed, prefix="split:")
    keyed = df.withColumn("_key", key)
    if digest is None:
        placed = hash_position(
            keyed, by=[], hexed="_key", tie="sha256", digits=params.skew.hash_digits, out="_pos"
        )
    else:
        placed = prefix_sums(
            hash_bucket(keyed, "_key", params.skew.hash_digits).drop("_key"),
            by=[],
            order=["_key", "_tie"],
            sums={"_pos": F.lit(1).cast("bigint")},
            late={"_key": key, "_tie": digest},
        )
    fold = (
        F.when(F.col("_pos") <= n_train, "train")
        .when(F.col("_pos") <= n_train + n_validate, "validate")
        .otherwise("test")
    )
    return placed.withColumn("fold_random", fold).drop("_key", "_pos")


def straddling(split: DataFrame) -> DataFrame:
    """How many groups appear in more than one fold; must be 0."""
    per_group = split.groupBy("group").agg(
        (F.min("fold") != F.max("fold")).alias("_crosses")
    )
    return per_group.agg(F.count_if("_crosses").alias("straddling"))


def prevalence(df: DataFrame, *by: str, y: str = "y") -> DataFrame:
    """Rows and positive share, raw and weighted by 1/pi, rounded to 4 places."""
    weight = F.lit(1.0) / F.col("pi")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col(y).cast("double")), 4).alias("raw"),
        F.round(F.sum(weight * F.col(y)) / F.sum(weight), 4).alias("reweighted"),
    )


def split_report(split: DataFrame, excluded: DataFrame) -> DataFrame:
    """Every input row once: in a fold, in the gap, or excluded by its label."""
    place = F.when(F.col("in_gap"), "gap").otherwise(F.col("fold"))
    placed = split.select(place.alias("part"), "group", "y", "pi")
    left_out = excluded.select(
        F.concat(F.lit("excluded:"), F.col("label")).alias("part"),
        F.lit(None).cast("string").alias("group"),
        F.lit(None).cast("int").alias("y"),
        F.lit(None).cast("double").alias("pi"),
    )
    weight = F.lit(1.0) / F.col("pi")
    return (
        placed.unionByName(left_out)
        .groupBy("part")
        .agg(
            F.count("*").alias("n"),
            F.count_distinct("group").alias("groups"),
            F.round(F.avg("y"), 4).alias("raw"),
            F.round(F.sum(weight * F.col("y")) / F.sum(weight), 4).alias("reweighted"),
        )
    )
