"""Bands on agreement, and the stratified draw that records every inclusion probability."""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from ..params import BELOW_FLOOR, Bands, Params
from ..plans.ordering import hash_key, hash_top
from ..plans.small import small_table


def band(n_malicious: Column, n_definite: Column, bands: Bands, floor: Column | None = None) -> Column:
    """The agreement band of one scan; too few definite answers is its own band.

    `floor` replaces the fixed floor, e.g. by a share of the typical coverage.
    """
    least = F.lit(max(bands.min_definite, 1)) if floor is None else F.greatest(floor, F.lit(1))
    m = ratio(n_malicious, n_definite)
    return (
        F.when((n_definite < least) | m.isNull(), BELOW_FLOOR)
        .when(m >= bands.consensus, "consensus_malicious")
        .when(m >= bands.upper, "leaning_malicious")
        .when(m > bands.lower, "contested")
        .when(m > 0, "leaning_clean")
        .otherwise("consensus_clean")
    )


def with_band(df: DataFrame, bands: Bands, out: str = "stratum") -> DataFrame:
    return df.withColumn(out, band(F.col("n_malicious"), F.col("n_definite"), bands))


def relative_floor(df: DataFrame, share: float) -> Column:
    """A floor as a share of the median coverage; engine counts are a small domain."""
    return df.agg(F.percentile("n_definite", F.lit(0.5)).alias("p")).scalar() * F.lit(share)


def _targets(spark: SparkSession, params: Params) -> DataFrame:
    """The share and row target of every band; the below-floor band wants none."""
    shares = {**{name: params.targets[name] for name in params.drawn}, BELOW_FLOOR: 0.0}
    rows = [(name, share, math.ceil(params.cohort_size * share)) for name, share in shares.items()]
    return small_table(spark, rows, "stratum string, target_share double, n_target bigint")


def draw_report(banded: DataFrame, params: Params) -> DataFrame:
    """One row per band: available, wanted, drawn, and the probability that follows.

    The below-floor band is counted and never drawn.
    """
    available = banded.groupBy("stratum").agg(F.count("*").alias("_n"))
    joined = _targets(banded.sparkSession, params).join(available, "stratum", "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    drawn = F.least(n, F.col("n_target"))
    return joined.select(
        "stratum",
        n.alias("n_available"),
        "target_share",
        "n_target",
        drawn.alias("n_draw"),
        F.when(F.col("stratum") != BELOW_FLOOR, ratio(drawn, n)).alias("pi"),
        (drawn < F.col("n_target")).alias("underfilled"),
    )


def _with_pi(drawn: DataFrame, wanted: Column) -> DataFrame:
    taken = drawn.withColumn("n_draw", F.least(F.col("n_available"), wanted))
    return taken.withColumn("pi", ratio(F.col("n_draw"), F.col("n_available")))


def stratified_draw(base: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """(cohort, report). A band short of its target is taken whole and reported so.

    Positions come from the digest of (sha256, seed), so a larger cohort contains a smaller
    one. No band is sorted in one task, and rows that cannot be drawn are not shuffled.
    """
    if "stratum" in base.columns:
        raise ValueError("bands are computed at draw time; the base must not carry one")
    banded = with_band(base, params.bands)
    # One row per band.
    targets = F.broadcast(_targets(base.sparkSession, params).filter("n_target > 0").drop("target_share"))
    cohort = hash_top(
        banded.withColumn("_key", hash_key("sha256", params.seed)).join(targets, "stratum"),
        by=["stratum"],
        hexed="_key",
        tie="sha256",
        limit=F.col("n_target"),
        digits=params.skew.hash_digits,
        size="n_available",
        few_groups=True,
    )
    return _with_pi(cohort, F.col("n_target")).drop("_key", "n_target"), draw_report(banded, params)


def even_cell_draw(base: DataFrame, cells: list[str], per_cell: int, params: Params) -> DataFrame:
    """A draw of the same size from every cell of `cells` (eras times bands), pi per cell."""
    drawn = hash_top(
        base.withColumn("_key", hash_key("sha256", params.seed)),
        by=cells,
        hexed="_key",
        tie="sha256",
        limit=per_cell,
        digits=params.skew.hash_digits,
        size="n_available",
    )
    return _with_pi(drawn, F.lit(per_cell).cast("bigint")).drop("_key")


def check_draw(cohort: DataFrame, report: DataFrame) -> DataFrame:
    """The three checks of a sound draw, as rows with a count of violations."""
    rows = cohort.agg(F.count("*").alias("rows"), F.count_if(~F.col("pi").between(1e-300, 1.0)).alias("bad_pi"))
    repeats = (
        cohort.groupBy("sha256").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("r"))
    )
    expected = report.agg(F.coalesce(F.sum("n_draw"), F.lit(0)).alias("e")).scalar()
    one = rows.select(
        F.abs(F.col("rows") - expected).alias("row_count"),
        F.col("bad_pi").alias("pi_range"),
        repeats.scalar().alias("duplicate_key"),
    )
    return one.unpivot([], ["row_count", "pi_range", "duplicate_key"], "check", "violations").select(
        "check", F.col("violations").cast("bigint").alias("violations"), (F.col("violations") == 0).alias("ok")
    )


def composite_pi(cohort: DataFrame, pi_base: float) -> DataFrame:
    """The draw's probability times the slice's."""
    return cohort.withColumnRenamed("pi", "pi_draw").withColumns(
        {"pi_base": F.lit(pi_base), "pi": F.col("pi_draw") * F.lit(pi_base)}
    )


def realized_pi(drawn: DataFrame, kept: Column) -> DataFrame:
    """Probabilities after losses: rows kept over rows available, per band."""
    counts = drawn.groupBy("stratum").agg(F.count_if(kept).alias("n_kept"))
    return (
        drawn.filter(kept)
        .join(counts, "stratum")  # a few bands: Spark sees the size and broadcasts
        .withColumn("pi_realized", ratio(F.col("n_kept"), F.col("n_available")))
    )
