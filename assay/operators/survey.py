"""Surveys and composition reports, all as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.families import clean_family
from ..functions.scalar import days_between, ratio, year_of
from ..params import BELOW_FLOOR, Bands, Params
from ..plans.ordering import exact_quantiles
from ..plans.small import small_table
from .draw import band, with_band
from .labels import paired

LADDER = (90, 180, 365, 1000)  # fixed values: the horizon ladder in days


# ---------------------------------------------------------------- bands


def band_histogram(banded: DataFrame, params: Params) -> DataFrame:
    """Rows, share and target per band, and the largest cohort the band could fill."""
    rows = [(n, float(s)) for n, s in params.targets.items() if n in params.drawn] + [(BELOW_FLOOR, 0.0)]
    targets = small_table(banded.sparkSession, rows, "stratum string, target_share double")
    counts = banded.groupBy("stratum").agg(F.count("*").alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(0))
    total = F.sum(n).over(Window.partitionBy())  # over one row per band
    return targets.join(counts, "stratum", "left").select(
        "stratum",
        n.alias("n"),
        F.coalesce(ratio(n, total), F.lit(0.0)).alias("share"),
        "target_share",
        F.when(F.col("target_share") > 0, F.floor(n / F.col("target_share"))).alias("fills_cohort_up_to"),
    )


def largest_cohort(histogram: DataFrame, sample_pct: int = 100) -> DataFrame:
    """The cohort every drawn band can fill: the smallest band bounds it. Of a sample, scaled."""
    least = F.min("fills_cohort_up_to")
    if sample_pct == 100:
        return histogram.agg(least.alias("largest_cohort"))
    return histogram.agg(F.floor(least * F.lit(100.0 / sample_pct)).alias("largest_cohort"))


def gap_and_coverage(banded: DataFrame, params: Params) -> DataFrame:
    """Label gap and answering engines per band.

    Gaps take too many values for one quantile buffer; engine counts do not.
    """
    gaps = exact_quantiles(
        banded,
        by=["stratum"],
        value="gap_days",
        quantiles={"gap_p50": 0.5, "gap_p90": 0.9},
        buckets=params.skew.buckets,
    )
    rest = banded.groupBy("stratum").agg(
        F.count("*").alias("n"),
        F.max("gap_days").alias("gap_max"),
        F.min("n_definite").alias("definite_min"),
        F.percentile("n_definite", F.lit(0.1)).alias("definite_p10"),
        F.percentile("n_definite", F.lit(0.5)).alias("definite_med"),
        F.percentile("n_responded", F.lit(0.5)).alias("responded_med"),
        F.count_if(F.col("provenance") == "customer").alias("customer"),
    )
    return rest.join(gaps, "stratum")


def band_survey(banded: DataFrame, params: Params) -> DataFrame:
    """Per band: its fill and target beside label gap and coverage, empty bands included."""
    return band_histogram(banded, params).join(gap_and_coverage(banded, params).drop("n"), "stratum", "left")


def change_totals(long: DataFrame, bands: Bands) -> DataFrame:
    """Engine-level totals, and artifacts whose band moved: by all engines, and by those
    present at both scans. Only artifacts with both scans count."""
    t, l = F.col("t_state"), F.col("l_state")
    both = t.isNotNull() & l.isNotNull()

    def counts(name: str, state: Column, where: Column) -> list[Column]:
        return [
            F.count_if(where & (state == 1)).alias(f"{name}_mal"),
            F.count_if(where & (state >= 0)).alias(f"{name}_def"),
        ]

    yes = F.lit(True)
    per = (
        paired(long)
        .groupBy("sha256")
        .agg(
            F.count(t).alias("at_t"),
            F.count(l).alias("at_l"),
            F.count_if(t != l).alias("flips"),
            F.count_if((t == 1) & (l == 0)).alias("retractions"),
            F.count_if(t.isNull() & l.isNotNull()).alias("joined"),
            F.count_if(t.isNotNull() & l.isNull()).alias("left"),
            F.count_if(t == l).alias("stable"),
            *counts("at", t, yes),
            *counts("al", l, yes),
            *counts("bt", t, both),
            *counts("bl", l, both),
        )
        .filter((F.col("at_t") > 0) & (F.col("at_l") > 0))
    )

    def moved(a: str, b: str) -> Column:
        before = band(F.col(f"{a}_mal"), F.col(f"{a}_def"), bands)
        after = band(F.col(f"{b}_mal"), F.col(f"{b}_def"), bands)
        return F.count_if(before != after)

    return per.agg(
        F.count("*").alias("artifacts"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("flips", "retractions", "joined", "left", "stable")],
        F.count_if(F.col("flips") > 0).alias("with_flip"),
        moved("at", "al").alias("moved_all"),
        moved("bt", "bl").alias("moved_both"),
    )


def modal_families(long: DataFrame, role: str = "label") -> DataFrame:
    """The most common family string per artifact; the lowest name wins a tie."""
    named = (
        long.filter((F.col("scan_role") == role) & F.col("verdict"))
        .withColumn("family", clean_family(F.col("malware_family")))
        .filter(F.col("family") != "")
    )
    counts = named.groupBy("sha256", "family").agg(F.count("*").alias("n"))
    return counts.groupBy("sha256").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "family")).alias("_top")
    ).select("sha256", F.col("_top.family").alias("modal_family"), (-F.col("_top.n")).alias("n"))


def family_diversity(base: DataFrame, long: DataFrame) -> DataFrame:
    """Artifacts against distinct modal families: how large the sample really is."""
    modal = modal_families(long)
    artifacts = base.agg(F.count_distinct("sha256").alias("a")).scalar()
    return modal.agg(
        artifacts.alias("artifacts"),
        F.count("*").alias("with_family"),
        F.count_distinct("modal_family").alias("distinct_families"),
        ratio(F.count_distinct("modal_family"), F.count("*")).alias("families_per_artifact"),
    )


def realized_shares(cohort: DataFrame, params: Params) -> DataFrame:
    """Drawn share per band against its target, with pi checked against its own counts."""
    total = cohort.agg(F.count("*").alias("t")).scalar()
    rows = [(n, float(s)) for n, s in params.targets.items()]
    targets = small_table(cohort.sparkSession, rows, "stratum string, target_share double")
    per = cohort.groupBy("stratum").agg(
        F.count("*").alias("n_draw"), F.max("n_available").alias("n_available"), F.max("pi").alias("pi")
    )
    return per.join(F.broadcast(targets), "stratum").select(
        "stratum",
        "n_draw",
        "n_available",
        "pi",
        ratio(F.col("n_draw"), total).alias("realized_share"),
        "target_share",
        (F.abs(ratio(F.col("n_draw"), F.col("n_available")) - F.col("pi")) <= 1e-9).alias("pi_ok"),
    )


def three_ways(base: DataFrame, cohort: DataFrame, long: DataFrame, cut: float = 0.5) -> DataFrame:
    """One count over the cohort raw, the cohort weighted, and the base directly."""
    shares = (
        long.filter(F.col("scan_role") == "label")
        .groupBy("sha256")
        .agg(ratio(F.count_if("verdict"), F.count("verdict")).alias("m"))
        .filter(F.col("m").isNotNull())
    )
    hit = (F.col("m") >= cut).cast("double")
    w = F.lit(1.0) / F.col("pi")
    direct = base.select("sha256").join(shares, "sha256").agg(F.avg(hit).alias("h")).scalar()
    return (
        cohort.select("sha256", "pi")
        .join(shares, "sha256")
        .agg(
            F.avg(hit).alias("cohort_raw"),
            (F.sum(w * hit) / F.sum(w)).alias("cohort_weighted"),
            direct.alias("base_direct"),
        )
    )


def frame_survey(labelled: DataFrame, sample_pct: int = 100) -> DataFrame:
    """Frame size, labellable and customer shares, scaled to the whole when sampled."""
    has_label = F.col("label_instance_number").isNotNull()
    customer = F.col("provenance") == "customer"
    return labelled.agg(
        F.count("*").alias("frame"),
        F.count_if(has_label).alias("labellable"),
        ratio(F.count_if(has_label), F.count("*")).alias("labellable_share"),
        F.count_if(customer).alias("customer"),
        F.count_if(customer & has_label).alias("customer_labellable"),
        (F.count_if(has_label) * F.lit(100.0 / sample_pct)).alias("labellable_scaled"),
    )


# ---------------------------------------------------------------- slices of first and latest scans


def labellable_at(
    horizon_days: int, horizon_max_days: Column | int, gap: Column, rescanned: Column, latest_definite: Column
) -> Column:
    return rescanned & (gap >= horizon_days) & (gap < horizon_max_days) & (latest_definite > 0)


def slice_columns(df: DataFrame) -> DataFrame:
    """A slice with its counts filled, gap in days, and whether a later scan exists."""
    return df.select(
        "*",
        F.coalesce(F.col("first_definite"), F.lit(0)).alias("_def"),
        F.coalesce(F.col("latest_definite"), F.lit(0)).alias("_ldef"),
        days_between(F.col("first_created"), F.col("latest_created")).alias("_gap"),
    ).withColumn(
        "_rescanned",
        (F.col("_def") > 0) & F.coalesce(F.col("latest_instance") != F.col("first_instance"), F.lit(False)),
    )


def slice_ladder(df: DataFrame, horizon_days: int, pi: float, ladder: Sequence[int] = LADDER) -> DataFrame:
    """Labellable files per horizon limit, and scaled to the whole population."""
    rungs = sorted(set(ladder))

    def good(limit: int) -> Column:
        return labellable_at(horizon_days, limit, F.col("_gap"), F.col("_rescanned"), F.col("_ldef"))

    one = slice_columns(df).agg(
        F.count("*").alias("_all"), *[F.count_if(good(h)).alias(str(h)) for h in rungs]
    )
    return one.unpivot(["_all"], [str(h) for h in rungs], "hmax", "labellable").select(
        F.col("hmax").cast("int").alias("hmax"),
        "labellable",
        ratio(F.col("labellable"), F.col("_all")).alias("share"),
        (F.col("labellable") / F.lit(pi)).alias("scaled"),
    )


def slice_survey(df: DataFrame, pi: float) -> DataFrame:
    """Unscanned, scanned and rescanned files of a slice, in one pass."""
    columns = slice_columns(df)
    unscanned = F.col("_def") == 0
    return columns.agg(
        F.count("*").alias("documents"),
        (F.count("*") / F.lit(pi)).alias("documents_scaled"),
        F.count_if(unscanned).alias("unscanned_first"),
        F.count_if(unscanned & (F.col("_ldef") > 0)).alias("scanned_later"),
        F.count_if(~unscanned).alias("scanned_first"),
        F.count_if("_rescanned").alias("rescanned"),
        ratio(F.count_if("_rescanned"), F.count_if(~unscanned)).alias("rescanned_share"),
    )


def slice_quantiles(df: DataFrame, params: Params) -> DataFrame:
    """(measure, n, p10, p50, p90, most): days to the latest scan of rescanned files, and definite
    verdicts at the first scan of scanned ones."""
    columns = slice_columns(df)
    gap = columns.filter("_rescanned").select(F.lit("gap_days").alias("measure"), F.col("_gap").alias("v"))
    definite = columns.filter(F.col("_def") > 0).select(F.lit("first_definite").alias("measure"), F.col("_def").cast("double").alias("v"))
    both = gap.unionByName(definite)
    found = exact_quantiles(
        both, by=["measure"], value="v", quantiles={"p10": 0.1, "p50": 0.5, "p90": 0.9}, buckets=params.skew.buckets
    )
    return both.groupBy("measure").agg(F.count("*").alias("n"), F.max("v").alias("most")).join(found, "measure")


def mimetype_counts(df: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent mimetypes of a slice; ties in order of their names."""
    counts = df.groupBy("mimetype").agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col("mimetype").asc_nulls_last()).limit(top)


def prefix_length(cohort_size: int, fills: Column, pi: float) -> Column:
    """Hex digits of the prefix that a cohort needs, from what one slice can fill."""
    need = F.lit(float(cohort_size)) / F.nullif(fills.cast("double") / F.lit(pi), F.lit(0.0))
    digits = F.greatest(F.lit(1), F.floor(-F.ln(need) / F.ln(F.lit(16.0))).cast("int"))
    return F.when(need < 1, digits)


def scans_per_artifact(scans: DataFrame) -> DataFrame:
    """Distribution of scans per artifact; counts are collapsed before the quantiles."""
    sizes = scans.groupBy("sha256").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("files"))
    return sizes.agg(
        F.sum("files").alias("files"),
        F.percentile("n", F.lit(0.5), F.col("files")).alias("p50"),
        F.percentile("n", F.lit(0.9), F.col("files")).alias("p90"),
        F.max("n").alias("max"),
        ratio(F.sum(F.when(F.col("n") > 2, F.col("files")).otherwise(0)), F.sum("files")).alias("share_over_two"),
    )


def latest_is_nearest(frame: DataFrame, scans: DataFrame, nearest: DataFrame) -> DataFrame:
    """How often an artifact's latest scan is the one a label would have used."""
    latest = scans.groupBy("sha256").agg(
        F.max_by("number", F.struct("completed", "number")).alias("latest_number")
    )
    joined = nearest.join(latest, "sha256").join(frame.select("sha256"), "sha256", "left_semi")
    same = F.col("label_instance_number") == F.col("latest_number")
    return joined.agg(
        F.count("*").alias("labellable"), F.count_if(same).alias("latest_is_label"), ratio(F.count_if(same), F.count("*")).alias("share")
    )


# ---------------------------------------------------------------- value domains and history


def value_counts(df: DataFrame, *columns: str, k: int | None = None) -> DataFrame:
    """Values by frequency, ties in value order; `k` makes it a top-k report."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    if k is None:
        return counts
    return counts.orderBy(F.col("n").desc(), *columns).limit(k)


def history_extent(scans: DataFrame) -> DataFrame:
    return scans.agg(
        F.min("created").alias("earliest"), F.max("created").alias("latest"), F.count("*").alias("instances")
    )


def history_by_year(scans: DataFrame) -> DataFrame:
    return scans.groupBy(year_of(F.col("created")).alias("yr")).agg(
        F.count("*").alias("instances"),
        F.count_distinct("sha256").alias("artifacts"),
        F.count("completed").alias("revealed"),
    )


def column_fill(scans: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percentage of non-missing values per column and year."""
    return scans.groupBy(year_of(F.col("created")).alias("yr")).agg(
        F.count("*").alias("rows"),
        *[F.round(F.lit(100.0) * F.count(c) / F.count("*"), 1).alias(f"pct_{c}") for c in columns],
    )


def engines_by_year(scans: DataFrame, verdicts: DataFrame, least: int = 100) -> DataFrame:
    """(yr, author, assertions) where an engine answered at least `least` times that year.

    Verdicts are counted per scan's year map-side; only the year column crosses the join.
    """
    years = scans.filter(F.col("completed").isNotNull()).select(
        F.col("number").alias("instance_number"), year_of(F.col("created")).alias("yr")
    )
    return (
        verdicts.select("instance_number", "author")
        .join(years, "instance_number")
        .groupBy("yr", "author")
        .agg(F.count("*").alias("assertions"))
        .filter(F.col("assertions") >= least)
    )


def engines_active(per_year: DataFrame) -> DataFrame:
    return per_year.groupBy("yr").agg(F.count("*").alias("engines_active"))


def engines_always_present(per_year: DataFrame) -> DataFrame:
    """Engines present in every year: division of (author, year) by the set of years."""
    years = per_year.agg(F.count_distinct("yr").alias("n")).scalar()
    return (
        per_year.groupBy("author")
        .agg(F.count_distinct("yr").alias("years"))
        .filter(F.col("years") == years)
    )


def duration_sanity(scans: DataFrame, params: Params) -> DataFrame:
    """Discrete median and minimum of completed - created in seconds, and impossible rows."""
    lags = scans.filter(F.col("completed").isNotNull()).select(
        F.timestamp_diff("SECOND", F.col("created"), F.col("completed")).alias("lag")
    )
    median = exact_quantiles(
        lags,
        by=[],
        value="lag",
        quantiles={"median_lag": 0.5},
        buckets=params.skew.buckets,
        discrete=True,
    )
    return lags.agg(
        median.scalar().alias("median_lag"),
        F.min("lag").alias("min_lag"),
        F.count_if(F.col("lag") < 0).alias("impossible_rows"),
    )



def firehose_bands(renders: DataFrame, bands: Bands) -> DataFrame:
    """Band sizes of raw scan records in one pass, counting inside each record's own array."""
    verdicts = F.transform("assertions", lambda a: a["verdict"])
    definite = F.filter(verdicts, lambda v: v.isNotNull())
    sized = renders.select(
        F.size(F.filter(definite, lambda v: v)).alias("n_malicious"), F.size(definite).alias("n_definite")
    )
    return with_band(sized.fillna(0), bands).groupBy("stratum").agg(F.count("*").alias("n"))


def index_coverage(scans: DataFrame, indexed: DataFrame, scored: DataFrame, sandboxed: DataFrame) -> DataFrame:
    """Per day of first scan: shares of artifacts that are indexed, scored and sandboxed."""
    flagged = scans
    for name, keys in (("indexed", indexed), ("scored", scored), ("sandboxed", sandboxed)):
        listed = keys.select("sha256").distinct().withColumn(name, F.lit(1.0))
        flagged = flagged.join(listed, "sha256", "left")
    day = F.date_trunc("day", "scoring_moment").cast("timestamp_ntz")
    shares = [F.avg(F.coalesce(c, F.lit(0.0))).alias(f"{c}_share") for c in ("indexed", "scored", "sandboxed")]
    return flagged.groupBy(day.alias("day")).agg(F.count("*").alias("n"), *shares)
