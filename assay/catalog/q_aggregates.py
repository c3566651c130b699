"""Queries over aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks, features, forced, frame, labels, splits, survey
from ..plans.ordering import exact_quantiles
from ..sources.tables import ROSTER
from .ctes import band_sql
from .q_filters import LABELLABLE
from .q_joins import STATUS_CTE, overlaid
from .q_sources import SLICE_SQL, slice_of
from .registry import query
from .study import Study


@query("agg1_verdict_counts", "SELECT instance_number, n_definite, n_malicious, n_responded FROM counts")
def agg1(s: Study) -> DataFrame:
    return frame.verdict_counts(s.verdicts, "instance_number")


@query(
    "agg2_artifact_aggregates",
    "SELECT * FROM aggs",
    doubles="m malicious_share_responded bid_mean_malicious bid_mean_benign",
)
def agg2(s: Study) -> DataFrame:
    return features.aggregates(s.first_verdicts)


def _flags_sql(scheme: str) -> str:
    parts = []
    for e in ROSTER:
        found = f"coalesce(max(coalesce(verdict, false)::INT) FILTER (WHERE author = '{e}'), 0)"
        if scheme == "old":
            parts.append(f"{found} AS engine_{e}")
        else:
            parts.append(f"(count(*) FILTER (WHERE author = '{e}') > 0)::INT AS engine_{e}_responded")
            parts.append(f"{found} AS engine_{e}_malicious")
    return ", ".join(parts)


@query("agg3_two_column_pivot", f"SELECT sha256, {_flags_sql('new')} FROM long WHERE scan_role = 'feature' GROUP BY 1")
def agg3(s: Study) -> DataFrame:
    return features.encode_verdicts(s.first_verdicts, ROSTER)


@query("agg4_one_column_pivot", f"SELECT sha256, {_flags_sql('old')} FROM long WHERE scan_role = 'feature' GROUP BY 1")
def agg4(s: Study) -> DataFrame:
    return features.encode_verdicts(s.first_verdicts, ROSTER, "old")


@query("agg5_family_scalars", "SELECT * FROM families", doubles="modal_family_share")
def agg5(s: Study) -> DataFrame:
    return features.family_scalars(s.first_verdicts)


MODAL_L = {
    "fam_l": """SELECT sha256, coalesce(lower(trim(malware_family)), '') AS fam FROM at_l WHERE verdict""",
    "modal_l": """SELECT sha256, fam AS modal_family, n FROM (SELECT sha256, fam, count(*) AS n,
        row_number() OVER (PARTITION BY sha256 ORDER BY count(*) DESC, fam) AS rn FROM fam_l WHERE fam <> '' GROUP BY 1, 2) WHERE rn = 1""",
}


@query("agg6_modal_value", "SELECT sha256, modal_family, n FROM modal_l", **MODAL_L)
def agg6(s: Study) -> DataFrame:
    return survey.modal_families(s.long)


HISTOGRAM = """SELECT t.stratum, coalesce(b.n, 0) AS n, coalesce(b.n, 0)::DOUBLE / (SELECT count(*) FROM banded) AS share, t.target_share,
    CASE WHEN t.target_share > 0 THEN floor(coalesce(b.n, 0) / t.target_share)::BIGINT END AS fills_cohort_up_to
    FROM targets t LEFT JOIN (SELECT stratum, count(*) AS n FROM banded GROUP BY 1) b USING (stratum)"""


@query("agg7_band_histogram", HISTOGRAM, doubles="share target_share")
def agg7(s: Study) -> DataFrame:
    return survey.band_histogram(s.banded, s.params)


@query("agg7_largest_cohort", f"SELECT min(fills_cohort_up_to) AS largest_cohort FROM ({HISTOGRAM})")
def agg7_largest(s: Study) -> DataFrame:
    return survey.largest_cohort(survey.band_histogram(s.banded, s.params))


@query("flagship_composition", HISTOGRAM, doubles="share target_share")
def flagship(s: Study) -> DataFrame:
    """Scans to composition as one plan, with no stage written."""
    lazy = Study(s.spark, s.folder, s.params, lazy=True)
    return survey.band_histogram(lazy.banded, lazy.params)


@query(
    "agg8_gap_and_coverage",
    """SELECT stratum, count(*) AS n, quantile_cont(gap_days, 0.5) AS gap_p50, quantile_cont(gap_days, 0.9) AS gap_p90, max(gap_days) AS gap_max,
      min(n_definite) AS definite_min, quantile_cont(n_definite, 0.1) AS definite_p10, quantile_cont(n_definite, 0.5) AS definite_med,
      quantile_cont(n_responded, 0.5) AS responded_med, count(*) FILTER (WHERE provenance = 'customer') AS customer FROM banded GROUP BY 1""",
    doubles="gap_p50 gap_p90 gap_max definite_p10 definite_med responded_med",
)
def agg8(s: Study) -> DataFrame:
    return survey.gap_and_coverage(s.banded, s.params)


MOVES = {
    "moves": """SELECT p.sha256, count(*) FILTER (WHERE in_t) AS at_t_n, count(*) FILTER (WHERE in_l) AS at_l_n,
        count(*) FILTER (WHERE tv) AS tm, count(tv) AS td, count(*) FILTER (WHERE lv) AS lm, count(lv) AS ld,
        count(*) FILTER (WHERE tv AND in_l) AS btm, count(tv) FILTER (WHERE in_l) AS btd,
        count(*) FILTER (WHERE lv AND in_t) AS blm, count(lv) FILTER (WHERE in_t) AS bld FROM paired p GROUP BY 1""",
}


@query(
    "agg9_change_totals",
    f"""SELECT count(*) AS artifacts, sum(flips)::BIGINT AS flips, sum(retractions)::BIGINT AS retractions, sum(joined)::BIGINT AS joined,
      sum("left")::BIGINT AS "left", sum(stable)::BIGINT AS stable, count(*) FILTER (WHERE flips > 0) AS with_flip,
      count(*) FILTER (WHERE {band_sql('tm', 'td')} <> {band_sql('lm', 'ld')}) AS moved_all,
      count(*) FILTER (WHERE {band_sql('btm', 'btd')} <> {band_sql('blm', 'bld')}) AS moved_both
      FROM moves JOIN changes USING (sha256) WHERE at_t_n > 0 AND at_l_n > 0""",
    **MOVES,
)
def agg9(s: Study) -> DataFrame:
    return survey.change_totals(s.long, s.params.bands)


@query(
    "agg10_band_moved",
    f"""SELECT count(*) FILTER (WHERE {band_sql('tm', 'td')} <> {band_sql('lm', 'ld')}) AS moved_all,
      count(*) FILTER (WHERE {band_sql('btm', 'btd')} <> {band_sql('blm', 'bld')}) AS moved_both
      FROM moves WHERE at_t_n > 0 AND at_l_n > 0 AND sha256 IN (SELECT sha256 FROM cohort)""",
    **MOVES,
)
def agg10(s: Study) -> DataFrame:
    of_cohort = s.cohort_long
    return survey.change_totals(of_cohort, s.params.bands).select("moved_all", "moved_both")


@query(
    "agg11_family_diversity",
    """SELECT (SELECT count(DISTINCT sha256) FROM base) AS artifacts, count(*) AS with_family, count(DISTINCT modal_family) AS distinct_families,
      count(DISTINCT modal_family)::DOUBLE / count(*) AS families_per_artifact FROM modal_l""",
    doubles="families_per_artifact",
    **MODAL_L,
)
def agg11(s: Study) -> DataFrame:
    return survey.family_diversity(s.base, s.long)


@query(
    "agg12_rates",
    """SELECT l.label, avg((c.label = l.label)::INT) AS raw, sum((c.label = l.label)::INT / c.pi) / sum(1 / c.pi) AS weighted
      FROM (VALUES ('malicious'), ('benign'), ('unwanted'), ('undecidable')) l(label), labelled_cohort c GROUP BY 1""",
    doubles="raw weighted",
)
def agg12(s: Study) -> DataFrame:
    return labels.rates(s.labels)


@query("agg12_rates_by_stratum", "SELECT stratum, label, count(*) AS n FROM labelled_cohort GROUP BY 1, 2")
def agg12_by(s: Study) -> DataFrame:
    return labels.rates_by(s.labels, "stratum")


@query(
    "agg13_prevalence",
    """SELECT fold, count(*) AS n, round(avg(y), 4) AS raw, round(sum(y / pi) / sum(1 / pi), 4) AS reweighted
      FROM split_ WHERE NOT in_gap GROUP BY 1""",
    doubles="raw reweighted",
)
def agg13(s: Study) -> DataFrame:
    return splits.prevalence(s.split.filter(~F.col("in_gap")), "fold")


@query(
    "agg14_three_ways",
    """SELECT avg((m >= 0.5)::INT) AS cohort_raw, sum((m >= 0.5)::INT / pi) / sum(1 / pi) AS cohort_weighted,
      (SELECT avg((m >= 0.5)::INT) FROM base JOIN shares USING (sha256)) AS base_direct FROM cohort c JOIN shares USING (sha256)""",
    doubles="cohort_raw cohort_weighted base_direct",
    shares="""SELECT sha256, (count(*) FILTER (WHERE verdict))::DOUBLE / count(verdict) AS m FROM at_l GROUP BY 1 HAVING count(verdict) > 0""",
)
def agg14(s: Study) -> DataFrame:
    return survey.three_ways(s.base, s.cohort, s.long)


@query(
    "agg15_realized_shares",
    """SELECT c.stratum, count(*) AS n_draw, max(c.n_available) AS n_available, max(c.pi) AS pi,
      count(*)::DOUBLE / (SELECT count(*) FROM cohort) AS realized_share, max(t.target_share) AS target_share,
      abs(count(*)::DOUBLE / max(c.n_available) - max(c.pi)) <= 1e-9 AS pi_ok
      FROM cohort c JOIN targets t USING (stratum) GROUP BY 1""",
    doubles="pi realized_share target_share",
)
def agg15(s: Study) -> DataFrame:
    return survey.realized_shares(s.cohort, s.params)


@query(
    "agg17_history_extent",
    "SELECT min(created) AS earliest, max(created) AS latest, count(*) AS instances FROM instances",
)
def agg17(s: Study) -> DataFrame:
    return survey.history_extent(s.instances)


@query(
    "agg17_history_by_year",
    """SELECT year(created)::INT AS yr, count(*) AS instances, count(DISTINCT sha256) AS artifacts, count(completed) AS revealed
      FROM instances GROUP BY 1""",
)
def agg17_years(s: Study) -> DataFrame:
    return survey.history_by_year(s.instances)


FILLED = ("scan_config", "meta_community", "actions", "completed", "extended_type")


@query(
    "agg18_column_fill",
    "SELECT year(created)::INT AS yr, count(*) AS rows, "
    + ", ".join(f"round(100.0::DOUBLE * count({c}) / count(*), 1) AS pct_{c}" for c in FILLED)
    + " FROM instances GROUP BY 1",
    doubles=" ".join(f"pct_{c}" for c in FILLED),
)
def agg18(s: Study) -> DataFrame:
    return survey.column_fill(s.instances, FILLED)


PER_YEAR = {
    "per_year": """SELECT year(i.created)::INT AS yr, v.author, count(*) AS assertions FROM instances i JOIN verdicts v ON v.instance_number = i.number
        WHERE i.completed IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 100"""
}


@query("agg19_engines_active", "SELECT yr, count(*) AS engines_active FROM per_year GROUP BY 1", **PER_YEAR)
def agg19(s: Study) -> DataFrame:
    return survey.engines_active(survey.engines_by_year(s.instances, s.verdicts))


@query(
    "agg20_value_domains",
    """SELECT scan_config, meta_community, count(*) AS rows, count(*) FILTER (WHERE json_extract_string(actions, '$._default') = 'false') AS storage_only,
      count(completed) AS revealed, count(failed) AS failed_known, count(*) FILTER (WHERE failed) AS failed_rows FROM instances GROUP BY 1, 2""",
)
def agg20(s: Study) -> DataFrame:
    return s.instances.groupBy("scan_config", "meta_community").agg(
        F.count("*").alias("rows"),
        F.count_if(F.get_json_object("actions", "$._default") == "false").alias("storage_only"),
        F.count("completed").alias("revealed"),
        F.count("failed").alias("failed_known"),
        F.count_if("failed").alias("failed_rows"),
    )


@query(
    "agg21_duration_sanity",
    """SELECT quantile_disc(date_diff('second', created, completed), 0.5) AS median_lag, min(date_diff('second', created, completed)) AS min_lag,
      count(*) FILTER (WHERE completed < created) AS impossible_rows FROM instances WHERE completed IS NOT NULL""",
)
def agg21(s: Study) -> DataFrame:
    return survey.duration_sanity(s.instances, s.params)


@query(
    "agg22_frame_survey",
    """SELECT count(*) AS frame, count(label_instance_number) AS labellable, count(label_instance_number)::DOUBLE / count(*) AS labellable_share,
      count(*) FILTER (WHERE provenance = 'customer') AS customer,
      count(label_instance_number) FILTER (WHERE provenance = 'customer') AS customer_labellable,
      count(label_instance_number) * 5.0 AS labellable_scaled FROM labelled WHERE CAST('0x' || substr(md5(sha256), 1, 8) AS BIGINT) % 100 < 20""",
    doubles="labellable_share labellable_scaled",
)
def agg22(s: Study) -> DataFrame:
    """The survey of a hash sample, scaled back to the whole: sampling is the feature here."""
    return survey.frame_survey(s.labelled.filter(frame.hash_percent("sha256", 20)), sample_pct=20)


SAMPLED = "(SELECT * FROM banded WHERE CAST('0x' || substr(md5(sha256), 1, 8) AS BIGINT) % 100 < 20)"


@query(
    "agg22_band_survey",
    f"""SELECT h.*, c.* EXCLUDE (stratum) FROM ({HISTOGRAM}) h LEFT JOIN (
      SELECT stratum, quantile_cont(gap_days, 0.5) AS gap_p50, quantile_cont(gap_days, 0.9) AS gap_p90, max(gap_days) AS gap_max,
        min(n_definite) AS definite_min, quantile_cont(n_definite, 0.1) AS definite_p10, quantile_cont(n_definite, 0.5) AS definite_med,
        quantile_cont(n_responded, 0.5) AS responded_med, count(*) FILTER (WHERE provenance = 'customer') AS customer FROM banded GROUP BY 1) c
      ON c.stratum = h.stratum""",
    doubles="share target_share gap_p50 gap_p90 gap_max definite_p10 definite_med responded_med",
)
def agg22_bands(s: Study) -> DataFrame:
    return survey.band_survey(s.banded, s.params)


@query(
    "agg22_scaled_largest_cohort",
    f"""SELECT floor(min(fills_cohort_up_to) * 5.0)::BIGINT AS largest_cohort FROM (
      {HISTOGRAM.replace("FROM banded", f"FROM {SAMPLED}")})""",
)
def agg22_largest(s: Study) -> DataFrame:
    """The largest cohort of the whole, from a hash sample: sampling is the feature here."""
    sample = s.banded.filter(frame.hash_percent("sha256", 20))
    return survey.largest_cohort(survey.band_histogram(sample, s.params), sample_pct=20)


RESCANNED = "first_definite > 0 AND latest_instance <> first_instance"


@query(
    "agg23_slice_survey",
    f"""SELECT count(*) AS documents, count(*) * 16.0 AS documents_scaled, count(*) FILTER (WHERE first_definite = 0) AS unscanned_first,
      count(*) FILTER (WHERE first_definite = 0 AND latest_definite > 0) AS scanned_later, count(*) FILTER (WHERE first_definite > 0) AS scanned_first,
      count(*) FILTER (WHERE {RESCANNED}) AS rescanned,
      (count(*) FILTER (WHERE {RESCANNED}))::DOUBLE / count(*) FILTER (WHERE first_definite > 0) AS rescanned_share FROM slice""",
    doubles="documents_scaled rescanned_share",
    slice=SLICE_SQL,
)
def agg23(s: Study) -> DataFrame:
    return survey.slice_survey(slice_of(s), 1 / 16)


@query(
    "agg23_slice_quantiles",
    f"""SELECT measure, count(*) AS n, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.9) AS p90, max(v) AS most FROM (
      SELECT 'gap_days' AS measure, date_diff('microsecond', first_created, latest_created) / 86400000000.0 AS v FROM slice WHERE {RESCANNED}
      UNION ALL SELECT 'first_definite', first_definite::DOUBLE FROM slice WHERE first_definite > 0) GROUP BY 1""",
    doubles="p10 p50 p90 most",
    slice=SLICE_SQL,
)
def agg23_quantiles(s: Study) -> DataFrame:
    return survey.slice_quantiles(slice_of(s), s.params)


@query(
    "agg23_mimetypes",
    "SELECT mimetype, count(*) AS n FROM slice GROUP BY 1 ORDER BY n DESC, mimetype NULLS LAST LIMIT 5",
    slice=SLICE_SQL,
)
def agg23_mimetypes(s: Study) -> DataFrame:
    return survey.mimetype_counts(slice_of(s))


@query(
    "agg23_slice_bands",
    f"""SELECT {band_sql('first_malicious', 'first_definite')} AS stratum, count(*) AS labellable, median(gap) AS gap_p50, median(first_definite) AS definite_med
      FROM (SELECT *, date_diff('microsecond', first_created, latest_created) / 86400000000.0 AS gap FROM slice, (SELECT 1000 AS hmax) WHERE {LABELLABLE})
      GROUP BY 1""",
    doubles="gap_p50 definite_med",
    slice=SLICE_SQL,
)
def agg23_bands(s: Study) -> DataFrame:
    rows = survey.slice_columns(slice_of(s))
    good = survey.labellable_at(30, 1000, F.col("_gap"), F.col("_rescanned"), F.col("_ldef"))
    kept = rows.filter(good).select(
        F.col("first_malicious").alias("n_malicious"), F.col("first_definite").alias("n_definite"), F.col("_gap").alias("gap_days")
    )
    from ..operators.draw import with_band

    banded = with_band(kept, s.params.bands)
    gaps = exact_quantiles(banded, by=["stratum"], value="gap_days", quantiles={"gap_p50": 0.5}, buckets=s.params.skew.buckets)
    rest = banded.groupBy("stratum").agg(
        F.count("*").alias("labellable"), F.percentile("n_definite", F.lit(0.5)).alias("definite_med")
    )
    return rest.join(gaps, "stratum")


@query(
    "agg23_prefix_sizing",
    f"""SELECT fills, CASE WHEN 10000.0 / (fills * 256) < 1 THEN greatest(1, floor(-ln(10000.0 / (fills * 256)) / ln(16.0)))::INT END AS prefix_digits
      FROM (SELECT min(floor(coalesce(b.n, 0) / t.target_share))::BIGINT AS fills FROM targets t LEFT JOIN (
        SELECT {band_sql('first_malicious', 'first_definite')} AS stratum, count(*) AS n FROM slice, (SELECT 1000 AS hmax) WHERE {LABELLABLE} GROUP BY 1) b
        USING (stratum) WHERE t.target_share > 0)""",
    slice=SLICE_SQL,
)
def agg23_prefix(s: Study) -> DataFrame:
    rows = survey.slice_columns(slice_of(s))
    good = survey.labellable_at(30, 1000, F.col("_gap"), F.col("_rescanned"), F.col("_ldef"))
    bands = rows.filter(good).select(
        F.col("first_malicious").alias("n_malicious"), F.col("first_definite").alias("n_definite")
    )
    from ..operators.draw import with_band

    largest = survey.largest_cohort(survey.band_histogram(with_band(bands, s.params.bands), s.params))
    fills = F.col("largest_cohort")
    return largest.select(
        fills.alias("fills"), survey.prefix_length(10_000, fills, 1 / 256).alias("prefix_digits")
    )


@query(
    "agg24_status_crosstab",
    "SELECT stratum, "
    + ", ".join(f"count(*) FILTER (WHERE status = '{x}') AS {x}" for x in forced.STATUSES)
    + " FROM overlaid GROUP BY 1",
    **STATUS_CTE,
)
def agg24(s: Study) -> DataFrame:
    return forced.status_by_band(overlaid(s))


@query(
    "agg25_dropped_after_draw",
    "SELECT stratum, status, count(*) AS n FROM overlaid WHERE status <> 'labelled' GROUP BY 1, 2",
    **STATUS_CTE,
)
def agg25(s: Study) -> DataFrame:
    return forced.dropped_after_draw(overlaid(s))


@query(
    "agg26_straddling_groups",
    'SELECT count(*) AS straddling FROM (SELECT "group" FROM split_ GROUP BY 1 HAVING count(DISTINCT fold) > 1)',
)
def agg26(s: Study) -> DataFrame:
    return splits.straddling(s.split)


@query(
    "agg27_count_drift",
    """SELECT count(*) FILTER (WHERE o.n IS DISTINCT FROM c.n_responded) AS drifted, count(*) AS compared
      FROM scans s LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) o ON o.l_orderkey = s.number
      LEFT JOIN counts c ON c.instance_number = s.number""",
)
def agg27(s: Study) -> DataFrame:
    lines = s.table("lineitem").groupBy(F.col("l_orderkey").alias("number")).agg(F.count("*").alias("n"))
    counts = frame.verdict_counts(s.verdicts, "instance_number").withColumnRenamed("instance_number", "number")
    both = s.scans.select("number").join(lines, "number", "left").join(counts, "number", "left")
    return both.agg(checks.drifted(F.col("n"), F.col("n_responded")).alias("drifted"), F.count("*").alias("compared"))


@query(
    "agg28_scans_per_artifact",
    """SELECT count(*) AS files, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, max(n) AS max,
      (count(*) FILTER (WHERE n > 2))::DOUBLE / count(*) AS share_over_two FROM (SELECT sha256, count(*) AS n FROM scans GROUP BY 1)""",
    doubles="p50 p90 share_over_two",
)
def agg28(s: Study) -> DataFrame:
    return survey.scans_per_artifact(s.scans)


@query(
    "agg29_top_values",
    "SELECT extended_type, mimetype, count(*) AS n FROM instances GROUP BY 1, 2 ORDER BY n DESC, extended_type NULLS FIRST, mimetype LIMIT 5",
)
def agg29(s: Study) -> DataFrame:
    """A top-k report, so the limit is the feature."""
    return survey.value_counts(s.instances, "extended_type", "mimetype", k=5)


@query("agg29_reasons", "SELECT reason, count(*) AS n FROM labelled_cohort GROUP BY 1")
def agg29_reasons(s: Study) -> DataFrame:
    return survey.value_counts(s.labels, "reason")
