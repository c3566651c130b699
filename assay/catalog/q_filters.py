"""Queries over projections, filters and boundary checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import provenance_of, scan_action
from ..operators import checks, forced, frame, survey
from ..sources import pages
from .q_sources import SLICE_SQL, slice_of
from .registry import query
from .study import Study

ELIGIBLE = """meta_community = '_public' AND artifact_type = 'FILE' AND completed IS NOT NULL AND failed IS NOT TRUE
    AND state <> 'KNOWN_GOOD' AND CAST(coalesce(json_extract_string(actions, '$.scan'), json_extract_string(actions, '$._default'), 'true') AS BOOLEAN)
    AND mimetype IN ('application/x-dosexec', 'application/vnd.microsoft.portable-executable', 'application/x-msdownload')"""


@query(
    "flt1_eligible_scans",
    f"""SELECT number, sha256, completed, scan_config FROM instances WHERE {ELIGIBLE}
    AND completed >= TIMESTAMP '1996-01-01' AND completed < TIMESTAMP '2000-01-01'""",
)
def flt1(s: Study) -> DataFrame:
    kept = s.instances.filter(frame.eligible() & frame.in_window("completed", "1996-01-01", "2000-01-01"))
    return kept.select("number", "sha256", "completed", "scan_config")


@query("flt2_null_safe_exclusion", "SELECT number, scan_config FROM scans WHERE scan_config IS DISTINCT FROM 'feed'")
def flt2(s: Study) -> DataFrame:
    return s.scans.filter(frame.not_feed()).select("number", "scan_config")


@query(
    "flt3_json_flag",
    """SELECT number, CAST(coalesce(json_extract_string(actions, '$.scan'), json_extract_string(actions, '$._default'), 'true') AS BOOLEAN) AS scanned
    FROM instances""",
)
def flt3(s: Study) -> DataFrame:
    return s.instances.select("number", scan_action(F.col("actions")).alias("scanned"))


@query("flt4_with_verdicts", "SELECT number, sha256 FROM scans WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = number)")
def flt4(s: Study) -> DataFrame:
    return frame.with_verdicts(s.scans, s.verdicts).select("number", "sha256")


@query("flt5_hash_percent", "SELECT number, sha256 FROM scans WHERE CAST('0x' || substr(md5(sha256), 1, 8) AS BIGINT) % 100 < 20")
def flt5(s: Study) -> DataFrame:
    return s.scans.filter(frame.hash_percent("sha256", 20)).select("number", "sha256")


@query("flt6_prefix_sample", "SELECT number, sha256, 1 / 16.0 AS pi_base FROM scans WHERE sha256 LIKE 'a%'", doubles="pi_base")
def flt6(s: Study) -> DataFrame:
    return frame.prefix_sample(s.scans, "a").select("number", "sha256", "pi_base")


@query(
    "flt7_prefix_union",
    "SELECT number, sha256, 1 / 16.0 + 1 / 256.0 AS pi_base FROM scans WHERE sha256 LIKE 'a%' OR sha256 LIKE 'b1%'",
    doubles="pi_base",
)
def flt7(s: Study) -> DataFrame:
    slices = {p: s.scans.filter(F.col("sha256").startswith(p)) for p in ("a", "b1")}
    return frame.prefix_union(slices, {("1995-01-01", "2002-01-01")}).select("number", "sha256", "pi_base")


@query(
    "flt8_forced_frame",
    """SELECT sha256, size, first_created, date_diff('microsecond', first_created, TIMESTAMP '2001-01-01') / 86400000000.0 AS age_days
    FROM slice WHERE first_definite > 0 AND age_days >= 365 AND age_days < 2000 AND NOT coalesce(size > 800000, false)""",
    doubles="age_days",
    slice=SLICE_SQL,
)
def flt8(s: Study) -> DataFrame:
    now = F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")
    return forced.forced_frame(slice_of(s), now, 365, 2000, 800_000).select("sha256", "size", "first_created", "age_days")


LABELLABLE = """first_definite > 0 AND latest_instance <> first_instance
    AND date_diff('microsecond', first_created, latest_created) / 86400000000.0 >= 30
    AND date_diff('microsecond', first_created, latest_created) / 86400000000.0 < hmax AND latest_definite > 0"""


@query(
    "flt9_horizon_ladder",
    f"""SELECT hmax, count(*) FILTER (WHERE {LABELLABLE}) AS labellable,
      (count(*) FILTER (WHERE {LABELLABLE}))::DOUBLE / count(*) AS share, (count(*) FILTER (WHERE {LABELLABLE})) * 16.0 AS scaled
      FROM slice, (VALUES (90), (180), (365), (1000)) h(hmax) GROUP BY 1""",
    doubles="share scaled",
    slice=SLICE_SQL,
)
def flt9(s: Study) -> DataFrame:
    return survey.slice_ladder(slice_of(s), 30, 1 / 16)


@query(
    "flt10_provenance",
    "SELECT number, CASE WHEN scan_config = 'feed' THEN 'feed' ELSE 'customer' END AS provenance FROM scans",
)
def flt10(s: Study) -> DataFrame:
    return s.scans.select("number", provenance_of(F.col("scan_config")).alias("provenance"))


@query(
    "flt11_metadata_projection",
    "SELECT instance_number, author, malware_family, '1.' || bid AS scanner_version FROM verdicts",
)
def flt11(s: Study) -> DataFrame:
    packed = s.verdicts.select(
        "instance_number",
        "author",
        F.to_json(
            F.struct("malware_family", F.concat(F.lit("1."), F.col("bid").cast("string")).alias("scanner"), F.lit("x").alias("rest"))
        ).alias("engine_metadata"),
    )
    return pages.project_metadata(packed)


@query(
    "flt12_as_of_guard",
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN name IN ('tags', 'combined_score') THEN 'regenerated'
      WHEN name IN ('pi', 'stratum') THEN 'bookkeeping' WHEN as_of > scoring_moment THEN 'late' END AS reason
      FROM (SELECT CASE number % 6 WHEN 0 THEN 'tags' WHEN 1 THEN 'pi' WHEN 2 THEN 'combined_score' WHEN 3 THEN 'stratum' ELSE 'n_malicious' END AS name,
        s.completed AS as_of, f.scoring_moment FROM scans s JOIN frame f USING (sha256))) WHERE reason IS NOT NULL GROUP BY 1""",
)
def flt12(s: Study) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("tags", "pi", "combined_score", "stratum", "n_malicious", "n_malicious")])
    fields = s.scans.join(s.labelled.select("sha256", "scoring_moment"), "sha256").select(
        F.get(names, (F.col("number") % 6).cast("int")).alias("name"), F.col("completed").alias("as_of"), "scoring_moment"
    )
    return checks.as_of_violations(fields).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "flt14_taxonomy_guard",
    """SELECT label, count(*) AS n FROM (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'malicious' WHEN '2-HIGH' THEN 'dual_use'
      WHEN '3-MEDIUM' THEN 'benign' WHEN '5-LOW' THEN 'known_good' END AS label FROM orders)
      WHERE label IS NULL OR label NOT IN ('malicious', 'benign', 'unwanted', 'undecidable') GROUP BY 1""",
)
def flt14(s: Study) -> DataFrame:
    p = F.col("o_orderpriority")
    fine = F.when(p == "1-URGENT", "malicious").when(p == "2-HIGH", "dual_use").when(p == "3-MEDIUM", "benign").when(p == "5-LOW", "known_good")
    return checks.stray_labels(s.table("orders").select(fine.alias("label")))


@query("flt15_grade_guard", "SELECT grade, count(*) AS n FROM labelled_cohort WHERE grade < 3 GROUP BY 1")
def flt15(s: Study) -> DataFrame:
    return checks.low_grades(s.labels)


@query(
    "flt16_row_balance",
    """SELECT 'frame to labels' AS boundary, (SELECT count(*) FROM frame) AS n_before, (SELECT count(*) FROM labelled) AS n_after,
      (SELECT count(*) FROM frame) = (SELECT count(*) FROM labelled) AS ok
      UNION ALL SELECT 'cohort to labels', (SELECT count(*) FROM cohort), (SELECT count(*) FROM labelled_cohort),
        (SELECT count(*) FROM cohort) = (SELECT count(*) FROM labelled_cohort)""",
)
def flt16(s: Study) -> DataFrame:
    first = checks.row_balance(s.frame, s.labelled, "frame to labels")
    return first.unionByName(checks.row_balance(s.cohort, s.labels, "cohort to labels"))
