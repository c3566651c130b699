"""Queries over joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks, draw, features, forced, frame, labels, metrics, survey
from ..sources import pages
from ..sources.tables import ROSTER
from .q_filters import ELIGIBLE
from .q_sources import key_file, render_lines
from .ctes import band_sql
from .registry import query
from .study import Study


@query(
    "join1_first_ever",
    f"""SELECT sha256, number AS instance_number, completed AS scoring_moment FROM (
      SELECT s.*, row_number() OVER (PARTITION BY sha256 ORDER BY completed, number) AS rn FROM seen s
      WHERE {ELIGIBLE} AND NOT EXISTS (SELECT 1 FROM seen e WHERE e.sha256 = s.sha256 AND e.completed < s.completed)) WHERE rn = 1""",
    seen="""SELECT * FROM instances i WHERE completed IS NOT NULL AND failed IS NOT TRUE
      AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = i.number)""",
)
def join1(s: Study) -> DataFrame:
    seen = frame.with_verdicts(s.instances.filter(frame.revealed()), s.verdicts)
    return frame.first_seen(seen, frame.eligible()).select("sha256", "instance_number", "scoring_moment")


@query(
    "join2_first_reveal_back_join",
    """SELECT s.sha256, min(s.number) AS instance_number, f.first_reveal FROM scans s
      JOIN (SELECT sha256, min(completed) AS first_reveal FROM scans GROUP BY 1) f ON f.sha256 = s.sha256 AND f.first_reveal = s.completed
      WHERE s.scan_config IS DISTINCT FROM 'feed' GROUP BY 1, 3""",
)
def join2(s: Study) -> DataFrame:
    seen = frame.first_seen(s.scans, frame.not_feed())
    return seen.select("sha256", "instance_number", F.col("scoring_moment").alias("first_reveal"))


@query(
    "join3_nearest_later",
    "SELECT sha256, label_instance_number, label_moment, gap_days, l_definite, l_malicious FROM nearest",
    doubles="gap_days",
)
def join3(s: Study) -> DataFrame:
    return s.nearest.select("sha256", "label_instance_number", "label_moment", "gap_days", "l_definite", "l_malicious")


# Scans as they are, unfinished and failed ones included, of which only eligible ones open a history.
ELIGIBLE_CTES = {
    "answered": "SELECT i.*, c.n_definite, c.n_malicious, c.n_responded FROM instances i JOIN counts c ON c.instance_number = i.number",
    "opened": f"""SELECT sha256, number AS instance_number, completed AS scoring_moment, scan_config, n_definite, n_malicious, n_responded FROM (
      SELECT s.*, row_number() OVER (PARTITION BY sha256 ORDER BY completed, number) AS rn FROM answered s
      WHERE {ELIGIBLE} AND NOT EXISTS (SELECT 1 FROM answered e WHERE e.sha256 = s.sha256 AND e.completed < s.completed AND e.failed IS NOT TRUE))
      WHERE rn = 1""",
    "followed": """SELECT * FROM (SELECT f.sha256, s.number AS label_instance_number, s.completed AS label_moment,
      date_diff('microsecond', f.scoring_moment, s.completed) / 86400000000.0 AS gap_days, s.n_definite AS l_definite, s.n_malicious AS l_malicious,
      row_number() OVER (PARTITION BY f.sha256 ORDER BY s.completed, s.number) AS rn
      FROM opened f JOIN answered s ON s.sha256 = f.sha256 AND s.failed IS NOT TRUE
        AND s.completed >= f.scoring_moment + INTERVAL 30 DAY AND s.completed < f.scoring_moment + INTERVAL 365 DAY) WHERE rn = 1""",
}


def eligible_labelled(s: Study) -> DataFrame:
    """Histories of eligible first scans, and their nearest later finished scan that did not fail."""
    answered = frame.counted_scans(s.instances, s.counts())
    first = frame.first_seen(answered.filter(frame.revealed()), frame.eligible(), carry=frame.COUNTS)
    return frame.labelled_frame(first, frame.nearest_later(first, answered, s.params))


@query(
    "join3_eligible_nearest",
    "SELECT sha256, label_instance_number, label_moment, gap_days, l_definite, l_malicious FROM followed",
    doubles="gap_days",
    **ELIGIBLE_CTES,
)
def join3_eligible(s: Study) -> DataFrame:
    kept = eligible_labelled(s).filter(F.col("label_instance_number").isNotNull())
    return kept.select("sha256", "label_instance_number", "label_moment", "gap_days", "l_definite", "l_malicious")


@query(
    "join5_eligible_unlabellable_kept",
    """SELECT o.sha256, o.instance_number, f.label_instance_number, o.n_definite, o.n_malicious, o.n_responded
      FROM opened o LEFT JOIN followed f USING (sha256)""",
    **ELIGIBLE_CTES,
)
def join5_eligible(s: Study) -> DataFrame:
    return eligible_labelled(s).select("sha256", "instance_number", "label_instance_number", "n_definite", "n_malicious", "n_responded")


@query(
    "flagship_eligible_composition",
    f"""SELECT stratum, count(*) AS n FROM (SELECT {band_sql("o.n_malicious", "o.n_definite")} AS stratum FROM opened o JOIN followed USING (sha256))
      GROUP BY 1""",
    **ELIGIBLE_CTES,
)
def flagship_eligible(s: Study) -> DataFrame:
    base = draw.with_band(frame.base_snapshot(eligible_labelled(s)), s.params.bands)
    return base.groupBy("stratum").agg(F.count("*").alias("n"))


@query(
    "join4_all_later",
    "SELECT f.sha256, s.number, s.completed FROM frame f JOIN scored s ON s.sha256 = f.sha256 AND s.completed > f.scoring_moment",
)
def join4(s: Study) -> DataFrame:
    return frame.later_scans(s.labelled, s.scored, s.params).select("sha256", "number", "completed")


@query(
    "join5_unlabellable_kept",
    "SELECT sha256, instance_number, label_instance_number, n_definite, n_malicious, n_responded FROM labelled",
)
def join5(s: Study) -> DataFrame:
    lazy = frame.labelled_frame(s.frame, s.nearest)
    return lazy.select("sha256", "instance_number", "label_instance_number", "n_definite", "n_malicious", "n_responded")


@query(
    "join6_key_lookup",
    "SELECT v.instance_number, v.author, v.verdict FROM verdicts v WHERE v.instance_number IN (SELECT instance_number FROM frame)",
)
def join6(s: Study) -> DataFrame:
    keys = s.labelled.select("instance_number")
    return s.verdicts.join(keys, "instance_number", "left_semi").select("instance_number", "author", "verdict")


@query("join7_long_verdicts", "SELECT sha256, scan_role, instance_number, author, verdict, bid, malware_family FROM long")
def join7(s: Study) -> DataFrame:
    return frame.long_verdicts(frame.roles(s.base), s.verdicts).select(
        "sha256", "scan_role", "instance_number", "author", "verdict", "bid", "malware_family"
    )


@query(
    "join8_membership_gate",
    "SELECT sha256, instance_number FROM frame WHERE sha256 IN (SELECT sha256(CAST(c_custkey AS varchar)) FROM customer WHERE c_custkey % 3 <> 0)",
)
def join8(s: Study) -> DataFrame:
    return frame.members(s.labelled, pages.key_list(s.spark, key_file(s))).select("sha256", "instance_number")


@query(
    "join9_verdict_comparison",
    """SELECT sha256, author, CASE WHEN NOT in_t THEN 'joined' WHEN NOT in_l THEN 'left' WHEN tv IS NOT DISTINCT FROM lv THEN 'stable'
      WHEN tv AND NOT lv THEN 'retraction' ELSE 'flip' END AS change FROM paired""",
)
def join9(s: Study) -> DataFrame:
    t, l = F.col("t_state"), F.col("l_state")
    kind = (
        F.when(t.isNull(), "joined")
        .when(l.isNull(), "left")
        .when(t == l, "stable")
        .when((t == 1) & (l == 0), "retraction")
        .otherwise("flip")
    )
    return labels.paired(s.long).select("sha256", "author", kind.alias("change"))


@query(
    "join10_one_to_one",
    "SELECT c.sha256, c.stratum, l.label, l.reason FROM cohort c JOIN labelled_cohort l ON l.sha256 = c.sha256",
)
def join10(s: Study) -> DataFrame:
    left, right = s.cohort.select("sha256", "stratum"), s.labels.select("sha256", "label", "reason")
    checks.one_to_one(left, right, "sha256")
    return left.join(right, "sha256")


@query(
    "join11_zero_filled_blocks",
    """SELECT c.sha256, coalesce(f.n_with_family, 0) AS n_with_family, coalesce(f.modal_family, '') AS modal_family,
      coalesce(a.n_unknown, 0) AS n_unknown FROM cohort c LEFT JOIN families f ON f.sha256 = c.sha256 LEFT JOIN aggs a ON a.sha256 = c.sha256""",
)
def join11(s: Study) -> DataFrame:
    return s.matrix[0].select("sha256", "n_with_family", "modal_family", "n_unknown")


def _aligned_sql() -> str:
    known = ", ".join(
        f"(count(*) FILTER (WHERE author = '{e}') > 0)::INT AS engine_{e}_responded,"
        f" (count(*) FILTER (WHERE author = '{e}' AND verdict) > 0)::INT AS engine_{e}_malicious"
        for e in ROSTER[:8]
    )
    absent = ", ".join(f"0 AS engine_{e}_responded, 0 AS engine_{e}_malicious" for e in ROSTER[8:])
    return f"SELECT sha256, {known}, {absent} FROM long WHERE scan_role = 'feature' GROUP BY 1"


@query("join12_column_alignment", _aligned_sql())
def join12(s: Study) -> DataFrame:
    narrow = features.encode_verdicts(s.first_verdicts, ROSTER[:8], strict=False)
    return features.align(narrow, ["sha256", *features.flag_columns(ROSTER)])


def cohort_renders(s: Study) -> DataFrame:
    """The renders of the cohort's own scans, which are all that its overlay asks for."""
    scans = frame.roles(s.cohort).select(F.col("instance_number").alias("number")).distinct()
    return pages.parse_renders(render_lines(s, scans))


def overlaid(s: Study) -> DataFrame:
    """The cohort with its label scan as the forced one, for artifacts with an even number."""
    drawn = s.cohort.select("sha256", "stratum", "pi", "n_available", "instance_number", "scoring_moment", "label_instance_number")
    submitted = drawn.filter(F.col("label_instance_number") % 4 != 0).select(
        "sha256", F.col("label_instance_number").alias("rescan_instance")
    )
    return forced.overlay(drawn, submitted, pages.render_rows(cohort_renders(s)))


STATUS_CTE = {
    "renders_": """SELECT o_orderkey AS instance, o_orderdate AS created, o_orderstatus <> 'P' AS window_closed, o_orderkey % 31 = 0 AS failed,
        o_orderkey % 37 = 0 AS missing, coalesce(n_responded, 0) AS n FROM orders LEFT JOIN counts ON instance_number = o_orderkey""",
    "overlaid": """SELECT c.*, l.created AS l_created, CASE WHEN c.label_instance_number % 4 = 0 THEN 'not_submitted'
        WHEN coalesce(l.missing, false) OR coalesce(t.missing, false) THEN 'missing_render' WHEN l.failed THEN 'failed'
        WHEN NOT l.window_closed THEN 'pending' WHEN l.n = 0 OR t.n = 0 THEN 'no_assertions' ELSE 'labelled' END AS status
        FROM cohort c LEFT JOIN renders_ l ON l.instance = c.label_instance_number LEFT JOIN renders_ t ON t.instance = c.instance_number""",
}


@query("join13_status_overlay", "SELECT sha256, stratum, status FROM overlaid", **STATUS_CTE)
def join13(s: Study) -> DataFrame:
    return overlaid(s).select("sha256", "stratum", "status")


@query(
    "join14_latest_is_nearest",
    """SELECT count(*) AS labellable, count(*) FILTER (WHERE label_instance_number = number) AS latest_is_label,
      (count(*) FILTER (WHERE label_instance_number = number))::DOUBLE / count(*) AS share FROM nearest n JOIN
      (SELECT sha256, number, row_number() OVER (PARTITION BY sha256 ORDER BY completed DESC, number DESC) AS rn FROM scored) l
      ON l.sha256 = n.sha256 AND rn = 1""",
    doubles="share",
)
def join14(s: Study) -> DataFrame:
    return survey.latest_is_nearest(s.labelled, s.scored, s.base)


@query(
    "join15_in_subquery",
    "SELECT sha256, min(completed) AS first_reveal FROM scans WHERE sha256 IN (SELECT sha256 FROM scans WHERE scan_config = 'feed') GROUP BY 1",
)
def join15(s: Study) -> DataFrame:
    feed = s.scans.filter(F.col("scan_config") == "feed").select("sha256")
    return s.scans.join(feed, "sha256", "left_semi").groupBy("sha256").agg(F.min("completed").alias("first_reveal"))


@query(
    "join16_run_pairs",
    """SELECT a.run AS run_a, b.run AS run_b, avg(abs(a.score - b.score)) AS score_mad FROM runs a JOIN runs b
      ON a.sha256 = b.sha256 AND a.run < b.run GROUP BY 1, 2""",
    doubles="score_mad",
    runs="""SELECT doc_id AS sha256, unnest(['r1', 'r2', 'r3']) AS run, unnest([n_chars::DOUBLE, sqrt(n_chars), (doc_id % 97)::DOUBLE]) AS score FROM documents""",
)
def join16(s: Study) -> DataFrame:
    return metrics.stability(run_scores(s), ["r1", "r2", "r3"], s.params.skew).select("run_a", "run_b", "score_mad")


def run_scores(s: Study) -> DataFrame:
    """Three scores per document, as three runs."""
    scores = {"r1": F.col("n_chars").cast("double"), "r2": F.sqrt("n_chars"), "r3": (F.col("doc_id") % 97).cast("double")}
    listed = F.explode(F.array(*[F.struct(F.lit(n).alias("run"), c.alias("score")) for n, c in scores.items()]))
    return s.table("documents").select(F.col("doc_id").alias("sha256"), listed.alias("r")).select("sha256", "r.*")
