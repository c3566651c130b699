"""Queries over draws, labels, features and splits."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import draw, features, forced, frame, labels, models, splits
from ..sources import pages
from ..sources.tables import ROSTER, artifact_key
from .q_aggregates import _flags_sql
from .q_joins import STATUS_CTE, cohort_renders, overlaid
from .registry import query
from .study import Study

# ---------------------------------------------------------------- draw


@query("draw1_bands", "SELECT sha256, stratum FROM banded")
def draw1(s: Study) -> DataFrame:
    return s.banded.select("sha256", "stratum")


@query("draw2_stratified_draw", "SELECT sha256, stratum, pi, n_available, n_draw FROM cohort", doubles="pi")
def draw2(s: Study) -> DataFrame:
    return draw.stratified_draw(s.base, s.params)[0].select("sha256", "stratum", "pi", "n_available", "n_draw")


@query("draw3_stratum_report", "SELECT * FROM report", doubles="target_share pi")
def draw3(s: Study) -> DataFrame:
    return s.report


@query(
    "draw4_draw_checks",
    """SELECT "check", violations, violations = 0 AS ok FROM (
      SELECT 'row_count' AS "check", abs((SELECT count(*) FROM cohort) - (SELECT sum(n_draw) FROM report))::BIGINT AS violations
      UNION ALL SELECT 'pi_range', count(*) FILTER (WHERE pi <= 0 OR pi > 1) FROM cohort
      UNION ALL SELECT 'duplicate_key', count(*) - count(DISTINCT sha256) FROM cohort)""",
)
def draw4(s: Study) -> DataFrame:
    return draw.check_draw(s.cohort, s.report)


@query("draw5_composite_pi", "SELECT sha256, pi AS pi_draw, 1 / 256.0 AS pi_base, pi / 256.0 AS pi FROM cohort", doubles="pi_draw pi_base pi")
def draw5(s: Study) -> DataFrame:
    return draw.composite_pi(s.cohort, 1 / 256).select("sha256", "pi_draw", "pi_base", "pi")


@query(
    "draw6_realized_pi",
    """SELECT o.sha256, o.stratum, k.n AS n_kept, k.n::DOUBLE / o.n_available AS pi_realized FROM overlaid o
      JOIN (SELECT stratum, count(*) AS n FROM overlaid WHERE status = 'labelled' GROUP BY 1) k USING (stratum) WHERE status = 'labelled'""",
    doubles="pi_realized",
    **STATUS_CTE,
)
def draw6(s: Study) -> DataFrame:
    kept = draw.realized_pi(overlaid(s), F.col("status") == "labelled")
    return kept.select("sha256", "stratum", "n_kept", "pi_realized")


@query(
    "draw7_stable_prefix",
    """SELECT count(*) AS small, count(c.sha256) AS kept_in_large FROM (SELECT b.sha256, b.stratum, row_number() OVER (PARTITION BY b.stratum ORDER BY md5(sha256 || '20260922'), sha256) AS rn FROM banded b)
      JOIN (VALUES ('contested', 90), ('leaning_malicious', 30), ('leaning_clean', 30), ('consensus_malicious', 20), ('consensus_clean', 20)) t(stratum, n) USING (stratum)
      LEFT JOIN (SELECT sha256 FROM cohort) c USING (sha256) WHERE rn <= n""",
)
def draw7(s: Study) -> DataFrame:
    """Members of a smaller draw that the larger one keeps: all of them."""
    small, _ = draw.stratified_draw(s.base, replace(s.params, cohort_size=200))
    kept = small.select("sha256").join(s.cohort.select(F.col("sha256"), F.lit(1).alias("kept")), "sha256", "left")
    return kept.agg(F.count("*").alias("small"), F.count("kept").alias("kept_in_large"))


@query("draw9_status", "SELECT status, count(*) AS n FROM overlaid GROUP BY 1", **STATUS_CTE)
def draw9(s: Study) -> DataFrame:
    return overlaid(s).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "draw10_collected_base",
    """SELECT o.sha256, o.instance_number, o.label_instance_number, c.n_definite AS t_definite, c.n_malicious AS t_malicious, c.n_responded AS t_responded,
      date_diff('microsecond', o.scoring_moment, o.l_created) / 86400000000.0 AS gap_days, k.n::DOUBLE / o.n_available AS pi_realized
      FROM overlaid o JOIN (SELECT stratum, count(*) AS n FROM overlaid WHERE status = 'labelled' GROUP BY 1) k USING (stratum)
      JOIN counts c ON c.instance_number = o.instance_number WHERE status = 'labelled'""",
    doubles="gap_days pi_realized",
    **STATUS_CTE,
)
def draw10(s: Study) -> DataFrame:
    rows = pages.explode_renders(cohort_renders(s))
    return forced.collected_base(overlaid(s), rows).select(
        "sha256", "instance_number", "label_instance_number", "t_definite", "t_malicious", "t_responded", "gap_days", "pi_realized"
    )


COLLECTED = {
    **STATUS_CTE,
    "kept_": """SELECT o.*, k.n AS n_kept FROM overlaid o JOIN (
        SELECT stratum, count(*) AS n FROM overlaid WHERE status = 'labelled' GROUP BY 1) k USING (stratum) WHERE status = 'labelled'""",
}


@query(
    "draw10_collected_cohort",
    """SELECT k.sha256, k.stratum, k.instance_number, k.label_instance_number, k.l_created AS label_moment,
      date_diff('microsecond', k.scoring_moment, k.l_created) / 86400000000.0 AS gap_days,
      t.n_definite, t.n_malicious, t.n_responded, l.n_definite AS l_definite, l.n_malicious AS l_malicious, l.n_responded AS l_responded,
      k.pi AS pi_draw, k.n_kept AS n_draw, k.n_kept::DOUBLE / k.n_available AS pi
      FROM kept_ k JOIN counts t ON t.instance_number = k.instance_number JOIN counts l ON l.instance_number = k.label_instance_number""",
    doubles="gap_days pi_draw pi",
    **COLLECTED,
)
def draw10_cohort(s: Study) -> DataFrame:
    cohort, _ = forced.collected_run(overlaid(s), pages.explode_renders(cohort_renders(s)))
    kept = ["sha256", "stratum", "instance_number", "label_instance_number", "label_moment", "gap_days"]
    return cohort.select(
        *kept, "n_definite", "n_malicious", "n_responded", "l_definite", "l_malicious", "l_responded", "pi_draw", "n_draw", "pi"
    )


@query(
    "draw10_collected_long",
    """SELECT k.sha256, r.scan_role, v.author, v.verdict, v.malware_family FROM kept_ k,
      LATERAL (VALUES ('feature', k.instance_number), ('label', k.label_instance_number)) r(scan_role, number)
      JOIN verdicts v ON v.instance_number = r.number""",
    **COLLECTED,
)
def draw10_long(s: Study) -> DataFrame:
    _, long = forced.collected_run(overlaid(s), pages.explode_renders(cohort_renders(s)))
    return long.select("sha256", "scan_role", "author", "verdict", "malware_family")


# ---------------------------------------------------------------- labels


@query("lab1_change", "SELECT * FROM changes")
def lab1(s: Study) -> DataFrame:
    return labels.change(s.long)


@query(
    "lab2_turnover",
    """SELECT sha256, flips + stable AS "both", (joined + "left")::DOUBLE / (flips + stable + joined + "left") AS turnover_rate FROM changes""",
    doubles="turnover_rate",
)
def lab2(s: Study) -> DataFrame:
    return labels.with_turnover(labels.change(s.long)).select("sha256", "both", "turnover_rate")


@query(
    "lab3_evidence",
    "SELECT sha256, n_definite, n_malicious, weighted_malicious, n_specific, n_generic, n_pup, n_dual_use FROM evidence",
    doubles="weighted_malicious",
)
def lab3(s: Study) -> DataFrame:
    return labels.evidence(s.long, s.params.generic_discount).select("sha256", *labels.EVIDENCE)


@query("lab4_labels", "SELECT sha256, label, grade, reason FROM labelled_cohort")
def lab4(s: Study) -> DataFrame:
    return labels.label(s.cohort, s.cohort_long, s.params).select("sha256", "label", "grade", "reason")


@query(
    "lab5_no_label_scan",
    """SELECT c.sha256, CASE WHEN c.n % 10 = 0 THEN 'no_label_scan_assertions' ELSE l.reason END AS reason FROM
      (SELECT sha256, instance_number AS n FROM cohort) c JOIN labelled_cohort l USING (sha256)""",
)
def lab5(s: Study) -> DataFrame:
    """A tenth of the cohort loses its label-scan rows and keeps a row with that reason."""
    lost = s.cohort.filter(F.col("instance_number") % 10 == 0).select("sha256", F.lit("label").alias("scan_role"))
    partial = s.cohort_long.join(lost, ["sha256", "scan_role"], "left_anti")
    return labels.label(s.cohort, partial, s.params).select("sha256", "reason")


@query(
    "lab6_trainable",
    "SELECT sha256, trainable, y, horizon_days FROM labelled_cohort",
    doubles="horizon_days",
)
def lab6(s: Study) -> DataFrame:
    return s.labels.select("sha256", "trainable", "y", "horizon_days")


@query(
    "lab7_taxonomy_fold",
    """SELECT folded, count(*) AS n FROM (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'malicious' WHEN '2-HIGH' THEN 'unwanted'
      WHEN '3-MEDIUM' THEN 'benign' WHEN '5-LOW' THEN 'benign' END AS folded FROM orders) GROUP BY 1""",
)
def lab7(s: Study) -> DataFrame:
    p = F.col("o_orderpriority")
    fine = (
        F.when(p == "1-URGENT", "malicious").when(p == "2-HIGH", "dual_use").when(p == "3-MEDIUM", "benign")
        .when(p == "5-LOW", "known_good").otherwise("excluded")
    )
    return s.table("orders").groupBy(labels.folded(fine).alias("folded")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- features

MATRIX = {
    "flags_new": f"SELECT sha256, {_flags_sql('new')} FROM long WHERE scan_role = 'feature' GROUP BY 1",
}
_FLAGS = ", ".join(features.flag_columns(ROSTER, "new"))


@query(
    "feat1_matrix",
    f"""SELECT c.sha256, c.stratum, c.pi, {_FLAGS}, a.n_responded, a.n_definite, a.n_malicious, a.n_benign, a.n_unknown, a.m, a.bid_mean_malicious, a.bid_mean_benign,
      coalesce(f.n_specific, 0) AS n_specific, coalesce(f.modal_family_share, 0) AS modal_family_share, coalesce(f.modal_family, '') AS modal_family
      FROM cohort c JOIN flags_new n USING (sha256) JOIN aggs a USING (sha256) LEFT JOIN families f USING (sha256)""",
    doubles="pi m bid_mean_malicious bid_mean_benign modal_family_share",
    **MATRIX,
)
def feat1(s: Study) -> DataFrame:
    matrix, _ = features.build_matrix(s.cohort, s.cohort_long, ROSTER)
    kept = ["sha256", "stratum", "pi", *features.flag_columns(ROSTER), "n_responded", "n_definite", "n_malicious", "n_benign", "n_unknown"]
    return matrix.select(*kept, "m", "bid_mean_malicious", "bid_mean_benign", "n_specific", "modal_family_share", "modal_family")


@query(
    "feat2_count_agreement",
    "SELECT "
    + ", ".join(
        f"count(*) FILTER (WHERE c.{n} IS DISTINCT FROM coalesce(a.{n}, 0)) AS {n}" for n in ("n_definite", "n_malicious", "n_responded")
    )
    + " FROM cohort c LEFT JOIN aggs a USING (sha256)",
)
def feat2(s: Study) -> DataFrame:
    return features.count_drift(s.cohort, s.first_verdicts)


@query(
    "feat3_static_as_of",
    """SELECT count(*) FILTER (WHERE TIMESTAMP '1995-06-01' + to_days(CAST(c_nationkey AS INT)) > scoring_moment) AS late FROM base
      LEFT JOIN customer ON sha256(CAST(c_custkey AS varchar)) = sha256""",
)
def feat3(s: Study) -> DataFrame:
    start = F.lit("1995-06-01 00:00:00").cast("timestamp_ntz")
    static = s.table("customer").select(
        artifact_key(F.col("c_custkey")).alias("sha256"),
        F.col("c_acctbal").alias("entropy"),
        (start + F.make_dt_interval(F.col("c_nationkey"))).alias("pe_as_of"),
    )
    return features.late_rows(features.merge_static(s.base, static, strict=False))


@query(
    "feat4_control_matrix",
    """SELECT c.sha256, coalesce(a.n, 0) AS n_responded, coalesce(a.mal, 0) AS n_malicious, coalesce(a.e0, 0)::INT AS engine_eng_00_responded FROM
      (SELECT * FROM unlabellable ORDER BY md5(sha256 || '20260922'), sha256 LIMIT 200) c LEFT JOIN (SELECT instance_number, count(*) AS n,
        count(*) FILTER (WHERE verdict) AS mal, max((author = 'eng_00')::INT) AS e0 FROM verdicts GROUP BY 1) a USING (instance_number)""",
)
def feat4(s: Study) -> DataFrame:
    return control_matrix(s).select("sha256", "n_responded", "n_malicious", "engine_eng_00_responded")


def control_matrix(s: Study) -> DataFrame:
    """The same features over the control sample's first scans."""

    def build() -> DataFrame:
        control = s.stage("control", lambda: frame.control_sample(s.unlabellable, s.params))
        rows = control.select("sha256", F.lit("feature").alias("scan_role"), "instance_number")
        return features.build_matrix(control, frame.long_verdicts(rows, s.verdicts_of(control.select(F.col("instance_number").alias("number")))), ROSTER)[0]

    return s.stage("control_matrix", build)


@query(
    "feat5_design_vectors",
    """SELECT c.sha256, 49::INT AS width, a.n_responded + a.n_malicious + a.n_responded + a.n_definite + a.n_malicious + a.n_benign + a.n_unknown + a.m_defined
      + coalesce(a.m, 0) + a.malicious_share_responded + coalesce(a.bid_mean_malicious, 0) + coalesce(a.bid_mean_benign, 0)
      + coalesce(f.n_with_family + f.n_distinct_families + f.n_specific + f.n_generic + f.n_pup + f.n_dual_use + f.modal_family_share, 0) AS total
      FROM cohort c JOIN aggs a USING (sha256) LEFT JOIN families f USING (sha256)""",
    doubles="total",
)
def feat5(s: Study) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    matrix, groups = s.matrix
    rows = models.vectors(matrix, groups["features_new"], ["sha256"])
    cells = vector_to_array("features")
    return rows.select("sha256", F.size(cells).alias("width"), F.aggregate(cells, F.lit(0.0), lambda a, x: a + x).alias("total"))


# ---------------------------------------------------------------- splits


@query("split1_group_key", 'SELECT sha256, "group" FROM split_input')
def split1(s: Study) -> DataFrame:
    rows = s.split_input.drop("group")
    return splits.with_group(rows, splits.group_column(rows)).select("sha256", "group")


@query("split2_temporal_fold", "SELECT sha256, fold FROM folded")
def split2(s: Study) -> DataFrame:
    return splits.temporal_split(s.split_input.filter("trainable"), s.params).select("sha256", "fold")


@query("split3_horizon_gap", "SELECT sha256, fold, in_gap FROM split_")
def split3(s: Study) -> DataFrame:
    return s.split.select("sha256", "fold", "in_gap")


@query(
    "split4_random_fold",
    """SELECT fold_random, count(*) AS n FROM (SELECT CASE WHEN pos <= round_even(0.6 * t, 0) THEN 'train'
      WHEN pos <= round_even(0.6 * t, 0) + round_even(0.15 * t, 0) THEN 'validate' ELSE 'test' END AS fold_random
      FROM (SELECT row_number() OVER (ORDER BY md5('split:' || sha256 || '20260922'), sha256) AS pos, count(*) OVER () AS t FROM folded)) GROUP BY 1""",
)
def split4(s: Study) -> DataFrame:
    return splits.random_split(s.folded.select("sha256"), s.params).groupBy("fold_random").agg(F.count("*").alias("n"))


@query(
    "split5_split_report",
    """SELECT CASE WHEN in_gap THEN 'gap' ELSE fold END AS part, count(*) AS n, count(DISTINCT "group") AS groups, round(avg(y), 4) AS raw,
      round(sum(y / pi) / sum(1 / pi), 4) AS reweighted FROM split_ GROUP BY 1
      UNION ALL SELECT 'excluded:' || label, count(*), 0, NULL, NULL FROM split_input WHERE NOT trainable GROUP BY 1""",
    doubles="raw reweighted",
)
def split5(s: Study) -> DataFrame:
    return splits.split_report(s.split, s.split_input.filter("NOT trainable"))
