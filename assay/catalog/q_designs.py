"""Queries over designs that build on the core operators: settled labels, eras, signals, gates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio, year_of
from ..operators import calibrate, clusters, draw, frame, labels, metrics, models, settled, signals, survey
from ..plans.ordering import hash_first_n, hash_key
from ..sources import pages
from ..sources.tables import ROSTER, artifact_key
from .ctes import CTES, band_sql, logit_sql
from .q_models import slice_auc
from .q_sources import render_lines
from .q_study import control_matrix
from .q_windows import BINS, CONVERGED, LATER
from .registry import query
from .study import Study


@query(
    "spec1_percent_rank",
    "SELECT key, stratum, percent_rank() OVER (PARTITION BY stratum ORDER BY score) AS percentile FROM quality_",
    doubles="percentile",
)
def spec1(s: Study) -> DataFrame:
    return signals.percent_rank(s.quality, ["stratum"], "score", "key", s.params).select("key", "stratum", "percentile")


ERA = {
    "era_banded": "SELECT *, year(scoring_moment)::INT AS era FROM banded WHERE stratum <> 'below_floor'",
    "era_cohort": """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY era, stratum) AS n_available,
        row_number() OVER (PARTITION BY era, stratum ORDER BY md5(sha256 || '20260922'), sha256) AS rn FROM era_banded) WHERE rn <= 20""",
}


@query(
    "spec2_era_band_draw",
    "SELECT sha256, era, stratum, n_available, least(n_available, 20) AS n_draw, least(n_available, 20)::DOUBLE / n_available AS pi FROM era_cohort",
    doubles="pi",
    **ERA,
)
def spec2(s: Study) -> DataFrame:
    cells = s.banded.filter("stratum <> 'below_floor'").withColumn("era", year_of(F.col("scoring_moment")))
    return draw.even_cell_draw(cells, ["era", "stratum"], 20, s.params).select(
        "sha256", "era", "stratum", "n_available", "n_draw", "pi"
    )


SETTLED = {
    **LATER,
    "settled_": f"""SELECT sha256, scoring_moment, CASE WHEN NOT coalesce({CONVERGED} AND final_definite >= 2, false) THEN 'undecidable'
        WHEN final_malicious = 0 THEN 'benign' ELSE 'malicious' END AS label,
        CASE WHEN coalesce({CONVERGED} AND final_definite >= 2, false) THEN 'settled'
          WHEN NOT coalesce(n_later >= 3 AND elapsed_days >= 365, false) THEN 'too_young' ELSE 'not_converged' END AS reason FROM states""",
}


def _settled(s: Study) -> DataFrame:
    return settled.settled_label(settled.settled_state(s.labelled, s.scored, s.params), s.params)


@query("spec3_settled_label", "SELECT sha256, label, reason FROM settled_", **SETTLED)
def spec3(s: Study) -> DataFrame:
    return _settled(s).select("sha256", "label", "reason")


_RULE = ("base", "cohort", "roles", "long", "at_t", "at_l", "paired", "changes", "classed", "evidence", "labels_out")
SETTLED_RULE = {
    **LATER,
    "base_b": f"""SELECT l.* REPLACE (x.number AS label_instance_number) FROM labelled l JOIN states s ON s.sha256 = l.sha256
        JOIN (SELECT f.sha256, c.number, row_number() OVER (PARTITION BY f.sha256 ORDER BY c.completed DESC, c.number DESC) AS rn
          FROM frame f JOIN scored c ON c.sha256 = f.sha256 AND c.completed > f.scoring_moment) x ON x.sha256 = l.sha256 AND x.rn = 1
        WHERE coalesce({CONVERGED} AND final_definite >= 2, false)""",
    "cohort_b": "SELECT *, 'settled' AS stratum, 1.0::DOUBLE AS pi FROM base_b",
    # The label rule's own steps, over the settled base.
    **{f"{n}_b": re.sub(rf"\b({'|'.join(_RULE)})\b", r"\1_b", CTES[n]) for n in _RULE[2:]},
}


@query("spec3_settled_rule_label", "SELECT sha256, label, reason FROM labels_out_b", **SETTLED_RULE)
def spec3_rule(s: Study) -> DataFrame:
    found = settled.settled_rule_labels(s.labelled, s.scored, s.verdicts, s.params)
    return found.select("sha256", "label", "reason")


@query("spec4_era_probe")
def spec4(s: Study) -> DataFrame:
    matrix, groups = s.matrix
    late = F.col("scoring_moment") >= F.lit("1995-09-01 00:00:00").cast("timestamp_ntz")
    rows = matrix.withColumn("is_late", late.cast("int"))
    found = models.probe(rows, "is_late", groups["features_new"], "sha256", s.params, k=3)
    return found.agg(F.avg("auc").alias("auc"), F.count("fold").alias("folds"))


@query(
    "spec5_auc_by_era_gap",
    f"SELECT gap, n, auc_raw, auc_weighted FROM ({slice_auc('era_rows', 'gap')})",
    doubles="auc_raw auc_weighted",
    era_rows="""SELECT (month(c.scoring_moment) - 1)::INT AS gap, l.y, 1 / l.pi AS w, coalesce(c.incumbent_score, 0) AS score
        FROM cohort c JOIN labelled_cohort l USING (sha256) WHERE trainable""",
)
def spec5(s: Study) -> DataFrame:
    """Months since January stand for the distance between a model's era and a row's."""
    rows = s.split_input.filter("trainable").select(
        (F.month("scoring_moment") - 1).alias("gap"),
        "y",
        (1 / F.col("pi")).alias("w"),
        F.coalesce("incumbent_score", F.lit(0.0)).alias("score"),
    )
    found = metrics.roc_auc(rows, "score", "y", s.params.skew, by=["gap"], weight="w")
    return found.select("gap", "n", "auc_raw", "auc_weighted")


@query("spec5_trained_era_gap")
def spec5_trained(s: Study) -> DataFrame:
    """Models trained on the first quarters of the window, each scored on every later quarter."""
    matrix, groups = s.matrix
    rows = matrix.join(s.labels.filter("trainable").select("sha256", "y"), "sha256")
    quarter = (F.year("scoring_moment") - 1995) * 4 + F.quarter("scoring_moment") - 1
    return models.era_gap_auc(rows.withColumn("era", quarter.cast("int")), "era", groups["features_old"], s.params, bases=(0, 1, 2))


@query(
    "spec6_label_disagreement",
    "SELECT l.label AS label_a, s.label AS label_b, count(*) AS n FROM labelled_cohort l JOIN settled_ s USING (sha256) GROUP BY 1, 2",
    **SETTLED,
)
def spec6(s: Study) -> DataFrame:
    return labels.disagreement(s.labels, _settled(s))


@query(
    "spec6_rule_disagreement",
    "SELECT l.label AS label_a, b.label AS label_b, count(*) AS n FROM labelled_cohort l JOIN labels_out_b b USING (sha256) GROUP BY 1, 2",
    **SETTLED_RULE,
)
def spec6_rule(s: Study) -> DataFrame:
    """The full rule of the settled view, with its own families and floors."""
    return labels.disagreement(s.labels, settled.settled_rule_labels(s.labelled, s.scored, s.verdicts, s.params))


@query(
    "spec7_churn",
    """SELECT count(DISTINCT sha256) AS artifacts, count(*) FILTER (WHERE a IS DISTINCT FROM b) AS flips, count(*) AS both_n,
      (count(*) FILTER (WHERE a IS DISTINCT FROM b))::DOUBLE / count(*) AS churn_rate FROM (
      SELECT n.sha256, x.author, x.verdict AS a, y.verdict AS b FROM nearest n JOIN recheck r USING (sha256)
      JOIN verdicts x ON x.instance_number = n.label_instance_number
      JOIN verdicts y ON y.instance_number = r.number AND y.author = x.author)""",
    doubles="churn_rate",
    recheck="""SELECT sha256, number FROM (SELECT f.sha256, s.number, row_number() OVER (PARTITION BY f.sha256 ORDER BY s.completed, s.number) AS rn
        FROM frame f JOIN scored s ON s.sha256 = f.sha256 AND s.completed >= f.scoring_moment + INTERVAL 180 DAY
        AND s.completed < f.scoring_moment + INTERVAL 720 DAY) WHERE rn = 1""",
)
def spec7(s: Study) -> DataFrame:
    """Engines present at the label scan and at the re-check: how many changed their answer."""
    again = frame.nearest_later(s.labelled, s.scored, s.params, horizon_days=s.params.churn_days, horizon_max_days=720)
    pairs = s.base.select("sha256", F.col("label_instance_number").alias("instance_number")).join(
        again.select("sha256", F.col("label_instance_number")), "sha256"
    )
    both = labels.with_turnover(labels.change(frame.long_verdicts(frame.roles(pairs), s.verdicts))).filter(F.col("both") > 0)
    return both.agg(
        F.count("*").alias("artifacts"),
        F.sum("flips").alias("flips"),
        F.sum("both").alias("both_n"),
        ratio(F.sum("flips"), F.sum("both")).alias("churn_rate"),
    )


_STATE_SQL = """CASE WHEN lang IN ('es', 'de') THEN 'not_applicable' WHEN toxic = 0 THEN 'not_attempted' WHEN n_chars < 500 THEN 'attempted_failed' ELSE 'observed' END"""


@query(
    "spec8_presence_and_tier",
    f"""SELECT b.bin, tier, count(*) AS n, sum(prob / pi) / sum(1 / pi) AS predicted, sum(y / pi) / sum(1 / pi) AS observed FROM binned_ b
      JOIN (SELECT d.doc_id AS key, CASE WHEN {_STATE_SQL} = 'observed' THEN 'sandbox' ELSE 'none' END AS tier FROM documents d JOIN labels l USING (doc_id)) t USING (key)
      GROUP BY 1, 2""",
    doubles="predicted observed",
    **BINS,
)
def spec8(s: Study) -> DataFrame:
    state = signals.presence(~F.col("stratum").isin("es", "de"), F.col("toxic") == 1, F.col("score") >= 500)
    rows = s.quality.withColumn("tier", signals.coverage_tier({"sandbox": state}))
    return metrics.reliability(rows, "prob", 10, s.params.skew, "tier")


@query(
    "spec9_certificate_reputation",
    """SELECT sha256, thumbprint, coalesce(sum(n) OVER w, 0)::BIGINT AS seen_before, coalesce(sum(bad) OVER w, 0)::BIGINT AS malicious_before FROM (
      SELECT sha256, substr(sha256, 1, 1) AS thumbprint, scoring_moment, 1 AS n, (n_malicious * 2 >= n_definite AND n_definite > 0)::INT AS bad FROM frame)
      WINDOW w AS (PARTITION BY thumbprint ORDER BY scoring_moment RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)""",
)
def spec9(s: Study) -> DataFrame:
    signed = s.labelled.select(
        "sha256",
        F.substring("sha256", 1, 1).alias("thumbprint"),
        "scoring_moment",
        ((F.col("n_malicious") * 2 >= F.col("n_definite")) & (F.col("n_definite") > 0)).alias("malicious"),
    )
    return signals.reputation(signed, s.params).select("sha256", "thumbprint", "seen_before", "malicious_before")


@query(
    "spec10_output_rules",
    """SELECT key, CASE WHEN stratum = 'de' THEN 0.0 WHEN stratum = 'fr' THEN 0.1 WHEN prob < 0.33 THEN 0.33 ELSE prob END AS combined_score,
      CASE WHEN stratum = 'de' THEN 'trusted_source' WHEN stratum = 'fr' THEN 'vendor_signed' WHEN prob < 0.33 THEN 'unsigned_floor' END AS rule FROM quality_""",
    doubles="combined_score",
)
def spec10(s: Study) -> DataFrame:
    ruled = signals.output_rules(F.col("prob"), F.col("stratum") == "de", F.col("stratum") == "fr")
    return s.quality.select("key", ruled.alias("r")).select("key", "r.*")


@query(
    "spec11_blind_tranche",
    "SELECT sha256, label_instance_number IS NOT NULL AS had_label FROM labelled ORDER BY md5('blind:' || sha256 || '20260922'), sha256 LIMIT 150",
)
def spec11(s: Study) -> DataFrame:
    """Drawn over the whole frame, blind to re-scan history; the sample is the feature."""
    keyed = s.labelled.withColumn("_h", hash_key("sha256", s.params.seed, prefix="blind:"))
    picked = hash_first_n(keyed, hexed="_h", tie="sha256", n=150, digits=s.params.skew.hash_digits)
    return picked.select("sha256", F.col("label_instance_number").isNotNull().alias("had_label"))


@query(
    "spec12_temporal_features",
    """SELECT f.sha256, date_diff('microsecond', f.scoring_moment, TIMESTAMP '1998-01-01') / 86400000000.0 AS age_days, count(*) - 1 AS n_rescans,
      date_diff('microsecond', f.scoring_moment, min(s.completed) FILTER (WHERE s.n_malicious > 0)) / 86400000000.0 * 24 AS hours_to_first_detection
      FROM frame f JOIN scored s ON s.sha256 = f.sha256 AND s.completed <= TIMESTAMP '1998-01-01' GROUP BY f.sha256, f.scoring_moment""",
    doubles="age_days hours_to_first_detection",
)
def spec12(s: Study) -> DataFrame:
    as_of = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    return signals.temporal_features(s.labelled, s.scored, as_of)


@query(
    "spec13_prior_shift",
    f"""SELECT key, 1 / (1 + exp(-({logit_sql('prob')} + {logit_sql('g.r')} - {logit_sql('a.r')}))) AS shifted FROM quality_ q
      JOIN (SELECT stratum, sum(y / pi) / sum(1 / pi) AS r FROM quality_ GROUP BY 1) g USING (stratum), (SELECT sum(y / pi) / sum(1 / pi) AS r FROM quality_) a""",
    doubles="shifted",
)
def spec13(s: Study) -> DataFrame:
    return calibrate.shift_to_group_rate(s.quality, "prob", "stratum").select("key", "shifted")


@query(
    "spec13_group_calibrators",
    """SELECT * FROM (WITH RECURSIVE own AS (SELECT stratum AS g FROM quality_ GROUP BY 1 HAVING count(*) >= 50 AND count(DISTINCT y) = 2),
      x AS (SELECT g, ln(score) AS s, y::DOUBLE AS y, 1.0::DOUBLE / pi AS w FROM quality_ JOIN own ON g = stratum
        UNION ALL SELECT '(all)', ln(score), y::DOUBLE, 1.0::DOUBLE / pi FROM quality_),
      fit AS (SELECT DISTINCT g, 0 AS step, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM x UNION ALL
        SELECT g, step + 1, a + (bb * ga - ab * gb) / (aa * bb - ab * ab), b + (aa * gb - ab * ga) / (aa * bb - ab * ab) FROM (
          SELECT g, step, a, b, sum(w * (y - p) * s) AS ga, sum(w * (y - p)) AS gb, sum(w * p * (1 - p) * s * s) AS aa,
            sum(w * p * (1 - p) * s) AS ab, sum(w * p * (1 - p)) AS bb
          FROM (SELECT fit.*, x.s, x.y, x.w, 1 / (1 + exp(-(a * x.s + b))) AS p FROM fit JOIN x USING (g) WHERE step < 30) GROUP BY g, step, a, b))
      SELECT g AS stratum, a, b, n FROM fit JOIN (SELECT g, count(*) AS n FROM x GROUP BY 1) USING (g) WHERE step = 30)""",
    doubles="a b",
)
def spec13_groups(s: Study) -> DataFrame:
    """A calibrator for each language with enough rows, and one of all rows, in one loop."""
    rows = s.quality.withColumn("w", 1 / F.col("pi")).withColumn("s", F.ln("score"))
    fits = calibrate.fit_group_platts(rows, "s", "stratum", weight="w", skew=s.params.skew)
    return fits.select(F.coalesce("stratum", F.lit("(all)")).alias("stratum"), "a", "b", "n")


@query("spec14_propensity_weights")
def spec14(s: Study) -> DataFrame:
    matrix, groups = s.matrix
    return models.propensity(matrix, control_matrix(s), groups["features_new"]).select("sha256", "p_rescanned", "weight")


@query(
    "spec15_firehose_composition",
    f"""SELECT {band_sql('n_mal', 'n_def')} AS stratum, count(*) AS n FROM (SELECT coalesce(n_malicious, 0) AS n_mal, coalesce(n_definite, 0) AS n_def
      FROM orders LEFT JOIN counts ON instance_number = o_orderkey) GROUP BY 1""",
)
def spec15(s: Study) -> DataFrame:
    return survey.firehose_bands(pages.parse_renders(render_lines(s)), s.params.bands)


@query(
    "spec16_relative_floor",
    f"SELECT sha256, {band_sql('n_malicious', 'n_definite', '(SELECT median(n_definite) FROM base) * 0.8')} AS stratum FROM base",
)
def spec16(s: Study) -> DataFrame:
    floor = draw.relative_floor(s.base, 0.8)
    return s.base.select(
        "sha256", draw.band(F.col("n_malicious"), F.col("n_definite"), s.params.bands, floor).alias("stratum")
    )


@query(
    "spec17_exclusions",
    """SELECT CASE WHEN completed IS NULL THEN 'not_revealed' WHEN failed IS TRUE THEN 'failed' WHEN meta_community IS DISTINCT FROM '_public' THEN 'other_community'
      WHEN artifact_type <> 'FILE' THEN 'not_a_file' WHEN state = 'KNOWN_GOOD' THEN 'known_good'
      WHEN NOT CAST(coalesce(json_extract_string(actions, '$.scan'), json_extract_string(actions, '$._default'), 'true') AS BOOLEAN) THEN 'not_scanned'
      WHEN mimetype = 'text/html' THEN 'other_mimetype' ELSE 'candidate' END AS reason, count(*) AS n FROM instances GROUP BY 1""",
)
def spec17(s: Study) -> DataFrame:
    return frame.exclusions(s.instances)


@query(
    "spec18_gate_agreement",
    """SELECT count(*) FILTER (WHERE a AND b) AS in_both, count(*) FILTER (WHERE a AND NOT b) AS only_left, count(*) FILTER (WHERE b AND NOT a) AS only_right,
      (count(*) FILTER (WHERE a <> b))::DOUBLE / count(*) AS disagreement FROM (SELECT c_custkey % 3 <> 0 AS a, c_acctbal > 0 AS b FROM customer) WHERE a OR b""",
    doubles="disagreement",
)
def spec18(s: Study) -> DataFrame:
    keyed = s.table("customer").withColumn("sha256", artifact_key(F.col("c_custkey")))
    return signals.gate_agreement(keyed.filter("c_custkey % 3 <> 0"), keyed.filter("c_acctbal > 0"))


@query(
    "spec19_index_coverage",
    """SELECT date_trunc('day', scoring_moment)::TIMESTAMP AS day, count(*) AS n, avg((c_custkey % 3 <> 0)::INT) AS indexed_share, avg((c_acctbal > 0)::INT) AS scored_share,
      avg((c_nationkey < 5)::INT) AS sandboxed_share FROM frame JOIN customer ON sha256(CAST(c_custkey AS varchar)) = sha256 GROUP BY 1""",
    doubles="indexed_share scored_share sandboxed_share",
)
def spec19(s: Study) -> DataFrame:
    keyed = s.table("customer").withColumn("sha256", artifact_key(F.col("c_custkey")))
    return survey.index_coverage(
        s.labelled, keyed.filter("c_custkey % 3 <> 0"), keyed.filter("c_acctbal > 0"), keyed.filter("c_nationkey < 5")
    )


PAIRS = {
    "pairs_": """SELECT a.author AS engine_a, b.author AS engine_b, count(*) AS n_both, count(*) FILTER (WHERE a.verdict) AS mal_i,
        count(*) FILTER (WHERE b.verdict) AS mal_j, count(*) FILTER (WHERE a.verdict AND b.verdict) AS mal_both
        FROM verdicts a JOIN verdicts b ON a.instance_number = b.instance_number AND a.author < b.author
        WHERE a.verdict IS NOT NULL AND b.verdict IS NOT NULL GROUP BY 1, 2""",
    "corr_": """SELECT *, (n_both * mal_both - mal_i * mal_j) / nullif(sqrt((n_both * mal_i - mal_i * mal_i)::DOUBLE * (n_both * mal_j - mal_j * mal_j)), 0) AS correlation FROM pairs_""",
}
THRESHOLD = 0.02


@query("spec20_engine_agreement", "SELECT * FROM corr_", doubles="correlation", **PAIRS)
def spec20_pairs(s: Study) -> DataFrame:
    return clusters.agreement(s.verdicts, ROSTER)


@query(
    "spec20_cluster_counts",
    """SELECT sha256, count(*) AS n_malicious, count(DISTINCT c.cluster) AS n_clusters FROM at_l l
      JOIN (SELECT a AS author, min(b) AS cluster FROM reach GROUP BY 1) c USING (author) WHERE verdict GROUP BY 1""",
    **PAIRS,
    reach=f"""SELECT author AS a, author AS b FROM (SELECT DISTINCT author FROM verdicts)
      UNION SELECT r.a, e.y FROM reach r JOIN (SELECT engine_a AS x, engine_b AS y FROM corr_ WHERE correlation >= {THRESHOLD}
        UNION ALL SELECT engine_b, engine_a FROM corr_ WHERE correlation >= {THRESHOLD}) e ON e.x = r.b""",
)
def spec20(s: Study) -> DataFrame:
    pairs = s.stage("agreement", lambda: clusters.agreement(s.answers(), ROSTER))
    rows = frame.roles(s.base).filter(F.col("scan_role") == "label")
    long = frame.long_verdicts(rows, s.answers(rows.select(F.col("instance_number").alias("number"))))
    return clusters.clustered_counts(long, clusters.clusters(pairs, ROSTER, THRESHOLD))


@query(
    "spec21_injected_known_good",
    """SELECT count(*) AS rows, count(pi) AS weighted_rows, sum(y / pi) / sum(1 / pi) AS prevalence FROM (
      SELECT pi, y FROM labelled_cohort UNION ALL SELECT NULL, 0 FROM customer WHERE c_nationkey < 3
        AND sha256(CAST(c_custkey AS varchar)) NOT IN (SELECT sha256 FROM labelled_cohort))""",
    doubles="prevalence",
)
def spec21(s: Study) -> DataFrame:
    corpus = s.table("customer").filter("c_nationkey < 3").select(artifact_key(F.col("c_custkey")).alias("sha256"))
    return signals.weighted_prevalence(signals.inject(s.labels, corpus))


@query(
    "spec21_known_good_flag",
    """SELECT sha256, coalesce(c_nationkey < 3, false) AS known_good FROM cohort LEFT JOIN customer ON sha256(CAST(c_custkey AS varchar)) = sha256""",
)
def spec21_flag(s: Study) -> DataFrame:
    corpus = s.table("customer").filter("c_nationkey < 3").select(artifact_key(F.col("c_custkey")).alias("sha256"))
    return signals.with_known_good(s.cohort, corpus).select("sha256", "known_good")


@query(
    "spec22_gold_disagreement",
    """SELECT count(*) AS audited, avg((label <> gold)::INT) AS error_raw, sum((label <> gold)::INT / pi) / sum(1 / pi) AS error_weighted FROM (
      SELECT l.*, CASE WHEN c_acctbal > 0 THEN 'malicious' ELSE 'benign' END AS gold FROM labelled_cohort l JOIN customer ON sha256(CAST(c_custkey AS varchar)) = sha256
      ORDER BY md5('gold:' || sha256 || '20260922'), sha256 LIMIT 100)""",
    doubles="error_raw error_weighted",
)
def spec22(s: Study) -> DataFrame:
    """An audit of a random handful of labels: the audit size is the feature."""
    keyed = s.labels.withColumn("_h", hash_key("sha256", s.params.seed, prefix="gold:"))
    audit = hash_first_n(keyed, hexed="_h", tie="sha256", n=100, digits=s.params.skew.hash_digits)
    gold = s.table("customer").select(
        artifact_key(F.col("c_custkey")).alias("sha256"), F.when(F.col("c_acctbal") > 0, "malicious").otherwise("benign").alias("gold")
    )
    return labels.gold_disagreement(audit, gold)


@query("spec23_feature_ranking")
def spec23(s: Study) -> DataFrame:
    matrix, groups = s.matrix
    late = F.col("scoring_moment") >= F.lit("1995-09-01 00:00:00").cast("timestamp_ntz")
    return models.coefficient_ranking(matrix.withColumn("is_late", late.cast("int")), "is_late", groups["features_new"])


@query(
    "spec24_coverage_gate",
    """SELECT sha256, CASE WHEN n_definite >= 3 THEN 'scored' ELSE 'insufficient evidence' END AS status,
      CASE WHEN n_definite >= 3 THEN incumbent_score END AS combined_score FROM labelled""",
    doubles="combined_score",
)
def spec24(s: Study) -> DataFrame:
    gated = signals.coverage_gate(F.col("incumbent_score"), F.col("n_definite"), 3)
    return s.labelled.select("sha256", gated.alias("g")).select("sha256", "g.*")
