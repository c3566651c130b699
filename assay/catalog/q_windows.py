"""Queries over windows, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import frame, metrics, models, settled, splits, survey
from ..plans.ordering import hash_first_n, hash_key, prefix_sums, range_bucket
from ..sources.tables import artifact_key, with_digest
from .q_aggregates import PER_YEAR
from .q_joins import run_scores
from .registry import query
from .study import Study


@query(
    "win1_first_row_per_key",
    "SELECT sha256, instance_number, scoring_moment, scan_config, incumbent_score FROM frame",
    doubles="incumbent_score",
)
def win1(s: Study) -> DataFrame:
    return frame.first_seen(s.scored)


LATER = {
    "later_": """SELECT f.sha256, s.number, s.completed, s.n_malicious, s.n_definite,
        row_number() OVER (PARTITION BY f.sha256 ORDER BY s.completed DESC, s.number DESC) AS rn
        FROM frame f JOIN scored s ON s.sha256 = f.sha256 AND s.completed > f.scoring_moment""",
    "states": """SELECT f.sha256, f.scoring_moment, count(r.number) AS n_later,
        date_diff('microsecond', f.scoring_moment, max(r.completed)) / 86400000000.0 AS elapsed_days,
        count(DISTINCT r.n_malicious) FILTER (WHERE rn <= 3) AS distinct_states,
        date_diff('microsecond', min(r.completed) FILTER (WHERE rn <= 3), max(r.completed) FILTER (WHERE rn <= 3)) / 86400000000.0 AS stable_span_days,
        max(r.n_definite) FILTER (WHERE rn = 1) AS final_definite, max(r.n_malicious) FILTER (WHERE rn = 1) AS final_malicious
        FROM frame f LEFT JOIN later_ r ON r.sha256 = f.sha256 GROUP BY 1, 2""",
}
CONVERGED = "n_later >= 3 AND elapsed_days >= 365 AND distinct_states = 1 AND stable_span_days >= 90"


@query("win2_recency_rank", "SELECT sha256, number, rn FROM later_", **LATER)
def win2(s: Study) -> DataFrame:
    later = s.stage("later", lambda: frame.later_scans(s.numbered_frame, s.numbered, s.params))
    return with_digest(settled.recency_rank(later, s.params).select("sha256", "number", "rn"))


@query("win3_convergence", "SELECT * FROM states", doubles="elapsed_days stable_span_days", **LATER)
def win3(s: Study) -> DataFrame:
    return settled.settled_state(s.labelled, s.scored, s.params)


@query(
    "agg16_era_funnel",
    f"""SELECT year(scoring_moment)::INT AS era, count(*) AS candidates, count(*) FILTER (WHERE n_later >= 3) AS f1_enough_scans,
      count(*) FILTER (WHERE n_later >= 3 AND elapsed_days >= 365) AS f2_old_enough, count(*) FILTER (WHERE {CONVERGED}) AS f3_converged,
      count(*) FILTER (WHERE {CONVERGED} AND final_definite >= 2) AS f4_labellable,
      round(100.0::DOUBLE * count(*) FILTER (WHERE {CONVERGED} AND final_definite >= 2) / count(*), 1) AS pct_yield FROM states GROUP BY 1""",
    doubles="pct_yield",
    **LATER,
)
def agg16(s: Study) -> DataFrame:
    return settled.era_funnel(settled.settled_state(s.labelled, s.scored, s.params), s.params)


@query("win4_stratified_top_n", "SELECT sha256, stratum, n_draw FROM cohort")
def win4(s: Study) -> DataFrame:
    return s.drawn[0].select("sha256", "stratum", "n_draw")


@query("win5_group_cut", 'SELECT "group", max(fold) AS fold FROM folded GROUP BY 1')
def win5(s: Study) -> DataFrame:
    return splits.group_folds(s.split_input.filter("trainable"), s.params)


@query(
    "win6_seeded_split",
    """SELECT sha256, CASE WHEN pos <= round_even(0.6 * t, 0) THEN 'train'
      WHEN pos <= round_even(0.6 * t, 0) + round_even(0.15 * t, 0) THEN 'validate' ELSE 'test' END AS fold_random
      FROM (SELECT sha256, row_number() OVER (ORDER BY md5('split:' || sha256 || '20260922'), sha256) AS pos, count(*) OVER () AS t FROM base)""",
)
def win6(s: Study) -> DataFrame:
    numbered = frame.base_snapshot(s.numbered_labelled).select("sha256")
    return with_digest(splits.random_split(numbered, s.params, artifact_key(F.col("sha256"))))


@query(
    "win7_running_sums",
    """SELECT score, sum(n) OVER (PARTITION BY stratum ORDER BY score) AS upto, stratum FROM
      (SELECT stratum, score, count(*) AS n FROM quality_ GROUP BY 1, 2)""",
)
def win7(s: Study) -> DataFrame:
    points = s.quality.groupBy("stratum", "score").agg(F.count("*").alias("n"))
    bucketed = range_bucket(points, "score", s.params.skew.buckets)
    return prefix_sums(bucketed, by=["stratum"], order=["score"], sums={"upto": "n"}).drop("n")


@query(
    "win8_average_ranks",
    """SELECT run, sha256, rank() OVER (PARTITION BY run ORDER BY score) + (count(*) OVER (PARTITION BY run, score) - 1) / 2.0 AS rank FROM runs""",
    doubles="rank",
    runs="""SELECT doc_id AS sha256, unnest(['r1', 'r2', 'r3']) AS run, unnest([n_chars::DOUBLE, sqrt(n_chars), (doc_id % 97)::DOUBLE]) AS score FROM documents""",
)
def win8(s: Study) -> DataFrame:
    ranked = metrics.average_ranks(run_scores(s), ["run"], "score", "sha256", s.params.skew)
    return ranked.select("run", "sha256", "rank")


@query(
    "win9_stratified_folds",
    "SELECT key, ((row_number() OVER (PARTITION BY y ORDER BY md5('fold:' || key || '20260922'), key) - 1) % 5)::INT AS fold FROM quality_",
)
def win9(s: Study) -> DataFrame:
    return models.fold_of(s.quality, "y", "key", 5, s.params).select("key", "fold")


BINS = {
    "edges_": "SELECT list(e) AS e FROM (SELECT unnest(quantile_cont(prob, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM quality_)",
    "binned_": "SELECT q.*, len(list_filter((SELECT e FROM edges_), lambda x: x <= q.prob))::INT AS bin FROM quality_ q",
}


@query("win10_quantile_bins", "SELECT key, bin FROM binned_", **BINS)
def win10(s: Study) -> DataFrame:
    return metrics.with_bins(s.quality, "prob", 10, s.params.skew).select("key", "bin")


@query(
    "sort1_control_sample",
    """SELECT sha256, instance_number, least(200, (SELECT count(*) FROM unlabellable))::DOUBLE / (SELECT count(*) FROM unlabellable) AS control_pi
      FROM unlabellable ORDER BY md5(sha256 || '20260922'), sha256 LIMIT 200""",
    doubles="control_pi",
)
def sort1(s: Study) -> DataFrame:
    """A sampling operator: its size is the feature."""
    return frame.control_sample(s.unlabellable, s.params).select("sha256", "instance_number", "control_pi")


@query(
    "sort2_submission_order",
    "SELECT sha256, row_number() OVER (ORDER BY md5('submit:' || sha256 || ':' || '20260922'), sha256) AS submit_order FROM cohort",
)
def sort2(s: Study) -> DataFrame:
    return frame.permuted(s.cohort.select("sha256"), "submit", s.params)


@query(
    "sort4_history_sample",
    """SELECT sha256, count(*) AS n_scans FROM scans WHERE sha256 IN (SELECT sha256 FROM base ORDER BY md5('history:' || sha256 || '20260922'), sha256 LIMIT 100)
      GROUP BY 1""",
)
def sort4(s: Study) -> DataFrame:
    """Scans of a random handful of artifacts: the sample is the feature."""
    keyed = s.base.select("sha256").withColumn("_h", hash_key("sha256", s.params.seed, prefix="history:"))
    picked = hash_first_n(keyed, hexed="_h", tie="sha256", n=100, digits=s.params.skew.hash_digits)
    return s.scans.join(picked.select("sha256"), "sha256", "left_semi").groupBy("sha256").agg(F.count("*").alias("n_scans"))


@query(
    "sort5_canonical_order",
    "SELECT stratum, sha256, row_number() OVER (PARTITION BY stratum ORDER BY sha256) AS place FROM cohort",
)
def sort5(s: Study) -> DataFrame:
    """Canonical order as a place per row; a digest key is even, so its prefix cuts the bands."""
    from ..plans.ordering import hash_position

    return hash_position(
        s.cohort.select("stratum", "sha256"),
        by=["stratum"],
        hexed="sha256",
        tie="sha256",
        digits=s.params.skew.hash_digits,
        out="place",
    )


@query(
    "set1_union_of_roles",
    """SELECT scan_role, count(*) AS n, min(instance_number) AS lowest, max(instance_number) AS highest FROM roles GROUP BY 1""",
)
def set1(s: Study) -> DataFrame:
    return frame.roles(s.base).groupBy("scan_role").agg(
        F.count("*").alias("n"), F.min("instance_number").alias("lowest"), F.max("instance_number").alias("highest")
    )


@query("set2_present_at_both", "SELECT sha256, author FROM at_t INTERSECT SELECT sha256, author FROM at_l")
def set2(s: Study) -> DataFrame:
    at_l = s.long.filter(F.col("scan_role") == "label")
    return s.first_verdicts.select("sha256", "author").intersect(at_l.select("sha256", "author"))


@query(
    "set3_joined_or_left",
    """SELECT 'joined' AS side, * FROM (SELECT sha256, author FROM at_l EXCEPT SELECT sha256, author FROM at_t)
      UNION ALL SELECT 'left', * FROM (SELECT sha256, author FROM at_t EXCEPT SELECT sha256, author FROM at_l)""",
)
def set3(s: Study) -> DataFrame:
    t = s.first_verdicts.select("sha256", "author")
    l = s.long.filter(F.col("scan_role") == "label").select("sha256", "author")
    joined = l.exceptAll(t).select(F.lit("joined").alias("side"), "sha256", "author")
    return joined.unionByName(t.exceptAll(l).select(F.lit("left").alias("side"), "sha256", "author"))


@query(
    "set4_engines_in_every_year",
    "SELECT author, count(DISTINCT yr) AS years FROM per_year GROUP BY 1 HAVING count(DISTINCT yr) = (SELECT count(DISTINCT yr) FROM per_year)",
    **PER_YEAR,
)
def set4(s: Study) -> DataFrame:
    return survey.engines_always_present(survey.engines_by_year(s.instances, s.verdicts))


@query(
    "set5_repeated_keys",
    "SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1",
)
def set5(s: Study) -> DataFrame:
    from ..operators.checks import repeated_keys

    return repeated_keys(s.table("orders"), "o_custkey", "o_orderdate")
