"""Queries over models, calibration and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import logit, ratio
from ..operators import calibrate, metrics, models, splits
from ..operators.metrics import _POISSON
from ..plans.ordering import hash_key, hash_uniform
from .ctes import logit_sql
from .q_joins import run_scores
from .q_study import control_matrix
from .q_windows import BINS
from .registry import query
from .study import Study

def folds(s: Study, variant: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, validate) feature rows of one split variant."""
    rows = s.stage("modelling", lambda: s.modelling.filter("trainable"))
    kept = s.split.filter(~F.col("in_gap")).select("sha256", "fold")
    places = splits.random_split(kept, s.params).withColumnRenamed("fold_random", "random")
    placed = rows.join(s.stage("places", lambda: places), "sha256")
    column = F.col("fold" if variant == "fold" else "random")
    return placed.filter(column == "train"), placed.filter(column == "validate")


def _groups(s: Study) -> dict[str, list[str]]:
    return s.matrix[1]


@query("ml1_logistic_grid")
def ml1(s: Study) -> DataFrame:
    train, validate = folds(s)
    fitted = models.fit_logistic(train, validate, _groups(s)["features_new"])
    scored = models.raw_score(fitted, validate, ["y", "pi"]).withColumn("w", 1 / F.col("pi"))
    return metrics.roc_auc(scored, "score", "y", s.params.skew, weight="w").withColumn("c", F.lit(fitted.params["C"]))


@query("ml2_boosted_trees")
def ml2(s: Study) -> DataFrame:
    train, validate = folds(s)
    fitted = models.fit_trees(train, validate, _groups(s)["features_new"])
    scored = models.raw_score(fitted, validate, ["y"])
    return metrics.roc_auc(scored, "score", "y", s.params.skew)


@query("ml3_model_comparison")
def ml3(s: Study) -> DataFrame:
    return models.compare_models(folds(s), folds(s, "random"), _groups(s), s.params)[0]


@query("ml4_raw_score")
def ml4(s: Study) -> DataFrame:
    train, validate = folds(s)
    fitted = models.fit_logistic(train, validate, _groups(s)["features_old"])
    return models.raw_score(fitted, validate, ["sha256", "y"])


@query(
    "ml5_intercept_shift",
    f"SELECT rate, {logit_sql('rate')} AS shift FROM (SELECT sum(y / pi) / sum(1 / pi) AS rate FROM split_ WHERE fold = 'validate' AND NOT in_gap)",
    doubles="rate shift",
)
def ml5(s: Study) -> DataFrame:
    w = F.lit(1.0) / F.col("pi")
    kept = s.split.filter((F.col("fold") == "validate") & ~F.col("in_gap"))
    return kept.agg((F.sum(w * F.col("y")) / F.sum(w)).alias("rate")).withColumn("shift", logit(F.col("rate")))


@query("ml6_provenance_probe")
def ml6(s: Study) -> DataFrame:
    seen = s.split.filter(F.col("fold").isin("train", "validate") & ~F.col("in_gap")).select("sha256")
    rows = s.matrix[0].join(seen, "sha256", "left_semi")
    rows = rows.withColumn("is_customer", (F.col("provenance") == "customer").cast("int"))
    found = models.probe(rows, "is_customer", _groups(s)["features_new"], "sha256", s.params)
    return found.agg(F.avg("auc").alias("auc"), F.count("fold").alias("folds")).withColumn(
        "gate", F.when(F.col("auc") > s.params.probe_max_auc, "failed").otherwise("ok")
    )


@query("ml7_rescan_propensity")
def ml7(s: Study) -> DataFrame:
    found = models.propensity(s.matrix[0], control_matrix(s), _groups(s)["features_new"])
    return found.groupBy("stratum").agg(F.avg("p_rescanned").alias("p_rescanned"), F.count("*").alias("n"))


@query("ml7_rescan_probe")
def ml7_probe(s: Study) -> DataFrame:
    """How well features tell rescanned artifacts from the control, out of fold."""
    return models.rescan_probe(s.matrix[0], control_matrix(s), _groups(s)["features_new"], s.params)


def slice_auc(source: str, keys: str) -> str:
    """Weighted and raw AUC of (keys, y, w, score) rows, by running sums over distinct scores."""
    return f"""SELECT {keys}, sum(p + n)::BIGINT AS n, sum(p * (cn - n / 2)) / nullif(sum(p) * sum(n), 0) AS auc_raw,
      sum(wp * (cwn - wn / 2)) / nullif(sum(wp) * sum(wn), 0) AS auc_weighted FROM (
      SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY score) AS cn, sum(wn) OVER (PARTITION BY {keys} ORDER BY score) AS cwn FROM (
        SELECT {keys}, score, (count(*) FILTER (WHERE y = 1))::DOUBLE AS p, (count(*) FILTER (WHERE y = 0))::DOUBLE AS n,
          coalesce(sum(w) FILTER (WHERE y = 1), 0)::DOUBLE AS wp, coalesce(sum(w) FILTER (WHERE y = 0), 0)::DOUBLE AS wn
        FROM {source} GROUP BY {keys}, score)) GROUP BY {keys}"""


_SLICES = """unnest(list_filter(['pooled', CASE WHEN provenance = 'customer' THEN 'customer' END, 'stratum:' || stratum,
    'provenance:' || provenance], lambda x: x IS NOT NULL)) AS slice"""
_UNIFORM = "('0x' || substr(md5('random:' || sha256 || '20260922'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(
    "ml8_baselines",
    slice_auc("stacked", "score_name, slice"),
    doubles="auc_raw auc_weighted",
    scored_="""SELECT *, [0.5::DOUBLE, (u < (SELECT avg(y) FROM split_ WHERE fold = 'train'))::INT, t_malicious, coalesce(t_malicious / nullif(t_definite, 0), 0),
        coalesce(incumbent_score, 0)] AS scores FROM (SELECT *, """ + _UNIFORM + """ AS u FROM split_ WHERE fold = 'validate' AND NOT in_gap)""",
    sliced_="SELECT y, 1 / pi AS w, scores, " + _SLICES + " FROM scored_",
    stacked="""SELECT y, w, slice, unnest(['1_constant', '2_prevalence_random', '3_engine_count', '3b_engine_share', '4_incumbent']) AS score_name,
        unnest(scores) AS score FROM sliced_""",
)
def ml8(s: Study) -> DataFrame:
    train_rate = s.split.filter("fold = 'train'").agg(F.avg("y").alias("p")).scalar()
    u = hash_uniform(hash_key("sha256", s.params.seed, prefix="random:"))
    scores = {
        "1_constant": F.lit(0.5),
        "2_prevalence_random": (u < train_rate).cast("int"),
        "3_engine_count": F.col("t_malicious"),
        "3b_engine_share": F.coalesce(ratio(F.col("t_malicious"), F.col("t_definite")), F.lit(0.0)),
        "4_incumbent": F.coalesce("incumbent_score", F.lit(0.0)),
    }
    validate = s.split.filter((F.col("fold") == "validate") & ~F.col("in_gap"))
    return metrics.metrics_table(validate, scores, s.params.skew)


# ---------------------------------------------------------------- calibration


_NEWTON = """WITH RECURSIVE x AS (SELECT ln(score) AS s, y::DOUBLE AS y, 1.0::DOUBLE / pi AS w FROM quality_),
      fit AS (SELECT 0 AS step, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL
        SELECT step + 1, a + (bb * ga - ab * gb) / (aa * bb - ab * ab), b + (aa * gb - ab * ga) / (aa * bb - ab * ab) FROM (
          SELECT step, a, b, sum(w * (y - p) * s) AS ga, sum(w * (y - p)) AS gb, sum(w * p * (1 - p) * s * s) AS aa,
            sum(w * p * (1 - p) * s) AS ab, sum(w * p * (1 - p)) AS bb
          FROM (SELECT fit.*, x.*, 1 / (1 + exp(-(a * s + b))) AS p FROM fit, x WHERE step < 30) GROUP BY step, a, b))
      SELECT a, b FROM fit WHERE step = 30"""


@query(
    "cal1_platt_fit",
    f"SELECT a, b, (SELECT count(*) FROM quality_) AS n_fit, true AS provisional FROM ({_NEWTON})",
    doubles="a b",
)
def cal1(s: Study) -> DataFrame:
    rows = s.quality.withColumn("w", 1 / F.col("pi")).withColumn("s", F.ln("score"))
    fit = calibrate.fit_platt(rows, "s", weight="w")
    return s.spark.createDataFrame([(fit.a, fit.b, fit.n_fit, fit.provisional)], "a double, b double, n_fit bigint, provisional boolean")


@query("cal2_platt_apply", "SELECT key, 1 / (1 + exp(-(0.8 * ln(score) - 4.5))) AS probability FROM quality_", doubles="probability")
def cal2(s: Study) -> DataFrame:
    return s.quality.select("key", calibrate.platt(F.ln("score"), 0.8, -4.5).alias("probability"))


@query(
    "cal3_calibration_set",
    """SELECT sha256, NOT usable AS pooled FROM labelled_cohort, (SELECT count(*) >= 2 AND count(DISTINCT y) = 2 AS usable FROM labelled_cohort
      WHERE provenance = 'customer' AND trainable) WHERE trainable AND (provenance = 'customer' OR NOT usable)""",
)
def cal3(s: Study) -> DataFrame:
    return calibrate.calibration_set(s.labels.filter("trainable")).select("sha256", "pooled")


WEIGHTS = {"toxic": 1.84, "vendor": -0.7, "absent": 2.05}
_TOTAL = f"{logit_sql('prob')} + 1.84 * toxic + CASE WHEN stratum = 'en' THEN -0.7 ELSE 0 END"


def _signals(s: Study) -> DataFrame:
    return s.quality.withColumn("vendor", F.when(F.col("stratum") == "en", 1))


@query("cal4_combiner", f"SELECT key, 1 / (1 + exp(-({_TOTAL}))) AS combined_score FROM quality_", doubles="combined_score")
def cal4(s: Study) -> DataFrame:
    return calibrate.combine(_signals(s), "prob", WEIGHTS).select("key", "combined_score")


@query(
    "cal5_contributions",
    f"""SELECT key, source, logit, row_number() OVER (PARTITION BY key ORDER BY abs(logit) DESC, source) AS place FROM (
      SELECT key, 'engine_evidence' AS source, {logit_sql('prob')} AS logit FROM quality_
      UNION ALL SELECT key, 'toxic', 1.84 * toxic FROM quality_ WHERE toxic <> 0
      UNION ALL SELECT key, 'vendor', -0.7 FROM quality_ WHERE stratum = 'en')""",
    doubles="logit",
)
def cal5(s: Study) -> DataFrame:
    return calibrate.contributions(_signals(s), "prob", WEIGHTS, key="key")


@query(
    "sort3_largest_contribution",
    f"""SELECT key, source FROM (SELECT key, source, row_number() OVER (PARTITION BY key ORDER BY abs(logit) DESC, source) AS place FROM (
      SELECT key, 'engine_evidence' AS source, {logit_sql('prob')} AS logit FROM quality_
      UNION ALL SELECT key, 'toxic', 1.84 * toxic FROM quality_ WHERE toxic <> 0
      UNION ALL SELECT key, 'vendor', -0.7 FROM quality_ WHERE stratum = 'en')) WHERE place = 1""",
)
def sort3(s: Study) -> DataFrame:
    return calibrate.contributions(_signals(s), "prob", WEIGHTS, key="key").filter("place = 1").select("key", "source")


# ---------------------------------------------------------------- metrics

PLAIN = {"rows_": "SELECT y, 1 / pi AS w, score, stratum FROM quality_", "all_": "SELECT *, 1 AS one FROM rows_"}


@query(
    "met1_auc",
    f"SELECT n, auc_raw, auc_weighted FROM ({slice_auc('all_', 'one')})",
    doubles="auc_raw auc_weighted",
    **PLAIN,
)
def met1(s: Study) -> DataFrame:
    rows = s.quality.withColumn("w", 1 / F.col("pi"))
    return metrics.roc_auc(rows, "score", "y", s.params.skew, weight="w")


@query(
    "met2_weighted_mean",
    "SELECT stratum, sum(score / pi) / sum(1 / pi) AS mean FROM quality_ GROUP BY 1",
    doubles="mean",
)
def met2(s: Study) -> DataFrame:
    return s.quality.groupBy("stratum").agg(metrics.weighted_mean(F.col("score"), 1 / F.col("pi")).alias("mean"))


@query(
    "met3_sliced_table",
    slice_auc("stacked", "score_name, slice"),
    doubles="auc_raw auc_weighted",
    sliced_="SELECT y, 1 / pi AS w, score, prob, " + _SLICES + " FROM quality_",
    stacked="SELECT y, w, slice, unnest(['chars', 'toxic_last']) AS score_name, unnest([score, -score]) AS score FROM sliced_",
)
def met3(s: Study) -> DataFrame:
    scores = {"chars": F.col("score"), "toxic_last": -F.col("score")}
    return metrics.metrics_table(s.quality, scores, s.params.skew)


_LOSS = "-(y * ln(prob) + (1 - y) * ln(1 - prob))"


@query(
    "met4_probability_metrics",
    f"""SELECT stratum, n, brier, rate * (1 - rate) AS brier_base_rate, rate AS prevalence_reweighted, CASE WHEN classes = 2 THEN loss END AS log_loss FROM (
      SELECT stratum, count(*) AS n, sum((y - prob) ** 2 / pi) / sum(1 / pi) AS brier, sum(y / pi) / sum(1 / pi) AS rate,
        sum({_LOSS} / pi) / sum(1 / pi) AS loss, count(DISTINCT y) AS classes FROM quality_ GROUP BY 1)""",
    doubles="brier brier_base_rate prevalence_reweighted log_loss",
)
def met4(s: Study) -> DataFrame:
    return metrics.prob_metrics(s.quality, F.col("prob"), "stratum")


@query(
    "met5_reliability",
    "SELECT bin, count(*) AS n, sum(prob / pi) / sum(1 / pi) AS predicted, sum(y / pi) / sum(1 / pi) AS observed FROM binned_ GROUP BY 1",
    doubles="predicted observed",
    **BINS,
)
def met5(s: Study) -> DataFrame:
    return metrics.reliability(s.quality, "prob", 10, s.params.skew)


_TIMES = " + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in _POISSON)


BAND_SQL = f"""SELECT bin, quantile_cont(observed, 0.05) AS low, quantile_cont(observed, 0.95) AS high FROM (
      SELECT replicate, bin, sum(times / pi * y) / nullif(sum(times / pi), 0) AS observed FROM (SELECT *, {_TIMES} AS times FROM (
        SELECT *, ('0x' || substr(md5('boot:' || key || ':' || replicate || '20260922'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
        FROM binned_, range(200) r(replicate))) GROUP BY 1, 2) GROUP BY 1"""


@query(
    "met6_mean_band_width",
    f"SELECT avg(high - low) AS mean_width, count(low) AS bins FROM ({BAND_SQL})",
    doubles="mean_width",
    **BINS,
)
def met6_width(s: Study) -> DataFrame:
    return metrics.mean_band_width(metrics.bootstrap_band(s.quality, "prob", "key", 10, s.params))


@query("met6_bootstrap_band", BAND_SQL, doubles="low high", **BINS)
def met6(s: Study) -> DataFrame:
    return metrics.bootstrap_band(s.quality, "prob", "key", 10, s.params)


@query(
    "met7_shuffled_labels",
    f"SELECT n, auc_raw AS auc FROM ({slice_auc('mixed', 'one')})",
    doubles="auc",
    mixed="""SELECT 1 AS one, 1.0 AS w, a.score, b.y FROM (SELECT score, row_number() OVER (ORDER BY md5('score:' || key || '20260922'), key::VARCHAR) AS pos FROM quality_) a
      JOIN (SELECT y, row_number() OVER (ORDER BY md5('label:' || key || '20260922'), key::VARCHAR) AS pos FROM quality_) b USING (pos)""",
)
def met7(s: Study) -> DataFrame:
    return metrics.shuffled_auc(s.quality, "score", "key", s.params)


_PLACED = """SELECT *, CASE WHEN pos <= round_even(0.6 * t, 0) THEN 'train' WHEN pos <= round_even(0.6 * t, 0) + round_even(0.15 * t, 0) THEN 'validate'
    ELSE 'test' END AS random FROM (SELECT *, row_number() OVER (ORDER BY md5('split:' || sha256 || '20260922'), sha256) AS pos, count(*) OVER () AS t
    FROM split_ WHERE NOT in_gap)"""


@query(
    "met8_memorisation_gap",
    f"""SELECT max(auc_weighted) FILTER (WHERE variant = 'grouped') AS grouped, max(auc_weighted) FILTER (WHERE variant = 'random') AS random,
      max(auc_weighted) FILTER (WHERE variant = 'random') - max(auc_weighted) FILTER (WHERE variant = 'grouped') AS gap
      FROM ({slice_auc('both_', 'variant')})""",
    doubles="grouped random gap",
    placed_=_PLACED,
    both_="""SELECT 'grouped' AS variant, y, 1 / pi AS w, incumbent_score AS score FROM placed_ WHERE fold = 'validate'
      UNION ALL SELECT 'random', y, 1 / pi, incumbent_score FROM placed_ WHERE random = 'validate'""",
)
def met8(s: Study) -> DataFrame:
    kept = s.split.filter(~F.col("in_gap")).select("sha256", "fold", "y", "pi", "incumbent_score")
    placed = s.stage("random_places", lambda: splits.random_split(kept, s.params))
    variants = F.array_compact(
        F.array(
            F.when(F.col("fold") == "validate", F.lit("grouped")), F.when(F.col("fold_random") == "validate", F.lit("random"))
        )
    )
    rows = placed.select("y", (1 / F.col("pi")).alias("w"), F.col("incumbent_score").alias("score"), F.explode(variants).alias("variant"))
    found = metrics.roc_auc(rows, "score", "y", s.params.skew, by=["variant"], weight="w")
    grouped = F.max(F.when(F.col("variant") == "grouped", F.col("auc_weighted")))
    random = F.max(F.when(F.col("variant") == "random", F.col("auc_weighted")))
    return found.agg(grouped.alias("grouped"), random.alias("random"), (random - grouped).alias("gap"))


@query(
    "met9_stability",
    """SELECT a.run AS run_a, b.run AS run_b, avg(abs(a.score - b.score)) AS score_mad, corr(a.rk, b.rk) AS spearman
      FROM ranked_ a JOIN ranked_ b ON a.sha256 = b.sha256 AND a.run < b.run GROUP BY 1, 2""",
    doubles="score_mad spearman",
    runs="""SELECT doc_id AS sha256, unnest(['r1', 'r2', 'r3']) AS run, unnest([n_chars::DOUBLE, sqrt(n_chars), (doc_id % 97)::DOUBLE]) AS score FROM documents""",
    ranked_="SELECT *, rank() OVER (PARTITION BY run ORDER BY score) + (count(*) OVER (PARTITION BY run, score) - 1) / 2.0 AS rk FROM runs",
)
def met9(s: Study) -> DataFrame:
    return metrics.stability(run_scores(s), ["r1", "r2", "r3"], s.params.skew)


RUN_CTES = {
    "runs": """SELECT doc_id AS sha256, unnest(['r1', 'r2', 'r3']) AS run, unnest([n_chars::DOUBLE, sqrt(n_chars), (doc_id % 97)::DOUBLE]) AS score FROM documents""",
    "run_rows": "SELECT run, score, quality AS y, 1.0 AS w FROM runs JOIN labels ON doc_id = sha256",
}


def run_aucs(s: Study) -> DataFrame:
    truth = s.table("labels").select(F.col("doc_id").alias("sha256"), F.col("quality").alias("y"))
    rows = run_scores(s).join(truth, "sha256")
    return metrics.roc_auc(rows, "score", "y", s.params.skew, by=["run"]).select("run", "n", "auc_raw")


@query("met9_auc_spread", f"SELECT run, n, auc_raw FROM ({slice_auc('run_rows', 'run')})", doubles="auc_raw", **RUN_CTES)
def met9_auc(s: Study) -> DataFrame:
    return run_aucs(s)


@query(
    "met9_auc_range",
    f"""SELECT count(*) AS runs, count(auc_raw) AS defined, avg(auc_raw) AS auc_mean, stddev_samp(auc_raw) AS auc_sd,
      max(auc_raw) - min(auc_raw) AS auc_range FROM ({slice_auc('run_rows', 'run')})""",
    doubles="auc_mean auc_sd auc_range",
    **RUN_CTES,
)
def met9_range(s: Study) -> DataFrame:
    return metrics.auc_spread(run_aucs(s))
