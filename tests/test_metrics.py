"""Metrics against their definitions, computed by brute force."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assay.operators import metrics
from assay.params import Params, Skew

SKEW = Skew(buckets=4)


def brute_auc(rows):
    wins = total = 0.0
    for y, s, w in rows:
        for y2, s2, w2 in rows:
            if y == 1 and y2 == 0:
                total += w * w2
                wins += w * w2 * ((s > s2) + 0.5 * (s == s2))
    return wins / total if total else None


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.1, 0.2, 0.2, 0.5, 0.9]), st.sampled_from([0.5, 1.0, 4.0])), min_size=1, max_size=20))
def test_weighted_auc_is_the_pair_definition(spark, rows):
    df = spark.createDataFrame(rows, "y int, s double, w double")
    r = metrics.roc_auc(df, "s", "y", SKEW, weight="w").first()
    want = brute_auc(rows)
    assert r["auc_weighted"] == (None if want is None else pytest.approx(want))
    raw = brute_auc([(y, s, 1.0) for y, s, _ in rows])
    assert r["auc_raw"] == (None if raw is None else pytest.approx(raw))


def test_auc_is_null_with_one_class(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.4)], "y int, s double")
    assert metrics.roc_auc(df, "s", "y", SKEW).first()["auc_raw"] is None


def test_slices_customer_and_feed_only(spark):
    rows = [(0, 0.1, 1.0, "customer", "a"), (1, 0.9, 0.5, "customer", "a"), (0, 0.2, 1.0, "feed", "b"), (1, 0.8, 0.5, "feed", "b")]
    df = spark.createDataFrame(rows, "y int, s double, pi double, provenance string, stratum string")
    got = {r["slice"]: r for r in metrics.metrics_table(df, {"s": F.col("s")}, SKEW).collect()}
    assert set(got) == {"pooled", "customer", "stratum:a", "stratum:b", "provenance:customer", "provenance:feed"}
    assert got["pooled"]["auc_raw"] == got["customer"]["auc_weighted"] == 1.0 and got["customer"]["n"] == 2
    feed = metrics.metrics_table(df.withColumn("provenance", F.lit("feed")), {"s": F.col("s")}, SKEW)
    none = next(r for r in feed.collect() if r["slice"] == "customer")
    assert (none["n"], none["auc_raw"], none["auc_weighted"]) == (0, None, None)


def test_base_rate_brier(spark):
    df = spark.createDataFrame([(1, 1.0)] + [(0, 1.0)] * 3, "y int, pi double")
    r = metrics.prob_metrics(df, F.lit(0.25)).first()
    assert r["brier"] == pytest.approx(0.1875) and r["brier_base_rate"] == pytest.approx(0.1875)
    assert r["log_loss"] == pytest.approx(-(np.log(0.25) + 3 * np.log(0.75)) / 4)


def test_bin_count():
    assert [metrics.bin_count(n) for n in (3, 9, 10, 24, 50, 1000)] == [2, 2, 2, 4, 10, 10]


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(0)
    p = np.round(rng.random(300), 2)
    rows = [(i, float(x), int(rng.random() < x), 0.5 if i % 2 else 0.25) for i, x in enumerate(p)]
    return spark.createDataFrame(rows, "id long, p double, y int, pi double")


def test_reliability_bins_match_numpy(scored):
    pdf = scored.toPandas()
    edges = np.quantile(pdf.p, np.linspace(0, 1, 6))
    edges[0], edges[-1] = 0, 1
    pdf["bin"] = np.clip(np.searchsorted(edges, pdf.p, side="right") - 1, 0, 4)
    pdf["w"] = 1 / pdf.pi
    got = {r["bin"]: r for r in metrics.reliability(scored, "p", 5, SKEW).collect()}
    for b, part in pdf.groupby("bin"):
        assert got[b]["n"] == len(part)
        assert got[b]["observed"] == pytest.approx(np.average(part.y, weights=part.w))
        assert got[b]["predicted"] == pytest.approx(np.average(part.p, weights=part.w))


def test_bootstrap_band_holds_the_curve_and_ignores_partitioning(scored):
    params = Params(skew=SKEW)
    band = metrics.bootstrap_band(scored, "p", "id", 5, params, replicates=60)
    again = metrics.bootstrap_band(scored.repartition(7), "p", "id", 5, params, replicates=60)
    got = {r["bin"]: r for r in band.collect()}
    curve = {r["bin"]: r["observed"] for r in metrics.reliability(scored, "p", 5, SKEW).collect()}
    assert all(r["low"] <= curve[b] <= r["high"] and r["low"] < r["high"] for b, r in got.items())
    for r in again.collect():
        assert r["low"] == pytest.approx(got[r["bin"]]["low"])


def test_shuffled_labels_score_near_half(spark):
    df = spark.range(2000).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2).cast("double").alias("s"))
    r = metrics.shuffled_auc(df, "s", "id", Params(skew=SKEW)).first()
    assert r["n"] == 2000 and abs(r["auc"] - 0.5) < 0.05


def test_stability_matches_pandas(spark):
    rng = np.random.default_rng(1)
    wide = pd.DataFrame({"a": np.round(rng.random(80), 1), "b": np.round(rng.random(80), 1)})
    rows = [(run, f"k{i}", float(v)) for run in wide for i, v in enumerate(wide[run])]
    tight = Skew(buckets=4, hot_rows=5, salts=3)
    r = metrics.stability(spark.createDataFrame(rows, "run string, sha256 string, score double"), ["a", "b"], tight).first()
    assert r["score_mad"] == pytest.approx((wide.a - wide.b).abs().mean())
    assert r["spearman"] == pytest.approx(wide.a.rank().corr(wide.b.rank()))


def test_baseline_verdicts(spark):
    cases = {None: "undefined", 0.99: "stop", 0.9: "healthy", 0.52: "disconnected", 0.7: "outside"}
    df = spark.createDataFrame([(a,) for a in cases], "a double")
    assert {r["a"]: r["v"] for r in df.select("a", metrics.baseline_verdict(F.col("a")).alias("v")).collect()} == cases
