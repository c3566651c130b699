"""The draw: determinism, recorded probabilities, honest under-fill."""

from dataclasses import replace

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from assay.operators.draw import band, check_draw, composite_pi, even_cell_draw, realized_pi, stratified_draw, with_band
from assay.params import Bands, Params

P = Params(cohort_size=400)


@pytest.fixture(scope="module")
def base(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(3000):
        n = rnd.randint(5, 19)
        share = rnd.choices([0.0, 0.07, 0.25, 0.45, 0.7], [0.4, 0.15, 0.25, 0.1, 0.1])[0]
        rows.append((hashlib.sha256(str(i).encode()).hexdigest(), round(n * share), n, n))
    return spark.createDataFrame(rows, "sha256 string, n_malicious long, n_definite long, n_responded long").cache()


def _ids(df):
    return {r["sha256"] for r in df.select("sha256").collect()}


def test_same_seed_same_cohort_whatever_the_partitioning(base):
    one = stratified_draw(base, P)[0]
    two = stratified_draw(base.repartition(13), P)[0]
    assert sorted(one.collect()) == sorted(two.select(*one.columns).collect())
    assert _ids(stratified_draw(base, replace(P, seed=1))[0]) != _ids(one)


def test_pi_is_drawn_over_available_and_recovers_the_base(base):
    cohort, report = stratified_draw(base, P)
    for r in report.filter("stratum <> 'below_floor'").collect():
        assert r["n_draw"] == min(r["n_available"], r["n_target"])
        assert r["pi"] is None or r["pi"] == pytest.approx(r["n_draw"] / r["n_available"])
    weight = cohort.agg(F.sum(1 / F.col("pi")).alias("w")).first()["w"]
    drawable = with_band(base, P.bands).filter("stratum <> 'below_floor'").count()
    assert weight == pytest.approx(drawable)


def test_underfill_is_reported_and_never_back_filled(base):
    cohort, report = stratified_draw(base, replace(P, cohort_size=20_000))
    rows = {r["stratum"]: r for r in report.collect()}
    assert all(r["underfilled"] and r["pi"] == 1.0 for s, r in rows.items() if s != "below_floor")
    assert cohort.count() == sum(r["n_draw"] for r in rows.values())


def test_below_floor_is_counted_not_drawn(base):
    cohort, report = stratified_draw(base, P)
    floor = report.filter("stratum = 'below_floor'").first()
    assert floor["n_available"] > 0 and floor["n_draw"] == 0 and floor["pi"] is None
    assert cohort.filter("stratum = 'below_floor'").count() == 0


def test_larger_cohort_contains_the_smaller_one(base):
    small = _ids(stratified_draw(base, replace(P, cohort_size=100))[0])
    assert small <= _ids(stratified_draw(base, P)[0])


@pytest.mark.parametrize(
    "floor, cases",
    [
        (5, {(0, 15): "consensus_clean", (1, 15): "leaning_clean", (3, 15): "contested", (6, 15): "leaning_malicious", (7, 13): "consensus_malicious", (2, 3): "below_floor"}),
        (10, {(13, 15): "consensus_malicious", (7, 15): "leaning_malicious", (7, 13): "consensus_malicious", (1, 10): "leaning_clean", (1, 2): "below_floor", (0, 0): "below_floor"}),
    ],
)
def test_band_edges(spark, floor, cases):
    df = spark.createDataFrame(list(cases), "m long, n long")
    got = df.select("m", "n", band(F.col("m"), F.col("n"), Bands(min_definite=floor)).alias("b")).collect()
    assert {(r["m"], r["n"]): r["b"] for r in got} == cases


def test_a_banded_base_and_bad_shares_are_refused(base):
    with pytest.raises(ValueError):
        stratified_draw(base.withColumn("stratum", F.lit("x")), P)
    with pytest.raises(ValueError):
        Params(targets={"contested": 0.5})


def test_checks_find_fan_out_and_bad_pi(base):
    cohort, report = stratified_draw(base, P)
    assert all(r["ok"] for r in check_draw(cohort, report).collect())
    broken = cohort.unionByName(cohort.limit(1).withColumn("pi", F.lit(1.5)))
    assert {r["check"]: r["violations"] for r in check_draw(broken, report).collect()} == {"row_count": 1, "pi_range": 1, "duplicate_key": 1}


def test_composite_and_realized_pi(base):
    cohort, _ = stratified_draw(base, P)
    row = composite_pi(cohort, 0.25).first()
    assert row["pi"] == pytest.approx(row["pi_draw"] * 0.25)
    kept = realized_pi(cohort, F.col("n_definite") > 12)
    for r in kept.groupBy("stratum").agg(F.count("*").alias("n"), F.max("n_available").alias("a"), F.max("pi_realized").alias("p")).collect():
        assert r["p"] == pytest.approx(r["n"] / r["a"])


def test_even_cells(base):
    cells = with_band(base, P.bands).withColumn("era", F.pmod(F.xxhash64("sha256"), F.lit(3)))
    got = even_cell_draw(cells, ["era", "stratum"], 15, P)
    per = got.groupBy("era", "stratum").agg(F.count("*").alias("n"), F.max("n_available").alias("a"), F.max("pi").alias("pi")).collect()
    assert all(r["n"] == min(15, r["a"]) and r["pi"] == pytest.approx(r["n"] / r["a"]) for r in per)
