"""Four verdict states in the matrix, count agreement, and the as-of rule."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from assay.operators import checks
from assay.operators.features import (
    aggregates,
    align,
    build_matrix,
    count_drift,
    design,
    encode_verdicts,
    family_scalars,
    late_rows,
    merge_static,
    off_roster,
    roster_of,
)

ROSTER = ["A", "B", "C", "D"]
T = dt.datetime(2026, 9, 1)


@pytest.fixture(scope="module")
def long(spark):
    rows = [
        ("x", "feature", "A", True, 10, "Emotet"),
        ("x", "feature", "B", False, 20, None),
        ("x", "feature", "C", None, 30, None),
        ("x", "label", "D", True, 1, "PUA"),
    ]
    return spark.createDataFrame(rows, "sha256 string, scan_role string, author string, verdict boolean, bid long, malware_family string")


@pytest.fixture(scope="module")
def cohort(spark):
    rows = [("x", 25035718062263813, T, 30.0, 2, 1, 3, "contested", 0.5, "feed"), ("lone", 7, T, 31.0, 0, 0, 0, "contested", 0.5, "feed")]
    return spark.createDataFrame(
        rows,
        "sha256 string, instance_number long, scoring_moment timestamp_ntz, gap_days double, n_definite long, n_malicious long,"
        " n_responded long, stratum string, pi double, provenance string",
    )


def test_four_states_stay_apart(long):
    r = encode_verdicts(long.filter("scan_role = 'feature'"), ROSTER).first()
    got = {e: (r[f"engine_{e}_responded"], r[f"engine_{e}_malicious"]) for e in ROSTER}
    assert got == {"A": (1, 1), "B": (1, 0), "C": (1, 0), "D": (0, 0)}
    old = encode_verdicts(long.filter("scan_role = 'feature'"), ROSTER, "old").first()
    assert [old[f"engine_{e}"] for e in ROSTER] == [1, 0, 0, 0]


def test_aggregates(long):
    r = aggregates(long.filter("scan_role = 'feature'")).first()
    assert (r["n_responded"], r["n_definite"], r["n_malicious"], r["n_benign"], r["n_unknown"]) == (3, 2, 1, 1, 1)
    assert (r["m"], r["m_defined"], r["bid_mean_malicious"], r["bid_mean_benign"]) == (0.5, 1, 10.0, 20.0)


def test_family_scalars_and_modal_tie(spark):
    rows = [("x", True, f) for f in [" Zbot", "zbot ", "emotet", "Emotet\t", None, "PUA.x", "Gen:Variant"]] + [("x", False, "ignored")]
    r = family_scalars(spark.createDataFrame(rows, "sha256 string, verdict boolean, malware_family string")).first()
    assert (r["n_with_family"], r["n_distinct_families"], r["n_specific"], r["n_generic"], r["n_pup"]) == (6, 4, 4, 2, 1)
    assert r["modal_family"] == "emotet" and r["modal_family_share"] == pytest.approx(2 / 7)


def test_matrix_groups_and_zero_rows(cohort, long):
    matrix, groups = build_matrix(cohort, long, ROSTER)
    rows = {r["sha256"]: r for r in matrix.collect()}
    assert rows["x"]["instance_number"] == 25035718062263813
    assert rows["lone"]["n_responded"] == 0 and rows["lone"]["m"] is None and rows["lone"]["modal_family"] == ""
    assert groups["bookkeeping"] == ["pi", "provenance", "stratum"]
    assert not set(groups["features_new"]) & {"pi", "stratum", "provenance", "sha256", "modal_family"}
    assert len(groups["features_old"]) == 4 and "engine_D_responded" in groups["features_new"]


def test_counts_out_of_step_are_found(cohort, long):
    first = long.filter("scan_role = 'feature'")
    assert count_drift(cohort, first).first().asDict() == {"n_definite": 0, "n_malicious": 0, "n_responded": 0}
    broken = cohort.withColumn("n_malicious", F.col("n_malicious") + 1)
    assert count_drift(broken, first).first()["n_malicious"] == 2
    with pytest.raises(Exception, match="stored counts differ"):
        build_matrix(broken, long, ROSTER)[0].collect()
    assert build_matrix(broken, long, ROSTER, strict=False)[0].count() == 2


def test_static_block_needs_an_instant_and_is_checked_per_row(spark, cohort, long):
    static = spark.createDataFrame([("x", 3, T + dt.timedelta(seconds=1))], "sha256 string, n_sections int, pe_as_of timestamp_ntz")
    assert late_rows(merge_static(cohort, static, strict=False)).first()["late"] == 1
    with pytest.raises(Exception, match="later than the scoring moment"):
        merge_static(cohort, static).collect()
    fine = static.withColumn("pe_as_of", F.lit(T).cast("timestamp_ntz"))
    assert late_rows(merge_static(cohort, fine)).first()["late"] == 0
    matrix, groups = build_matrix(cohort, long, ROSTER, fine)
    assert "n_sections" in groups["features_new"] and "n_sections" in matrix.columns
    with pytest.raises(checks.AsOfError):
        merge_static(cohort, static.drop("pe_as_of"))


@pytest.mark.parametrize("name", ["family_rollup", "tags", "combined_score", "stratum", "pi", "provenance"])
def test_refused_names(name):
    with pytest.raises(checks.AsOfError):
        checks.refuse_names(["n_malicious", name])


def test_as_of_violations(spark):
    hour = dt.timedelta(hours=1)
    rows = [("a", T - hour, T), ("b", T, T), ("c", T + dt.timedelta(seconds=1), T), ("families", T - hour, T), ("pi", T - hour, T)]
    df = spark.createDataFrame(rows, "name string, as_of timestamp_ntz, scoring_moment timestamp_ntz")
    assert {r["name"]: r["reason"] for r in checks.as_of_violations(df).collect()} == {"c": "late", "families": "regenerated", "pi": "bookkeeping"}


def test_design_and_align(spark):
    df = spark.createDataFrame([(1, None)], "a int, m double")
    assert design(df, ["a", "m"]).first().asDict() == {"a": 1.0, "m": 0.0}
    assert design(df, ["m"], impute=False).first()["m"] is None
    with pytest.raises(ValueError):
        design(df.withColumn("pi", F.lit(1.0)), ["a", "pi"])
    assert align(df, ["z", "a"]).first().asDict() == {"z": 0, "a": 1}


def test_engines_off_the_roster_are_counted_and_refused(cohort, long):
    assert roster_of(long) == ["A", "B", "C", "D"]
    with pytest.raises(ValueError, match="more than 3"):
        roster_of(long, most=3)
    first = long.filter("scan_role = 'feature'")
    assert {r["author"]: r["n"] for r in off_roster(first, ["A"]).collect()} == {"B": 1, "C": 1}
    with pytest.raises(Exception, match="off the roster"):
        encode_verdicts(first, ["A", "B"]).collect()
    with pytest.raises(Exception, match="off the roster"):
        build_matrix(cohort, long, ["A", "B"])[0].collect()
    kept = encode_verdicts(first, ["A", "B"], strict=False).first().asDict()
    assert kept == {"sha256": "x", "engine_A_responded": 1, "engine_A_malicious": 1, "engine_B_responded": 1, "engine_B_malicious": 0}


def test_three_hundred_engines_are_no_aggregates_each(spark):
    roster = [f"engine {i:03d}.x" for i in range(300)]
    rows = [(f"s{i % 7}", e, None if i % 3 == 2 else i % 3 == 0) for i, e in enumerate(roster)]
    df = spark.createDataFrame(rows, "sha256 string, author string, verdict boolean")
    wide = encode_verdicts(df, roster)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("max(") < 20 and "pivotfirst" in plan.lower()
    found = {r["sha256"]: r for r in wide.collect()}
    for i, e in enumerate(roster):
        mine = found[f"s{i % 7}"]
        assert (mine[f"engine_{e}_responded"], mine[f"engine_{e}_malicious"]) == (1, int(i % 3 == 0))
        assert found[f"s{(i + 1) % 7}"][f"engine_{e}_responded"] == 0


def test_one_to_one(spark):
    one, two = (spark.createDataFrame([(k,) for k in keys], "k string") for keys in ("ab", "abc"))
    checks.one_to_one(one, one, "k")
    for left, right in ((one, two), (two, one), (one.union(one), one)):
        with pytest.raises(checks.CheckError):
            checks.one_to_one(left, right, "k")
