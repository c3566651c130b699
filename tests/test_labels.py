"""Families, the change decomposition, and every branch of the label rule."""

import pytest
from pyspark.sql import functions as F

from assay.functions.families import family_class
from assay.operators import checks
from assay.operators.labels import change, folded, gold_disagreement, label, rates, with_turnover
from assay.params import Params

P = Params()
LONG = "sha256 string, scan_role string, author string, verdict boolean, malware_family string"

FAMILIES = {
    None: "none",
    "  ": "none",
    "Trojan.Generic": "generic",
    "Gen:Variant.12": "generic",
    "Artemis!A1B2C3D4": "generic",
    "a variant of Win32/Agent": "generic",
    "Win32/Emotet": "specific",
    "Trojan.AgentTesla": "specific",
    "PUA.Bundler": "pup",
    "not-a-virus:AdWare.Win32": "pup",
    "HackTool.Mimikatz": "dual_use",
    "Riskware/RemoteAdmin": "pup",
}


def test_family_class(spark):
    df = spark.createDataFrame([(f,) for f in FAMILIES], "f string")
    assert {r["f"]: r["c"] for r in df.select("f", family_class(F.col("f")).alias("c")).collect()} == FAMILIES


def _history(label_rows, feature_rows=()):
    rows = [("x", "feature", f"e{i}", v, None) for i, v in enumerate(feature_rows)]
    return rows + [("x", "label", f"e{i}", v, fam) for i, (v, fam) in enumerate(label_rows)]


CASES = {
    "floor": (_history([(True, "Emotet")] * 4), ("undecidable", "below_floor")),
    "unknown is not definite": (_history([(None, None)] * 3 + [(True, "Emotet")] * 4), ("undecidable", "below_floor")),
    "clean": (_history([(False, None)] * 6), ("benign", "no_detection")),
    "retracted": (_history([(False, None)] * 6, [True]), ("benign", "retracted")),
    "three specific": (_history([(True, "Emotet")] * 3 + [(False, None)] * 3), ("malicious", "specific_families")),
    "three generic": (_history([(True, "Trojan.Generic")] * 3 + [(False, None)] * 3), ("undecidable", "weak_consensus")),
    "six generic": (_history([(True, "Trojan.Generic")] * 6), ("malicious", "generic_volume")),
    "three pup": (_history([(True, "PUA.X")] * 3 + [(False, None)] * 3), ("unwanted", "pup_family")),
    "two pup, one generic": (_history([(True, "PUA.X")] * 2 + [(True, "Gen:Variant")] + [(False, None)] * 3), ("undecidable", "weak_consensus")),
    "three tools": (_history([(True, "HackTool.Psexec")] * 3 + [(False, None)] * 3), ("unwanted", "dual_use")),
    "more specific than pup": (_history([(True, "PUA.X")] * 2 + [(True, "Emotet")] * 3), ("malicious", "specific_families")),
    "no label scan": (_history([], [True]), ("undecidable", "no_label_scan_assertions")),
}


def test_label_rule(spark):
    names = list(CASES)
    rows = [(n, *r[1:]) for n in names for r in CASES[n][0]]
    cohort = spark.createDataFrame([(n, "contested", 0.5) for n in names], "sha256 string, stratum string, pi double")
    got = label(cohort, spark.createDataFrame(rows, LONG), P).collect()
    assert {r["sha256"]: (r["label"], r["reason"]) for r in got} == {n: CASES[n][1] for n in names}
    assert {r["trainable"] for r in got if r["label"] in ("unwanted", "undecidable")} == {False}
    assert {r["grade"] for r in got} == {1}


@pytest.mark.parametrize(
    "at_t, at_l, want",
    [
        ([False, True], [False, True, True, True], (0, 0, 2, 0, 2)),
        ([True], [False], (1, 1, 0, 0, 0)),
        ([None], [True], (1, 0, 0, 0, 0)),
        ([], [True], (0, 0, 1, 0, 0)),
        ([True, None], [], (0, 0, 0, 2, 0)),
        ([None], [None], (0, 0, 0, 0, 1)),
    ],
)
def test_change_decomposition(spark, at_t, at_l, want):
    rows = _history([(v, None) for v in at_l], at_t)
    r = change(spark.createDataFrame(rows, LONG)).first()
    assert (r["flips"], r["retractions"], r["joined"], r["left"], r["stable"]) == want


def test_turnover_rate(spark):
    df = spark.createDataFrame([(0, 0, 2, 0, 1), (0, 0, 0, 0, 0)], "flips long, retractions long, joined long, left long, stable long")
    assert sorted(r["turnover_rate"] for r in with_turnover(df).collect()) == pytest.approx([0.0, 2 / 3])


def test_guards(spark):
    df = spark.createDataFrame([("malicious", 1), ("known_good", 3), (None, 3)], "label string, grade int")
    assert {r["label"] for r in checks.stray_labels(df).collect()} == {"known_good", None}
    assert [r["grade"] for r in checks.low_grades(df).collect()] == [1]
    with pytest.raises(checks.CheckError):
        checks.enforce(checks.low_grades(df), "calibration needs adjudicated labels")
    checks.enforce(checks.low_grades(df.filter("grade = 3")), "fine")
    names = ["known_good", "dual_use", "excluded", "malicious"]
    got = spark.createDataFrame([(n,) for n in names], "l string").select("l", folded(F.col("l")).alias("f")).collect()
    assert {r["l"]: r["f"] for r in got} == dict(zip(names, ["benign", "unwanted", None, "malicious"]))


def test_rates_raw_and_weighted(spark):
    df = spark.createDataFrame([("malicious", 1.0), ("benign", 0.25)], "label string, pi double")
    got = {r["label"]: (r["raw"], r["weighted"]) for r in rates(df).collect()}
    assert got == {"malicious": (0.5, 0.2), "benign": (0.5, 0.8), "unwanted": (0.0, 0.0), "undecidable": (0.0, 0.0)}


def test_gold_disagreement(spark):
    labels = spark.createDataFrame([("a", "malicious", 0.5), ("b", "benign", 0.25)], "sha256 string, label string, pi double")
    gold = spark.createDataFrame([("a", "malicious"), ("b", "malicious")], "sha256 string, gold string")
    r = gold_disagreement(labels, gold).first()
    assert (r["audited"], r["error_raw"], r["error_weighted"]) == (2, 0.5, pytest.approx(4 / 6))
