"""Groups stay whole, the gap is kept, every row is accounted for."""

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from assay.operators.splits import (
    group_column,
    horizon_gap,
    prevalence,
    random_split,
    split_report,
    straddling,
    temporal_split,
    with_group,
)
from assay.params import Params, Skew
from assay.plans.ordering import prefix_sums

T = dt.datetime(2026, 9, 1)
P = Params(train_frac=0.5, validate_frac=0.2)
SCHEMA = "sha256 string, group string, scoring_moment timestamp_ntz, y int, pi double"


@pytest.fixture(scope="module")
def rows(spark):
    days = [("a", 0, 4), ("b", 10, 2), ("c", 20, 2), ("d", 60, 2)]
    data = [(f"{g}{i}", g, T + dt.timedelta(days=d), i % 2, 0.5) for g, d, n in days for i in range(n)]
    return spark.createDataFrame(data, SCHEMA)


def test_groups_are_cut_whole_in_time_order(rows):
    got = {r["group"]: r["fold"] for r in temporal_split(rows, P).collect()}
    assert got == {"a": "train", "b": "validate", "c": "test", "d": "test"}
    assert straddling(temporal_split(rows, P)).first()["straddling"] == 0


def test_one_family_with_a_third_of_the_rows_is_salted_and_whole(spark):
    data = [(f"s{i}", "big" if i % 3 == 0 else f"g{i}", T + dt.timedelta(days=i % 5), 0, 0.5) for i in range(600)]
    df = spark.createDataFrame(data, SCHEMA)
    tight = replace(P, skew=Skew(hot_rows=50, salts=4, buckets=8, hash_digits=1))
    plain = {r["sha256"]: r["fold"] for r in temporal_split(df, P).collect()}
    assert {r["sha256"]: r["fold"] for r in temporal_split(df, tight).collect()} == plain and len(plain) == 600
    assert len({plain[f"s{i}"] for i in range(0, 600, 3)}) == 1


def test_horizon_gap(rows):
    got = horizon_gap(temporal_split(rows, P), 30).filter("in_gap").collect()
    assert {r["group"] for r in got} == {"c"}


def test_every_row_is_in_a_fold_the_gap_or_excluded(spark, rows):
    split = horizon_gap(temporal_split(rows, P), 30)
    excluded = spark.createDataFrame([("q", "unwanted")], "sha256 string, label string")
    report = {r["part"]: r["n"] for r in split_report(split, excluded).collect()}
    assert report == {"train": 4, "validate": 2, "gap": 2, "test": 2, "excluded:unwanted": 1}


def test_random_split_has_exact_counts_and_a_seed(spark):
    df = spark.range(0, 1000).select(F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    one = random_split(df, P)
    assert {r["fold_random"]: r["count"] for r in one.groupBy("fold_random").count().collect()} == {"train": 500, "validate": 200, "test": 300}
    assert sorted(one.collect()) == sorted(random_split(df.repartition(7), P).collect())
    assert sorted(one.collect()) != sorted(random_split(df, replace(P, seed=1)).collect())


def test_random_split_by_number_is_that_by_digest(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("sha256"))
    digest = F.sha2(F.col("sha256").cast("string"), 256)
    one = random_split(df, P, digest)
    want = random_split(df.withColumn("sha256", digest), P)
    assert sorted(one.withColumn("sha256", digest).collect()) == sorted(want.collect())
    lines = one._jdf.queryExecution().executedPlan().toString().splitlines()
    moved = [below for line, below in zip(lines, lines[1:]) if "REPARTITION_BY_COL" in line]
    assert moved and not any("AS _key" in m or "AS _tie" in m for m in moved)
    with pytest.raises(ValueError, match="moved first"):
        prefix_sums(df, by=[], order=["k"], sums={}, keep=F.lit(True), late={"k": digest})


def test_group_key_falls_back(spark):
    df = spark.createDataFrame([("a", "emotet", None), ("b", "", None), ("c", None, None)], "sha256 string, modal_family string, tlsh_cluster string")
    assert group_column(df) == "modal_family"
    assert {r["sha256"]: r["group"] for r in with_group(df, "modal_family").collect()} == {"a": "emotet", "b": "b", "c": "c"}
    filled = df.withColumn("tlsh_cluster", F.when(F.col("sha256") == "a", "t1"))
    assert group_column(filled) == "tlsh_cluster"
    assert {r["group"] for r in with_group(filled, "tlsh_cluster").collect()} == {"t1", "b", "c"}


def test_prevalence(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.25), (0, 0.25), (0, 0.25)], "y int, pi double")
    r = prevalence(df).first()
    assert (r["n"], r["raw"], r["reweighted"]) == (4, 0.25, round(1 / 13, 4))
