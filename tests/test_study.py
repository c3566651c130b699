import datetime
from dataclasses import replace

import pytest

from assay.catalog.q_joins import cohort_renders
from assay.catalog.q_sources import render_lines
from assay.catalog.study import STUDY, Study
from assay.operators import frame, settled
from assay.params import Skew
from assay.plans import ordering, stage
from assay.sources import pages, tables

DAY = datetime.datetime(2020, 1, 1)


@pytest.fixture
def folder(spark, tmp_path):
    lines = [(o, p, s, flag, q) for o in range(1, 9) for p, s, flag, q in ((4, 3, "R", 5.0), (5, 19, "A", 2.0), (6, 7, "N", 1.0))]
    lines += [(1, 99, 8, "R", 1.0), (2, None, 9, "R", 1.0), (3, 6, 7, "A", 9.0)]  # no such part; none; a second answer
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, f"name {i}") for i in range(8)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    orders = [(o, o % 2, "F", 1000.0 * o, DAY + datetime.timedelta(days=40 * o), "1-URGENT") for o in range(1, 9)]
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(orders, schema).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_answers_are_the_verdicts_without_a_join_by_part(spark, folder):
    s, names = Study(spark, folder), ["instance_number", "author", "verdict"]
    assert rows(s.orphans) == ["(99,)"]
    assert rows(s.answers()) == rows(s.verdicts.select(*names)) and s.answers().count() == 16
    few = spark.createDataFrame([(1,), (3,), (3,), (None,)], "number long")
    assert rows(s.answers(few)) == rows(s.verdicts.filter("instance_number IN (1, 3)").select(*names))
    assert rows(s.verdicts_of(few)) == rows(s.verdicts.filter("instance_number IN (1, 3)"))


def test_counts_meet_before_the_shuffle_and_equal_those_of_verdicts(spark, folder):
    schema = spark.read.parquet(f"{folder}/lineitem.parquet").schema
    odd = [(1, 4, None, "R", 1.0), (1, 4, -1, "A", 1.0), (1, 4, -10, "R", 1.0), (1, 4, -15, "N", 1.0), (1, 4, -2, "N", 1.0), (1, 4, -9, "A", 1.0)]
    odd += [(2, 5, k, flag, 1.0) for k in range(-20, 40) for flag in "ANR"[k % 3 :]] + [(None, 4, 1, "R", 1.0), (3, 98, 1, "R", 1.0)]
    spark.createDataFrame(odd, schema).write.mode("append").parquet(f"{folder}/lineitem.parquet")
    s = Study(spark, folder)
    want = frame.verdict_counts(s.verdicts, "instance_number")
    assert s.counts().schema.simpleString() == want.schema.simpleString()
    assert rows(s.counts()) == rows(want) and want.count() == 9
    assert rows(s.numbered) == rows(Study(spark, folder, lazy=True).numbered)
    plan = s.counts()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in plan


def test_scans_are_kept_by_number_and_leave_by_digest(spark, folder):
    s = Study(spark, folder)
    lazy = Study(spark, folder, lazy=True)
    assert s.numbered.schema["sha256"].dataType.simpleString() == "bigint"
    assert rows(s.scored.select("number", "sha256")) == rows(tables.scans(spark, folder).select("number", "sha256"))
    assert rows(s.labelled) == rows(lazy.labelled) and s.labelled.count() == 2


def test_labelled_scans_are_written_by_number(spark, folder):
    s = Study(spark, folder)
    assert s.labelled.columns == Study(spark, folder, lazy=True).labelled.columns
    written = {k[2]: path for k, path in stage._WRITTEN.items() if k[0] == spark.sparkContext.applicationId}["labelled"]
    assert spark.read.parquet(written).schema["sha256"].dataType.simpleString() == "bigint"
    assert "_n_scans" not in s.labelled.columns + s.frame.columns


def test_labels_group_no_verdicts_but_the_cohorts(spark, folder):
    s = Study(spark, folder)
    assert rows(s.cohort_long) == rows(s.long.join(s.cohort.select("sha256"), "sha256", "left_semi").select(s.cohort_long.columns))
    before = dict(stage._WRITTEN)
    fresh = Study(spark, folder, params=replace(STUDY, seed=1))
    fresh.labels.count(), fresh.matrix[0].count(), fresh.split_input.count()
    written = {k[2] for k in stage._WRITTEN if k not in before}
    assert "cohort_long" in written and "long" not in written


def test_short_histories_are_ranked_in_one_bucket(spark, folder):
    later = Study(spark, folder).numbered.select("sha256", "number", "completed")
    plan = lambda hot: settled.recency_rank(later, replace(STUDY, skew=Skew(hot_rows=hot, salts=2)))
    want = rows(later.join(spark.createDataFrame([(n, 5 - (n + 1) // 2) for n in range(1, 9)], "number long, rn long"), "number").select("number", "rn"))
    for hot in (1_000_000, 3):  # no history is hot; both are
        assert rows(plan(hot).select("number", "rn")) == want
    many = spark.createDataFrame([(1, n, DAY + datetime.timedelta(days=n)) for n in range(64)], "sha256 long, number long, completed timestamp_ntz")
    assert settled.timed(many, STUDY).select(ordering.BUCKET).distinct().count() == 1
    assert settled.timed(many, replace(STUDY, skew=Skew(hot_rows=10))).select(ordering.BUCKET).distinct().count() > 1


def test_renders_of_the_cohort_alone(spark, folder):
    s = Study(spark, folder)
    wanted = {r[c] for r in s.cohort.collect() for c in ("instance_number", "label_instance_number")}
    every = pages.render_rows(pages.parse_renders(render_lines(s)))
    found = pages.render_rows(cohort_renders(s))
    assert {r["instance"] for r in found.collect()} == wanted and every.count() == 8
    assert rows(found) == rows(every.filter(every["instance"].isin(*wanted)))
