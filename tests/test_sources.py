"""Snapshots, landed JSON, and the incremental forms."""

import datetime as dt
import math
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from assay.operators.forced import STATUSES, overlay
from assay.sources import pages, snapshots
from assay.streaming import flows

BIG = 25035718062263813
T = dt.datetime(2026, 1, 1)


def test_snapshots_are_written_once_and_verified(spark, tmp_path):
    df = spark.createDataFrame([(BIG, "a", None), (2, "b", 1.5)], "number long, k string, v double")
    path = str(tmp_path / "snap")
    manifest = snapshots.write_snapshot(df, path, stage="base", seed=7)
    back, read = snapshots.read_snapshot(spark, path)
    assert read == manifest and read["seed"] == 7 and {r["number"] for r in back.collect()} == {BIG, 2}
    with pytest.raises(AnalysisException):
        snapshots.write_snapshot(df, path, stage="base")
    df.limit(1).write.mode("append").parquet(path)
    with pytest.raises(snapshots.SnapshotError):
        snapshots.read_snapshot(spark, path)
    snapshots.write_snapshot(df, path, stage="base", overwrite=True)
    assert snapshots.read_snapshot(spark, path)[0].count() == 2


def test_fingerprint_ignores_order_and_sees_every_cell(spark):
    df = spark.createDataFrame([(i, str(i), None if i % 2 else 1.0) for i in range(50)], "a long, b string, c double")
    one = snapshots.fingerprint(df).first()
    assert snapshots.fingerprint(df.repartition(7).orderBy(F.desc("a")).select("c", "b", "a")).first() == one
    assert snapshots.fingerprint(df.withColumn("c", F.when(F.col("a") != 3, F.col("c")).otherwise(2.0))).first() != one
    assert snapshots.fingerprint(df.select("a", F.col("b").alias("x"), "c")).first() != one


def test_a_run_refuses_another_base(spark, tmp_path):
    base, other, run = (str(tmp_path / n) for n in ("base", "other", "run"))
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "sha256 string, n int")
    for path, df in ((base, rows), (other, rows.limit(1))):
        snapshots.write_snapshot(df, path, stage="base")
        snapshots.write_snapshot(df, path + "_long", stage="long")
    snapshots.write_run(rows.limit(1), run, base)
    assert snapshots.load_run(spark, run).base.count() == 2
    with pytest.raises(snapshots.SnapshotError):
        snapshots.load_run(spark, run, other)


def test_periods_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(i, T + dt.timedelta(days=i % 3, hours=5)) for i in range(30)]
    snapshots.write_periods(spark.createDataFrame(rows, "number long, created timestamp_ntz"), path)
    again = spark.createDataFrame([(100, T + dt.timedelta(days=1))], "number long, created timestamp_ntz")
    snapshots.write_periods(again, path)
    window = snapshots.read_window(spark, path, "2026-01-01", "2026-01-03")
    assert sorted(r["number"] for r in window.collect()) == sorted([i for i in range(30) if i % 3 == 0] + [100])
    assert "PartitionFilters: [isnotnull(period" in window._jdf.queryExecution().toString()


def test_pages_keep_ids_and_missing_blocks(spark, tmp_path):
    scan = {"artifact_instance_id": BIG, "created": "2026-01-01T10:00:00+02:00", "detections": {"malicious": 1, "benign": 2, "total": 3},
            "assertions": {"z": {"verdict": True}, "a": {"verdict": None}}}
    page = {"result": [{"artifact": {"sha256": "s", "size": 5}, "scan": {"mimetype": "m", "first_scan": scan}}, {"artifact": {"sha256": "t"}}], "next": None}
    (tmp_path / "page_0000.json").write_text(json.dumps(page))
    got = {r["sha256"]: r for r in pages.read_pages(spark, str(tmp_path)).collect()}
    assert got["s"]["first_instance"] == BIG and got["s"]["first_created"] == dt.datetime(2026, 1, 1, 8)
    assert (got["s"]["first_definite"], got["s"]["first_responded"], got["s"]["latest_instance"]) == (3, 2, None)
    assert got["s"]["first_assertions"].index('"a"') < got["s"]["first_assertions"].index('"z"')
    assert got["t"]["first_responded"] == 0 and got["t"]["first_assertions"] is None


def test_iso_moments(spark):
    cases = {"2026-01-01T00:00:00Z": T, "2026-01-01T01:30:00.5+01:30": T + dt.timedelta(seconds=0.5), "2025-12-31T19:00:00-05:00": T, "2026-01-01 00:00:00": T, "x": None, None: None}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {r["t"]: r["m"] for r in df.select("t", pages.iso_moment(F.col("t")).alias("m")).collect()} == cases


def test_last_record_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "k string, at long, v string")
    assert {r["k"]: r["v"] for r in pages.last_record(df, "k", ["at"]).collect()} == {"a": None, "b": "y"}


def test_renders_and_statuses(spark):
    def render(i, closed=True, failed=False, n=1):
        answers = [{"author": f"e{j}", "verdict": None, "bid": ["12", "x", None][j % 3], "metadata": {"malware_family": "F", "scanner": {"version": "2"}}} for j in range(n)]
        return (json.dumps({"id": str(i), "created": "2026-01-01T00:00:00Z", "window_closed": closed, "failed": failed, "assertions": answers}),)

    lines = [render(i) for i in range(1, 10)] + [render(10, closed=False), render(11, failed=True), render(12, n=0), render(BIG, n=3)]
    parsed = pages.parse_renders(spark.createDataFrame(lines, "value string"))
    rows = [r for r in pages.explode_renders(parsed).collect() if r["instance_number"] == BIG]
    assert [r["bid"] for r in rows] == [12, 0, 0] and rows[0]["verdict"] is None and rows[0]["scanner_version"] == "2"
    renders = pages.render_rows(parsed)
    renders = renders.unionByName(renders.limit(1).withColumns({"instance": F.lit(13).cast("long"), "missing": F.lit(True)}))
    asked = {"a": 2, "b": 12, "c": 10, "d": 11, "e": 13, "f": None, "g": 999}
    drawn = spark.createDataFrame([(k, 1) for k in asked], "sha256 string, instance_number long")
    sent = spark.createDataFrame([(k, v) for k, v in asked.items() if v], "sha256 string, rescan_instance long")
    got = {r["sha256"]: r["status"] for r in overlay(drawn, sent, renders).collect()}
    assert [got[k] for k in "abcdef"] == list(STATUSES) and got["g"] == "pending"


def test_key_list(spark, tmp_path):
    (tmp_path / "keys.txt").write_text(" aa \n\nbb\t\naa\n   \n")
    assert sorted(r["sha256"] for r in pages.key_list(spark, str(tmp_path)).collect()) == ["aa", "bb"]


# ---------------------------------------------------------------- streams

SIGNALS = "signal_id long, sha256 string, type string, observed_at timestamp_ntz"


def test_ingest_goes_on_with_new_files_only(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    for part in range(2):
        rows = [(part * 10 + i, T + dt.timedelta(days=part)) for i in range(5)]
        spark.createDataFrame(rows, "id long, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(src)
        stream = flows.file_stream(spark, src, spark.read.parquet(src).schema, files_per_batch=1)
        flows.ingest_stream(stream, out, state, "ts").awaitTermination()
        assert spark.read.parquet(out).count() == 5 * (part + 1)
    assert {r["day"].isoformat() for r in spark.read.parquet(out).select("day").distinct().collect()} == {"2026-01-01", "2026-01-02"}


def test_late_signals_count_whatever_their_age(spark, tmp_path):
    src, store, out, state = (str(tmp_path / n) for n in ("src", "store", "out", "state"))
    at = lambda hours: T + dt.timedelta(hours=hours)
    runs = [
        [(1, "a", "c2", at(12)), (1, "a", "c2", at(12)), (2, "a", "c2", at(-1)), (3, "b", "other", at(1))],
        # Older than anything seen, a repeat, and two signals of one key at one moment.
        [(4, "a", "c2", at(6)), (1, "a", "c2", at(12)), (5, "b", "c2", at(2)), (6, "b", "vt", at(2)), (7, "nobody", "c2", at(9))],
        [],
    ]
    scores = spark.createDataFrame([("a", 0.2, T), ("b", 0.4, T)], "sha256 string, probability double, scoring_moment timestamp_ntz")
    scores = scores.withColumn("scoring_moment", F.col("scoring_moment").cast("timestamp"))
    for rows in runs:
        if rows:
            spark.createDataFrame(rows, SIGNALS).coalesce(1).write.mode("append").parquet(src)
        stream = flows.file_stream(spark, src, spark.read.parquet(src).schema)
        flows.rescore_stream(
            stream, scores, {"c2": 2.0, "vt": 0.5}, key="sha256", store=store, out=out, checkpoint=state
        ).awaitTermination()
    rows = spark.read.parquet(out).collect()
    odds = {"a": -math.log(4), "b": math.log(0.4 / 0.6)}
    evidence = {1: 4.0, 3: 0.0, 4: 4.0, 5: 2.5, 6: 2.5}
    assert sorted(r["signal_id"] for r in rows) == sorted(evidence)
    for r in rows:
        expected = 1 / (1 + math.exp(-odds[r["sha256"]] - evidence[r["signal_id"]]))
        assert r["combined_score"] == pytest.approx(expected)


def test_pending_rows_settle(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    for at, rows in enumerate([[("a", "pending"), ("b", "labelled")], [("a", "labelled")], [("c", "pending")]]):
        spark.createDataFrame([(k, at, v) for k, v in rows], "k string, at int, status string").coalesce(1).write.mode("append").parquet(src)
        stream = flows.file_stream(spark, src, spark.read.parquet(src).schema)
        flows.settle_stream(stream, "k", ["at"], out, state).awaitTermination()
    view = {r["k"]: r["status"] for r in flows.settled_view(spark, out, "k", ["at"]).collect()}
    assert view == {"a": "labelled", "b": "labelled", "c": "pending"}


def test_a_mimetype_may_be_text_or_an_object(spark):
    scan = '{"scan": {"mimetype": %s}, "artifact": {"sha256": "%s"}}'
    lines = ['{"result": [%s, %s]}' % (scan % ('{"mime": "application/pdf", "extended": "x"}', "a"), scan % ('"text/html"', "b"))]
    got = pages.parse_pages(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {r["sha256"]: r["mimetype"] for r in got.collect()} == {"a": "application/pdf", "b": "text/html"}


def test_a_landed_render_may_be_missing(spark):
    lines = ['{"id": "1", "missing": true}', '{"id": "2", "window_closed": true}']
    rows = pages.render_rows(pages.parse_renders(spark.createDataFrame([(x,) for x in lines], "value string")))
    drawn = spark.createDataFrame([("a", 2), ("b", 2)], "sha256 string, instance_number long")
    sent = spark.createDataFrame([("a", 1), ("b", 2)], "sha256 string, rescan_instance long")
    assert {r["sha256"]: r["status"] for r in overlay(drawn, sent, rows).collect()} == {"a": "missing_render", "b": "no_assertions"}


def test_a_long_period_is_spread_by_its_count(spark, tmp_path):
    rows = [(i, T + dt.timedelta(hours=i % 40)) for i in range(400)]
    df = spark.createDataFrame(rows, "number long, created timestamp_ntz")
    merging = "spark.sql.adaptive.coalescePartitions.enabled"  # it joins tasks of few rows again
    spark.conf.set(merging, "false")
    snapshots.write_periods(df, str(tmp_path / "p"), rows_per_file=50)
    spark.conf.unset(merging)
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 400 and "_files" not in back.columns
    files = back.select("period", F.input_file_name().alias("f")).distinct().groupBy("period").count().collect()
    assert all(r["count"] > 1 for r in files)
