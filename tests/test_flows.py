"""Streams whose state is a table: what each batch reads, keeps and emits."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from assay.streaming import flows

START = datetime(2024, 1, 1)
POLLS = "k long, at timestamp, done boolean"


def _poll(spark, folder, name, rows):
    cells = [(k, START + timedelta(days=d) if d is not None else None, done) for k, d, done in rows]
    spark.createDataFrame(cells, POLLS).coalesce(1).write.mode("append").parquet(str(folder / name))


def _close(spark, folder, polls):
    source = spark.readStream.schema(POLLS).option("maxFilesPerTrigger", 1).parquet(str(polls))
    flows.close_pending_stream(
        source, key="k", moment="at", closed=F.col("done"), overdue_days=3,
        state=str(folder / "state"), out=str(folder / "out"), checkpoint=str(folder / "check"),
    ).awaitTermination()
    out = spark.read.parquet(str(folder / "out"))
    ended = {(r["k"], r["state"], (r["closed_at"] - START).days) for r in out.collect()}
    assert out.count() == len(ended)
    return ended, sorted(r["k"] for r in flows.pending_view(spark, str(folder / "state")).collect())


def test_keys_settle_once_and_overdue_ones_are_closed(spark, tmp_path):
    batches = [
        [(1, 0, False), (2, 0, False), (3, 0, True), (None, 0, True), (4, None, True)],
        [(1, 1, True), (3, 1, False), (3, 2, True)],  # 3 was settled: its later polls change nothing
        [(5, 5, False)],  # the clock passes the deadline of 2
        [(2, 6, True), (5, 6, False)],
    ]
    seen = []
    for rows in batches:  # each run goes on from the checkpoint
        _poll(spark, tmp_path, "polls", rows)
        seen.append(_close(spark, tmp_path, tmp_path / "polls"))
    assert [pending for _, pending in seen] == [[1, 2], [2], [5], [5]]
    assert seen[0][0] == {(3, "settled", 0)} and seen[-1][0] == {(1, "settled", 1), (2, "pending_overdue", 3), (3, "settled", 0)}
    # At most two states are kept, and a run without new polls changes nothing.
    assert len(flows._versions(spark, str(tmp_path / "state"))) <= 2
    assert _close(spark, tmp_path, tmp_path / "polls") == seen[-1]
    # One batch of all polls gives the same.
    _poll(spark, tmp_path, "once", [row for rows in batches for row in rows])
    assert _close(spark, tmp_path / "other", tmp_path / "once") == seen[-1]


def test_a_batch_reads_only_the_buckets_of_its_keys(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    read = {}
    for batches in (1, 10):
        path = str(tmp_path / f"store{batches}")
        for b in range(batches):
            flows._store(rows.withColumn("k", F.col("k") + 1000 * b), f"{path}/batch={b}", "k", 64)
        touched = flows._touched(rows.filter("k = 7"), "k", 64)
        found = flows.stored(spark, path, rows.schema, batches, touched)
        assert len(touched) == 1 and found.filter("k = 7").count() == 1
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
        read[batches] = found.count() / (1000 * batches)
    assert all(share < 0.05 for share in read.values())
    assert flows.stored(spark, str(tmp_path / "none"), rows.schema, 1, [0]).count() == 0
