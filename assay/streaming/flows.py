"""Incremental forms: resumable ingest, late-evidence rescoring, and settling of pending rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..functions.scalar import logit, sigmoid
from ..params import Skew
from ..plans.ordering import prefix_sums, range_bucket
from ..sources.pages import last_record


def file_stream(
    spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    """New Parquet files of a folder, a bounded number per batch."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def ingest_stream(source: DataFrame, out: str, checkpoint: str, moment: str) -> StreamingQuery:
    """Lands a stream as day partitions; after a stop it goes on with the next file."""
    return (
        source.withColumn("day", F.date_format(moment, "yyyy-MM-dd"))
        .writeStream.format("parquet")
        .partitionBy("day")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _touched(rows: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets of these rows' keys, at most `buckets` numbers."""
    return [r[0] for r in rows.select(_bucket(key, buckets)).distinct().collect()]


def _store(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """Rows as one partition per bucket of the key; a retry replaces all of them."""
    keyed = rows.withColumn("bucket", _bucket(key, buckets)).repartition("bucket")
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(path)


def stored(spark: SparkSession, path: str, schema: StructType, before: int, touched: list[int]) -> DataFrame:
    """Rows of a store's batches before this one, of these buckets alone: the others are not
    read. None if there is no store yet."""
    known = StructType([*schema.fields, StructField("batch", LongType()), StructField("bucket", IntegerType())])
    try:
        found = spark.read.schema(known).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return found.filter((F.col("batch") < before) & F.col("bucket").isin(touched)).select(*schema.names)


def rescore_stream(
    signals: DataFrame,
    scores: DataFrame,
    weights: Mapping[str, float],
    *,
    key: str,
    store: str,
    out: str,
    checkpoint: str,
    skew: Skew | None = None,
    buckets: int = 64,
) -> StreamingQuery:
    """A second observation per late signal; the first one is never edited.

    `signals` has (signal_id, key, type, observed_at); `scores` (key, scoring_moment,
    probability). Only the combination is redone, never the model: the log-odds of the first
    score plus the weights of all evidence known of the key up to the signal's moment.

    Evidence of any age counts. Signals are kept in `store`, partitioned by batch and by bucket
    of the key, and a batch reads only the buckets of its own keys. A repeated signal, which
    has the key it had, is one that the store has; there is no watermark that could lose one.
    A batch that is retried replaces its own partitions.
    """
    cut = skew or Skew()
    weight: Column = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col("type") == name, F.lit(float(w))).otherwise(weight)

    def rescore(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        named = batch.select("signal_id", key, "type", F.col("observed_at").cast("timestamp").alias("observed_at"))
        earlier = stored(spark, store, named.schema, batch_id, _touched(named, key, buckets))
        own = f"{store}/batch={batch_id}"
        _store(named.dropDuplicates(["signal_id"]).join(earlier, "signal_id", "left_anti"), own, key, buckets)
        fresh = spark.read.schema(named.schema).parquet(own).select(*named.columns)
        late = fresh.join(scores, key).filter(F.col("observed_at") > F.col("scoring_moment"))
        known = earlier.unionByName(fresh).join(late.select(key).distinct(), key, "left_semi")
        # Equal moments first become one row; a key of many signals is cut by time.
        moments = known.groupBy(key, "observed_at").agg(F.sum(weight).alias("w"))
        evidence = prefix_sums(
            range_bucket(moments, "observed_at", cut.buckets), by=[key], order=["observed_at"], sums={"evidence": "w"}
        )
        late.join(evidence.select(key, "observed_at", "evidence"), [key, "observed_at"]).select(
            "signal_id",
            key,
            "type",
            F.col("observed_at").alias("scored_at"),
            F.col("probability").alias("first_score"),
            sigmoid(logit(F.col("probability")) + F.col("evidence")).alias("combined_score"),
        ).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        signals.writeStream.foreachBatch(rescore)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def settle_stream(polls: DataFrame, key: str, order: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Keeps the last state per key of each batch, one partition per batch.

    A batch that is retried replaces its own partition, so a lost run leaves no repeats.
    """

    def keep_last(batch: DataFrame, batch_id: int) -> None:
        last_record(batch, key, order).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        polls.writeStream.foreachBatch(keep_last)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def settled_view(spark: SparkSession, out: str, key: str, order: list[str]) -> DataFrame:
    """The last state of every key over all batches so far."""
    return last_record(spark.read.parquet(out).drop("batch"), key, order)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The batches whose state was written to its end, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.listStatus(folder) if files.exists(folder) else []
    names = [f.getPath().getName() for f in found]
    whole = [n for n in names if n.startswith("batch=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("batch=")) for n in whole)


def close_pending_stream(
    polls: DataFrame,
    *,
    key: str,
    moment: str,
    closed: Column,
    overdue_days: int,
    state: str,
    out: str,
    checkpoint: str,
    buckets: int = 64,
) -> StreamingQuery:
    """Settles every key once: (key, state, opened_at, closed_at) in `out`.

    A key opens with its first poll. Its first poll that meets `closed` settles it, if that is
    within `overdue_days`; once the stream's clock, the latest moment seen, has passed that
    deadline, the key is closed as `pending_overdue`. The kept state is (key, opened_at) of the
    keys that are still pending, written anew by every batch; settled keys leave it, and later
    polls of theirs are dropped, for which only their buckets of `out` are read. Where polls come
    in order of their moments, the result does not depend on how batches are cut. Polls without
    key or moment are dropped. A batch that is retried starts from the state before it.
    """
    one_day = F.make_dt_interval(F.lit(1))
    polled = polls.withColumns({"_closed": closed, "_moment": F.col(moment)}).select(key, "_moment", "_closed")
    types = polled.schema
    kept = StructType([types[key], StructField("opened_at", types["_moment"].dataType), StructField("clock", types["_moment"].dataType)])
    emitted = StructType([types[key], StructField("state", StringType()), *(StructField(n, types["_moment"].dataType) for n in ("opened_at", "closed_at"))])

    def settle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.filter(F.col(key).isNotNull() & F.col("_moment").isNotNull())
        known = stored(spark, out, emitted, batch_id, _touched(rows, key, buckets)).select(key)
        earlier = [v for v in _versions(spark, state) if v < batch_id]
        before = spark.read.schema(kept).parquet(f"{state}/batch={earlier[-1]}") if earlier else spark.createDataFrame([], kept)
        clocks = rows.agg(F.max("_moment").alias("c")).unionByName(before.agg(F.max("clock").alias("c")))
        clock = clocks.agg(F.max("c").alias("clock"))  # one row
        fresh = rows.join(known, key, "left_anti").select(key, F.col("_moment").alias("opened_at"), F.when(F.col("_closed"), F.col("_moment")).alias("met"))
        pending = before.select(key, "opened_at", F.lit(None).cast(types["_moment"].dataType).alias("met"))
        each = pending.unionByName(fresh).groupBy(key).agg(F.min("opened_at").alias("opened_at"), F.min("met").alias("met"))
        deadline = F.col("opened_at") + one_day * overdue_days
        each = each.withColumns({"clock": clock.scalar(), "deadline": deadline})
        ending = F.when(F.col("met") <= F.col("deadline"), "settled").when(F.col("clock") > F.col("deadline"), "pending_overdue")
        each = each.withColumn("state", ending).persist()
        at = F.when(F.col("state") == "settled", F.col("met")).otherwise(F.col("deadline"))
        ended = each.filter("state IS NOT NULL").select(key, "state", "opened_at", at.alias("closed_at"))
        _store(ended, f"{out}/batch={batch_id}", key, buckets)
        each.filter("state IS NULL").select(key, "opened_at", "clock").write.mode("overwrite").parquet(f"{state}/batch={batch_id}")
        each.unpersist()
        for old in earlier[:-1]:  # the last one is what a retry of this batch would start from
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/batch={old}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return (
        polled.writeStream.foreachBatch(settle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def pending_view(spark: SparkSession, state: str) -> DataFrame:
    """(key, opened_at, clock) of the keys still pending after the last whole batch."""
    return spark.read.parquet(f"{state}/batch={_versions(spark, state)[-1]}")
