"""Queries over the incremental forms; each drains its stream and reads what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import new_path
from ..sources.tables import table
from ..streaming import flows
from .ctes import logit_sql
from .registry import query
from .study import Study


def _events(s: Study) -> DataFrame:
    schema = table(s.spark, s.folder, "events").schema
    return flows.file_stream(s.spark, s.folder, schema, "events.parquet")


@query(
    "str1_resumable_ingest",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1",
)
def str1(s: Study) -> DataFrame:
    out, state = new_path(s.spark, "ingest"), new_path(s.spark, "state")
    for _ in range(2):  # a second run finds no new file and adds nothing
        flows.ingest_stream(_events(s), out, state, "ts").awaitTermination()
    landed = s.spark.read.parquet(out).withColumn("day", F.col("day").cast("string"))
    return landed.groupBy("day").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


_P = "((c_custkey % 89 + 1) / 100.0::DOUBLE)"


@query(
    "str2_late_rescore",
    f"""SELECT signal_id, user_id, type, first_score, 1 / (1 + exp(-({logit_sql("first_score")} + evidence))) AS combined_score
      FROM (SELECT event_id AS signal_id, user_id, event_type AS type, {_P} AS first_score, ts,
          sum(CASE event_type WHEN 'error' THEN 1.84 WHEN 'purchase' THEN -0.7 ELSE 0 END::DOUBLE)
            OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS evidence
        FROM events JOIN customer ON c_custkey = user_id)
      WHERE ts > TIMESTAMP '2024-01-10'""",
    doubles="first_score combined_score",
)
def str2(s: Study) -> DataFrame:
    signals = _events(s).select(
        F.col("event_id").alias("signal_id"), "user_id", F.col("event_type").alias("type"), F.col("ts").alias("observed_at")
    )
    replayed = signals.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    scores = s.table("customer").select(
        F.col("c_custkey").alias("user_id"),
        ((F.col("c_custkey") % 89 + 1) / F.lit(100.0)).alias("probability"),
        F.lit("2024-01-10 00:00:00").cast("timestamp_ntz").cast("timestamp").alias("scoring_moment"),
    )
    out, store, state = (new_path(s.spark, n) for n in ("rescore", "signals", "state"))
    flows.rescore_stream(
        replayed, scores, {"error": 1.84, "purchase": -0.7}, key="user_id", store=store, out=out, checkpoint=state
    ).awaitTermination()
    return s.spark.read.parquet(out).select("signal_id", "user_id", "type", "first_score", "combined_score")


@query(
    "str3_settle_pending",
    """SELECT user_id, event_id, state FROM (SELECT user_id, event_id, CASE WHEN value > 20 THEN 'labelled' ELSE 'pending' END AS state,
      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def str3(s: Study) -> DataFrame:
    polls = _events(s).select(
        "user_id", "event_id", "ts", F.when(F.col("value") > 20, "labelled").otherwise("pending").alias("state")
    )
    out, state = new_path(s.spark, "settle"), new_path(s.spark, "state")
    flows.settle_stream(polls, "user_id", ["ts", "event_id"], out, state).awaitTermination()
    return flows.settled_view(s.spark, out, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "state")


@query(
    "str3_close_overdue",
    """SELECT user_id, state, opened_at, CASE state WHEN 'settled' THEN met ELSE opened_at + INTERVAL 5 DAY END AS closed_at FROM (
      SELECT *, CASE WHEN met <= opened_at + INTERVAL 5 DAY THEN 'settled'
          WHEN clock > opened_at + INTERVAL 5 DAY THEN 'pending_overdue' END AS state
      FROM (SELECT user_id, min(ts) AS opened_at, min(ts) FILTER (WHERE value > 40) AS met, (SELECT max(ts) FROM events) AS clock
        FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id)) WHERE state IS NOT NULL""",
)
def str3_overdue(s: Study) -> DataFrame:
    out, state, checkpoint = (new_path(s.spark, n) for n in ("closed", "pending", "state"))
    flows.close_pending_stream(
        _events(s), key="user_id", moment="ts", closed=F.col("value") > 40, overdue_days=5, state=state, out=out, checkpoint=checkpoint
    ).awaitTermination()
    return s.spark.read.parquet(out).select("user_id", "state", "opened_at", "closed_at")
