"""Queries over scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.families import clean_family, family_class, words
from ..functions.scalar import days_between, days_later, logit, safe_long, sigmoid
from ..operators import metrics
from ..plans.ordering import hash_key
from ..sources.pages import iso_moment
from .ctes import class_sql, logit_sql
from .registry import query
from .study import Study


@query("fn1_hash_key", "SELECT number, md5(sha256 || '20260922') AS key FROM scans")
def fn1(s: Study) -> DataFrame:
    return s.scans.select("number", hash_key("sha256", s.params.seed).alias("key"))


@query(
    "fn3_date_trunc",
    "SELECT date_trunc('year', completed)::TIMESTAMP AS yr, count(*) AS n FROM scans GROUP BY 1",
)
def fn3(s: Study) -> DataFrame:
    year = F.date_trunc("year", "completed").cast("timestamp_ntz")
    return s.scans.groupBy(year.alias("yr")).agg(F.count("*").alias("n"))


@query("fn4_interval_bounds", "SELECT number, completed + INTERVAL 30 DAY AS low, completed + INTERVAL 365 DAY AS high FROM scans")
def fn4(s: Study) -> DataFrame:
    moment = F.col("completed")
    return s.scans.select("number", days_later(moment, 30).alias("low"), days_later(moment, 365).alias("high"))


@query(
    "fn5_days_between",
    "SELECT event_id, date_diff('microsecond', TIMESTAMP '2024-01-01', date_trunc('second', ts)) / 86400000000.0 AS days FROM events",
    doubles="days",
)
def fn5(s: Study) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    second = F.date_trunc("second", "ts").cast("timestamp_ntz")
    return s.table("events").select("event_id", days_between(start, second).alias("days"))



@query(
    "fn6_clean_text",
    "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE lower(p_brand || ' ' || p_name) END AS cleaned FROM part",
)
def fn6(s: Study) -> DataFrame:
    text = F.concat(F.lit(" \t"), F.col("p_brand"), F.lit(" "), F.col("p_name"), F.lit("\n "))
    raw = F.when(F.col("p_partkey") % 9 != 0, text)
    return s.table("part").select("p_partkey", clean_family(raw).alias("cleaned"))


@query(
    "fn7_words",
    """SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_brand || '/' || p_name || '!' || p_type), '[a-z0-9]+'), ' ') AS words FROM part""",
)
def fn7(s: Study) -> DataFrame:
    text = F.concat("p_brand", F.lit("/"), "p_name", F.lit("!"), "p_type")
    return s.table("part").select("p_partkey", F.array_join(words(text), " ").alias("words"))


@query("fn8_family_class", f"SELECT instance_number, author, {class_sql('malware_family')} AS class FROM verdicts")
def fn8(s: Study) -> DataFrame:
    return s.verdicts.select("instance_number", "author", family_class(F.col("malware_family")).alias("class"))


@query(
    "fn9_logit_sigmoid",
    f"""SELECT number, {logit_sql('incumbent_score')} AS z, 1 / (1 + exp(-{logit_sql('incumbent_score')})) AS p,
      {logit_sql('(number % 2)::DOUBLE')} AS edge FROM scans""",
    doubles="z p edge",
)
def fn9(s: Study) -> DataFrame:
    z = logit(F.col("incumbent_score"))
    return s.scans.select("number", z.alias("z"), sigmoid(z).alias("p"), logit((F.col("number") % 2).cast("double")).alias("edge"))


@query(
    "fn11_iso_moment",
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 90 MINUTE ELSE ts + INTERVAL 300 MINUTE END AS moment FROM events",
)
def fn11(s: Study) -> DataFrame:
    third = F.col("event_id") % 3
    zone = F.when(third == 0, "Z").when(third == 1, "+01:30").otherwise("-0500")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), zone)
    return s.table("events").select("event_id", iso_moment(text).alias("moment"))


@query(
    "fn12_ceil_floor_round",
    """SELECT o_orderkey, ceil(o_totalprice * 0.15::DOUBLE)::BIGINT AS up, floor(o_totalprice / 0.15::DOUBLE)::BIGINT AS down,
      round(o_totalprice / 1000, 1) AS near FROM orders""",
    doubles="near",
)
def fn12(s: Study) -> DataFrame:
    price = F.col("o_totalprice")
    return s.table("orders").select(
        "o_orderkey", F.ceil(price * 0.15).alias("up"), F.floor(price / 0.15).alias("down"), F.round(price / 1000, 1).alias("near")
    )


@query(
    "fn13_safe_long",
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) END AS k FROM events",
)
def fn13(s: Study) -> DataFrame:
    text = F.when(F.col("event_id") % 4 == 0, F.lit("12x")).otherwise(F.get_json_object("props", "$.k"))
    return s.table("events").select("event_id", safe_long(text).alias("k"))


@query(
    "fn14_json_text",
    """SELECT event_id, json_extract_string(props, '$.k') AS k,
      '{"event_type":"' || event_type || '","k":"' || json_extract_string(props, '$.k') || '"}' AS canonical FROM events""",
)
def fn14(s: Study) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    pairs = F.create_map(F.lit("k"), k, F.lit("event_type"), F.col("event_type"))
    ordered = F.map_from_entries(F.array_sort(F.map_entries(pairs)))
    return s.table("events").select("event_id", k.alias("k"), F.to_json(ordered).alias("canonical"))


@query(
    "fn15_baseline_verdict",
    """SELECT stratum, CASE WHEN auc IS NULL THEN 'undefined' WHEN auc > 0.97 THEN 'stop' WHEN auc BETWEEN 0.85 AND 0.95 THEN 'healthy'
      WHEN abs(auc - 0.5) < 0.1 THEN 'disconnected' ELSE 'outside' END AS verdict FROM (
      SELECT stratum, sum(p * (cn - n / 2)) / nullif(sum(p) * sum(n), 0) AS auc FROM (
        SELECT stratum, count(*) FILTER (WHERE y = 1) AS p, (count(*) FILTER (WHERE y = 0))::DOUBLE AS n,
          sum(count(*) FILTER (WHERE y = 0)) OVER (PARTITION BY stratum ORDER BY score) AS cn FROM quality_ GROUP BY stratum, score) GROUP BY 1)""",
)
def fn15(s: Study) -> DataFrame:
    found = metrics.roc_auc(s.quality, "score", "y", s.params.skew, by=["stratum"])
    return found.select("stratum", metrics.baseline_verdict(F.col("auc_raw")).alias("verdict"))


@query(
    "fn16_arrays_to_rows",
    """SELECT instance_number, unnest(['n_definite', 'n_malicious', 'n_responded']) AS name, unnest([n_definite, n_malicious, n_responded]) AS n FROM counts""",
)
def fn16(s: Study) -> DataFrame:
    names = ("n_definite", "n_malicious", "n_responded")
    from ..operators.frame import verdict_counts

    counts = verdict_counts(s.verdicts, "instance_number")
    zipped = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("name"), F.array(*names).alias("n"))
    return counts.select("instance_number", F.explode(zipped).alias("z")).select(
        "instance_number", F.col("z.name").alias("name"), F.col("z.n").alias("n")
    )


@query(
    "fn17_null_and_clip",
    """SELECT number, coalesce(scan_config, 'none') AS config, nullif(scan_config, 'feed') AS not_feed,
      round(100.0::DOUBLE * n_malicious / nullif(n_definite, 0), 1) AS pct, least(greatest(incumbent_score, 0.2), 0.8) AS clipped FROM scored""",
    doubles="pct clipped",
)
def fn17(s: Study) -> DataFrame:
    share = F.lit(100.0) * F.col("n_malicious") / F.nullif(F.col("n_definite").cast("double"), F.lit(0.0))
    return s.scored.select(
        "number",
        F.coalesce("scan_config", F.lit("none")).alias("config"),
        F.nullif(F.col("scan_config"), F.lit("feed")).alias("not_feed"),
        F.round(share, 1).alias("pct"),
        F.least(F.greatest("incumbent_score", F.lit(0.2)), F.lit(0.8)).alias("clipped"),
    )


@query(
    "fn18_verdict_maps",
    """SELECT sha256, scan_role, count(*) AS size, count(*) FILTER (WHERE verdict IS NULL) AS unknown,
      bool_or(author = 'eng_00') AS has_first FROM long GROUP BY 1, 2""",
)
def fn18(s: Study) -> DataFrame:
    """Engine to verdict as a map; a NULL value is an answer, a missing key is not."""
    maps = s.long.groupBy("sha256", "scan_role").agg(
        F.map_from_entries(F.collect_list(F.struct("author", "verdict"))).alias("verdicts")
    )
    m = F.col("verdicts")
    unknown = F.filter(F.map_values(m), lambda v: v.isNull())
    return maps.select(
        "sha256",
        "scan_role",
        F.cardinality(m).cast("bigint").alias("size"),
        F.size(unknown).cast("bigint").alias("unknown"),
        F.map_contains_key(m, "eng_00").alias("has_first"),
    )
