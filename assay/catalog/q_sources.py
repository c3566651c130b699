"""Queries over sources and sinks. Each writes a table derived from the given ones and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import micros
from ..operators import frame, splits, survey
from ..schemas import require_exact_ids
from ..sources import pages, snapshots
from ..sources.session import new_path
from ..sources.tables import artifact_key
from .registry import query
from .study import Study

BASE_COLUMNS = ["sha256", "instance_number", "label_instance_number", "n_definite", "n_malicious", "n_responded", "provenance"]


def _base_at(s: Study) -> str:
    path = new_path(s.spark, "base")
    snapshots.write_snapshot(s.base.select(*BASE_COLUMNS, "gap_days"), path, stage="base", has_control=True)
    return path


@query(
    "src1_read_snapshot",
    "SELECT sha256, instance_number, label_instance_number, n_definite, n_malicious, n_responded, provenance FROM base",
)
def src1(s: Study) -> DataFrame:
    df, _ = snapshots.read_snapshot(s.spark, _base_at(s))
    return require_exact_ids(df, "instance_number", "label_instance_number").select(*BASE_COLUMNS)


@query("src2_write_snapshot", "SELECT 'base' AS stage, count(*) AS rows, 8 AS n_columns FROM base")
def src2(s: Study) -> DataFrame:
    path = _base_at(s)
    found = s.spark.read.text(path + snapshots.MANIFEST)
    return found.select(
        F.get_json_object("value", "$.stage").alias("stage"),
        F.get_json_object("value", "$.content.rows").cast("bigint").alias("rows"),
        F.json_array_length(F.get_json_object("value", "$.columns")).alias("n_columns"),
    )


def _row_text_sql(names: list[str]) -> str:
    value = "CAST({0} AS VARCHAR)"
    parts = [f"'{c}=' || coalesce(length({value.format(c)}) || ':' || {value.format(c)}, 'null')" for c in sorted(names)]
    return " || ';' || ".join(parts)


@query(
    "fpr1_fingerprint",
    f"""SELECT count(*) AS rows, CAST(coalesce(sum(h), 0) AS VARCHAR) AS hash_sum, coalesce(bit_xor(h), 0) AS hash_xor
      FROM (SELECT CAST('0x' || substr(md5({_row_text_sql(BASE_COLUMNS)}), 1, 15) AS BIGINT) AS h FROM base)""",
)
def fpr1(s: Study) -> DataFrame:
    return snapshots.fingerprint(s.base.select(*BASE_COLUMNS))


@query(
    "src4_load_run",
    """SELECT 'cohort' AS part, count(*) AS n FROM cohort UNION ALL SELECT 'base', count(*) FROM base
    UNION ALL SELECT 'long', count(*) FROM long UNION ALL SELECT 'control', least(count(*), 200) FROM unlabellable""",
)
def src4(s: Study) -> DataFrame:
    base_path, folder = _base_at(s), new_path(s.spark, "run")
    snapshots.write_snapshot(s.long, base_path + "_long", stage="long")
    control = frame.control_sample(s.unlabellable, s.params).select("sha256", "instance_number", "control_pi")
    snapshots.write_snapshot(control, base_path + "_control", stage="control")
    cohort = s.cohort.select(*BASE_COLUMNS, "stratum", "pi", "n_available", "n_draw")
    snapshots.write_run(cohort, folder, base_path)
    run = snapshots.load_run(s.spark, folder)
    parts = {"cohort": run.cohort, "base": run.base, "long": run.long, "control": run.control}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "src5_day_store",
    """SELECT number, sha256, created FROM instances
    WHERE created >= TIMESTAMP '1997-01-01' AND created < TIMESTAMP '1999-01-01'""",
)
def src5(s: Study) -> DataFrame:
    path = new_path(s.spark, "store")
    snapshots.write_periods(s.instances, path, grain="month")
    window = snapshots.read_window(s.spark, path, "1997-01-01", "1999-01-01", grain="month")
    return window.select("number", "sha256", "created")


def page_lines(s: Study) -> DataFrame:
    """Index documents as JSON: an artifact with its first and latest scan and verdict maps."""
    maps = s.verdicts.groupBy("instance_number").agg(
        # An artifact's scan has at most one row per engine.
        F.map_from_entries(F.collect_list(F.struct("author", F.struct("verdict", "malware_family")))).alias("assertions")
    )
    ordered = F.struct("completed", "number")
    blocks = s.scored.withColumn("block", F.struct("number", "completed", "n_definite", "n_malicious", "incumbent_score"))
    ends = blocks.groupBy("sha256").agg(F.min_by("block", ordered).alias("f"), F.max_by("block", ordered).alias("l"))

    def scan(block: str, verdict_map: str):
        b = F.col(block)
        return F.struct(
            b["number"].alias("artifact_instance_id"),
            F.concat(F.date_format(b["completed"], "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("created"),
            b["incumbent_score"].alias("score"),
            F.struct(
                b["n_malicious"].alias("malicious"),
                (b["n_definite"] - b["n_malicious"]).alias("benign"),
                b["n_definite"].alias("total"),
            ).alias("detections"),
            F.col(verdict_map).alias("assertions"),
        )

    first = maps.select(F.col("instance_number").alias("fi"), F.col("assertions").alias("fa"))
    latest = maps.select(F.col("instance_number").alias("li"), F.col("assertions").alias("la"))
    joined = ends.join(first, F.col("f.number") == F.col("fi")).join(latest, F.col("l.number") == F.col("li"))
    doc = F.struct(
        F.struct("sha256", (F.col("f.number") % 1000 * 1000).alias("size")).alias("artifact"),
        F.struct(
            F.lit("application/x-dosexec").alias("mimetype"),
            scan("f", "fa").alias("first_scan"),
            scan("l", "la").alias("latest_scan"),
        ).alias("scan"),
    )
    return joined.select(F.to_json(F.struct(F.array(doc).alias("result"))).alias("value"))


SLICE_SQL = """SELECT f.sha256, (f.instance_number % 1000 * 1000) AS size, 'application/x-dosexec' AS mimetype,
    f.instance_number AS first_instance, f.scoring_moment AS first_created, f.incumbent_score AS first_score, f.n_malicious AS first_malicious,
    f.n_definite - f.n_malicious AS first_benign, f.n_definite AS first_definite, f.n_responded AS first_responded,
    l.number AS latest_instance, l.completed AS latest_created, l.n_malicious AS latest_malicious,
    l.n_definite - l.n_malicious AS latest_benign, l.n_definite AS latest_definite, l.n_responded AS latest_responded
    FROM frame f JOIN (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY completed DESC, number DESC) AS rn FROM scored) l
      ON l.sha256 = f.sha256 AND l.rn = 1"""
SLICE_COLUMNS = ["sha256", "size", "mimetype"] + [
    f"first_{c}" for c in ("instance", "created", "score", "malicious", "benign", "definite", "responded")
] + [f"latest_{c}" for c in ("instance", "created", "malicious", "benign", "definite", "responded")]


def slice_of(s: Study) -> DataFrame:
    return pages.parse_pages(page_lines(s)).select(*SLICE_COLUMNS)


@query("src6_json_pages", SLICE_SQL, doubles="first_score")
def src6(s: Study) -> DataFrame:
    path = new_path(s.spark, "pages")
    page_lines(s).write.text(path)
    return pages.read_pages(s.spark, path).select(*SLICE_COLUMNS)


@query(
    "src7_last_record",
    """SELECT user_id, event_id, event_type, k FROM (SELECT user_id, event_id, event_type,
      CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def src7(s: Study) -> DataFrame:
    path = new_path(s.spark, "log")
    events = s.table("events")
    lines = events.select(
        "user_id", "event_id", "event_type", micros(F.col("ts")).alias("submitted_at"), F.get_json_object("props", "$.k").cast("bigint").alias("k")
    )
    lines.write.json(path)
    log = s.spark.read.schema("user_id bigint, event_id bigint, event_type string, submitted_at bigint, k bigint").json(path)
    return pages.last_record(log, "user_id", ["submitted_at", "event_id"]).select("user_id", "event_id", "event_type", "k")


def render_lines(s: Study, only: DataFrame | None = None) -> DataFrame:
    """Full renders as JSON: a scan with its nested verdict list (at most one per engine). With
    `only` (number), of those scans."""
    scans = s.scans if only is None else s.scans.join(only, "number", "left_semi")
    entry = F.struct(
        "author",
        F.concat(F.lit("name of "), F.col("author")).alias("author_name"),
        "verdict",
        F.when(F.col("author") == "eng_03", F.lit("n/a")).otherwise(F.col("bid").cast("string")).alias("bid"),
        F.lit(True).alias("mask"),
        F.struct("malware_family", F.struct(F.lit("1.0").alias("version")).alias("scanner")).alias("metadata"),
    )
    nested = s.verdicts_of(only).groupBy("instance_number").agg(F.collect_list(entry).alias("assertions"))
    joined = scans.join(nested, F.col("number") == F.col("instance_number"), "left")
    return joined.select(
        F.to_json(
            F.struct(
                F.col("number").cast("string").alias("id"),
                F.concat(F.date_format("completed", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("created"),
                "state",
                (F.col("state") != "P").alias("window_closed"),
                (F.col("number") % 31 == 0).alias("failed"),
                F.when(F.col("number") % 37 == 0, True).alias("missing"),
                F.col("incumbent_score").alias("score"),
                "assertions",
            )
        ).alias("value")
    )


@query(
    "src8_explode_renders",
    """SELECT instance_number, author, concat('name of ', author) AS author_name, verdict,
      CASE WHEN author = 'eng_03' THEN 0 ELSE bid END AS bid, true AS mask, malware_family, '1.0' AS scanner_version
      FROM verdicts v JOIN orders ON o_orderkey = v.instance_number""",
)
def src8(s: Study) -> DataFrame:
    return pages.explode_renders(pages.parse_renders(render_lines(s)))


def key_file(s: Study) -> str:
    path = new_path(s.spark, "keys")
    listed = s.table("customer").filter(F.col("c_custkey") % 3 != 0)
    key = artifact_key(F.col("c_custkey"))
    padded = listed.select(F.explode(F.array(F.concat(F.lit("  "), key, F.lit("\t")), key, F.lit("   "))).alias("value"))
    padded.write.text(path)
    return path


@query("src9_key_list", "SELECT sha256(CAST(c_custkey AS varchar)) AS sha256 FROM customer WHERE c_custkey % 3 <> 0")
def src9(s: Study) -> DataFrame:
    return pages.key_list(s.spark, key_file(s))


@query(
    "src10_static_block",
    """SELECT b.sha256, b.scoring_moment, c.c_nationkey AS n_sections, c.c_acctbal AS entropy
    FROM base b LEFT JOIN customer c ON sha256(CAST(c.c_custkey AS varchar)) = b.sha256 AND c.c_custkey % 2 = 0""",
)
def src10(s: Study) -> DataFrame:
    path = new_path(s.spark, "static")
    s.table("customer").filter(F.col("c_custkey") % 2 == 0).select(
        artifact_key(F.col("c_custkey")).alias("sha256"),
        F.col("c_nationkey").alias("n_sections"),
        F.col("c_acctbal").alias("entropy"),
        F.lit("1990-01-01 00:00:00").cast("timestamp_ntz").alias("pe_as_of"),
    ).write.parquet(path)
    from ..operators.features import merge_static

    merged = merge_static(s.base, s.spark.read.parquet(path))
    return merged.select("sha256", "scoring_moment", "n_sections", "entropy")


@query(
    "src11_fold_files",
    """SELECT 'grouped' AS variant, fold, count(*) AS n FROM kept GROUP BY ALL
    UNION ALL SELECT 'random', CASE WHEN pos <= round_even(0.6 * t, 0) THEN 'train'
      WHEN pos <= round_even(0.6 * t, 0) + round_even(0.15 * t, 0) THEN 'validate' ELSE 'test' END, count(*)
      FROM (SELECT row_number() OVER (ORDER BY md5('split:' || sha256 || '20260922'), sha256) AS pos, count(*) OVER () AS t FROM kept)
      GROUP BY ALL""",
    kept="SELECT * FROM split_ WHERE NOT in_gap",
)
def src11(s: Study) -> DataFrame:
    path = new_path(s.spark, "folds")
    kept = s.split.filter(~F.col("in_gap")).select("sha256", "y", "pi", "fold", "in_gap")
    snapshots.write_folds(splits.random_split(kept, s.params), path)
    return s.spark.read.parquet(path).groupBy("variant", "fold").agg(F.count("*").alias("n"))


@query(
    "src12_report_sink",
    """SELECT t.stratum, coalesce(b.n, 0) AS n, t.target_share FROM targets t
    LEFT JOIN (SELECT stratum, count(*) AS n FROM banded GROUP BY 1) b USING (stratum)""",
    doubles="target_share",
)
def src12(s: Study) -> DataFrame:
    path = new_path(s.spark, "report")
    snapshots.write_report(survey.band_histogram(s.banded, s.params), path)
    return s.spark.read.schema("stratum string, n bigint, target_share double").json(path)
