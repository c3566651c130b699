"""Times the headline queries. One JSON line: seconds per query, median of the runs after a warm-up.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores,
BENCH_RUNS the timed runs. Every timed query is one plan over the given tables, with no
stage table shared between queries, except those marked `staged`, which start from the
stage tables of a batch pipeline as their stage does.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.catalog.q_sources import page_lines
from assay.catalog.study import STUDY, Study
from assay.operators import calibrate, clusters, draw, features, frame, labels, metrics, settled, splits, survey
from assay.sources import pages
from assay.sources.session import local_session
from assay.sources.tables import ROSTER

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def platt(study: Study) -> DataFrame:
    rows = study.quality.withColumn("s", F.ln("score"))
    return study.spark.createDataFrame([(calibrate.fit_platt(rows, "s").a,)], "a double")


def main() -> None:
    spark = local_session(CPUS, partitions=max(int(CPUS) if CPUS.isdigit() else 8, 2))
    spark.sparkContext.setLogLevel("ERROR")
    shared = Study(spark, FOLDER)

    def fresh() -> Study:
        return Study(spark, FOLDER, STUDY, lazy=True)

    timed = {
        "flagship_composition": lambda: survey.band_histogram(fresh().banded, STUDY),
        "frame_extraction": lambda: fresh().frame,
        "label_lookup": lambda: fresh().nearest,
        "base_pull": lambda: fresh().labelled,
        "long_verdicts": lambda: fresh().long,
        "verdict_counts": lambda: frame.verdict_counts(fresh().verdicts, "instance_number"),
        "staged_run_draw": lambda: draw.stratified_draw(shared.base, STUDY)[0],
        "staged_change_totals": lambda: survey.change_totals(shared.long, STUDY.bands),
        "staged_labels": lambda: labels.label(shared.cohort, shared.long, STUDY),
        "staged_gap_and_coverage": lambda: survey.gap_and_coverage(shared.banded, STUDY),
        "staged_feature_matrix": lambda: features.build_matrix(shared.cohort, shared.long, ROSTER)[0],
        "staged_temporal_split": lambda: splits.temporal_split(shared.split_input.filter("trainable"), STUDY),
        "staged_era_funnel": lambda: settled.era_funnel(
            settled.settled_state(shared.labelled, shared.scored, STUDY), STUDY
        ),
        "sliced_auc": lambda: metrics.metrics_table(
            shared.quality, {"chars": shared.quality["score"]}, STUDY.skew
        ),
        "bootstrap_band": lambda: metrics.bootstrap_band(shared.quality, "prob", "key", 10, STUDY),
        "staged_engine_agreement": lambda: clusters.agreement(shared.long, ROSTER),
        "json_pages": lambda: pages.parse_pages(page_lines(fresh())),
        "platt_fit": lambda: platt(shared),
    }
    start = time.perf_counter()
    for stage in ("scored", "labelled", "long", "cohort", "labels", "split_input"):
        getattr(shared, stage)
    stages = time.perf_counter() - start

    seconds = {}
    for name, build in timed.items():
        drain(build())  # warm-up
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            drain(build())
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
    seconds["stages_cold"] = round(stages, 3)
    seconds["total_with_stages"] = round(sum(seconds.values()), 3)
    total = sum(v for k, v in seconds.items() if k not in ("stages_cold", "total_with_stages"))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(total, 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main()
