"""One study over the given tables: the stages that registered queries share.

A stage is a table written once per application to the shared folder, as the stages of a
batch pipeline are. With ``lazy=True`` nothing is written and a query is one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import draw, features, frame, labels, splits
from ..params import Bands, Params
from ..plans.stage import folder_state, stage_once
from ..sources import tables
from ..sources.tables import ROSTER

# Edges, floors and sizes that fill every band on the given tables.
STUDY = Params(
    bands=Bands(lower=0.25, upper=0.6, consensus=0.75, min_definite=2),
    cohort_size=500,
    control_size=200,
    horizon_days=30,
    horizon_max_days=365,
    label_min_definite=2,
    min_clusters=1.0,
    settled_min_definite=2,
)


@dataclass(frozen=True)
class Study:
    spark: SparkSession
    folder: str
    params: Params = STUDY
    lazy: bool = False

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if self.lazy:
            return build()
        return stage_once(self.spark, (folder_state(self.spark, self.folder), str(self.params)), name, build)

    def table(self, name: str) -> DataFrame:
        return tables.table(self.spark, self.folder, name)

    @cached_property
    def scans(self) -> DataFrame:
        return tables.scans(self.spark, self.folder)

    @cached_property
    def instances(self) -> DataFrame:
        return tables.instances(self.spark, self.folder)

    @cached_property
    def verdicts(self) -> DataFrame:
        return tables.verdicts(self.spark, self.folder)

    def verdicts_of(self, scans: DataFrame | None) -> DataFrame:
        """The verdicts of some scans (number), without grouping those of others; of all, if None."""
        return tables.verdicts(self.spark, self.folder, scans)

    @cached_property
    def orphans(self) -> DataFrame:
        return self.stage("orphans", lambda: tables.orphans(self.spark, self.folder))

    def answers(self, scans: DataFrame | None = None) -> DataFrame:
        """(instance_number, author, verdict) of all scans, or of some (number)."""
        if self.lazy:
            return tables.verdicts(self.spark, self.folder, scans).select("instance_number", "author", "verdict")
        return tables.answers(self.spark, self.folder, self.orphans, scans)

    def counts(self) -> DataFrame:
        """`frame.verdict_counts` of every scan that was answered."""
        if self.lazy:
            return frame.verdict_counts(self.answers(), "instance_number")
        return tables.counts(self.spark, self.folder, self.orphans)

    # Scans and first sightings are kept under the artifact's number: digests do not compress, and
    # are as long as the rest of a row. They are put back where a row leaves for other uses.

    @cached_property
    def numbered(self) -> DataFrame:
        scans = tables.scans(self.spark, self.folder, numbered=True)
        return self.stage("numbered", lambda: frame.counted_scans(scans, self.counts()))

    @cached_property
    def numbered_frame(self) -> DataFrame:
        return self.stage("frame", lambda: frame.first_seen(self.numbered, carry=frame.COUNTS, size=frame.N_SCANS))

    @cached_property
    def numbered_nearest(self) -> DataFrame:
        return frame.nearest_later(self.numbered_frame, self.numbered, self.params)

    @cached_property
    def scored(self) -> DataFrame:
        return tables.with_digest(self.numbered)

    @cached_property
    def frame(self) -> DataFrame:
        return tables.with_digest(self.numbered_frame.drop(frame.N_SCANS))

    @cached_property
    def nearest(self) -> DataFrame:
        return tables.with_digest(self.numbered_nearest)

    @cached_property
    def numbered_labelled(self) -> DataFrame:
        first = self.numbered_frame.drop(frame.N_SCANS)
        return self.stage("labelled", lambda: frame.labelled_frame(first, self.numbered_nearest))

    @cached_property
    def labelled(self) -> DataFrame:
        return tables.with_digest(self.numbered_labelled)

    @cached_property
    def base(self) -> DataFrame:
        return frame.base_snapshot(self.labelled)

    @cached_property
    def unlabellable(self) -> DataFrame:
        return self.labelled.filter(F.col("label_instance_number").isNull())

    @cached_property
    def long(self) -> DataFrame:
        return self.stage("long", lambda: self._long(self.base))

    @cached_property
    def cohort_long(self) -> DataFrame:
        """The cohort's rows of `long`, which need not be built for them."""
        return self.stage("cohort_long", lambda: self._long(self.cohort))

    def _long(self, base: DataFrame) -> DataFrame:
        rows = frame.roles(base)
        return frame.long_verdicts(rows, self.verdicts_of(rows.select(F.col("instance_number").alias("number"))))

    @cached_property
    def banded(self) -> DataFrame:
        return draw.with_band(self.base, self.params.bands)

    @cached_property
    def drawn(self) -> tuple[DataFrame, DataFrame]:
        return draw.stratified_draw(self.base, self.params)

    @property
    def cohort(self) -> DataFrame:
        return self.stage("cohort", lambda: self.drawn[0])

    @property
    def report(self) -> DataFrame:
        return self.drawn[1]

    @cached_property
    def labels(self) -> DataFrame:
        return self.stage("labels", lambda: labels.label(self.cohort, self.cohort_long, self.params))

    @cached_property
    def matrix(self) -> tuple[DataFrame, dict[str, list[str]]]:
        matrix, groups = features.build_matrix(self.cohort, self.cohort_long, ROSTER)
        return self.stage("matrix", lambda: matrix), groups

    @cached_property
    def first_verdicts(self) -> DataFrame:
        return self.long.filter(F.col("scan_role") == "feature")

    @cached_property
    def modelling(self) -> DataFrame:
        """Feature rows with their labels and group."""
        kept = self.labels.select("sha256", "label", "grade", "reason", "trainable", "horizon_days", "y")
        return splits.with_group(self.matrix[0].join(kept, "sha256"), "modal_family")

    @cached_property
    def split_input(self) -> DataFrame:
        """What a split needs, without the per-engine flags."""
        return self.stage("split_input", self._split_input)

    def _split_input(self) -> DataFrame:
        first = self.cohort_long.filter(F.col("scan_role") == "feature")
        modal = features.family_scalars(first).select("sha256", "modal_family")
        counts = self.cohort.select(
            "sha256",
            "incumbent_score",
            F.col("n_malicious").alias("t_malicious"),
            F.col("n_definite").alias("t_definite"),
        )
        rows = self.labels.join(counts, "sha256").join(modal, "sha256", "left")
        return splits.with_group(rows, "modal_family")

    @cached_property
    def folded(self) -> DataFrame:
        trainable = self.split_input.filter("trainable")
        return self.stage("folded", lambda: splits.temporal_split(trainable, self.params))

    @cached_property
    def split(self) -> DataFrame:
        return splits.horizon_gap(self.folded, self.params.horizon_days)

    @cached_property
    def quality(self) -> DataFrame:
        """Labelled documents as (key, y, score, prob, stratum, provenance, pi)."""
        docs = self.table("documents").select("doc_id", "lang", "source", "n_chars")
        joined = self.table("labels").join(docs, "doc_id")
        return joined.select(
            F.col("doc_id").alias("key"),
            F.col("quality").alias("y"),
            F.col("n_chars").cast("double").alias("score"),
            (F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))).alias("prob"),
            F.col("lang").alias("stratum"),
            F.when(F.col("source").isin("src0", "src1", "src2", "src3"), "feed").otherwise("customer").alias("provenance"),
            F.when(F.col("lang") == "en", 0.5).when(F.col("lang") == "fr", 0.25).otherwise(0.125).alias("pi"),
            "toxic",
        )
