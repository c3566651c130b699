"""Engines that move together: pairwise agreement and the clusters it implies."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.small import small_table
from .features import MAX_ROSTER, on_roster

def pair_sums(long: DataFrame, roster: Sequence[str], *, strict: bool = True) -> DataFrame:
    """Sums over scans both engines answered definitely, for every pair that shares one.

    A scan carries the places of its engines on the roster. Each task multiplies flag vectors
    and yields one matrix over all its rows, so pairs are never emitted per scan: what is
    shuffled is one roster-squared table per task. Engines off the roster are refused, or left
    out if not `strict`.
    """
    n = len(roster)
    if n > MAX_ROSTER:
        raise ValueError(f"a roster of {n} engines is over {MAX_ROSTER}: its pair table must stay small")
    place = F.create_map(*[x for i, e in enumerate(roster) for x in (F.lit(e), F.lit(i))])
    known = on_roster(long, roster, strict).filter(F.col("verdict").isNotNull())
    each = known.select("instance_number", place[F.col("author")].alias("e"), F.col("verdict").alias("v"))
    rows = each.groupBy("instance_number").agg(
        F.collect_set("e").alias("answered"), F.collect_set(F.when(F.col("v"), F.col("e"))).alias("malicious")
    )
    left, right = np.triu_indices(n, k=1)

    def flags(lists: pd.Series) -> np.ndarray:
        out = np.zeros((len(lists), n))
        sizes = lists.map(len).to_numpy()
        if sizes.sum():
            out[np.repeat(np.arange(len(lists)), sizes), np.concatenate(lists.to_list()).astype(int)] = 1
        return out

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        product = np.zeros((2 * n, 2 * n))
        for batch in batches:
            if not batch.empty:
                x = np.hstack([flags(batch["answered"]), flags(batch["malicious"])])
                product += x.T @ x
        yield pd.DataFrame(
            {
                "i": left,
                "j": right,
                "n_both": product[left, right],
                "mal_i": product[n + left, right],
                "mal_j": product[n + right, left],
                "mal_both": product[n + left, n + right],
            }
        )

    partial = rows.select("answered", "malicious").mapInPandas(
        multiply, "i int, j int, n_both double, mal_i double, mal_j double, mal_both double"
    )
    names = F.array(*[F.lit(e) for e in roster])
    return (
        partial.groupBy("i", "j")
        .agg(*[F.sum(c).cast("bigint").alias(c) for c in ("n_both", "mal_i", "mal_j", "mal_both")])
        .filter(F.col("n_both") > 0)
        .select(
            F.get(names, F.col("i")).alias("engine_a"),
            F.get(names, F.col("j")).alias("engine_b"),
            "n_both",
            "mal_i",
            "mal_j",
            "mal_both",
        )
    )


def correlation() -> Column:
    """Correlation of two engines' verdicts over the scans both answered."""
    n, a, b, ab = (F.col(c).cast("double") for c in ("n_both", "mal_i", "mal_j", "mal_both"))
    spread = F.sqrt((n * a - a * a) * (n * b - b * b))
    return (n * ab - a * b) / F.nullif(spread, F.lit(0.0))


def agreement(long: DataFrame, roster: Sequence[str], *, strict: bool = True) -> DataFrame:
    return pair_sums(long, roster, strict=strict).withColumn("correlation", correlation())


def clusters(pairs: DataFrame, roster: Sequence[str], threshold: float) -> DataFrame:
    """(author, cluster): engines connected by pairs above the threshold.

    Clusters are named by their lowest engine; an engine without such a pair is its own. Pairs
    without a correlation connect nothing.
    """
    engines = small_table(pairs.sparkSession, [(e,) for e in roster], "node string")
    edges = pairs.filter(F.col("correlation") >= threshold).select(F.col("engine_a").alias("a"), F.col("engine_b").alias("b"))
    return components(engines, edges).select(F.col("node").alias("author"), F.col("component").alias("cluster"))


def clustered_counts(long: DataFrame, engine_clusters: DataFrame) -> DataFrame:
    """Malicious answers per artifact at the label scan: engines, and clusters of engines.

    `engine_clusters` has a row per engine of a checked roster.
    """
    return (
        long.filter((F.col("scan_role") == "label") & F.col("verdict"))
        .join(F.broadcast(engine_clusters), "author")
        .groupBy("sha256")
        .agg(F.count("*").alias("n_malicious"), F.count_distinct("cluster").alias("n_clusters"))
    )
