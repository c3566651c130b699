"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import staged


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node reachable.

    Each round hangs the larger neighbours of a node on its smallest one, then the smaller
    ones. Neighbours are never gathered: a round is minima and joins, and ends in a table.
    """
    edges = staged(
        links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct(),
        "edges",
    )
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
                edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
            )
        seen = mark
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.first("hi")).alias("m"))
        large = (
            both.filter("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(
            F.inline(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo"))))
        )
        edges = staged(small.filter("hi > lo").distinct(), "edges")
