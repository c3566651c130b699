"""Connected components of an edge table, as joins and aggregates over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import staged


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each of `nodes` (node) is connected with by `edges` (a, b).

    Every round a node takes the least label among its own, its neighbours' and its label's
    label, so labels travel twice as far each time and rounds are few. Rounds are written
    tables; only the number of changes reaches the driver. Edges of nodes that are null or not
    among `nodes`, loops and repeats change nothing.
    """
    known = nodes.select("node").filter("node IS NOT NULL").distinct()
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = both.filter("a <> b").distinct()
    for end in ("a", "b"):
        both = both.join(known.withColumnRenamed("node", end), end, "left_semi")
    both = staged(both, "edges")
    labels = staged(known.withColumn("label", F.col("node")), "components")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        # A label's own label; labels are nodes, so each row finds one.
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = labels.join(jump, "label").join(seen, "node", "left")
        new = new.select("node", F.least("further", "near").alias("label"), (F.least("further", "near") < F.col("label")).alias("changed"))
        new = staged(new, "components")
        labels = new.select("node", "label")
        if new.filter("changed").isEmpty():
            return labels.withColumnRenamed("label", "component")
