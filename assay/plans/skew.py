"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Skew


def hot_keys(facts: DataFrame, keys: Sequence[str], skew: Skew) -> DataFrame:
    """The keys above `hot_rows`, with `_salts`, how many parts each is to be cut into.

    The count is pre-aggregated map-side, and the list is bounded, so it may be broadcast.
    """
    return hot_of(facts.groupBy(*keys).agg(F.count("*").alias("_rows")), keys, skew, rows="_rows")


def hot_of(sizes: DataFrame, keys: Sequence[str], skew: Skew, rows: str) -> DataFrame:
    """`hot_keys` of keys whose rows are counted already, in the column `rows`."""
    size = F.col(rows)
    return (
        sizes.filter(size > skew.hot_rows)
        .orderBy(size.desc(), *keys)
        .limit(skew.max_hot_keys)
        .select(*keys, F.greatest(F.lit(skew.salts), F.ceil(size / skew.hot_rows)).cast("int").alias("_salts"))
    )


def salted_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    *,
    spread_on: str,
    skew: Skew,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Inner join of many `facts` to one `lookup` row per key.

    Rows of a hot key get a salt from `spread_on`, and only that key's lookup row is copied
    once per salt. Every other key has salt 0 and is copied once.
    """
    keys = list(keys)
    marked = F.broadcast(hot_keys(facts, keys, skew) if hot is None else hot)
    parts = F.coalesce(F.col("_salts"), F.lit(1))
    tagged = facts.join(marked, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread_on), parts).cast("int"))
    copies = lookup.join(marked, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return tagged.drop("_salts").join(copies.drop("_salts"), [*keys, "_salt"]).drop("_salt")
