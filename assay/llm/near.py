"""Near copies by both methods: SimHash fingerprints and MinHash sets, as one set of links.

Fingerprints find texts of nearly the same weighted shingles, sets find those that share most
distinct ones. Neither covers the other, so classes of both are joined wherever they share a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stage import staged
from . import minhash, simhash
from .components import components


def _key(id_col: str, text_col: str) -> Column:
    """An id may stand on several texts, so rows go by a digest of both."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def linked(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, key, root): one row per row with an id. `root` is the least digest reachable over the
    links of `simhash.near_duplicates` and of `minhash.near_copies`, which takes `options`."""
    rows = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), _key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text")
    )
    found = simhash.near_duplicates(rows, id_col="key").select("doc_id", "component_id")
    sets = minhash.near_copies(rows, id_col="key", empty_alike=True, **options).select("doc_id", "component_id")
    links = found.unionByName(sets).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    named = rows.select("doc_id", "key").join(components(links).withColumnRenamed("node", "key"), "key", "left")
    return named.select("doc_id", "key", F.coalesce("root", "key").alias("root"))


def drop_linked(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one row of each component of `linked`, of the smallest id. Rows with a null id
    stay: nothing else names them."""
    found = linked(docs, id_col=id_col, text_col=text_col, **options).groupBy("root", "doc_id", "key").agg(F.count("*").alias("n"))
    kept = staged(found.groupBy("root").agg(F.min(F.struct("doc_id", "key", "n")).alias("k")).select("k.key", "k.n"), "near_kept")
    named = docs.filter(F.col(id_col).isNotNull())
    # A shuffle join at any size, as in `simhash.keep_least`.
    out = named.join(kept.hint("merge"), _key(id_col, text_col) == kept["key"], "left_semi")
    if not kept.filter("n > 1").isEmpty():
        out = out.dropDuplicates([id_col, text_col])
    return out.unionByName(docs.filter(F.col(id_col).isNull()))
