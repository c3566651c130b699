"""Exact token-length histograms: one pass answers totals, quantiles and truncations.

Documents are aggregated by encoded length. Over the histogram, suffix sums give for every
context limit how many documents exceed it and what truncating at it keeps.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import staged
from .tables import mapped, portions
from .tokens import encoder, vocabulary

#: Lengths that one window orders; the sums over ranges of this width are few.
RANGE = 1024


def histogram(docs: DataFrame, *, text_col: str = "text", path: str | None = None) -> DataFrame:
    """(length, n_docs): how many rows of `docs` encode to each length.

    A null or empty text has length zero. A task sends one row per length it met.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, found = encoder(path), Counter()
        for batch in portions(batches, "text"):
            found.update(len(encode(t)) if t else 0 for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["length", "n_docs"])

    rows = mapped(docs.select(F.col(text_col).cast("string").alias("text")), run, "length long, n_docs long")
    return rows.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def with_suffix_sums(counts: DataFrame, width: int = RANGE) -> DataFrame:
    """`counts` with sums over all documents of at least this length and, at the length as a
    context limit, what truncation keeps.

    Columns: length, n_docs, n_tokens, docs_from and tokens_from (this length and up),
    docs_over (longer), kept_tokens (total if cut here), share_upto (of documents this long at
    most: a quantile is the first length whose share reaches it).
    """
    # A row per length: written, so that the texts are encoded once however often it is read.
    counts = staged(counts, "lengths")
    rows = counts.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"))
    rows = rows.withColumn("_range", F.floor(F.col("length") / width))
    later = Window.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    zero = F.lit(0).cast("long")
    # One row per range of lengths: the longest document over `width` rows.
    ranges = rows.groupBy("_range").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    ranges = ranges.select(
        "_range",
        F.coalesce(F.sum("d").over(later), zero).alias("later_docs"),
        F.coalesce(F.sum("t").over(later), zero).alias("later_tokens"),
        F.sum("d").over(all_rows).alias("docs"),
        F.sum("t").over(all_rows).alias("tokens"),
    )
    inside = Window.partitionBy("_range").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    docs_from = F.col("later_docs") + F.sum("n_docs").over(inside)
    tokens_from = F.col("later_tokens") + F.sum("n_tokens").over(inside)
    out = rows.join(ranges, "_range").select(
        "length", "n_docs", "n_tokens", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"), "docs", "tokens"
    )
    over = F.col("docs_from") - F.col("n_docs")
    return out.select(
        "length",
        "n_docs",
        "n_tokens",
        "docs_from",
        "tokens_from",
        over.alias("docs_over"),
        (F.col("tokens") - F.col("tokens_from") + F.col("docs_from") * F.col("length")).alias("kept_tokens"),
        ((F.col("docs") - over) / F.col("docs")).alias("share_upto"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_over, kept_tokens) for any limits, met as lengths or not."""
    tests = F.array(*[F.lit(int(x)).cast("long") for x in limits])
    limit = F.col("limit")
    return (
        sums.select(F.explode(tests).alias("limit"), "length", "n_docs", "n_tokens")
        .groupBy("limit")
        .agg(
            F.sum(F.when(F.col("length") > limit, F.col("n_docs")).otherwise(0)).alias("docs_over"),
            F.sum(F.when(F.col("length") > limit, F.col("n_docs") * limit).otherwise(F.col("n_tokens"))).alias("kept_tokens"),
        )
    )


def quantiles(sums: DataFrame, shares: dict[str, float]) -> DataFrame:
    """One row: for each name the least length that this share of documents does not exceed."""
    return sums.agg(*[F.min(F.when(F.col("share_upto") >= q, F.col("length"))).alias(n) for n, q in shares.items()])
