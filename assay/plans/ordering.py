"""Ranks, running sums and exact quantiles without a single-task sort.

A window ordered over a whole table, or over a handful of groups, sends each group to one
task. Here the order is cut into buckets first: totals per (group, bucket) are a small
aggregate whose running sum gives every bucket its offset, and the window only runs inside
one (group, bucket). The result is exact; the buckets only decide where work happens.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"
#: Most (group, bucket) rows that are broadcast, some 100 bytes each.
MAX_OFFSETS = 1_000_000


def hash_key(key: str | Column, seed: int | str, prefix: str = "") -> Column:
    """md5 of key and seed: an order that depends on nothing but the row and the seed."""
    parts = [F.lit(prefix)] if prefix else []
    return F.md5(F.concat(*parts, F.col(key) if isinstance(key, str) else key, F.lit(str(seed))))


def hash_uniform(hexed: Column) -> Column:
    """The first 32 bits of a hex digest as a double in [0, 1)."""
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))


def hash_bucket(df: DataFrame, hexed: str, digits: int) -> DataFrame:
    """Bucket by leading hex digits: in order of the digest, and even by construction."""
    return df.withColumn(BUCKET, F.conv(F.substring(hexed, 1, digits), 16, 10).cast("int"))


def range_bucket(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """Bucket by approximate quantiles of `value`, in its order.

    The edges are one array read as a scalar subquery; a binary search places each row.
    Only the balance depends on the approximation. `buckets` must be a power of two.
    """
    if buckets & (buckets - 1):
        raise ValueError(f"buckets must be a power of two, got {buckets}")
    if buckets == 1:
        return df.withColumn(BUCKET, F.lit(0))
    shares = [i / buckets for i in range(1, buckets)]
    edges = df.select(
        F.percentile_approx(F.col(value).cast("double"), shares, 100 * buckets).alias("edges")
    )
    steps = F.array(*[F.lit(2**i) for i in reversed(range(buckets.bit_length() - 1))])
    placed = df.withColumn("_edges", edges.scalar()).withColumn(
        BUCKET,
        F.aggregate(
            steps,
            F.lit(0),
            lambda low, step: F.when(
                F.col(value).cast("double") >= F.get(F.col("_edges"), low + step - 1), low + step
            ).otherwise(low),
        ),
    )
    return placed.drop("_edges")


def _few(offsets: DataFrame) -> DataFrame:
    """`offsets` as they are, failing if there are too many to broadcast."""
    n = F.count("*").over(Window.partitionBy())
    over = F.when(F.col("_all") > MAX_OFFSETS, F.raise_error(F.lit("too many groups for few_groups")).cast("boolean"))
    return offsets.withColumn("_all", n).filter(over.otherwise(True)).drop("_all")


def prefix_sums(
    df: DataFrame,
    *,
    by: Sequence[str],
    order: Sequence[str | Column],
    sums: Mapping[str, str | Column],
    wholes: Mapping[str, str] | None = None,
    keep: Column | None = None,
    few_groups: bool = False,
    descending_buckets: bool = False,
    late: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Running sums (inclusive) of `sums` within `by`, in `order`; needs a bucket column.

    Rows must come bucketed by `hash_bucket` or `range_bucket` on the leading order column.
    `wholes` names extra columns for the group's whole sum: {output: name in sums}.

    `keep` drops whole buckets before any row is shuffled. It may read, per sum, the columns
    `_o_<sum>` (total before the bucket), `_t_<sum>` (total in it) and those of `wholes`.
    With `few_groups`, groups are a small fixed domain (bands, slices): offsets are then at
    most groups times buckets rows and are broadcast, so dropped rows never leave their task.
    More than MAX_OFFSETS of them are refused; without `few_groups` any number will do.

    `late` makes columns that `order` reads where the rows have arrived, so that long ones are not
    moved. Every row is then moved, so `keep` is refused.
    """
    if late and keep is not None:
        raise ValueError("rows that are moved first cannot be dropped before")
    by = list(by)
    wholes = dict(wholes or {})
    values = {name: F.col(v) if isinstance(v, str) else v for name, v in sums.items()}
    totals = df.groupBy(*by, BUCKET).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    along = F.col(BUCKET).desc() if descending_buckets else F.col(BUCKET).asc()
    earlier = Window.partitionBy(*by).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        BUCKET,
        *[f"_t_{n}" for n in values],
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in values],
        *[F.sum(f"_t_{n}").over(Window.partitionBy(*by)).alias(w) for w, n in wholes.items()],
    )
    rows = df.repartition(*by, BUCKET).withColumns(dict(late)) if late else df
    placed = rows.join(F.broadcast(_few(offsets)) if few_groups else offsets, by + [BUCKET])
    if keep is not None:
        placed = placed.filter(keep)
    inside = (
        Window.partitionBy(*by, BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return placed.select(
        *[c for c in df.columns if c != BUCKET],
        *[(F.col(f"_o_{n}") + F.sum(v).over(inside)).alias(n) for n, v in values.items()],
        *wholes,
    )


def running_by_value(
    df: DataFrame,
    *,
    value: str,
    hexed: str,
    tie: str,
    sums: Mapping[str, str | Column],
    buckets: int,
    digits: int,
) -> DataFrame:
    """Running sums over a whole table in order of (value, digest, tie).

    Rows sharing one value may be any share of the table, so they are cut by digest as well:
    totals per (value, digest bucket) are summed first, and each such cell is ordered alone.
    """
    values = {name: F.col(v) if isinstance(v, str) else v for name, v in sums.items()}
    cells = hash_bucket(df, hexed, digits).withColumnRenamed(BUCKET, "_cell")
    totals = cells.groupBy(value, "_cell").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    running = prefix_sums(
        range_bucket(totals, value, buckets),
        by=[],
        order=[value, "_cell"],
        sums={f"_r_{n}": f"_t_{n}" for n in values},
        wholes={f"{n}_whole": f"_r_{n}" for n in values},
    )
    inside = (
        Window.partitionBy(value, "_cell")
        .orderBy(hexed, tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = cells.select("*", *[F.sum(v).over(inside).alias(f"_l_{n}") for n, v in values.items()])
    return local.join(running, [value, "_cell"]).select(
        *df.columns,
        *[(F.col(f"_r_{n}") - F.col(f"_t_{n}") + F.col(f"_l_{n}")).alias(n) for n in values],
        *[f"{n}_whole" for n in values],
    )


def hash_position(
    df: DataFrame, *, by: Sequence[str], hexed: str, tie: str, digits: int, out: str = "position"
) -> DataFrame:
    """1-based position of each row within `by`, ordered by (digest, tie)."""
    return prefix_sums(
        hash_bucket(df, hexed, digits),
        by=by,
        order=[hexed, tie],
        sums={out: F.lit(1).cast("bigint")},
    )


def hash_top(
    df: DataFrame,
    *,
    by: Sequence[str],
    hexed: str,
    tie: str,
    limit: int | Column,
    digits: int,
    size: str | None = None,
    few_groups: bool = False,
) -> DataFrame:
    """The first `limit` rows of each group by (digest, tie); `limit` may be a column.

    `size` names a column for the group's whole row count.

    Bucket totals show which digest prefixes can still hold a wanted row; all other rows are
    dropped before the shuffle, so a small draw from a huge table moves little more than it
    keeps.
    """
    cut = F.lit(limit) if isinstance(limit, int) else limit
    ranked = prefix_sums(
        hash_bucket(df, hexed, digits),
        by=by,
        order=[hexed, tie],
        sums={"_pos": F.lit(1).cast("bigint")},
        wholes={size: "_pos"} if size else None,
        keep=F.col("_o__pos") < cut,
        few_groups=few_groups,
    )
    return ranked.filter(F.col("_pos") <= cut).drop("_pos")


def hash_first_n(df: DataFrame, *, hexed: str, tie: str, n: int, digits: int) -> DataFrame:
    """The first n rows of a table by (digest, tie)."""
    return hash_top(df, by=[], hexed=hexed, tie=tie, limit=n, digits=digits, few_groups=True)


def exact_quantiles(
    df: DataFrame,
    *,
    by: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    buckets: int,
    discrete: bool = False,
) -> DataFrame:
    """Quantiles per group, for value domains too wide for one buffer: linearly
    interpolated, or with `discrete` the first value whose cumulative share reaches q.

    Equal values are collapsed first; then each quantile needs the values at two positions,
    which are plain minima over the running counts. Only the buckets holding such a position
    are ordered. Groups must be a small domain, as bands are.
    """
    by = list(by)
    before, within, size = F.col("_o__upto"), F.col("_t__upto"), F.col("_size")
    wanted = F.lit(False)
    for q in quantiles.values():
        at = (size - 1) * F.lit(float(q))
        # One position to either side covers both quantile definitions.
        wanted |= (before <= F.ceil(at) + 1) & (before + within >= F.floor(at))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    running = prefix_sums(
        range_bucket(counts, value, buckets),
        by=by,
        order=[value],
        sums={"_upto": "_n"},
        wholes={"_size": "_upto"},
        keep=wanted,
        few_groups=True,
    )
    exprs = []
    for name, q in quantiles.items():
        if discrete:
            reached = F.col("_upto") >= F.col("_size") * F.lit(float(q))
            exprs.append(F.min(F.when(reached, F.col(value))).alias(name))
            continue
        at = (F.col("_size") - 1) * F.lit(float(q))
        low = F.min(F.when(F.col("_upto") > F.floor(at), F.col(value)))
        high = F.min(F.when(F.col("_upto") > F.ceil(at), F.col(value)))
        part = F.max(at - F.floor(at))
        exprs.append((low + part * (high - low)).cast("double").alias(name))
    return running.groupBy(*by).agg(*exprs)
