"""The given tables, and where their queries register."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch of texts.
BATCH = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a query under `name`, with its SQL if SQL can express it."""

    def add(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def set_aside(docs: DataFrame, taken: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with columns of the names an operator takes renamed, and all its names as they
    are now, by the old ones; `put_back` undoes it."""
    used = {*taken, *(c.lower() for c in docs.columns)}
    names = {}
    for c in docs.columns:
        names[c] = c
        while c.lower() in taken and names[c].lower() in used:
            names[c] += "_"
        used.add(names[c].lower())
    return docs.toDF(*names.values()), names


def put_back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns that `set_aside` was given, under their own names."""
    return rows.select(*[F.col(f"`{new}`").alias(old) for old, new in names.items()])


def hashed_sample(rows: DataFrame, columns: list[str], size: int) -> DataFrame:
    """At most `size` rows, first by a hash of these columns.

    Rows are counted first and most of those that cannot be among them dropped where they are,
    so what meets in the one sorting task is about twice the sample, however many tasks there are.
    """
    total = rows.count()
    share = min(1.0, 2.0 * size / max(1, total))
    h = F.xxhash64(*columns)
    if share < 1:
        rows = rows.filter(F.pmod(h, F.lit(1 << 32)) < int(share * (1 << 32)))
    return rows.orderBy(F.pmod(h, F.lit(1 << 32)), h, *columns).limit(size)


def portions(batches: Iterator[pa.RecordBatch], column: str, rows: int = 1000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: at most `rows`, and about `size` bytes of `column`, so
    that what a task holds besides them stays small however long the texts are."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(start, stop - start)
            start = stop


def mapped(rows: DataFrame, run: Callable, schema) -> DataFrame:
    """`rows.mapInArrow(run, schema)`, with Arrow batches of at most BATCH rows.

    Whole texts travel in these batches, and an executor holds some for each task on both sides
    of the pipe to Python. The setting is the session's and stays; a smaller one is kept.
    """
    conf = rows.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_SETTING)) <= BATCH:
        conf.set(_BATCH_SETTING, str(BATCH))
    return rows.mapInArrow(run, schema)
