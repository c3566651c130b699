"""Small constant tables, as local relations the optimizer can see through."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def small_table(spark: SparkSession, rows: Sequence[Sequence[Any]], schema: str) -> DataFrame:
    """A handful of rows under a schema of simple types, such as "name string, n bigint"."""
    columns = [part.split() for part in schema.split(",")]
    cells = F.array(
        *[
            F.struct(*[F.lit(value).cast(kind).alias(name) for value, (name, kind) in zip(row, columns)])
            for row in rows
        ]
    )
    return spark.range(1).select(F.inline(cells))
