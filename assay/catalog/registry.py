"""Where queries register: a Spark function of a Study, and its oracle SQL if it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ctes import oracle
from .study import Study

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 9


def query(name: str, sql: str | None = None, *, doubles: str = "", **ctes: str):
    """Register a query. `doubles` lists columns compared at nine decimals on both sides."""
    rounded = doubles.split()

    def add(build: Callable[[Study], DataFrame]) -> Callable[[Study], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = build(Study(spark, folder))
            return out.withColumns({c: F.round(F.col(c).cast("double"), DIGITS) for c in rounded})

        QUERIES[name] = run
        if sql is not None:
            text = oracle(sql, **ctes)
            if rounded:
                replaced = ", ".join(f"round(CAST({c} AS DOUBLE), {DIGITS}) AS {c}" for c in rounded)
                text = f"SELECT * REPLACE ({replaced}) FROM ({text})"
            ORACLES[name] = text
        return build

    return add
