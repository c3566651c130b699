"""Stage boundaries: a written table in the shared folder, which also cuts the lineage."""

from __future__ import annotations

from collections.abc import Callable, Hashable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..sources.session import new_path

_WRITTEN: dict[Hashable, str] = {}


def folder_state(spark: SparkSession, folder: str) -> tuple[tuple[str, int, int], ...]:
    """(name, bytes, time written) of every file under a folder, in any store Spark can read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    files = []
    while found.hasNext():
        one = found.next()
        files.append((one.getPath().toString(), one.getLen(), one.getModificationTime()))
    return tuple(sorted(files))


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table other executors can read again after a loss."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def stage_once(spark: SparkSession, key: Hashable, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stage table written under `key` in this application, built if it is not there."""
    full = (spark.sparkContext.applicationId, key, name)
    if full in _WRITTEN:
        try:
            return spark.read.parquet(_WRITTEN[full])
        except AnalysisException:
            del _WRITTEN[full]
    path = new_path(spark, name)
    build().write.parquet(path)
    _WRITTEN[full] = path
    return spark.read.parquet(path)
