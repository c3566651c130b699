"""Schemas of what enters from outside; identifiers are bigint end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

def page_schema(score_field: str = "score") -> T.StructType:
    """An index page: documents with an artifact, its first scan and its latest scan.

    `score_field` is what the landed JSON calls the score of a scan.
    """
    counts = T.StructType([T.StructField(c, T.LongType()) for c in ("malicious", "benign", "total")])
    answer = T.StructType(
        [T.StructField("verdict", T.BooleanType()), T.StructField("malware_family", T.StringType())]
    )
    scan = T.StructType(
        [
            T.StructField("artifact_instance_id", T.LongType()),
            T.StructField("created", T.StringType()),
            T.StructField(score_field, T.DoubleType()),
            T.StructField("detections", counts),
            T.StructField("assertions", T.MapType(T.StringType(), answer)),
        ]
    )
    artifact = T.StructType(
        [
            T.StructField("sha256", T.StringType()),
            T.StructField("created", T.StringType()),
            T.StructField("size", T.LongType()),
        ]
    )
    scans = T.StructType(
        [
            T.StructField("mimetype", T.StringType()),
            T.StructField("first_scan", scan),
            T.StructField("latest_scan", scan),
        ]
    )
    document = T.StructType([T.StructField("artifact", artifact), T.StructField("scan", scans)])
    return T.StructType(
        [T.StructField("result", T.ArrayType(document)), T.StructField("next", T.StringType())]
    )


RENDER = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("created", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("window_closed", T.BooleanType()),
        T.StructField("failed", T.BooleanType()),
        T.StructField("missing", T.BooleanType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("result", T.BooleanType()),
        T.StructField(
            "assertions",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("author", T.StringType()),
                        T.StructField("author_name", T.StringType()),
                        T.StructField("verdict", T.BooleanType()),
                        T.StructField("bid", T.StringType()),
                        T.StructField("mask", T.BooleanType()),
                        T.StructField(
                            "metadata",
                            T.StructType(
                                [
                                    T.StructField("malware_family", T.StringType()),
                                    T.StructField(
                                        "scanner",
                                        T.StructType([T.StructField("version", T.StringType())]),
                                    ),
                                ]
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)


def require_exact_ids(df: DataFrame, *columns: str) -> DataFrame:
    """Refuse identifier columns that could have been rounded (17 digits do not fit a double)."""
    for name in columns:
        kind = df.schema[name].dataType
        if not isinstance(kind, T.LongType):
            raise TypeError(f"{name} is {kind.simpleString()}: identifiers must be bigint")
    return df
