"""Many logistic regressions at once, by Newton steps over one pass each.

Each row adds to the gradient and curvature of every model that trains on it, whatever tells the
models apart: penalties, folds or eras. A step is one job whose result is a vector and a matrix per
model, so what reaches the driver depends on features and models and not on rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..plans.stage import staged
from .features import design

# Functions that run in tasks are sent with the job: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Features that a matrix of curvatures is kept for: a megabyte a model and task.
MOST_FEATURES = 512
STEPS, TOLERANCE = 60, 1e-10
#: Rows that make a partition worth a task of its own.
TASK_ROWS = 50_000


@dataclass(frozen=True)
class Logistic:
    columns: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float
    n: int
    classes: int

    def score(self) -> Column:
        """The raw margin, with 0 for missing values."""
        terms = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(b) for c, b in zip(self.columns, self.coefficients)]
        return sum(terms, F.lit(self.intercept))


def _matrix(batch: pa.RecordBatch, at: int, width: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy().reshape(batch.num_rows, width)


def _sums(data: DataFrame, beta: np.ndarray, live: list[int], features: int, models: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """(loss, gradient, curvature) of each live model at its coefficients, intercept last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = features + 1
        total = np.zeros((len(live), 1 + size + size * size))
        for batch in batches:
            x = np.column_stack([_matrix(batch, 0, features), np.ones(batch.num_rows)])
            y, use = batch.column(1).to_numpy(), _matrix(batch, 2, models)
            for k, m in enumerate(live):
                some = use[:, m] > 0
                if some.any():
                    own, w, z = x[some], use[some, m], x[some] @ beta[m]
                    p = 1 / (1 + np.exp(-z))
                    loss = (w * (np.logaddexp(0, z) - y[some] * z)).sum()
                    curve = (own * (w * p * (1 - p))[:, None]).T @ own
                    total[k] += np.concatenate([[loss], own.T @ (w * (y[some] - p)), curve.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["model", "sums"])

    found: dict[int, np.ndarray] = {}
    for m, raw in zip(*[c.to_pylist() for c in data.mapInArrow(run, "model int, sums binary").toArrow().columns]):
        found[m] = found.get(m, 0.0) + np.frombuffer(raw)
    size = features + 1
    return {m: (t[0], t[1 : 1 + size], t[1 + size :].reshape(size, size)) for m, t in found.items()}


def fit(df: DataFrame, columns: Sequence[str], y: str, penalties: Sequence[float], use: Column | None = None) -> list[Logistic | None]:
    """One model per penalty: least log loss over its rows plus penalty / 2 times the squared
    coefficients, the intercept free. A model without both classes is None.

    `use` is an array of weights, one per model, 0 where a model does not train on the row; by
    default all train on all rows. Missing values are 0.
    """
    models, features = len(penalties), len(columns)
    if features > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features for matrices of curvature")
    weights = F.array(*[F.lit(1.0)] * models) if use is None else F.transform(use, lambda w: w.cast("double"))
    named = df.withColumns({"_y": F.col(y).cast("double"), "_use": weights})
    rows = design(named, columns, keep=["_y", "_use"]).select(F.array(*columns).cast("array<double>").alias("x"), F.col("_y").alias("y"), F.col("_use").alias("use"))
    shape = rows.agg(
        F.count("*").alias("all"),
        *[F.count_if(F.get("use", F.lit(m)) > 0).alias(f"n{m}") for m in range(models)],
        *[F.sum(F.when(F.get("use", F.lit(m)) > 0, F.get("use", F.lit(m)) * F.col("y"))).alias(f"p{m}") for m in range(models)],
        *[F.sum(F.get("use", F.lit(m))).alias(f"w{m}") for m in range(models)],
    ).first()
    tasks = max(1, math.ceil(shape["all"] / TASK_ROWS))
    data = staged(rows.repartition(tasks), "newton_rows").coalesce(tasks)
    beta = np.zeros((models, features + 1))
    live = []
    for m in range(models):
        share = (shape[f"p{m}"] or 0.0) / shape[f"w{m}"] if shape[f"w{m}"] else 0.0
        if 0 < share < 1:
            beta[m, -1] = math.log(share / (1 - share))
            live.append(m)
    fitted, last = list(live), {}
    for _ in range(STEPS):
        if not live:
            break
        on = []
        for m, (loss, gradient, curve) in _sums(data, beta, live, features, models).items():
            ridge = np.full(features + 1, float(penalties[m]))
            ridge[-1] = 0.0
            value = loss + 0.5 * float(ridge @ beta[m] ** 2)
            if m in last and value > last[m][0] + 1e-9 * abs(last[m][0]):
                beta[m] = (beta[m] + last[m][1]) / 2  # too far: halfway back
                on.append(m)
                continue
            last[m] = value, beta[m].copy()
            slope = gradient - ridge * beta[m]
            step = np.linalg.lstsq(curve + np.diag(ridge), slope, rcond=None)[0]
            beta[m] += step
            if float(slope @ step) > TOLERANCE * (1 + abs(value)):
                on.append(m)
        live = sorted(on)
    out: list[Logistic | None] = []
    for m in range(models):
        own = tuple(map(float, beta[m]))
        out.append(Logistic(tuple(columns), own[:-1], own[-1], shape[f"n{m}"], 2) if m in fitted else None)
    return out


def scored(df: DataFrame, models: dict[str, Logistic], keep: Sequence[str]) -> DataFrame:
    """`keep` and a column of raw margins per model, in one pass."""
    some = next(iter(models.values()))
    plain = design(df, some.columns, keep=[F.col(c).alias(f"_keep_{c}") for c in keep])
    plain = plain.select(F.array(*some.columns).cast("array<double>").alias("_x"), *[f"_keep_{c}" for c in keep])
    schema = StructType([*[StructField(c, plain.schema[f"_keep_{c}"].dataType) for c in keep], *[StructField(n, DoubleType()) for n in models]])
    beta = np.array([[*m.coefficients, m.intercept] for m in models.values()]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = _matrix(batch, 0, len(beta) - 1) @ beta[:-1] + beta[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *map(pa.array, margins.T.copy())], [f.name for f in schema.fields])

    return plain.mapInArrow(run, schema)
