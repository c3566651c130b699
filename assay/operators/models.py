"""Models on the design matrix: logistic regression and boosted trees, tuned on log loss."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio, sigmoid
from ..params import Params
from ..plans.ordering import hash_key, hash_position
from ..plans.stage import staged
from . import newton, trees
from .features import design
from .metrics import roc_auc, weighted_mean

# The tuning grids.
LR_GRID = (0.01, 0.1, 1.0, 10.0)
TREE_LEAVES = (7, 15)
TREE_COUNTS = (100, 300)


@dataclass(frozen=True)
class Fitted:
    model: newton.Logistic | trees.Forest
    columns: tuple[str, ...]
    params: dict[str, Any]
    loss: float | None


def vectors(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Feature vectors with 0 for missing."""
    flat = design(df, columns, keep=keep)
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(flat).select(*keep, "features")


def _margins(models: dict[str, Any], df: DataFrame, keep: Sequence[str]) -> DataFrame:
    kind = trees if isinstance(next(iter(models.values())), trees.Forest) else newton
    return kind.scored(df, models, keep)


def raw_score(fitted: Fitted, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The raw margin, for ranking, and the model's own probability."""
    return _margins({"score": fitted.model}, df, keep).withColumn("probability", sigmoid(F.col("score")))


def log_losses(models: dict[str, Any], df: DataFrame) -> dict[str, float | None]:
    """Weighted log loss of each model, in one pass, with probabilities kept 1e-6 inside; None
    with one class. The models are of one kind and share their columns."""
    rows = _margins(models, df, ["y", "pi"])
    y = F.col("y").cast("double")

    def loss(name: str) -> Column:
        p = F.least(F.greatest(sigmoid(F.col(name)), F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.when(F.min(y) != F.max(y), weighted_mean(-(y * F.ln(p) + (1 - y) * F.ln(1 - p)), 1 / F.col("pi")))

    return rows.agg(*[loss(n).alias(n) for n in models]).first().asDict()


def log_loss(fitted: Fitted, df: DataFrame) -> float | None:
    return log_losses({"score": fitted.model}, df)["score"]


def _best(fits: list[tuple[Any, dict[str, Any]]], columns: Sequence[str], validate: DataFrame) -> Fitted:
    """The model of least loss; the first of equal ones, or of all if none is known."""
    losses = log_losses({f"m{i}": model for i, (model, _) in enumerate(fits)}, validate)
    known = [i for i in range(len(fits)) if losses[f"m{i}"] is not None]
    best = min(known, key=lambda i: losses[f"m{i}"]) if known else 0
    return Fitted(fits[best][0], tuple(columns), fits[best][1], losses[f"m{best}"])


def _one(found: newton.Logistic | None) -> newton.Logistic:
    if found is None:
        raise ValueError("rows of one class alone cannot be fitted")
    return found


def fit_logistic(train: DataFrame, validate: DataFrame, columns: Sequence[str], grid: Sequence[float] = LR_GRID) -> Fitted:
    """L2 logistic regression; the grid is in inverse strength, and all of it is fitted together."""
    found = newton.fit(train, columns, "y", [1 / c for c in grid])
    return _best([(_one(m), {"C": c}) for m, c in zip(found, grid)], columns, validate)


def fit_trees(
    train: DataFrame,
    validate: DataFrame,
    columns: Sequence[str],
    leaves: Sequence[int] = TREE_LEAVES,
    counts: Sequence[int] = TREE_COUNTS,
    least: int | None = None,
) -> Fitted:
    """Boosted trees that grow best first, missing values on the side that each split learns.

    One chain of trees per number of leaves; the smaller counts are prefixes of it. `least` is the
    fewest rows of a leaf: by default 20, or a tenth of the rows if there are fewer than 200.
    """
    least = least or max(1, min(20, train.count() // 10))
    forests = trees.fit_forests(train, columns, "y", leaves=leaves, rounds=max(counts), least=least)
    fits = [(f.prefix(n), {"leaves": k, "rounds": n}) for k, f in zip(leaves, forests) for n in counts]
    return _best(fits, columns, validate)


def compare_models(
    grouped: tuple[DataFrame, DataFrame],
    random: tuple[DataFrame, DataFrame],
    groups: dict[str, list[str]],
    params: Params,
    *,
    grid: Sequence[float] = LR_GRID,
    leaves: Sequence[int] = TREE_LEAVES,
    counts: Sequence[int] = TREE_COUNTS,
) -> tuple[DataFrame, dict[str, Fitted]]:
    """The comparisons: old encoding, new encoding, trees, and the new one on a random split.

    Returns one row per model and the fitted models; a fold with one class is skipped.
    """
    new, old = groups["features_new"], groups["features_old"]
    specs = {
        "a": (old, grouped, "logistic"),
        "b": (new, grouped, "logistic"),
        "c": (new, grouped, "trees"),
        "b_random": (new, random, "logistic"),
    }
    rows, fitted = [], {}
    for name, (columns, (train, validate), kind) in specs.items():
        shape = train.agg(F.count("*").alias("n"), F.count_distinct("y").alias("classes")).first()
        if shape["classes"] < 2:
            rows.append((name, kind, len(columns), shape["n"], None, None, None))
            continue
        if kind == "trees":
            model = fit_trees(train, validate, columns, leaves, counts)
        else:
            model = fit_logistic(train, validate, columns, grid)
        fitted[name] = model
        scored = raw_score(model, validate, ["y", "pi"]).withColumn("w", 1 / F.col("pi"))
        auc = roc_auc(scored, "score", "y", params.skew, weight="w").first()
        rows.append(
            (name, kind, len(columns), shape["n"], model.loss, auc["auc_raw"] if auc else None, auc["auc_weighted"] if auc else None)
        )
    schema = "model string, kind string, n_features int, n_train bigint, log_loss double, auc_raw double, auc_weighted double"
    return grouped[0].sparkSession.createDataFrame(rows, schema), fitted


def fold_of(df: DataFrame, target: str, key: str, k: int, params: Params) -> DataFrame:
    """Stratified fold numbers 0..k-1 in digest order within each class."""
    keyed = df.withColumn("_key", hash_key(F.col(key).cast("string"), params.seed, prefix="fold:"))
    placed = hash_position(
        keyed, by=[target], hexed="_key", tie=key, digits=params.skew.hash_digits, out="_pos"
    )
    return placed.withColumn("fold", ((F.col("_pos") - 1) % k).cast("int")).drop("_key", "_pos")


def probe(
    df: DataFrame, target: str, columns: Sequence[str], key: str, params: Params, k: int = 5, least: int = 5
) -> DataFrame:
    """How well features tell `target` apart: out-of-fold AUC per fold, all folds fitted together.

    As many folds as the smaller class has rows, `k` at most. If it has fewer than `least`, there
    is nothing to fold: one row without a fold or AUC, with the number of rows.
    """
    sizes = {r[target]: r["count"] for r in df.groupBy(target).count().collect()}
    smallest = min(sizes.get(0, 0), sizes.get(1, 0))
    schema = "fold int, n bigint, auc double"
    if smallest < least:
        return df.sparkSession.createDataFrame([(None, sum(sizes.values()), None)], schema)
    k = min(k, smallest)
    data = staged(fold_of(df.select(key, F.col(target).alias("y"), *columns), "y", key, k, params), "probe_folds")
    found = newton.fit(data, columns, "y", [1.0] * k, F.array(*[F.col("fold") != f for f in range(k)]))
    margins = newton.scored(data, {f"m{f}": _one(m) for f, m in enumerate(found)}, ["fold", "y"])
    out = margins.select("fold", F.col("y").cast("double").alias("y"), F.get(F.array(*[f"m{f}" for f in range(k)]), F.col("fold")).alias("score"))
    return roc_auc(out, "score", "y", params.skew, by=["fold"]).select("fold", "n", F.col("auc_raw").alias("auc"))


def propensity(cohort: DataFrame, control: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Probability of having been rescanned, per cohort row, and its inverse as a weight."""
    both = cohort.select(*columns).withColumn("y", F.lit(1)).unionByName(control.select(*columns).withColumn("y", F.lit(0)))
    model = _one(newton.fit(both, columns, "y", [1.0])[0])
    scored = newton.scored(cohort, {"score": model}, ["sha256", "stratum"])
    p = sigmoid(F.col("score"))
    return scored.select(
        "sha256", "stratum", p.alias("p_rescanned"), ratio(F.lit(1.0), p).alias("weight")
    )


def rescan_probe(cohort: DataFrame, control: DataFrame, columns: Sequence[str], params: Params, k: int = 5) -> DataFrame:
    """One row: mean out-of-fold AUC of rescanned against control rows, folds with an AUC, and
    the size of both sides. AUC is null where either side is too small to fold."""
    kept = ["sha256", *columns]
    both = cohort.select(*kept).withColumn("rescanned", F.lit(1)).unionByName(control.select(*kept).withColumn("rescanned", F.lit(0)))
    sizes = both.agg(F.count_if(F.col("rescanned") == 1).alias("rescanned"), F.count_if(F.col("rescanned") == 0).alias("control"))
    aucs = probe(both, "rescanned", columns, "sha256", params, k).agg(F.avg("auc").alias("auc"), F.count("auc").alias("folds"))
    return aucs.withColumns({c: sizes.select(c).scalar() for c in ("rescanned", "control")})


def era_gap_auc(
    df: DataFrame, era: str, columns: Sequence[str], params: Params, *, bases: Sequence[int], strength: float = 1.0
) -> DataFrame:
    """(base, gap, n, auc_raw, auc_weighted): a model trained on one era's rows alone, and its AUC
    on that era and each later one.

    `era` is a whole number per row and `bases` the eras to train on, all fitted together; a base
    without both classes is left out.
    """
    found = newton.fit(df, columns, "y", [1 / strength] * len(bases), F.array(*[F.coalesce(F.col(era) == b, F.lit(False)) for b in bases]))
    models = {f"m{b}": m for b, m in zip(bases, found) if m is not None}
    if not models:
        return df.sparkSession.createDataFrame([], "base int, gap int, n bigint, auc_raw double, auc_weighted double")
    each = F.array(*[F.struct(F.lit(b).alias("base"), F.col(f"m{b}").alias("score")) for b in bases if f"m{b}" in models])
    rows = newton.scored(df, models, ["y", "pi", era]).select("y", "pi", era, F.inline(each)).filter(F.col(era) >= F.col("base"))
    out = rows.select("base", (F.col(era) - F.col("base")).alias("gap"), F.col("y").cast("double").alias("y"), (1 / F.col("pi")).alias("w"), "score")
    return roc_auc(out, "score", "y", params.skew, by=["base", "gap"], weight="w")


def coefficient_ranking(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Features behind a probe, by |coefficient| times standard deviation."""
    model = _one(newton.fit(df, columns, target, [1.0])[0])
    spreads = design(df, columns).agg(*[F.stddev_samp(c).alias(c) for c in columns]).first()
    rows = [
        (name, float(model.coefficients[i]), float(abs(model.coefficients[i]) * (spreads[name] or 0.0)))
        for i, name in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double, effect double").orderBy(
        F.col("effect").desc(), "feature"
    )
