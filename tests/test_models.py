"""Models and probes on small data with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.operators import clusters, models, newton, trees
from assay.params import Params, Skew

P = Params(skew=Skew(buckets=4))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        y = int(rng.random() < 0.4)
        m = None if i % 10 == 0 else float(rng.normal(y, 0.7))
        rows.append((f"k{i:03d}", m, float(rng.normal()), y, 0.5 if y else 0.25, "a" if i % 2 else "b"))
    return spark.createDataFrame(rows, "sha256 string, m double, noise double, y int, pi double, stratum string").cache()


def test_logistic_regression_matches_its_penalised_optimum(data):
    fitted = models.fit_logistic(data, data, ["m", "noise"], grid=(1.0,))
    pdf = data.toPandas().fillna(0.0)
    x = np.c_[pdf[["m", "noise"]], np.ones(len(pdf))]
    beta, ridge = np.zeros(3), np.diag([1.0, 1.0, 0.0])  # C = 1: half the squared weights
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (pdf.y - p) - ridge @ beta)
    got = [*fitted.model.coefficients, fitted.model.intercept]
    assert got == pytest.approx(list(beta), abs=1e-6)


def test_the_grid_keeps_the_lowest_weighted_loss(data):
    best = models.fit_logistic(data, data, ["m", "noise"])
    for strength in models.LR_GRID:
        assert best.loss <= models.fit_logistic(data, data, ["m", "noise"], grid=(strength,)).loss + 1e-9


def test_trees_rank_and_prefixes_are_forests_of_fewer_rounds(data):
    fitted = models.fit_trees(data, data, ["m", "noise"], leaves=(4,), counts=(5,))
    means = {r["y"]: r["s"] for r in models.raw_score(fitted, data, ["y"]).groupBy("y").agg(F.avg("score").alias("s")).collect()}
    assert means[1] > means[0] and len(fitted.model.trees) == 5
    options = {"leaves": [4], "least": 20}
    long, short = (trees.fit_forests(data, ["m", "noise"], "y", rounds=n, **options)[0] for n in (30, 3))
    assert long.prefix(3) == short  # scores written on the way change nothing
    both = trees.scored(data, {"a": short, "b": long}, ["sha256"]).collect()
    assert all(a["a"] != a["b"] for a in both[:5])


def _exhaustive(matrix, grad, curve, leaves, least):
    """Leaf of each row of a best-first tree, every cut of every feature tried on plain rows."""
    at, size, value = np.zeros(len(grad), int), 1, {}

    def side(rows):
        return grad[rows].sum() ** 2 / curve[rows].sum()

    def cut(rows):
        best = (1e-12, None)
        for f in range(matrix.shape[1]):
            for end in np.unique(matrix[:, f][~np.isnan(matrix[:, f])])[:-1]:
                for missing in (False, True):
                    left = np.where(np.isnan(matrix[:, f]), missing, matrix[:, f] <= end) & rows
                    right = rows & ~left
                    if min(left.sum(), right.sum()) >= least and min(curve[left].sum(), curve[right].sum()) >= 1e-3:
                        gain = side(left) + side(right) - side(rows)
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, left)
        return best

    while size < leaves:
        cuts = {k: cut(at == k) for k in range(size)}
        k = max(cuts, key=lambda k: cuts[k][0])
        if cuts[k][1] is None:
            break
        at[(at == k) & ~cuts[k][1]] = size
        size += 1
    for k in range(size):
        value[k] = -trees.RATE * grad[at == k].sum() / curve[at == k].sum()
    return np.array([value[k] for k in at])


@pytest.mark.parametrize(("leaves", "least"), [(7, 20), (15, 5), (2, 1)])
def test_trees_equal_an_exhaustive_search_with_missing_values(spark, leaves, least):
    rng = np.random.default_rng(leaves)
    matrix = np.round(rng.normal(size=(160, 3)), 1)
    y = (matrix[:, 0] + 0.5 * np.abs(matrix[:, 1]) + rng.normal(size=160) > 0.4).astype(int)
    matrix[rng.random((160, 3)) < 0.25] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(matrix, y))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, y int").repartition(3)
    forest = trees.fit_forests(df, ["a", "b", "c"], "y", leaves=[leaves], rounds=3, least=least)[0]
    score = np.full(160, np.log(y.mean() / (1 - y.mean())))
    for n in range(1, 4):
        p = 1 / (1 + np.exp(-score))
        score = score + _exhaustive(matrix, p - y, p * (1 - p), leaves, least)
        got = trees.scored(df, {"s": forest.prefix(n)}, ["id"]).orderBy("id").toPandas()["s"].to_numpy()
        assert got == pytest.approx(score, abs=1e-9)


def test_models_fitted_together_equal_separate_ones(data):
    folds = models.fold_of(data, "y", "sha256", 3, P).cache()
    together = newton.fit(folds, ["m", "noise"], "y", [1.0, 0.1, 10.0], F.array(*[F.col("fold") != k for k in range(3)]))
    for k, penalty in enumerate([1.0, 0.1, 10.0]):
        alone = newton.fit(folds.filter(F.col("fold") != k), ["m", "noise"], "y", [penalty])[0]
        assert [*alone.coefficients, alone.intercept] == pytest.approx([*together[k].coefficients, together[k].intercept], abs=1e-8)
        assert together[k].n == folds.filter(F.col("fold") != k).count()
    assert newton.fit(data.filter("y = 0"), ["m"], "y", [1.0]) == [None]


def test_folds_are_stratified_and_stable(data):
    folds = models.fold_of(data, "y", "sha256", 5, P)
    sizes = [r["count"] for r in folds.groupBy("y", "fold").count().collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= max(sizes) * 0.5
    for y in (0, 1):
        per = [r["count"] for r in folds.filter(F.col("y") == y).groupBy("fold").count().collect()]
        assert max(per) - min(per) <= 1


def test_probes_tell_leaks_from_noise(data):
    leak = models.probe(data, "y", ["m"], "sha256", P, k=3).agg(F.avg("auc").alias("a")).first()["a"]
    noise = models.probe(data, "y", ["noise"], "sha256", P, k=3).agg(F.avg("auc").alias("a")).first()["a"]
    assert leak > 0.75 and abs(noise - 0.5) < 0.12
    assert models.probe(data.filter("y = 0"), "y", ["m"], "sha256", P).first().asDict() == {"fold": None, "n": data.filter("y = 0").count(), "auc": None}


def test_propensity_and_ranking(data):
    got = models.propensity(data.filter("y = 1"), data.filter("y = 0"), ["m", "noise"])
    r = got.agg(F.min("p_rescanned").alias("lo"), F.max("p_rescanned").alias("hi"), F.count("*").alias("n")).first()
    assert 0 < r["lo"] < r["hi"] < 1 and r["n"] == data.filter("y = 1").count()
    assert [x["feature"] for x in models.coefficient_ranking(data, "y", ["noise", "m"]).collect()] == ["m", "noise"]


def test_comparison_skips_one_class_folds(data):
    groups = {"features_new": ["m", "noise"], "features_old": ["noise"]}
    one = data.filter("y = 0")
    table, fitted = models.compare_models((data, data), (one, data), groups, P, grid=(1.0,), leaves=(3,), counts=(3,))
    rows = {r["model"]: r for r in table.collect()}
    assert set(fitted) == {"a", "b", "c"} and rows["b_random"]["log_loss"] is None
    assert rows["b"]["auc_raw"] > rows["a"]["auc_raw"]


def test_engines_that_agree_share_a_cluster(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        truth, other = bool(rng.random() < 0.5), bool(rng.random() < 0.5)
        for engine, v in (("e0", truth), ("e1", truth), ("e2", other), ("e3", None)):
            if rng.random() < 0.8:
                rows.append((i, f"s{i % 50}", "label", engine, v))
    long = spark.createDataFrame(rows, "instance_number long, sha256 string, scan_role string, author string, verdict boolean")
    roster = ["e0", "e1", "e2", "e3"]
    pairs = clusters.agreement(long, roster)
    got = {(r["engine_a"], r["engine_b"]): r for r in pairs.collect()}
    answers = {(r[0], r[3]): r[4] for r in rows if r[4] is not None}
    both = [(answers[i, "e0"], answers[i, "e2"]) for i in range(300) if (i, "e0") in answers and (i, "e2") in answers]
    assert got["e0", "e2"]["n_both"] == len(both)
    assert got["e0", "e2"]["correlation"] == pytest.approx(np.corrcoef(np.array(both, dtype=float).T)[0, 1])
    assert got["e0", "e1"]["correlation"] == pytest.approx(1.0) and ("e0", "e3") not in got
    found = {r["author"]: r["cluster"] for r in clusters.clusters(pairs, roster, 0.9).collect()}
    assert found == {"e0": "e0", "e1": "e0", "e2": "e2", "e3": "e3"}
    with pytest.raises(ValueError):
        clusters.pair_sums(long, [str(i) for i in range(clusters.MAX_ROSTER + 1)])
