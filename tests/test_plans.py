"""Ordering and skew helpers against brute force, with hot keys and heavy ties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.params import Skew
from assay.plans.components import components
from assay.plans.ordering import (
    exact_quantiles,
    hash_first_n,
    hash_key,
    hash_position,
    prefix_sums,
    range_bucket,
    running_by_value,
)
from assay.plans.skew import hot_keys, salted_lookup
from assay.plans.stage import folder_state, stage_once, staged


def _rows(n=800, seed=3):
    rnd = random.Random(seed)
    # one group holds a third of the rows, and values repeat heavily
    return [("hot" if i % 3 == 0 else f"g{rnd.randrange(9)}", float(rnd.choice([1, 1, 1, 2, 3, rnd.random()])), i) for i in range(n)]


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_prefix_sums_equal_a_plain_running_sum(spark, buckets):
    rows = _rows()
    df = spark.createDataFrame(rows, "g string, v double, id long")
    got = prefix_sums(
        range_bucket(df, "v", buckets), by=["g"], order=["v", "id"], sums={"n": F.lit(1).cast("long"), "s": "v"}, wholes={"all": "n"}
    ).collect()
    groups = {}
    for g, v, i in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(g, []).append((v, i))
    want = {}
    for g, items in groups.items():
        total = 0.0
        for place, (v, i) in enumerate(items, 1):
            total += v
            want[i] = (place, round(total, 6), len(items))
    assert {r["id"]: (r["n"], round(r["s"], 6), r["all"]) for r in got} == want


def test_range_bucket_follows_the_order_and_spreads_rows(spark):
    df = spark.range(5000).select((F.col("id") * 1.5).alias("v"))
    sizes = range_bucket(df, "v", 16).groupBy("_bucket").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).orderBy("_bucket").collect()
    assert len(sizes) == 16 and max(r["n"] for r in sizes) < 2 * 5000 / 16
    assert all(a["hi"] < b["lo"] for a, b in zip(sizes, sizes[1:]))
    with pytest.raises(ValueError):
        range_bucket(df, "v", 10)


def test_hash_position_and_first_n(spark):
    df = spark.createDataFrame(_rows(), "g string, v double, id long").withColumn("h", hash_key(F.col("id").cast("string"), 7))
    got = {r["id"]: r["position"] for r in hash_position(df, by=["g"], hexed="h", tie="id", digits=2).collect()}
    want = {}
    for g in {r["g"] for r in df.collect()}:
        for place, r in enumerate(sorted((r["h"], r["id"]) for r in df.collect() if r["g"] == g), 1):
            want[r[1]] = place
    assert got == want
    first = {r["id"] for r in hash_first_n(df, hexed="h", tie="id", n=37, digits=2).collect()}
    assert first == {i for _, i in sorted((r["h"], r["id"]) for r in df.collect())[:37]}


def test_running_by_value_cuts_one_huge_tie(spark):
    rows = [(10 if i % 3 else i % 7, f"k{i}", i % 4 + 1) for i in range(600)]
    df = spark.createDataFrame(rows, "v long, k string, size long").withColumn("h", F.md5("k"))
    got = running_by_value(df, value="v", hexed="h", tie="k", sums={"upto": "size"}, buckets=8, digits=2).collect()
    total, want = 0, {}
    for v, h, k, size in sorted((r["v"], r["h"], r["k"], r["size"]) for r in df.collect()):
        total += size
        want[k] = total
    assert {r["k"]: r["upto"] for r in got} == want
    assert {r["upto_whole"] for r in got} == {total}


def test_many_groups_are_not_broadcast(spark, monkeypatch):
    from assay.plans import ordering

    monkeypatch.setattr(ordering, "MAX_OFFSETS", 3)
    df = spark.createDataFrame(_rows(), "g string, v double, id long")
    with pytest.raises(Exception, match="too many groups"):
        exact_quantiles(df, by=["g"], value="v", quantiles={"a": 0.5}, buckets=16).collect()


def test_exact_quantiles_match_numpy(spark):
    df = spark.createDataFrame(_rows(), "g string, v double, id long")
    got = exact_quantiles(df, by=["g"], value="v", quantiles={"a": 0.1, "b": 0.5, "c": 0.9}, buckets=16).collect()
    for r in got:
        values = [x["v"] for x in df.filter(F.col("g") == r["g"]).collect()]
        assert [r["a"], r["b"], r["c"]] == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.9])))
    low = exact_quantiles(df, by=[], value="v", quantiles={"m": 0.5}, buckets=16, discrete=True).first()["m"]
    assert low == sorted(r[1] for r in _rows())[399]


def test_hot_keys_are_bounded_and_largest_first(spark):
    df = spark.createDataFrame([(k,) for k in ["a"] * 50 + ["b"] * 30 + ["c"] * 20 + ["d"] * 2], "k string")
    found = hot_keys(df, ["k"], Skew(hot_rows=10, max_hot_keys=2))
    assert {r["k"]: r["_salts"] for r in found.collect()} == {"a": 5, "b": 3}


def test_salted_lookup_equals_a_plain_join(spark):
    facts = spark.createDataFrame(_rows(), "g string, v double, id long")
    lookup = spark.createDataFrame([(f"g{i}", i) for i in range(9)] + [("hot", 99), ("unused", 1)], "g string, x long")
    skew = Skew(hot_rows=20, max_hot_keys=3, salts=8)
    got = salted_lookup(facts, lookup, ["g"], spread_on="id", skew=skew)
    assert sorted(got.select("id", "x").collect()) == sorted(facts.join(lookup, "g").select("id", "x").collect())
    # the hot key's rows really are spread over salts
    plan = got._jdf.queryExecution().toString()
    assert "_salt" in plan


def test_stages_are_written_once_and_rebuilt_when_lost(spark, tmp_path):
    import shutil

    from assay.plans import stage

    built = []

    def build():
        built.append(1)
        return spark.range(5)

    key = str(tmp_path)
    assert stage_once(spark, key, "t", build).count() == 5
    assert stage_once(spark, key, "t", build).count() == 5 and len(built) == 1
    shutil.rmtree(stage._WRITTEN[(spark.sparkContext.applicationId, key, "t")])
    assert stage_once(spark, key, "t", build).count() == 5 and len(built) == 2
    assert staged(spark.range(3), "u").count() == 3


def test_a_folder_written_again_is_another_one(spark, tmp_path):
    folder = str(tmp_path / "t")
    spark.range(3).write.parquet(folder)
    first = folder_state(spark, folder)
    assert first == folder_state(spark, folder) and len(first) > 0
    spark.range(4).write.mode("overwrite").parquet(folder)
    assert folder_state(spark, folder) != first


def test_components_against_union_find(spark):
    draw = random.Random(5)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    draw.shuffle(chain)
    star = [("hub", f"s{i}") for i in range(30)]
    loose = [(f"r{draw.randrange(40)}", f"r{draw.randrange(40)}") for _ in range(25)]
    edges = chain + star + loose + star[:3] + [(b, a) for a, b in loose[:5]] + [("x", "x"), (None, "x"), ("x", "stranger")]
    nodes = {n for edge in edges for n in edge if n not in (None, "stranger")} | {"alone"}
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        if a in nodes and b in nodes:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    given = spark.createDataFrame([(n,) for n in nodes] * 2 + [(None,)], "node string")
    found = components(given, spark.createDataFrame(edges, "a string, b string")).collect()
    assert len(found) == len(nodes) and {r["node"]: r["component"] for r in found} == {n: root(n) for n in nodes}
    none = spark.createDataFrame([], "a string, b string")
    assert components(given.filter("node = 'alone'"), none).collect() == [("alone", "alone")]
    assert components(given.limit(0), none).count() == 0
