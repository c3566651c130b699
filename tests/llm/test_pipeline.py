import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assay.llm import decontam, queries, secrets, simhash
from assay.llm.tables import hashed_sample, put_back, set_aside, table

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = queries.load()


def test_fourteen_queries():
    assert [sum(n.startswith(f"op{i}_") for n in QUERIES) for i in range(1, 14)] == [1] * 13 and "pipeline" in QUERIES
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == sorted(map(repr, found.fetchall()))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_each_stage_works_on_what_the_last_one_kept(spark):
    docs = table(spark, FOLDER, "documents")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = stage(spark, kept, FOLDER).cache()
        after = {r["doc_id"]: r["text"] for r in kept.collect()}
        assert kept.columns == columns and set(after) <= set(before), name
        if name != "secrets":
            assert all(before[i] == t for i, t in after.items()), name
    assert not decontam.digest(decontam.scan(kept, table(spark, FOLDER, "benchmark"))).filter("contaminated").count()
    found = simhash.near_duplicates(kept).collect()
    assert len({r["component_id"] for r in found}) >= len(found) - 2  # masking may bring two together
    models = secrets.fit(secrets.labelled_strings(docs))
    assert not secrets.digest(secrets.scan(kept, models)).filter("n_access + n_hex > 0").count()
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in packed} == set(after)


def test_empty_tables_run_through(spark, tmp_path):
    schemas = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id string, text string"}
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_samples_are_bounded_and_stable(spark):
    rows = spark.range(5000).selectExpr("id", "id % 7 AS x")
    one = {r["id"] for r in hashed_sample(rows, ["id"], 100).collect()}
    two = {r["id"] for r in hashed_sample(rows.repartition(5), ["id"], 100).collect()}
    assert len(one) == 100 and one == two
    assert hashed_sample(rows, ["id"], 10_000).count() == 5000 and hashed_sample(rows.limit(0), ["id"], 5).count() == 0


def test_columns_set_aside_come_back(spark):
    rows = spark.createDataFrame([(1, 2, 3, 4)], "a int, Hits int, hits_ int, words int")
    aside, names = set_aside(rows, ["hits", "words"])
    assert not {"hits", "words"} & {c.lower() for c in aside.columns} and len(set(aside.columns)) == 4
    back = put_back(aside.withColumn("hits", F.lit(9)), names)
    assert back.columns == rows.columns and tuple(back.first()) == (1, 2, 3, 4)
