"""Every registered query that has an oracle, against DuckDB at the smallest scale."""

import os

import pytest

import __spark_entry__ as driver
from assay import catalog

duckdb = pytest.importorskip("duckdb")

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = ("ml2", "ml3")  # full grids of boosted trees take minutes; their parts are tested in test_models

QUERIES, ORACLES = catalog.load()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def _rows(columns, names, rows):
    order = [names.index(c) for c in columns]
    return sorted(repr(tuple(row[i] + 0.0 if isinstance(row[i], float) else row[i] for i in order)) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, tables, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    columns = sorted(df.columns)
    found = tables.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert _rows(columns, df.columns, df.collect()) == _rows(columns, names, found.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(ORACLES) if not n.startswith(SLOW)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_the_flagship_is_one_plan_with_rows(spark):
    df = driver.entry(spark)
    assert sum(r["n"] for r in df.collect()) == 115


def test_the_driver_gets_every_query():
    assert set(QUERIES) <= set(driver.queries())
    assert set(ORACLES) <= set(driver.oracle_sql())
