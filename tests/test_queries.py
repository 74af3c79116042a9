"""Every catalogue query with SQL against DuckDB on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from larkspur import queries

TABLES = "events documents embeddings conversations labels".split()


def normal(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equals_sql(spark, duck, sf_dir, name):
    made = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(made.columns)
    got = sorted((tuple(normal(r[c]) for c in columns) for r in made.collect()), key=repr)
    want = duck.sql(queries.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(normal(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_flagship_has_no_python_and_one_shuffle(spark, sf_dir):
    plan = queries.QUERIES["curate_pipeline"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp" in plan and "props" not in plan


def test_every_entry_is_reachable(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
