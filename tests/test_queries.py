"""Every query with an oracle gives DuckDB's rows, names and types."""

import duckdb
import pytest

from millrace.plans.queries import ORACLES, QUERIES
from millrace.sources.tables import NAMES

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for n in NAMES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{data}/{n}.parquet'")
    return c


def table(rows, columns):
    return sorted(tuple(repr(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    r = duck.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    kinds = {d[0]: str(d[1]) for d in r.description}
    assert {c: KINDS[t] for c, t in df.dtypes} == kinds
    columns = sorted(names)
    assert table([x.asDict() for x in df.collect()], columns) == table([dict(zip(names, x)) for x in r.fetchall()], columns)


def test_every_query_runs(spark, data):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, data).count() >= 1


def test_pushdown(spark, data):
    plan = QUERIES["scan_filter_project"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double,l_shipdate:timestamp_ntz>" in plan
    plan = QUERIES["top_k"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
