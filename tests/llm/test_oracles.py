"""Queries with SQL give DuckDB's rows."""

import duckdb
import pytest

from millrace.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_same_as_duckdb(spark, data, name, size):
    folder = data.replace("0.001", size)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    r = c.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    df = QUERIES[name](spark, folder)
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(x[n] for n in names) for x in df.collect()) == sorted(map(tuple, r.fetchall()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb_on_odd_rows(spark, docs, corpus, name, tmp_path):
    docs.drop_duplicates(["doc_id"]).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    r = c.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    df = QUERIES[name](spark, str(tmp_path))
    assert sorted(tuple(x[n] for n in names) for x in df.collect()) == sorted(map(tuple, r.fetchall()))
