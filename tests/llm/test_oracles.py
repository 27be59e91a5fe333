"""The queries that SQL can state against DuckDB."""

import duckdb
import pytest

from vocalith.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    res = con.execute(queries.ORACLES[name])
    names = [d[0] for d in res.description]
    want = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in res.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == want
