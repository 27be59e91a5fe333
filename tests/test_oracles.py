"""Every registered query of the speech operators against its SQL in DuckDB."""

import math
from collections import Counter

import duckdb
import pytest

from vocalith.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    res = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    want = sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in res.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["edit_counts", "length_scatter"])
def test_rows_of_odd_texts_are_those_of_the_sql_in_type_and_to_the_last_bit(spark, tmp_path, name):
    texts = ["", " ", "\n\t ", "!!!", "<a>", "+um+", "a", "a b " * 20, "a " * 39, "a " * 41, "a b c " * 27, " x\u0085y\u000bz", "日本", "zz zz " * 30, "<a> +b+ <c", "' it's"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    df, res = catalog.QUERIES[name](spark, str(tmp_path)), con.execute(catalog.ORACLES[name])
    types = {"VARCHAR": "string", "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double"}
    assert df.dtypes == [(d[0], types[str(d[1])]) for d in res.description]
    want = Counter(res.fetchall())
    assert Counter(map(tuple, df.collect())) == want and any(math.isinf(r[-1]) for r in want)


@pytest.mark.parametrize("name", ["edit_counts", "length_scatter"])
def test_rows_of_null_and_repeated_documents_are_those_of_the_sql(spark, tmp_path, name):
    rows = [(1, None), (2, "\u0130stanbul x"), (3, "a\u0130b " * 50), (4, "a b " * 30), (4, "a b " * 30), (4, "c d"), (None, "a b"), (None, "a b"), (None, None), (5, None), (5, "")]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    df, res = catalog.QUERIES[name](spark, str(tmp_path)), con.execute(catalog.ORACLES[name])
    assert df.columns == [d[0] for d in res.description]
    assert Counter(map(tuple, df.collect())) == Counter(res.fetchall())
