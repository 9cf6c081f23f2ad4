"""Every registered query against its DuckDB oracle on the smallest tables
(row count, column names, order-insensitive values)."""

import os

import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, digest

SF = os.environ.get("VARIETA_TEST_SF", "/root/testdata/sf0.001")
QUERIES = E.queries()
SQLS = E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQLS:
        assert len(df.columns) > 0
        return
    res = duck.execute(SQLS[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(dcols, drows)[0]


def test_entry_smoke(spark):
    out = E.entry(spark)
    assert out.count() >= 0
    assert {"model", "split", "variety", "is_cm", "f1_score"} <= set(out.columns)
