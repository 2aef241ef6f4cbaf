"""Every query with SQL against DuckDB, on the smallest tables."""

from decimal import Decimal
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not Path(DATA).exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    return float(v) if isinstance(v, Decimal) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    answer = duck.execute(SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == order
    at = [names.index(c) for c in order]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in answer.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
