"""Every query of the engine against DuckDB on sf0.001."""

import duckdb
import pytest

from verispan import catalogue

WHERE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{WHERE}/{t}.parquet')")
    return con


def text(value):
    if value is None or isinstance(value, float) and value != value:
        return "null"
    return f"{value:.12g}" if isinstance(value, float) else str(value)


def test_every_query_has_an_oracle():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_matches_duckdb(spark, con, name):
    got = catalogue.queries()[name](spark, WHERE)
    want = con.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    mine = sorted(tuple(map(text, r)) for r in got.select(*columns).collect())
    order = [want.columns.index(c) for c in columns]
    theirs = sorted(tuple(text(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in order) for r in want.fetchall())
    assert mine == theirs
