"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from quaestor.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    plain = lambda v: None if v is None or v != v else repr(round(v, 6)) if isinstance(v, float) else str(v)
    return cols, sorted(tuple(str(plain(v)) for v in r) for r in frame[cols].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.ALL))
def test_query(spark, duck, name):
    run, sql = catalog.ALL[name]
    got = rows(run(spark, DIR).toPandas())
    if sql:
        assert got == rows(duck.sql(sql).df())
    else:
        assert got[1]
