"""Every query with a DuckDB twin gives the same rows as it does, on the smallest tables."""

import duckdb
import pytest
from tamis.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "customer orders documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(str, frame.astype(object).where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", list(QUERIES))
def test_twin(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(want)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE_SQL)
