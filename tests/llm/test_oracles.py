"""The queries that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from strandloom.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    got = QUERIES[name](spark, SF)
    assert set(got.columns) == set(columns)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(cur.fetchall(), key=key)


def test_every_query_is_registered():
    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [n for i in range(1, 14) for n in QUERIES if n.startswith(f"op{i}_")]
