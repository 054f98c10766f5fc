"""Registered queries against their SQL in DuckDB."""

import math

import duckdb
import pytest

from weftgraph import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def comparable(v):
    if isinstance(v, float) or hasattr(v, "is_finite"):
        return round(float(v), 2) if math.isfinite(v) else str(v)
    return v


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_same_rows(spark, sql, name):
    df = queries.queries()[name](spark, SF)
    cursor = sql.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(map(comparable, r)) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(comparable(r[n]) for n in names) for r in df.collect()), key=repr)
    assert got == want
