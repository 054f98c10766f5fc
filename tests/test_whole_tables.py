"""Queries that must cover whole tables, on a size at which a subset would show."""

import duckdb
import pytest

from weftgraph import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["shortest_path_len", "all_shortest_suppliers"])
def test_whole_table(spark, name):
    sql = duckdb.connect()
    for t in ("conversations", "lineitem", "supplier", "part"):
        sql.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = sql.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in queries.queries()[name](spark, SF).collect()) == want


def test_every_conversation_is_searched(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").where("turn > 0").select("conv_id").distinct().count()
    assert queries.queries()["shortest_path_len"](spark, SF).select("c").distinct().count() == turns > 20


def test_ties_of_more_than_one_start(spark):
    rows = queries.queries()["all_shortest_suppliers"](spark, SF).collect()
    assert len({r.a for r in rows}) > 1 and max(r.n for r in rows) > 1
