"""DISTINCT in the aggregates that need all values."""

import pytest

from weftgraph import cypher
from weftgraph.sources.graph import from_rows

CASES = [
    ("UNWIND [1, 1, 1, 9] AS x RETURN percentileDisc(DISTINCT x, 0.5) AS d, percentileCont(DISTINCT x, 0.5) AS c", [(9.0, 5.0)]),
    ("UNWIND [1, 1, 1, 9, null] AS x RETURN stdevp(DISTINCT x) AS p, stdev(DISTINCT x) > 5.65 AS s, stdevp(x) < 4 AS q", [(4.0, True, True)]),
    ("UNWIND [7, 7] AS x RETURN stdev(DISTINCT x) AS s, stdevp(DISTINCT x) AS p, percentileCont(DISTINCT x, 0.9) AS c", [(0.0, 0.0, 7.0)]),
    ("UNWIND [0.0, -0.0, 4.0] AS x RETURN percentileCont(DISTINCT x, 0.5) AS c", [(2.0,)]),
    ("UNWIND [1, 2] AS x WITH x WHERE x > 5 RETURN percentileDisc(DISTINCT x, 0.5) AS d, percentileCont(DISTINCT x, 0.5) AS c, stdevp(DISTINCT x) AS p", [(None, None, None)]),
]


@pytest.mark.parametrize(("text", "want"), CASES, ids=[x for x, _ in CASES])
def test_distinct(spark, text, want):
    nodes = spark.createDataFrame([], "id string, labels array<string>, body string")
    edges = spark.createDataFrame([], "id string, from_id string, type string, to_id string, position long")
    assert [tuple(r) for r in cypher.query(from_rows(spark, nodes, edges), text).collect()] == want
