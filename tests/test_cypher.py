"""Small graphs with literal expected rows."""

import pytest

from weftgraph import cypher
from weftgraph.plans.errors import CypherError
from weftgraph.sources.graph import from_rows

NODES = "id string, labels array<string>, body string, name string, value double"
EDGES = "id string, from_id string, type string, to_id string, position long, kind string"


@pytest.fixture(scope="module")
def graph(spark):
    """A chain a-b-c with a shortcut, a pair of opposite edges and a loop."""
    nodes = [("a", ["X"], "", "a", 1.0), ("b", ["X", "Y"], "text", "b", 2.0), ("c", ["Y"], "", "c", None), ("l", ["Loop"], "", "l", 4.0), ("p", ["P"], "", "p", None), ("q", ["P"], "", "q", None)]
    edges = [("e1", "a", "BLOCKS", "b", None, "keep"), ("e2", "b", "BLOCKS", "c", None, None), ("e3", "a", "OTHER", "c", None, "keep"), ("e4", "l", "LOOP", "l", None, None), ("e5", "p", "R", "q", None, None), ("e6", "q", "R", "p", None, None)]
    return from_rows(spark, spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


def rows(graph, text, **params):
    return sorted(map(tuple, cypher.query(graph, text, params or None).collect()), key=repr)


CASES = [
    ("MATCH (n:X:Y) RETURN n.name AS n", [("b",)]),
    ("MATCH (a)-[:BLOCKS]->(b) RETURN a.name AS a, b.name AS b", [("a", "b"), ("b", "c")]),
    ("MATCH (a {name: 'c'})<-[r]-(b) RETURN b.name AS b, type(r) AS t", [("a", "OTHER"), ("b", "BLOCKS")]),
    ("MATCH (a)-[r:LOOP]-(b) RETURN count(*) AS n", [(1,)]),
    ("MATCH (a)-[r:LOOP]->(a) RETURN count(*) AS n", [(1,)]),
    ("MATCH (a:P)-[r]-(b) RETURN a.name AS a, b.name AS b", [("p", "q"), ("p", "q"), ("q", "p"), ("q", "p")]),
    ("MATCH (a)-[r]->(b)-[s]->(c) RETURN a.name AS a, c.name AS c", [("a", "c"), ("p", "p"), ("q", "q")]),
    ("MATCH (a:P)-[r:R]-(b)-[s:R]-(c) RETURN count(*) AS n", [(4,)]),
    ("MATCH (a {name: 'a'})-[*]->(b) RETURN b.name AS b", [("b",), ("c",), ("c",)]),
    ("MATCH (a {name: 'a'})-[rs*2..]->(b) RETURN b.name AS b, size(rs) AS n, rs[0].kind AS k", [("c", 2, "keep")]),
    ("MATCH (a {name: 'a'})-[*0..0]->(b) RETURN b.name AS b", [("a",)]),
    ("MATCH (l:Loop)-[*1..3]->(x) RETURN count(*) AS n", [(1,)]),
    ("MATCH p = (a {name: 'a'})-[:BLOCKS*]->(c {name: 'c'}) RETURN [x IN nodes(p) | x.name] AS n, length(p) AS l", [(["a", "b", "c"], 2)]),
    ("MATCH p = (c {name: 'c'})<-[*2]-(a) RETURN [x IN nodes(p) | x.name] AS n", [(["c", "b", "a"],)]),
    ("MATCH (a {name: 'a'}), (c {name: 'c'}) MATCH p = shortestPath((a)-[*]->(c)) RETURN length(p) AS l, [r IN relationships(p) | type(r)] AS t", [(1, ["OTHER"])]),
    ("MATCH (a {name: 'a'}), (c {name: 'c'}) MATCH p = allShortestPaths((a)-[:BLOCKS*]-(c)) RETURN [x IN nodes(p) | x.name] AS n", [(["a", "b", "c"],)]),
    ("MATCH p = shortestPath((a:X)-[*]->(c {name: 'c'})) RETURN length(p) AS l", [(1,)]),
    ("MATCH (a {name: 'c'}), (b {name: 'a'}) MATCH p = shortestPath((a)-[*]->(b)) RETURN p", []),
    ("MATCH (a {name: 'a'}), (c {name: 'c'}) MATCH p = shortestPath((a)-[*2..]->(c)) RETURN [x IN nodes(p) | x.name] AS n", [(["a", "b", "c"],)]),
    ("MATCH (n:X) WHERE EXISTS { MATCH (n)-[:OTHER]->() RETURN 1 AS x UNION MATCH (n)-[:NONE]->() RETURN 1 AS x } RETURN n.name AS n", [("a",)]),
    ("MATCH (n) OPTIONAL MATCH (n)-[:BLOCKS]->(m) RETURN n.name AS n, m.name AS m", [("a", "b"), ("b", "c"), ("c", None), ("l", None), ("p", None), ("q", None)]),
    ("OPTIONAL MATCH (n:Nothing) RETURN n", [(None,)]),
    ("MATCH (n) WHERE (n)-[:BLOCKS]->() RETURN n.name AS n", [("a",), ("b",)]),
    ("MATCH (n:X) RETURN n.name AS n, (n)-[:OTHER]->() AS o, EXISTS { (n)-->(m) WHERE m.value > n.value } AS e", [("a", True, True), ("b", False, False)]),
    ("MATCH (n:X) RETURN n.name AS n, size([(n)-[r]->(m) WHERE r.kind = 'keep' | m.name]) AS k", [("a", 2), ("b", 0)]),
    ("MATCH (n) WHERE n.value > 1 OR n.value IS NULL RETURN count(*) AS n", [(5,)]),
    ("MATCH (n) RETURN n.value > 1 AS t, count(*) AS n", [(False, 1), (None, 3), (True, 2)]),
    ("MATCH (n {body: 'text'}) RETURN n.name AS n, body(n) AS b, keys(n) AS k", [("b", "text", ["name", "value"])]),
    ("MATCH (n:X) WITH n, n.name AS m WHERE n.value = 1 RETURN m", [("a",)]),
    ("MATCH (n:X) CALL { WITH n OPTIONAL MATCH (n)-->(m) RETURN count(m) AS k } RETURN n.name AS n, k", [("a", 2), ("b", 1)]),
    ("MATCH (n:X) CALL { RETURN 7 AS k UNION RETURN 8 AS k } RETURN n.name AS n, k", [("a", 7), ("a", 8), ("b", 7), ("b", 8)]),
    ("MATCH ()-[r {kind: $k}]->() RETURN count(r) AS n", [(2,)]),
    ("MATCH (a)-[r]->(b) WHERE startNode(r) = a AND id(endNode(r)) = id(b) RETURN count(*) AS n", [(6,)]),
    ("CALL db.labels()", [("Loop",), ("P",), ("X",), ("Y",)]),
    ("CALL db.propertyKeys() YIELD propertyKey AS k RETURN k", [("body",), ("kind",), ("name",), ("value",)]),
    ("UNWIND [1, 2, 2, null] AS x RETURN count(x) AS a, count(DISTINCT x) AS b, sum(x) AS c, size(collect(DISTINCT x)) AS d, stdev(x) > 0 AS e", [(3, 2, 5, 2, True)]),
    ("UNWIND [5] AS x RETURN stdev(x) AS a, stdevp(x) AS b", [(0.0, 0.0)]),
    ("UNWIND [1, 2, 10, 11] AS x RETURN percentileDisc(x, 0.5) AS d, percentileCont(x, 0.5) AS c", [(10.0, 6.0)]),
    ("UNWIND [] AS x RETURN count(*) AS n, sum(x) AS s, collect(x) AS l", [(0, 0.0, [])]),
    ("UNWIND [1, 2, 3] AS x WITH x ORDER BY x DESC SKIP 1 LIMIT 1 RETURN x", [(2,)]),
    ("RETURN 7 / 2 AS a, -7 / 2 AS b, 7 % -2 AS c, 2 ^ 3 AS d, 1 + 1.5 AS e, 'a' + 'b' AS f, [1] + 2 AS g", [(3, -3, 1, 8.0, 2.5, "ab", [1, 2])]),
    ("RETURN range(5, 1) AS a, range(5, 1, -2) AS b, [1, 2, 3][-1] AS c, [1, 2, 3][5] AS d, [1, 2, 3][1..] AS e, [1, 2, 3][-2..-1] AS f", [([], [5, 3, 1], 3, None, [2, 3], [2])]),
    ("RETURN null IN [] AS a, null IN [1] AS b, 1 IN [1, null] AS c, 3 IN [1, null] AS d, [null] = [1] AS e, null <> null AS f", [(False, None, True, None, None, None)]),
    ("RETURN true XOR null AS a, false AND null AS b, true OR null AS c, NOT null AS d", [(None, False, True, None)]),
    ("RETURN false AND 1 / 0 = 1 AS a, true OR 1 / 0 = 1 AS b", [(False, True)]),
    ("RETURN toString(1.0) AS a, toString(1.5) AS b, toString(-0.25) AS c, toString(1000000.0 * 10) AS d, toString(true) AS e", [("1", "1.5", "-0.25", "1e+07", "true")]),
    ("RETURN split('a.b', '.') AS a, replace('aXa', 'X', '') AS b, replace('ab', '', '-') AS c, substring('hello', 1) AS d, trim(' \t x ') AS e, size('日本') AS f", [(["a", "b"], "aa", "-a-b-", "ello", "x", 2)]),
    ("RETURN head([]) AS a, last([1, 2]) AS b, tail([1]) AS c, reverse('abc') AS d, coalesce(null, 2) AS e, sign(-2.5) AS f, ceil(1.2) AS g", [(None, 2, [], "cba", 2, -1, 2.0)]),
    ("RETURN single(x IN [1, 2] WHERE x = 1) AS a, single(x IN [1, null] WHERE x = 1) AS b, none(x IN [] WHERE x) AS c, all(x IN [1, null] WHERE x = 1) AS d", [(True, None, True, None)]),
    ("RETURN reduce(a = '', x IN ['p', 'q'] | a + x) AS s, reduce(a = 0, x IN [1, 2] | a + x / 2.0) AS f", [("pq", 1.5)]),
    ("RETURN {a: 1, b: {c: 'x'}}.b.c AS a, {a: 1}['a'] AS b, {a: 1} = {a: 1} AS c, {a: 1} = {b: 1} AS d", [("x", 1, True, False)]),
    ("RETURN duration('P1M') = duration('P30D') AS a, duration('P1M') < duration('P2M') AS b, date('2020-01-31') + duration('P1M') AS c", [(False, None, __import__("datetime").date(2020, 2, 29))]),
    ("RETURN toString(duration.between(date('2020-01-31'), date('2020-03-01'))) AS a, toString(duration('PT90M') * 2) AS b, duration('P1Y2M').monthsOfYear AS c", [("P1M1D", "PT3H", 2)]),
]


@pytest.mark.parametrize(("text", "want"), CASES, ids=[c[0][:60] for c in CASES])
def test_rows(graph, text, want):
    assert rows(graph, text, k="keep") == sorted(want, key=repr)


@pytest.mark.parametrize(
    "text",
    ["RETURN x", "RETURN 1 AS a, 2 AS a", "MATCH (n) WITH n.name RETURN 1", "RETURN nothing(1)", "MATCH (n) WHERE n.name RETURN n", "RETURN 'a' - 1", "RETURN count(count(1))", "RETURN 1 AS a LIMIT -1", "RETURN $missing", "RETURN 1 AS a UNION RETURN 1 AS b", "CALL no.such()", "RETURN *", "CREATE (n)", "MATCH (a)-[r]->(b)-[r]->(c) RETURN a"],
)
def test_rejected(graph, text):
    with pytest.raises(CypherError):
        cypher.query(graph, text).collect()


def test_explain_runs_nothing(graph):
    df = cypher.query(graph, "EXPLAIN MATCH (n:X {name: 'a'}) RETURN n")
    assert df.columns == ["operator", "detail", "pushdown", "fallback"] and df.first().operator == "Match"


def test_filters_reach_the_scan(spark):
    from weftgraph.sources.graph import over_tables

    df = cypher.query(over_tables(spark, "/root/testdata/sf0.001"), "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_orderstatus = 'F' RETURN c.c_mktsegment AS s, count(*) AS n")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and plan.count("FileScan") == 2
    assert "o_totalprice" not in plan and "c_name" not in plan


def test_a_foreign_key_needs_no_join_of_its_own(spark):
    from weftgraph.sources.graph import over_tables

    df = cypher.query(over_tables(spark, "/root/testdata/sf0.001"), "MATCH (s:Supplier)-[:LOCATED_IN]->(n:Nation)<-[:CHILD]-(r:Region) RETURN r.r_name AS r, count(s) AS n")
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 3
