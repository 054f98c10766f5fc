"""startNode and endNode give the stored node with all that belongs to it."""

import pytest

from weftgraph import cypher
from weftgraph.operators.writes import Batch
from weftgraph.plans.parser import parse
from weftgraph.sources.graph import from_rows, over_tables

NODES = "id string, labels array<string>, body string, name string"
EDGES = "id string, from_id string, type string, to_id string, position long, kind string"


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [("a", ["X"], "", "A"), ("b", ["X", "Y"], "text", "B"), ("c", ["Y"], "", "C")]
    edges = [("e1", "a", "R", "b", None, None), ("e2", "b", "R", "c", None, None), ("e3", "a", "S", "c", None, "k")]
    return from_rows(spark, spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


CASES = [
    ("MATCH ()-[r:R]->() RETURN startNode(r).name AS a, endNode(r).name AS b", [("A", "B"), ("B", "C")]),
    ("MATCH (a)-[r:R]->(b) WITH r RETURN endNode(r).name AS n, labels(startNode(r)) AS l", [("B", ["X"]), ("C", ["X", "Y"])]),
    ("MATCH ()-[r]->() WHERE endNode(r).body = 'text' RETURN endNode(r).body AS t", [("text",)]),
    ("MATCH p = (a {name: 'A'})-[:R*2]->(c) RETURN startNode(relationships(p)[0]).name AS a, endNode(relationships(p)[1]).name AS b", [("A", "C")]),
    ("MATCH p = (a {name: 'A'})-[:R*2]->(c) RETURN [r IN relationships(p) | endNode(r).name] AS n", [(["B", "C"],)]),
    ("MATCH p = (a {name: 'A'})-[:R*1..2]->(c) WHERE all(r IN relationships(p) WHERE 'X' IN labels(startNode(r))) RETURN length(p) AS n", [(1,), (2,)]),
    ("MATCH p = (a {name: 'A'})-[:R*2]->(c) RETURN [i IN range(0, 1) | startNode(relationships(p)[i]).name] AS n", [(["A", "B"],)]),
    ("MATCH p = (a {name: 'A'})-[:R*2]->(c) RETURN reduce(s = '', r IN relationships(p) | s + endNode(r).name) AS n", [("BC",)]),
    ("MATCH ()-[r]->() RETURN endNode(r).name AS n, count(*) AS k", [("B", 1), ("C", 2)]),
    ("MATCH ()-[r]->() RETURN type(r) AS t, collect(endNode(r).name)[0] IS NOT NULL AS ok, count(startNode(r)) AS k", [("R", True, 2), ("S", True, 1)]),
    ("MATCH (n) OPTIONAL MATCH (n)-[r:S]->() RETURN n.name AS n, endNode(r).name AS e", [("A", "C"), ("B", None), ("C", None)]),
    ("MATCH ()-[r:R]->() RETURN properties(startNode(r)).name AS n, id(endNode(r)) AS e", [("A", "b"), ("B", "c")]),
]


@pytest.mark.parametrize(("text", "want"), CASES, ids=[x for x, _ in CASES])
def test_ends(graph, text, want):
    assert sorted(map(tuple, cypher.query(graph, text).collect()), key=repr) == sorted(want, key=repr)


def test_over_tables(spark):
    graph = over_tables(spark, "/root/testdata/sf0.001")
    rows = cypher.query(graph, "MATCH (s:Supplier)-[x:LOCATED_IN]->() WITH x RETURN startNode(x).s_name AS s, endNode(x).n_name AS n").collect()
    tables = [spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("supplier", "nation")]
    want = tables[0].join(tables[1], tables[0]["s_nationkey"] == tables[1]["n_nationkey"]).select("s_name", "n_name").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want)) and rows


@pytest.mark.parametrize(
    ("change", "read", "want"),
    [
        ("MATCH ()-[r:R]->(b) SET b.name = startNode(r).name", "MATCH (n) RETURN n.name AS n", [("A",), ("A",), ("B",)]),
        ("MATCH ()-[r:R]->() CREATE (:Z {name: endNode(r).name})", "MATCH (n:Z) RETURN n.name AS n", [("B",), ("C",)]),
        ("MATCH ()-[r:R]->() MERGE (n:Y {name: endNode(r).name})", "MATCH (n:Y) RETURN n.name AS n", [("B",), ("C",)]),
    ],
)
def test_written(graph, change, read, want):
    batch = Batch(graph)
    for statement in parse(change):
        batch.run(statement)
    assert sorted(map(tuple, cypher.query(batch.graph, read).collect())) == want
