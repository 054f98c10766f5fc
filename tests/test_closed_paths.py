"""Paths that end where they began, against plain loops and SQL."""

import random
from collections import Counter

import duckdb
import pytest

from weftgraph import cypher, queries
from weftgraph.plans.compiler import Compiler
from weftgraph.sources.graph import from_rows, over_tables

SMALL = "/root/testdata/sf0.001"
RANDOM = random.Random(3)
NODES = {f"n{k}": "XY"[k % 2] for k in range(6)}
EDGES = {f"e{k}": (RANDOM.choice(list(NODES)), RANDOM.choice("RRS"), RANDOM.choice(list(NODES))) for k in range(24)}


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(k, [v], "") for k, v in NODES.items()], "id string, labels array<string>, body string")
    edges = spark.createDataFrame([(k, a, kind, b, None) for k, (a, kind, b) in EDGES.items()], "id string, from_id string, type string, to_id string, position long")
    return from_rows(spark, nodes, edges)


def walks(steps, labels):
    """Node and relationship ids of each closed trail."""
    out = []

    def grow(nodes, rels):
        if len(rels) == len(steps):
            if nodes[0] == nodes[-1]:
                out.append((tuple(nodes), tuple(rels)))
            return
        kind, direction = steps[len(rels)]
        for e, (a, k, b) in EDGES.items():
            if k != kind or e in rels:
                continue
            for way, x, y in (("out", a, b), ("in", b, a)):
                if direction in (way, "both") and nodes[-1] == x and not (direction == "both" and way == "in" and a == b):
                    if labels.get(len(nodes)) in (None, NODES[y]):
                        grow([*nodes, y], [*rels, e])

    for n in NODES:
        if labels.get(0) in (None, NODES[n]):
            grow([n], [])
    return out


@pytest.mark.parametrize(
    ("text", "steps", "labels"),
    [
        ("(a)-[:R]->(b)-[:R]->(c)-[:R]->(d)-[:R]->(a)", [("R", "out")] * 4, {}),
        ("(a)-[:R]-(b)<-[:S]-(c)-[:R]->(d:X)-[:R]-(a:Y)", [("R", "both"), ("S", "in"), ("R", "out"), ("R", "both")], {0: "Y", 3: "X", 4: "Y"}),
        ("(a:X)-[:R]->(b)<-[:R]-(c)-[:S]->(d)<-[:R]-(e)-[:R]-(a)", [("R", "out"), ("R", "in"), ("S", "out"), ("R", "in"), ("R", "both")], {0: "X"}),
    ],
)
def test_trails(graph, text, steps, labels, monkeypatch):
    used = []
    monkeypatch.setattr(Compiler, "closed", lambda *a, f=Compiler.closed: used.append(1) or f(*a))
    rows = cypher.query(graph, f"MATCH p = {text} RETURN [x IN nodes(p) | id(x)] AS n, [x IN relationships(p) | id(x)] AS r, id(a) AS a, id(b) AS b").collect()
    want = Counter(walks(steps, labels))
    assert Counter((tuple(r.n), tuple(r.r)) for r in rows) == want and want and used
    assert all((r.a, r.b) == (r.n[0], r.n[1]) for r in rows)
    assert cypher.query(graph, f"MATCH {text} RETURN count(*) AS n").first().n == want.total()


CYCLE = "(s:Supplier)-[:LOCATED_IN]->(n:Nation)-[:CHILD]->(c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part)<-[:SUPPLIES]-(s)"


def test_properties_around(spark):
    graph = over_tables(spark, SMALL)
    rows = cypher.query(graph, f"MATCH {CYCLE} RETURN n.n_name AS n, c.c_mktsegment AS m, o.o_orderstatus AS o, sum(l.l_linenumber) AS l, min(p.p_size) AS p, min(s.s_name) AS s, count(*) AS k").collect()
    sql = duckdb.connect()
    for t in ("supplier", "nation", "customer", "orders", "lineitem", "part"):
        sql.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    want = sql.execute(
        "SELECT n_name, c_mktsegment, o_orderstatus, CAST(sum(l_linenumber) AS BIGINT), min(p_size), min(s_name), count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey"
        " JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN (SELECT DISTINCT l_suppkey AS sk, l_partkey AS pk FROM lineitem) ON sk = s_suppkey AND pk = p_partkey GROUP BY 1, 2, 3"
    ).fetchall()
    assert sorted(map(tuple, rows)) == sorted(want) and want


@pytest.mark.parametrize("text", [f"MATCH {CYCLE.replace('(s:Supplier)', '(s:Supplier {s_suppkey: 1})')}", f"MATCH {CYCLE} WHERE s.s_suppkey = 1"])
def test_one_start_is_searched_from(spark, text, monkeypatch):
    used = []
    monkeypatch.setattr(Compiler, "closed", lambda *a, f=Compiler.closed: used.append(1) or f(*a))
    cypher.query(over_tables(spark, SMALL), f"{text} RETURN count(*) AS n")
    assert not used


def joined(plan) -> list[int]:
    """Rows of each join of a plan that has run."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return joined(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return joined(plan.plan())
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in name and plan.metrics().contains("numOutputRows") else []
    return own + [n for k in range(plan.children().size()) for n in joined(plan.children().apply(k))]


def test_no_join_makes_more_rows_than_lines_and_results(spark):
    """Suppliers aren't paired with all customers of their nation."""
    df = queries.queries()["repeated_variable"](spark, "/root/testdata/sf0.01")
    found = df.collect()[0].n
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").count()
    rows = joined(df._jdf.queryExecution().executedPlan())
    assert rows and 0 < max(rows) <= max(lines, found), rows
