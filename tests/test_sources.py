import pytest

from weftgraph import cypher
from weftgraph.plans.errors import CypherError
from weftgraph.sources import pages
from weftgraph.sources.generated import work_graph
from weftgraph.sources.graph import over_tables


def test_pages_follow_each_other(spark):
    graph = over_tables(spark, "/root/testdata/sf0.001")
    df = pages.where_nodes(graph, labels=["Nation"])
    seen, cursor = [], None
    while True:
        rows, cursor = pages.page(df, "nations", limit=10, cursor=cursor)
        seen += [r["id"] for r in rows]
        if cursor is None:
            break
    assert seen == sorted(f"Nation:{k}" for k in range(25))
    _, cursor = pages.page(df, "nations", limit=10)
    for fingerprint, revision in (("other", 0), ("nations", 1)):
        with pytest.raises(CypherError):
            pages.page(df, fingerprint, revision, cursor=cursor)


def test_predicates(spark):
    graph = over_tables(spark, "/root/testdata/sf0.001")
    assert pages.where_nodes(graph, ids=["Nation:3", "Region:1"]).count() == 2
    assert pages.where_nodes(graph, labels=["Nation"], props={"n_name": "NATION_3"}).first()["id"] == "Nation:3"
    assert pages.where_edges(graph, types=["CHILD"], from_ids=["Region:0", "Region:1"]).count() == 10


def test_generated_graph_is_a_forest(spark):
    graph = work_graph(spark, 200, 300)
    assert cypher.query(graph, "MATCH (r)-[:CHILD*]->(x) WHERE NOT ()-[:CHILD]->(r) RETURN count(x) AS n").first().n == 199
    assert cypher.query(graph, "MATCH ()-[r:DEPENDS_ON|RELATES_TO|BLOCKS]->() RETURN count(r) AS n").first().n == 300
