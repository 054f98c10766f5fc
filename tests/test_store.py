"""Writes, revisions and time travel."""

import pytest

from weftgraph import cypher
from weftgraph.operators.writes import execute
from weftgraph.plans.errors import CypherError
from weftgraph.sources import render
from weftgraph.sources.store import Store
from weftgraph.streaming.results import stream


def rows(graph, text):
    return sorted(map(tuple, cypher.query(graph, text).collect()), key=repr)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("graph")))
    _, first = execute(s, "CREATE (a:Task {title: 'a', rank: 1})-[:CHILD {position: 0}]->(b:Task {title: 'b', rank: 2}) RETURN a.title AS t", actor="me", message="first")
    assert (first["revision"], first["nodes_created"], first["relationships_created"]) == (1, 2, 1)
    results, second = execute(s, "MATCH (n:Task {title: 'b'}) SET n.rank = 5, n:Done RETURN n.rank AS r; MATCH (n:Done) RETURN count(*) AS n")
    assert [[tuple(r) for r in d.collect()] for d in results] == [[(5,)], [(1,)]] and second["revision"] == 2
    results, third = execute(s, "UNWIND ['a', 'c', 'c'] AS t MERGE (n:Task {title: t}) ON CREATE SET n.rank = 9 ON MATCH SET n.seen = true RETURN n.title AS t, n.rank AS r")
    assert sorted(map(tuple, results[0].collect())) == [("a", 1), ("c", 9), ("c", 9)] and third["nodes_created"] == 1
    return s


def test_time_travel(store):
    by = lambda r: rows(store.graph(r), "MATCH (n:Task) RETURN n.title AS t, n.rank AS r, n:Done AS d")
    assert by(0) == []
    assert by(1) == [("a", 1, False), ("b", 2, False)]
    assert by(2) == [("a", 1, False), ("b", 5, True)]
    assert by(3) == [("a", 1, False), ("b", 5, True), ("c", 9, False)]
    with pytest.raises(CypherError):
        store.graph(99)
    first = store.revisions().where("revision = 1").first().committed_ns
    assert store.resolve(at_ns=first) == 1 and store.resolve(at_ns=first - 1) == 0


def test_history_and_revisions(store):
    versions = [(r.title, r.valid_from, r.valid_to) for r in store.history().where("title = 'b'").collect()]
    assert sorted(versions) == [("b", 1, 2), ("b", 2, None)]
    assert rows(store.graph(), "CALL graph.revisions(2) YIELD revision, actor, message, next RETURN revision, actor, message, next") == [(1, "me", "first", 2), (2, "", "", 2)]
    assert store.status()["revision"] == 3


def test_failures_change_nothing(store):
    for text in ("MATCH (n:Task {title: 'a'}) DELETE n", "MATCH (a:Task {title: 'a'}), (b:Task {title: 'b'}) CREATE (b)-[:CHILD]->(a)", "MERGE (n:Task {title: null})"):
        with pytest.raises(CypherError):
            execute(store, text)
    assert store.last() == 3


@pytest.mark.parametrize(
    "text",
    [
        "MATCH (n:Task {title: 'b'}) DETACH DELETE n RETURN n.title AS t",
        "MATCH (n:Task {title: 'b'}) DETACH DELETE n WITH n AS m RETURN labels(m) AS l",
        "MATCH (n:Task {title: 'b'}) DETACH DELETE n RETURN keys(n) AS k",
        "MATCH (:Task {title: 'a'})-[r:CHILD]->(n) DETACH DELETE n RETURN r.position AS p",
        "MATCH (n:Task {title: 'b'}), (m:Task {title: 'b'}) DETACH DELETE n RETURN m.title AS t",
    ],
)
def test_deleted_is_not_read(store, text):
    with pytest.raises(Exception, match="deleted node or relationship"):
        execute(store, text)
    assert store.last() == 3


def test_no_change_no_revision(store):
    _, summary = execute(store, "CREATE (x:Tmp) WITH x DETACH DELETE x")
    assert summary["revision"] is None and store.last() == 3


def test_streamed_rows(store):
    events = list(stream(store.graph(), "MATCH (n:Task) RETURN n.title AS t"))
    assert events[0] == ("start", ["t"]) and events[-1] == ("end", 3) and len(events) == 5
    with pytest.raises(CypherError):
        next(stream(store.graph(), "CREATE (n)"))


def test_rendering(store):
    df = cypher.query(store.graph(), "RETURN date('2020-01-02') AS d, duration('P1DT2S') AS u, 0.0 / 0 AS n, [1, null] AS l")
    row = df.first()
    assert [render.plain(v) for v in row] == [{"$date": "2020-01-02"}, {"$cypher_duration": "P1DT2S"}, {"$float": "NaN"}, [1, None]]
    assert render.as_table(["a", "b"], [(1, "x")]).splitlines() == ["a | b", "--+--", "1 | x"]
    with pytest.raises(ValueError):
        render.parse_json('{"a": {"b": 1, "b": 2}}')


def test_event_stream_is_committed_once(spark, tmp_path):
    from weftgraph.streaming import events

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(50).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = events.read(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    s = Store(spark, str(tmp_path / "graph"))
    for _ in range(2):
        events.append(source, s, str(tmp_path / "state")).awaitTermination()
    assert s.last() == 1 and rows(s.graph(), "MATCH (:User)-[:DID]->(e:Event) RETURN count(e) AS n") == [(50,)]


def _nodes(spark, *names, deleted=False):
    return spark.createDataFrame([(n, ["N"], "", deleted) for n in names], "id string, labels array<string>, body string, deleted boolean")


def _edges(spark, *rows):
    return spark.createDataFrame([(f"{a}-{b}", a, t, b, p, False) for a, t, b, p in rows], "id string, from_id string, type string, to_id string, position long, deleted boolean")


def test_interrupted_commit_is_never_read(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "g"))
    s.commit(_nodes(spark, "one"), _edges(spark))

    def fail(*_):
        raise OSError("the power went")

    monkeypatch.setattr("weftgraph.sources.store.time.time_ns", fail)
    with pytest.raises(OSError):
        s.commit(_nodes(spark, "ghost"), _edges(spark))
    monkeypatch.undo()
    s.commit(_nodes(spark, "two"), _edges(spark))
    assert s.last() == 2 and sorted(r.id for r in s.at("nodes", 2).collect()) == ["one", "two"]
    assert s.problems().collect() == []


def test_store_holds_its_rules(spark, tmp_path):
    s = Store(spark, str(tmp_path / "g"))
    s.commit(_nodes(spark, "a", "b", "c"), _edges(spark, ("a", "CHILD", "b", 0)))
    none = _nodes(spark)
    bad = [(none, _edges(spark, ("a", "R", "x", None))), (none, _edges(spark, ("a", "R", "b", 1))), (none, _edges(spark, ("c", "CHILD", "b", 0))), (_nodes(spark, "b", deleted=True), _edges(spark)), (_nodes(spark, "d", "d"), _edges(spark))]
    for nodes, edges in bad:
        with pytest.raises(CypherError):
            s.commit(nodes, edges)
    assert s.last() == 1
    s.commit(_nodes(spark, "d"), _edges(spark, ("d", "R", "a", None)))
    assert s.status() == {"revision": 2, "nodes": 4, "edges": 2}


def test_two_streams_feed_one_store(spark, tmp_path):
    from weftgraph.streaming import events

    s = Store(spark, str(tmp_path / "g"))
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    for name, first, n in (("x", 0, 5), ("y", 100, 7)):
        rows = spark.range(first, first + n).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id % 2 AS user_id", "'t' AS event_type")
        rows.write.parquet(str(tmp_path / name))
        for _ in range(2):  # a second start finds nothing new
            events.append(events.read(spark, str(tmp_path / name), schema), s, str(tmp_path / f"check-{name}")).awaitTermination()
    assert rows_of(s) == 12 and s.last() == 2


def rows_of(s):
    return rows(s.graph(), "MATCH (e:Event) RETURN count(*) AS n")[0][0]


def test_ids_and_others_are_read_after_a_deletion(spark, tmp_path):
    s = Store(spark, str(tmp_path / "g"))
    execute(s, "CREATE (a:Task {title: 'a'})-[:CHILD {position: 0}]->(b:Task {title: 'b'})")
    text = "MATCH (a:Task {title: 'a'})-[r:CHILD]->(n) DELETE r RETURN a.title AS t, n.title AS u, type(r) AS k, id(r) IS NULL AS i"
    results, summary = execute(s, text)
    assert [tuple(r) for r in results[0].collect()] == [("a", "b", "CHILD", False)] and summary["relationships_deleted"] == 1
    results, _ = execute(s, "MATCH (n:Nothing) DELETE n RETURN n.title AS t")
    assert results[0].collect() == []
