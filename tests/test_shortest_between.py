"""Shortest paths from all nodes of one pattern to all of another, counted against a plain search."""

import random
from collections import Counter, defaultdict

import pytest

from weftgraph import cypher
from weftgraph.operators import paths
from weftgraph.sources.graph import EdgeTable, Graph, NodeTable, from_rows

RANDOM = random.Random(5)
X, Y = range(12), range(9)
R = [(RANDOM.choice(X), RANDOM.choice(Y)) for _ in range(30)] + [(1, 1), (1, 1)]  # parallel ones too
S = [(RANDOM.choice(Y), RANDOM.choice(X)) for _ in range(8)]


@pytest.fixture(scope="module", params=["keyed", "rows"])
def graph(spark, request):
    if request.param == "keyed":
        x = spark.createDataFrame([(k, k % 3) for k in X], "k long, g long")
        y = spark.createDataFrame([(k, k % 3) for k in Y], "k long, g long")
        r = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(R)], "i long, x long, y long")
        s = spark.createDataFrame([(i, b, a) for i, (a, b) in enumerate(S)], "i long, x long, y long")
        edges = [EdgeTable(r, "R", "X", "Y", "x", "y", ("r", "i")), EdgeTable(s, "S", "Y", "X", "y", "x", ("s", "i"))]
        return Graph(spark, [NodeTable(x, "X", "k"), NodeTable(y, "Y", "k")], edges)
    nodes = [(f"{label}:{k}", [label], "", k, k % 3) for label, keys in (("X", X), ("Y", Y)) for k in keys]
    edges = [(f"r{i}", f"X:{a}", "R", f"Y:{b}", None) for i, (a, b) in enumerate(R)] + [(f"s{i}", f"Y:{a}", "S", f"X:{b}", None) for i, (a, b) in enumerate(S)]
    return from_rows(spark, spark.createDataFrame(nodes, "id string, labels array<string>, body string, k long, g long"), spark.createDataFrame(edges, "id string, from_id string, type string, to_id string, position long"))


def plain(types, direction, lo, hi, one):
    """(start, end): length and number of shortest paths."""
    near = defaultdict(list)
    for kind, pairs, (f, t) in (("R", R, "XY"), ("S", S, "YX")):
        for a, b in pairs if kind in types else ():
            for out, m, n in (("out", (f, a), (t, b)), ("in", (t, b), (f, a))):
                if direction in (out, "both"):
                    near[m].append(n)
    found = {}
    for start in [("X", k) for k in X] + [("Y", k) for k in Y]:
        level, at, seen = 0, Counter({start: 1}), {start}
        if lo == 0:
            found[start, start] = (0, 1)
        while at and (hi is None or level < hi):
            level, nxt = level + 1, Counter()
            for n, k in at.items():
                for m in near[n]:
                    if m not in seen:
                        nxt[m] += k
            seen |= set(nxt)
            found |= {(start, n): (level, 1 if one else k) for n, k in nxt.items()}
            at = nxt
    return found


@pytest.mark.parametrize(
    ("ends", "where", "kind", "rel", "plainly"),
    [
        ("(a:X), (b:X {g: 1})", "id(a) <> id(b)", "all", "-[:R*..2]-", ("R", "both", 1, 2)),
        ("(a:X {g: 1}), (b:X)", "id(a) <> id(b)", "all", "-[:R*..4]-", ("R", "both", 1, 4)),
        ("(a:X), (b:Y {g: 1})", "a.k < 8 AND b.k <> 4", "all", "-[:R*]-", ("R", "both", 1, None)),
        ("(a:Y), (b:X {g: 1})", "a.g <> b.k", "all", "<-[:R|S*..3]-", ("RS", "in", 1, 3)),
        ("(a:X), (b:X)", "true", "one", "-[:R|S*0..]->", ("RS", "out", 0, None)),
        ("(a:X {g: 2}), (b:Y)", "true", "one", "-[:R*]->", ("R", "out", 1, None)),
    ],
)
def test_between(graph, ends, where, kind, rel, plainly, monkeypatch):
    used = []
    monkeypatch.setattr(paths, "between", lambda *a, f=paths.between: used.append(1) or f(*a))
    name = {"all": "allShortestPaths", "one": "shortestPath"}[kind]
    text = f"MATCH {ends} WHERE {where} MATCH p = {name}((a){rel}(b)) RETURN id(a) AS a, id(b) AS b, length(p) AS l, count(*) AS n"
    rows = sorted(map(tuple, cypher.query(graph, text).collect()))
    la, lb = ends.split("(a:")[1][0], ends.split("(b:")[1][0]
    groups = [int(x.split("}")[0]) if (x := (part.split("g: ")[1:] or [""])[0]) else None for part in ends.split(", ")]
    test = {"id(a) <> id(b)": lambda a, b: a != b, "a.k < 8 AND b.k <> 4": lambda a, b: a[1] < 8 and b[1] != 4, "a.g <> b.k": lambda a, b: a[1] % 3 != b[1], "true": lambda a, b: True}[where]
    want = sorted(
        (f"{a[0]}:{a[1]}", f"{b[0]}:{b[1]}", length, n)
        for (a, b), (length, n) in plain(*plainly, kind == "one").items()
        if a[0] == la and b[0] == lb and groups[0] in (None, a[1] % 3) and groups[1] in (None, b[1] % 3) and test(a, b)
    )
    assert rows == want and want and used


def test_no_table_of_pairs(spark, monkeypatch):
    """Of 500 nodes and 500 others with a few relationships no table of all pairs is written."""
    nodes = [(f"{x}{k}", [x], "") for x in "AB" for k in range(500)]
    edges = [(f"e{k}", f"A{k}", "R", f"B{k + 1}", None) for k in range(99)]
    graph = from_rows(spark, spark.createDataFrame(nodes, "id string, labels array<string>, body string"), spark.createDataFrame(edges, "id string, from_id string, type string, to_id string, position long"))
    rows = []

    def stored(df, f=paths.stored):
        df = f(df)
        rows.append(df.count())
        return df

    monkeypatch.setattr(paths, "stored", stored)
    found = cypher.query(graph, "MATCH (a:A), (b:B) WHERE id(a) <> id(b) MATCH p = allShortestPaths((a)-[:R*..2]-(b)) RETURN length(p) AS l, count(*) AS n").collect()
    assert list(map(tuple, found)) == [(1, 99)] and rows and max(rows) <= 500


def test_many_paths_of_a_pair(spark):
    """More paths than one list of rows takes."""
    nodes = [("a", ["A"], ""), ("m", ["M"], ""), ("b", ["B"], "")]
    edges = [(f"e{k}", "a", "R", "m", None) for k in range(60)] + [(f"f{k}", "m", "R", "b", None) for k in range(50)]
    graph = from_rows(spark, spark.createDataFrame(nodes, "id string, labels array<string>, body string"), spark.createDataFrame(edges, "id string, from_id string, type string, to_id string, position long"))
    found = cypher.query(graph, "MATCH (a:A), (b:B) MATCH p = allShortestPaths((a)-[:R*]->(b)) RETURN length(p) AS l, count(*) AS n").collect()
    assert list(map(tuple, found)) == [(2, 3000)]


def test_random_tests_are_of_pairs(graph, monkeypatch):
    """A random value is drawn for each pair, so that the pairs are made."""
    used = []
    monkeypatch.setattr(paths, "between", lambda *a, f=paths.between: used.append(1) or f(*a))
    found = cypher.query(graph, "MATCH (a:X), (b:Y) WHERE a.k + rand() >= 0 MATCH p = shortestPath((a)-[:R]->(b)) RETURN length(p) AS l, count(*) AS n").collect()
    assert list(map(tuple, found)) == [(1, len(set(R)))] and not used
