"""Texts of numbers, limits and maps, where a plain Spark function differs."""

import random

import pytest

from weftgraph import cypher
from weftgraph.plans.errors import CypherError
from weftgraph.sources.graph import from_rows


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([("a", ["X"], "", 1, None), ("b", ["X"], "", 2, "t")], "id string, labels array<string>, body string, k long, s string")
    return from_rows(spark, nodes, spark.createDataFrame([], "id string, from_id string, type string, to_id string, position long"))


def one(graph, text, **params):
    return [tuple(r) for r in cypher.query(graph, text, params).collect()]


def shortest(x: float) -> str:
    """Shortest digits with an exponent below 1e-4 and from 1e6 on."""
    digits = repr(x).split("e")[0].replace(".", "").replace("-", "").lstrip("0").rstrip("0")
    exp = int(f"{x:.{len(digits) - 1}e}".partition("e")[2])
    sign = "-" if x < 0 else ""
    if exp < -4 or exp >= 6:
        return f"{sign}{digits[0]}{'.' if digits[1:] else ''}{digits[1:]}e{'-' if exp < 0 else '+'}{abs(exp):02d}"
    if exp < 0:
        return f"{sign}0.{'0' * (-exp - 1)}{digits}"
    return sign + digits[: exp + 1].ljust(exp + 1, "0") + ("." + digits[exp + 1 :] if digits[exp + 1 :] else "")


def test_float_texts(graph):
    r = random.Random(2)
    values = [r.choice((1, -1)) * round(r.random() * 10 ** r.randint(-3, 3), r.randint(1, 4)) * 10.0 ** r.choice((0, 0, 3, 8, -6)) for _ in range(200)]
    values = [v for v in values if v and abs(v) != float("inf") and len(repr(v).split("e")[0]) < 17]
    got = one(graph, "UNWIND $v AS x RETURN x, toString(x) AS t", v=values)
    assert len(got) == len(values) and all(t == shortest(x) for x, t in got)


def test_range_is_limited(graph):
    assert one(graph, "RETURN size(range(1, 1048576)) AS n") == [(1048576,)]
    for text in ("RETURN size(range(0, 1048576)) AS n", "RETURN range(1, 2, 0) AS n", "RETURN size(range(-9223372036854775807, 9223372036854775807)) AS n"):
        with pytest.raises(Exception, match="range"):
            one(graph, text)


def test_replace_and_split_take_any_signs(graph):
    assert one(graph, "RETURN replace($t, '', '-') AS r", t="a\u0001b") == [("-a-\u0001-b-",)]
    assert one(graph, "RETURN replace('', '', 'x') AS r") == [("x",)]
    assert one(graph, "RETURN split($t, $s) AS r", t=r"a\Eb.c", s=r"\E") == [(["a", "b.c"],)]
    assert one(graph, "RETURN split('a.b', '.') AS r") == [(["a", "b"],)]


def test_keys_of_properties_leave_nulls_out(graph):
    assert one(graph, "MATCH (n:X) RETURN n.k AS k, keys(properties(n)) AS p, keys(n) AS q ORDER BY k") == [(1, ["k"], ["k"]), (2, ["k", "s"], ["k", "s"])]
    assert one(graph, "RETURN keys({a: null, b: 1}) AS k") == [(["a", "b"],)]


def test_collect_follows_order(graph):
    text = "UNWIND [[1, 3], [1, null], [2, 9], [1, 2], [2, 10], [1, 3]] AS p WITH p[0] AS g, p[1] AS x ORDER BY x {} WITH g, collect({} x) AS xs RETURN g, xs ORDER BY g"
    assert one(graph, text.format("", "")) == [(1, [2, 3, 3]), (2, [9, 10])]
    assert one(graph, text.format("DESC", "")) == [(1, [3, 3, 2]), (2, [10, 9])]
    assert one(graph, text.format("DESC", "DISTINCT")) == [(1, [3, 2]), (2, [10, 9])]
    assert one(graph, "UNWIND range(1, 9) AS x WITH x ORDER BY x % 3, x DESC WITH x + 0 AS y RETURN collect(y) AS ys") == [([9, 6, 3, 7, 4, 1, 8, 5, 2],)]


def test_truncate_takes_components(graph):
    text = "RETURN toString(date.truncate('month', date('2020-05-17'), {day: 4})) AS a, toString(localdatetime.truncate('day', localdatetime('2020-05-17T10:11:12'), {hour: 3})) AS b, toString(date.truncate('year', date('2020-05-17'))) AS c"
    assert one(graph, text) == [("2020-05-04", "2020-05-17T03:00", "2020-01-01")]


def test_durations_written_like_date_times(graph):
    texts = ["P2012-02-02T14:37:21.545", "P0000-01-01T00:00:00", "P2020-02-29T23:59:59,000000001"]
    query = "UNWIND range(0, 2) AS k RETURN k, toString([" + ", ".join(f"duration('{t}')" for t in texts) + "][k]) AS d"
    got = {r.k: r.d for r in cypher.query(graph, query).collect()}
    assert got == {0: "P2012Y2M2DT14H37M21.545S", 1: "P1M1D", 2: "P2020Y2M29DT23H59M59.000000001S"}
    for text in ("P2012-13-02T14:37:21", "P2021-02-29T00:00:00", "P2012-02-02T24:00:00", "P2012-02-02T14:37"):
        with pytest.raises(CypherError):
            cypher.query(graph, f"RETURN duration('{text}') AS d")
