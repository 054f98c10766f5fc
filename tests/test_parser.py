import pytest

from weftgraph.plans import tree as t
from weftgraph.plans.errors import CypherSyntaxError
from weftgraph.plans.parser import parse


def only(text):
    (statement,) = parse(text)
    return statement.query.branches[0]


def expr(text):
    return only(f"RETURN {text}")[0].items[0].expr


def test_precedence():
    e = expr("1 + 2 * 3 ^ 2 = 19 AND NOT false OR true XOR false")
    assert e.op == "OR" and e.left.op == "AND" and e.right.op == "XOR"
    assert expr("-2 ^ 2").op == "^" and isinstance(expr("-2 ^ 2").left, t.Unary)


def test_chained_comparison_is_a_conjunction():
    e = expr("1 < x <= 3")
    assert e.op == "AND" and (e.left.op, e.right.op) == ("<", "<=")


def test_implicit_names_are_the_source_text():
    assert only("RETURN  a.b+1 , count( * )")[0].items[0].name == "a.b+1"
    assert only("RETURN a.b, count( * )")[0].items[1].name == "count( * )"


@pytest.mark.parametrize(("text", "direction"), [("(a)-[r:X]->(b)", "out"), ("(a)<-[r:X]-(b)", "in"), ("(a)-[r:X]-(b)", "both"), ("(a)<-[r:X]->(b)", "both")])
def test_directions(text, direction):
    assert only(f"MATCH {text} RETURN 1")[0].patterns[0].rels[0].direction == direction


@pytest.mark.parametrize(("text", "length"), [("*", (None, None)), ("*2", (2, 2)), ("*1..3", (1, 3)), ("*..3", (None, 3)), ("*2..", (2, None))])
def test_lengths(text, length):
    found = only(f"MATCH (a)-[{text}]->(b) RETURN 1")[0].patterns[0].rels[0].length
    assert tuple(x.value if x else None for x in found) == length


def test_literals():
    assert [expr(x).value for x in ("0x1F", "0o17", "1.5e3", ".5", r"'a\'A\n'", "null", "TRUE")] == [31, 15, 1500.0, 0.5, "a'A\n", None, True]
    assert expr("-9223372036854775808").value == -(1 << 63)


def test_patterns_and_expressions_in_parentheses():
    assert isinstance(expr("(a)-->(b)"), t.PatternTest)
    assert isinstance(expr("(a) - (b)"), t.Binary)
    assert isinstance(expr("[(a)-->(b) WHERE b.x = 1 | b.y]"), t.PatternList)
    assert isinstance(expr("[x IN [1] WHERE x > 0 | x]"), t.Comprehension)


def test_statements():
    assert [s.mode for s in parse("EXPLAIN RETURN 1; PROFILE RETURN 2; // end\nRETURN 3")] == ["explain", "profile", "run"]


@pytest.mark.parametrize("text", ["", "MATCH (a", "RETURN 1 RETURN 2", "RETURN 1 UNION RETURN 2 UNION ALL RETURN 3", "MATCH (a $p) RETURN a", "RETURN size(DISTINCT 1)", "RETURN 9223372036854775808", "RETURN 'open"])
def test_rejected(text):
    with pytest.raises(CypherSyntaxError):
        parse(text)
