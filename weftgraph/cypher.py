"""Running queries: text in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .functions.temporal import Clock
from .plans import tree as t
from .plans.compiler import Compiler
from .plans.errors import CypherError
from .plans.parser import parse
from .sources.graph import Graph


def explain(graph: Graph, statement: t.Statement) -> DataFrame:
    """operator, detail, pushdown, fallback: one row per clause; nothing is run."""
    rows = []
    for branch in statement.query.branches:
        for clause in branch:
            detail = getattr(clause, "patterns", None) or getattr(clause, "items", None) or ""
            labels = sorted({x for n in t.walk(clause) if isinstance(n, t.NodePattern) for x in n.labels} | {x for n in t.walk(clause) if isinstance(n, t.RelPattern) for x in n.types})
            keys = sorted({k for n in t.walk(clause) if isinstance(n, (t.NodePattern, t.RelPattern)) and isinstance(n.props, t.MapOf) for k in n.props.items})
            rows.append((type(clause).__name__, str(len(detail)) + " parts" if detail else "", ", ".join([*labels, *keys]), ""))
    return graph.spark.createDataFrame(rows, "operator string, detail string, pushdown string, fallback string")


def query(graph: Graph, text: str, params: dict | None = None, clock: Clock | None = None) -> DataFrame:
    """The result of one reading statement."""
    statements = parse(text)
    if len(statements) != 1:
        raise CypherError("one statement is expected")
    return read(graph, statements[0], params, clock)


def read(graph: Graph, statement: t.Statement, params: dict | None = None, clock: Clock | None = None) -> DataFrame:
    if statement.mode == "explain":
        return explain(graph, statement)
    if t.writes(statement):
        raise CypherError("a reading query may not write")
    return Compiler(graph, params, clock).run(statement.query)
