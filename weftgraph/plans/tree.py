"""Syntax tree of a query."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class Expr:
    text: str = field(default="", kw_only=True)


@dataclass
class Lit(Expr):
    value: Any


@dataclass
class Param(Expr):
    name: str


@dataclass
class Var(Expr):
    name: str


@dataclass
class Prop(Expr):
    of: Expr
    key: str


@dataclass
class Index(Expr):
    of: Expr
    at: Expr


@dataclass
class Slice(Expr):
    of: Expr
    start: Expr | None
    stop: Expr | None


@dataclass
class ListOf(Expr):
    items: list[Expr]


@dataclass
class MapOf(Expr):
    items: dict[str, Expr]


@dataclass
class Unary(Expr):
    op: str
    of: Expr


@dataclass
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass
class IsNull(Expr):
    of: Expr
    negated: bool


@dataclass
class HasLabels(Expr):
    of: Expr
    labels: list[str]


@dataclass
class Call(Expr):
    name: str
    args: list[Expr]
    distinct: bool = False
    star: bool = False


@dataclass
class Case(Expr):
    subject: Expr | None
    whens: list[tuple[Expr, Expr]]
    default: Expr | None


@dataclass
class Comprehension(Expr):
    var: str
    source: Expr
    where: Expr | None
    value: Expr | None


@dataclass
class Quantifier(Expr):
    kind: str
    var: str
    source: Expr
    where: Expr | None


@dataclass
class Reduce(Expr):
    acc: str
    start: Expr
    var: str
    source: Expr
    value: Expr


@dataclass
class NodePattern:
    var: str | None
    labels: list[str]
    props: Expr | None


@dataclass
class RelPattern:
    var: str | None
    types: list[str]
    direction: str  # out, in, both
    props: Expr | None
    length: tuple[Expr | None, Expr | None] | None = None


@dataclass
class PathPattern:
    var: str | None
    nodes: list[NodePattern]
    rels: list[RelPattern]
    shortest: str | None = None  # one, all


@dataclass
class PatternTest(Expr):
    pattern: PathPattern


@dataclass
class PatternList(Expr):
    pattern: PathPattern
    where: Expr | None
    value: Expr


@dataclass
class Exists(Expr):
    query: Query


@dataclass
class Item:
    expr: Expr
    alias: str | None

    @property
    def name(self) -> str:
        return self.alias or self.expr.text


@dataclass
class Match:
    patterns: list[PathPattern]
    where: Expr | None
    optional: bool


@dataclass
class Unwind:
    source: Expr
    var: str


@dataclass
class Project:
    """WITH or RETURN."""

    items: list[Item]
    star: bool
    distinct: bool
    order: list[tuple[Expr, bool]]
    skip: Expr | None
    limit: Expr | None
    where: Expr | None
    final: bool


@dataclass
class Create:
    patterns: list[PathPattern]


@dataclass
class SetItem:
    target: Expr  # Prop, Var or HasLabels
    value: Expr | None
    add: bool = False


@dataclass
class Merge:
    pattern: PathPattern
    on_create: list[SetItem]
    on_match: list[SetItem]


@dataclass
class Set:
    items: list[SetItem]


@dataclass
class Remove:
    items: list[Expr]


@dataclass
class Delete:
    items: list[Expr]
    detach: bool


@dataclass
class CallQuery:
    query: Query


@dataclass
class CallProcedure:
    name: str
    args: list[Expr]
    yields: list[tuple[str, str]] | None  # None: no YIELD; empty: *
    where: Expr | None


@dataclass
class Query:
    """Branches of a UNION, each a list of clauses."""

    branches: list[list]
    keep_all: bool = True


@dataclass
class Statement:
    query: Query
    mode: str = "run"  # run, explain, profile


WRITES = (Create, Merge, Set, Remove, Delete)


def walk(node: Any):
    """The node and all below it."""
    if isinstance(node, (list, tuple)):
        for x in node:
            yield from walk(x)
    elif isinstance(node, dict):
        for x in node.values():
            yield from walk(x)
    elif hasattr(node, "__dataclass_fields__"):
        yield node
        for name in node.__dataclass_fields__:
            yield from walk(getattr(node, name))


def writes(node: Any) -> bool:
    return any(isinstance(x, WRITES) for x in walk(node))
