"""Queries compiled to DataFrames.

A query is a chain of clauses over a table of bindings.  A node or relationship
variable is bound as flat columns (id, labels, key and one per property), so what
a query doesn't use is pruned at the scan; it becomes one struct only where it is
used whole.  Patterns become joins on keys, subqueries are run once over the
distinct values that they import and joined back, and everything else is a
projection, filter or aggregation that Catalyst plans.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import aggregates, scalar, temporal
from ..functions.values import Typer, Val, element, equal, less, make, numeric, sort_key, unify
from ..operators import paths
from ..sources.graph import NODE, REL, Graph, NodeTable, c, merged
from . import tree as t
from .errors import CypherError, CypherTypeError
from .parser import AGGREGATES

LAMBDAS = (t.Comprehension, t.Quantifier, t.Reduce)
SUBQUERIES = (t.PatternTest, t.Exists, t.PatternList)
#: Functions that give a node from a relationship, and where the relationship has its id.
ENDS = {"startnode": "from_id", "endnode": "to_id"}


@dataclass
class Entity:
    """A variable bound to a node, a relationship or, for variable length, a list of these."""

    kind: str  # node, rel, rels
    prefix: str
    props: dict[str, T.DataType]
    labels: frozenset[str] | None = None  # labels or types that it can have; None: any
    key_label: str | None = None  # its key column holds keys of this label's table
    gone: bool = False  # a column tells whether a DELETE of the statement took it away

    def col(self, name: str) -> Column:
        return c(f"{self.prefix}${name}")

    def prop(self, name: str) -> Column:
        return c(f"{self.prefix}.{name}")

    @property
    def columns(self) -> list[str]:
        if self.kind == "rels":
            return [f"{self.prefix}$list"]
        fixed = ["id", "labels", "body"] if self.kind == "node" else ["id", "from", "to", "type", "position"]
        if self.kind == "node" and self.key_label:
            fixed.append("key")
        if self.gone:
            fixed.append("gone")
        return [f"{self.prefix}${n}" for n in fixed] + [f"{self.prefix}.{p}" for p in self.props]

    @property
    def identity(self) -> list[str]:
        if self.kind == "rels":
            return [f"{self.prefix}$list"]
        return [f"{self.prefix}$id"] + ([f"{self.prefix}$key"] if self.kind == "node" and self.key_label else [])

ORDER = " order"


@dataclass
class Product:
    """What is known of a table that pairs the rows of two others: these, and tests by <> of both."""

    df: DataFrame  # the pairs; of any other table nothing is known
    left: State
    right: State
    tests: tuple[Column, ...] = ()

    def parts(self, state: State, *names: str) -> list[State] | None:
        """The tables that hold these variables, if ``state`` is still the product and each is in another one."""
        if self.df is not state.df:
            return None
        for parts in ([self.left, self.right], [self.right, self.left]):
            if all(n in p.scope and p.scope[n] is state.scope.get(n) for n, p in zip(names, parts, strict=True)):
                return parts
        return None


@dataclass
class State:
    """Bindings so far.

    Names that begin with a space are the compiler's own, ORDER for the keys of the
    last ORDER BY in turn, with their direction at the end.
    """

    df: DataFrame
    scope: dict[str, Entity | str] = field(default_factory=dict)
    #: Columns of a subquery's imports, by which all its steps are kept apart.
    hidden: tuple[str, ...] = ()
    unit: bool = False
    #: Columns that stand for subquery expressions, by the identity of their syntax node.
    ready: dict[int, str] = field(default_factory=dict)
    product: Product | None = None

    def columns(self) -> list[str]:
        cols = list(self.hidden)
        for b in self.scope.values():
            cols += b.columns if isinstance(b, Entity) else [b]
        return list(dict.fromkeys(cols))


def names_in(node) -> set[str]:
    """Variables mentioned anywhere below a syntax node, as expressions or in patterns."""
    out = set()
    for x in t.walk(node):
        if isinstance(x, t.Var):
            out.add(x.name)
        elif isinstance(x, (t.NodePattern, t.RelPattern)) and x.var:
            out.add(x.var)
        elif isinstance(x, t.Project) and x.star:
            out.add("*")
    return out


def measured(node) -> set[str]:
    """Variables that are mentioned only as the argument of length()."""
    asked = [x.args[0].name for x in t.walk(node) if isinstance(x, t.Call) and x.name == "length" and len(x.args) == 1 and isinstance(x.args[0], t.Var)]
    all_of = [x.name for x in t.walk(node) if isinstance(x, t.Var)]
    return {n for n in asked if asked.count(n) == all_of.count(n)} if "*" not in names_in(node) else set()


def is_random(e) -> bool:
    """Whether an expression can have another value for each row."""
    return any(isinstance(x, t.Call) and x.name in ("rand", "randomuuid") for x in t.walk(e))


def has_aggregate(e) -> bool:
    if isinstance(e, t.Call) and e.name in AGGREGATES:
        return True
    if isinstance(e, SUBQUERIES):
        return False
    if isinstance(e, (list, tuple)):
        return any(map(has_aggregate, e))
    if isinstance(e, dict):
        return any(map(has_aggregate, e.values()))
    if hasattr(e, "__dataclass_fields__"):
        return any(has_aggregate(getattr(e, n)) for n in e.__dataclass_fields__)
    return False


class Compiler:
    """Compiles one statement over one graph."""

    def __init__(self, graph: Graph, params: dict | None = None, clock: temporal.Clock | None = None):
        self.graph, self.spark, self.params = graph, graph.spark, params or {}
        self.clock = clock or temporal.Clock.now()
        self.typer = Typer(self.spark)
        self.counter = itertools.count()
        self.used: set[str] = set()
        #: Paths of which nothing but the length is asked.
        self.measured: set[str] = set()

    def fresh(self, stem: str) -> str:
        return f"{stem}{next(self.counter)}"

    def unit(self) -> State:
        return State(self.spark.range(1).select(F.lit(True).alias("$unit")), unit=True)

    # -- queries -----------------------------------------------------------

    def run(self, query: t.Query) -> DataFrame:
        self.used = {x.name for x in t.walk(query) if isinstance(x, t.Var)} | names_in(query) & {"*"}
        self.measured = measured(query)
        for x in t.walk(query):
            if isinstance(x, t.PathPattern) and x.var:
                self.used |= {x.var}
        _, df, names = self.query(query, self.unit())
        return df

    def query(self, query: t.Query, start: State) -> tuple[State, DataFrame, list[str]]:
        """Final state, result and column names; with hidden columns kept in front of the result."""
        frames, columns, state = [], None, start
        for branch in query.branches:
            state, df, names = self.branch(branch, start)
            if columns is not None and names != columns:
                raise CypherError(f"UNION branches return {columns} and {names}")
            columns = names
            frames.append(df)
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=False) if columns or start.hidden else out
        if len(frames) > 1 and not query.keep_all:
            out = out.distinct()
        return state, out, columns or []

    def branch(self, clauses: list, state: State) -> tuple[State, DataFrame, list[str]]:
        for k, clause in enumerate(clauses):
            if isinstance(clause, t.Project) and clause.final:
                df, names = self.result(clause, state)
                return state, df, names
            state = self.clause(clause, state)
        last = clauses[-1]
        if isinstance(last, t.CallProcedure):
            names = sorted(state.scope) if last.yields else list(state.scope)
            return state, state.df.select(*state.hidden, *[self.whole(state, n).col.alias(n) for n in names]), names
        return state, state.df.select(*state.hidden) if state.hidden else state.df.limit(0).select(), []

    def clause(self, clause, state: State) -> State:
        if isinstance(clause, t.Match):
            return self.optional(clause, state) if clause.optional else self.match(clause, state)
        if isinstance(clause, t.Unwind):
            return self.unwind(clause, state)
        if isinstance(clause, t.Project):
            return self.project(clause, state)
        if isinstance(clause, t.CallQuery):
            return self.call_query(clause, state)
        if isinstance(clause, t.CallProcedure):
            return self.call_procedure(clause, state)
        raise CypherError(f"{type(clause).__name__} is not a reading clause")

    # -- MATCH -------------------------------------------------------------

    def match(self, clause: t.Match, state: State) -> State:
        asked = names_in(clause.where) if clause.where is not None else set()
        for pattern in clause.patterns:
            state = self.path(pattern, state, asked)
        return self.where(clause.where, state) if clause.where is not None else state

    def optional(self, clause: t.Match, state: State) -> State:
        refs = self.imports(clause, state)
        inner = self.match(clause, self.import_state(state, refs))
        new = {k: v for k, v in inner.scope.items() if k not in state.scope}
        keys = self.import_columns(state, refs)
        cols = [x for v in new.values() for x in (v.columns if isinstance(v, Entity) else [v])]
        found = inner.df.select(*map(c, keys), *map(c, dict.fromkeys(cols)))
        return replace(state, df=self.join_back(state.df, found, keys, "left"), scope={**state.scope, **new}, unit=False)

    def imports(self, node, state: State) -> list[str]:
        names = names_in(node)
        return [n for n in state.scope if n in names or "*" in names]

    def import_columns(self, state: State, refs: list[str]) -> list[str]:
        cols = list(state.hidden)
        for n in refs:
            b = state.scope[n]
            cols += b.identity if isinstance(b, Entity) else [b]
        return list(dict.fromkeys(cols))

    def import_state(self, state: State, refs: list[str], keep_hidden: bool = True) -> State:
        """The distinct values of some variables as the start of a subquery."""
        scope = {n: state.scope[n] for n in refs}
        if not refs and not state.hidden:
            return self.unit()
        keys = self.import_columns(state, refs)
        cols = list(dict.fromkeys([*keys, *[x for b in scope.values() if isinstance(b, Entity) for x in b.columns]]))
        df = state.df.select(*map(c, cols)).dropDuplicates(keys)
        return State(df, scope, state.hidden)

    def join_back(self, df: DataFrame, found: DataFrame, keys: list[str], how: str) -> DataFrame:
        if not keys:
            if how in ("left_semi", "left_anti"):
                return df.join(found.limit(1), F.lit(True), how)
            return df.join(found, F.lit(True), how)
        renamed = {k: self.fresh("k") for k in keys}
        right = found.select(*[c(x).alias(renamed.get(x, x)) for x in found.columns])
        on = None
        for k in keys:
            # Ids that are null match nothing; other imports may be null and still be the same.
            same = c(k) == c(renamed[k]) if k.endswith(("$id", "$key")) else c(k).eqNullSafe(c(renamed[k]))
            on = same if on is None else on & same
        out = df.join(right, on, how)
        return out if how in ("left_semi", "left_anti") else out.drop(*renamed.values())

    # .. nodes

    def possible(self, labels: list[str], among: frozenset[str] | None) -> list[NodeTable]:
        return self.graph.node_tables(labels, among)

    def scan(self, var: str | None, labels: list[str], among: frozenset[str] | None = None, id_only: bool = False) -> tuple[DataFrame, Entity]:
        """All nodes with some labels, under a new prefix."""
        tables = self.possible(labels, among)
        prefix = self.fresh("n")
        frames, props = [], {}
        for table in tables:
            df = table.canonical()
            if table.label is None:
                for label in labels:
                    df = df.where(F.array_contains("$labels", label))
            own = {} if id_only else table.props
            if len(tables) > 1:
                df = df.withColumn("$key", c("$key").cast("string"))
            frames.append(df.select(*[c(f"${n}").alias(f"{prefix}${n}") for n in ("id", "labels", "body", "key")], *[c(p).alias(f"{prefix}.{p}") for p in own]))
            props |= own
        if not frames:
            empty = self.spark.createDataFrame([], f"`{prefix}$id` string, `{prefix}$labels` array<string>, `{prefix}$body` string")
            return empty, Entity("node", prefix, {}, frozenset(labels))
        known = frozenset(x.label for x in tables) if all(x.label for x in tables) else None
        entity = Entity("node", prefix, props, known, tables[0].label if len(tables) == 1 else None)
        df = merged(frames)
        return (df if entity.key_label else df.drop(f"{prefix}$key")), entity

    def narrow(self, state: State, entity: Entity, pattern: t.NodePattern) -> State:
        """Labels and property values that a pattern asks of a bound node."""
        df = state.df
        for label in pattern.labels:
            if entity.labels is None or len(entity.labels) > 1:
                df = df.where(F.array_contains(entity.col("labels"), label))
            elif label not in entity.labels:
                df = df.where(F.lit(False))
        return self.having(replace(state, df=df), entity, pattern.props)

    def having(self, state: State, entity: Entity, props: t.Expr | None) -> State:
        if props is None:
            return state
        if not isinstance(props, t.MapOf):
            raise CypherError("a pattern's properties are a map")
        state = self.prepare(list(props.items.values()), state)
        df = state.df
        for key, e in props.items.items():
            own = self.entity_prop(state, entity, key)
            df = df.where(F.coalesce(equal(own, self.expr(e, state)).col, F.lit(False)))
        return replace(state, df=df)

    # .. paths

    def path(self, pattern: t.PathPattern, state: State, asked: set[str] | frozenset[str] = frozenset()) -> State:
        """A path; ``asked`` are the variables of WHERE."""
        named = [r.var for r in pattern.rels if r.var]
        if len(named) != len(set(named)):
            raise CypherError("a relationship variable is used twice in a pattern")
        if pattern.shortest:
            return paths.shortest(self, pattern, state)
        nodes, rels = pattern.nodes, pattern.rels
        names = [n.var or f" {self.fresh('anon')}" for n in nodes]
        bound = [k for k, n in enumerate(names) if isinstance(state.scope.get(n), Entity)]
        for n in names:
            if isinstance(state.scope.get(n), str):
                raise CypherTypeError(f"{n} is not a node")
        at = bound[0] if bound else self.best_start(nodes)
        if not bound and state.unit and not state.hidden and (cut := self.cut(pattern, names, at, asked)):
            state, bindings = self.closed(pattern, names, cut, state)
            if pattern.var:
                state = self.bind_path(state, pattern, names, bindings)
            return replace(state, scope={k: v for k, v in state.scope.items() if not k.startswith(" ")})
        if not bound:
            lean = self.lean(pattern, names[at]) and nodes[at].props is None
            df, entity = self.scan(names[at], nodes[at].labels, self.reachable(pattern, at), id_only=lean)
            new, props = State(df, {names[at]: entity}), nodes[at].props
            if props is not None and not names_in(props) and not is_random(props):
                new, props = self.having(new, entity, props), None
            df = new.df if state.unit else state.df.crossJoin(new.df)
            product = None if state.unit else Product(df, state, new)
            state = replace(state, df=df, scope={**state.scope, names[at]: entity}, unit=False, product=product)
            state = self.having(state, entity, props)
        else:
            state = self.narrow(state, state.scope[names[at]], nodes[at])
        trail: list[Entity] = []
        bindings: dict[int, Entity] = {}
        for k in range(at, len(rels)):
            state, rel = self.hop(state, names[k], rels[k], nodes[k + 1], names[k + 1], False, trail, pattern)
            bindings[k] = rel
        for k in range(at - 1, -1, -1):
            state, rel = self.hop(state, names[k + 1], rels[k], nodes[k], names[k], True, trail, pattern)
            bindings[k] = rel
        if pattern.var:
            state = self.bind_path(state, pattern, names, bindings)
        scope = {k: v for k, v in state.scope.items() if not k.startswith(" ")}
        return replace(state, scope=scope)

    def to_one(self, rel: t.RelPattern, left: t.NodePattern, right: t.NodePattern) -> tuple[bool, bool]:
        """Whether a relationship leads from left to right, and from right to left, to one node at most."""
        picks = []
        for e in self.graph.edge_tables(rel.types):
            for d in {"out": ["out"], "in": ["in"], "both": ["out", "in"]}[rel.direction]:
                ends = (e.source, e.target) if d == "out" else (e.target, e.source)
                if e.type is None or all(not n.labels or set(n.labels) == {x} for n, x in zip((left, right), ends, strict=True)):
                    picks.append(e.node_end and (e.node_end == "source") == (d == "out"))
        return (picks[0] is True, picks[0] is False) if len(picks) == 1 else (False, False)

    def cut(self, pattern: t.PathPattern, names: list[str], at: int, asked) -> tuple[tuple[range, int], tuple[range, int]] | None:
        """For a path that ends where it began: two arcs of it, each with its start, of which neither fans out as often as the whole.

        With something asked of a node the path starts there and stays whole.
        """
        rels, m = pattern.rels, len(pattern.rels)
        if m < 3 or names[0] != names[-1] or len(set(names)) != m or asked & set(names):
            return None
        if any(r.length is not None or r.props is not None for r in rels) or any(n.props is not None for n in pattern.nodes):
            return None
        nodes = self.merged_ends(pattern)
        fans = [self.to_one(rels[k], nodes[k], nodes[(k + 1) % m]) for k in range(m)]

        def best(span: range) -> tuple[int, int, int]:
            """Hops to many from the best start, less is better; then those next to it that lead to one, and the start."""
            found = []
            for start in range(span.start, span.stop + 1):
                many = sum(not fans[k % m][0] for k in range(start, span.stop)) + sum(not fans[k % m][1] for k in range(span.start, start))
                near = (start < span.stop and fans[start % m][0]) + (start > span.start and fans[(start - 1) % m][1])
                found.append((many, -near, start))
            return min(found)

        # The last hop finds both its ends bound.
        now = sum(not fans[k][0] for k in range(at, m if at else m - 1)) + sum(not fans[k][1] for k in range(1, at))
        options = []
        for i in range(m):
            for j in range(i + 1, m):
                spans = range(i, j), range(j, i + m)
                costs = [best(x) for x in spans]
                options.append((max(x[0] for x in costs), sum(x[0] for x in costs), sum(x[1] for x in costs), i, j, [(x, k[2]) for x, k in zip(spans, costs, strict=True)]))
        least = min(options, key=lambda x: x[:-1])
        return tuple(least[-1]) if least[0] < now else None

    def merged_ends(self, pattern: t.PathPattern) -> list[t.NodePattern]:
        """The nodes of a path that ends where it began, the first with what is asked of the last."""
        first, *rest, last = pattern.nodes
        return [replace(first, labels=list(dict.fromkeys([*first.labels, *last.labels]))), *rest]

    def closed(self, pattern: t.PathPattern, names: list[str], cut, state: State) -> tuple[State, dict[int, Entity]]:
        """Both arcs by themselves, joined by the two nodes that they share."""
        nodes, m = self.merged_ends(pattern), len(pattern.rels)
        sides, trails, bindings = [], [], {}
        for second, (span, start) in enumerate(cut):
            places = range(span.start, span.stop + 1)
            own = [names[k % m] for k in places]
            part = replace(pattern, nodes=[nodes[k % m] for k in places], rels=[pattern.rels[k % m] for k in span])
            if second:  # its ends are those of the first arc, with names of their own here
                for k in (0, -1):
                    own[k], part.nodes[k] = f" {self.fresh('anon')}", replace(part.nodes[k], var=None)
            at = start - span.start
            among = self.reachable(part, at)
            lean = self.lean(part, own[at]) and len(self.possible(part.nodes[at].labels, among)) > 1
            df, entity = self.scan(own[at], part.nodes[at].labels, among, id_only=lean)
            side, trail = State(df, {own[at]: entity}), []
            ahead = [(k, False) for k in range(at, len(part.rels))]
            behind = [(k, True) for k in range(at - 1, -1, -1)]
            # Hops to one node come first, while rows are few.
            first = at > 0 and self.to_one(part.rels[at - 1], part.nodes[at - 1], part.nodes[at])[1]
            for k, back in [*behind, *ahead] if first else [*ahead, *behind]:
                x, y = (k + 1, k) if back else (k, k + 1)
                side, bindings[span[k] % m] = self.hop(side, own[x], part.rels[k], part.nodes[y], own[y], back, trail, part)
            sides.append((side, [side.scope[own[0]], side.scope[own[-1]]]))
            trails.append(trail)
            if second:
                side = replace(side, scope={k: v for k, v in side.scope.items() if k not in (own[0], own[-1])})
                sides[-1] = (side, sides[-1][1])
        (one, ends), (other, others) = sides
        on = None
        for a, b in zip(ends, reversed(others), strict=True):
            by = "key" if a.key_label and a.key_label == b.key_label else "id"
            same = a.col(by) == b.col(by)
            on = same if on is None else on & same
        df = one.df.join(other.df, on)
        for a in trails[0]:
            for b in trails[1]:
                if a.labels is None or b.labels is None or a.labels & b.labels:
                    df = df.where(a.col("id") != b.col("id"))
        return replace(state, df=df, scope={**state.scope, **one.scope, **other.scope}, unit=False), bindings

    def best_start(self, nodes: list[t.NodePattern]) -> int:
        """A node with a property to look up, else one with a label, else the first."""
        return max(range(len(nodes)), key=lambda k: (nodes[k].props is not None, bool(nodes[k].labels), -k))

    def reachable(self, pattern: t.PathPattern, at: int) -> frozenset[str] | None:
        """Labels that a node can have, judged by the relationships next to it."""
        out = None
        for k, incoming in ((at, False), (at - 1, True)):
            if not 0 <= k < len(pattern.rels) or pattern.rels[k].length is not None:
                continue
            rel, ends = pattern.rels[k], set()
            for e in self.graph.edge_tables(rel.types):
                if e.type is None:
                    return None
                leaves = rel.direction != ("in" if not incoming else "out")
                enters = rel.direction != ("out" if not incoming else "in")
                ends |= ({e.source} if leaves else set()) | ({e.target} if enters else set())
            out = frozenset(ends) if out is None else out & ends
        return out

    def lean(self, pattern: t.PathPattern, name: str) -> bool:
        """Whether only a node's identity can matter."""
        return name not in self.used and "*" not in self.used and not pattern.var

    def edge_frame(self, rel: t.RelPattern, back: bool, near: Entity, far_labels: list[str], with_node: bool):
        """Relationships seen from the near end: frame, entity, near and far columns, keys' labels, and the table if it is one."""
        prefix = self.fresh("r")
        directions = {"out": ["out"], "in": ["in"], "both": ["out", "in"]}[rel.direction]
        if back:
            directions = [{"out": "in", "in": "out"}[d] for d in directions]
        picks = []
        for e in self.graph.edge_tables(rel.types):
            for d in directions:
                ends = (e.source, e.target) if d == "out" else (e.target, e.source)
                if e.type is not None:
                    if near.labels is not None and ends[0] not in near.labels:
                        continue
                    if far_labels and set(far_labels) != {ends[1]}:
                        continue
                picks.append((e, d, ends))
        one = len(picks) == 1
        frames, props = [], {}
        for e, d, _ in picks:
            node_too = one and with_node and e.node_end == ("target" if d == "out" else "source")
            df = e.canonical(node_too)
            if e.type is None and rel.types:
                df = df.where(c("$type").isin(rel.types))
            if e.type is None and d == "in" and rel.direction == "both" or (rel.direction == "both" and d != directions[0] and e.source == e.target):
                df = df.where(c("$from") != c("$to"))  # a loop is seen once
            near_end, far_end = ("from", "to") if d == "out" else ("to", "from")
            cols = [c(f"${n}").alias(f"{prefix}${n}") for n in ("id", "from", "to", "type", "position")]
            cols += [c(f"${near_end}").alias(f"{prefix}$near"), c(f"${far_end}").alias(f"{prefix}$far")]
            if one:
                cols += [c(f"${near_end}_key").alias(f"{prefix}$near_key"), c(f"${far_end}_key").alias(f"{prefix}$far_key")]
            cols += [c(p).alias(f"{prefix}.{p}") for p in e.prop_types]
            if node_too:
                cols += [c(f"node.{f.name}") for f in e.df.schema]
            frames.append(df.select(*cols))
            props |= e.prop_types
        types = frozenset(e.type for e, *_ in picks) if all(e.type for e, *_ in picks) else None
        entity = Entity("rel", prefix, props, types)
        far = frozenset(ends[1] for *_, ends in picks) if types is not None else None
        if not frames:
            schema = ", ".join(f"`{prefix}${n}` {k}" for n, k in (("id", "string"), ("from", "string"), ("to", "string"), ("type", "string"), ("position", "bigint"), ("near", "string"), ("far", "string")))
            return self.spark.createDataFrame([], schema), entity, far, None, None
        return merged(frames), entity, far, (picks[0][2] if one else None), (picks[0] if one else None)

    def own_row(self, near: Entity, rel: Entity, pick) -> tuple[Column, list[Column]] | None:
        """A relationship that is a foreign key in the near node's own row: the condition for it and its columns."""
        e, d, ends = pick
        out = d == "out"
        far = e.target_key if out else e.source_key
        if e.node_end != ("source" if out else "target") or far not in near.props or not isinstance(e.key, tuple) or e.key[1] not in near.props or e.props or e.position:
            return None
        key = near.prop(far)
        far_id = F.concat(F.lit(f"{ends[1]}:"), key.cast("string"))
        cols = {
            "id": F.concat(F.lit(f"{e.type}:"), e.key_text(near.prop)),
            "from": near.col("id") if out else far_id,
            "to": far_id if out else near.col("id"),
            "type": F.lit(e.type),
            "position": F.lit(None).cast("long"),
            "near": near.col("id"),
            "far": far_id,
            "near_key": near.col("key"),
            "far_key": key,
        }
        return key.isNotNull() & near.col("id").isNotNull(), [v.alias(f"{rel.prefix}${k}") for k, v in cols.items()]

    def hop(self, state: State, near_name: str, rel: t.RelPattern, node: t.NodePattern, far_name: str, back: bool, trail: list[Entity], pattern: t.PathPattern) -> tuple[State, Entity]:
        """One relationship of a path and the node behind it."""
        near = state.scope[near_name]
        if rel.length is not None:
            return paths.variable(self, state, near, rel, node, far_name, back, trail, pattern)
        bound = state.scope.get(far_name)
        edges, entity, far_labels, ends, pick = self.edge_frame(rel, back, near, node.labels if bound is None else [], bound is None)
        by_key = ends is not None and ends[0] is not None and near.key_label == ends[0]
        row = self.own_row(near, entity, pick) if by_key else None
        if row is not None:
            df = state.df.where(row[0]).select("*", *row[1])
        else:
            on = near.col("key") == c(f"{entity.prefix}$near_key") if by_key else near.col("id") == c(f"{entity.prefix}$near")
            df = state.df.join(edges, on)
        for other in trail:
            if other.kind == "rel" and (other.labels is None or entity.labels is None or other.labels & entity.labels):
                df = df.where(other.col("id") != entity.col("id"))
            elif other.kind == "rels":
                df = df.where(~F.array_contains(F.transform(other.col("list"), lambda r: r[REL]), entity.col("id")))
        trail.append(entity)
        scope = dict(state.scope)
        if rel.var:
            if isinstance(old := scope.get(rel.var), Entity):
                df = df.where(old.col("id") == entity.col("id"))
            scope[rel.var] = entity
        state = replace(state, df=df, scope=scope, unit=False)
        state = self.having(state, entity, rel.props)
        embedded = pick is not None and bound is None and pick[0].node_end == ("target" if pick[1] == "out" else "source") and any(x.startswith("node.") for x in edges.columns)
        state = self.far_end(state, entity, node, far_name, far_labels, ends, embedded, pattern)
        return state, entity

    def far_end(self, state: State, rel: Entity, node: t.NodePattern, name: str, labels, ends, embedded: bool, pattern) -> State:
        bound = state.scope.get(name)
        far, far_key = c(f"{rel.prefix}$far"), c(f"{rel.prefix}$far_key")
        if isinstance(bound, Entity):
            by_key = ends is not None and ends[1] is not None and bound.key_label == ends[1]
            state = replace(state, df=state.df.where(bound.col("key") == far_key if by_key else bound.col("id") == far))
            return self.narrow(state, bound, node)
        prefix = self.fresh("n")
        label = ends[1] if ends is not None and ends[1] is not None else None
        tables = self.possible(node.labels, labels)
        if label and embedded:
            # The edge's row is the node's row too.
            table = tables[0]
            cols = [far.alias(f"{prefix}$id"), F.array(F.lit(label)).alias(f"{prefix}$labels"), F.lit("").alias(f"{prefix}$body"), far_key.alias(f"{prefix}$key")]
            cols += [c(f"node.{p}").alias(f"{prefix}.{p}") for p in table.props]
            keep = [c(x) for x in state.df.columns if not x.startswith("node.")]
            entity = Entity("node", prefix, table.props, frozenset({label}), label)
            state = replace(state, df=state.df.select(*keep, *cols), scope={**state.scope, name: entity})
            return self.having(state, entity, node.props)
        if label and self.lean(pattern, name) and node.props is None and set(node.labels) <= {label}:
            # Both ends of a relationship exist, so a node of which nothing is asked needs no join.
            cols = [far.alias(f"{prefix}$id"), F.array(F.lit(label)).alias(f"{prefix}$labels"), F.lit("").alias(f"{prefix}$body"), far_key.alias(f"{prefix}$key")]
            entity = Entity("node", prefix, {}, frozenset({label}), label)
            return replace(state, df=state.df.select("*", *cols), scope={**state.scope, name: entity})
        df, entity = self.scan(name, node.labels, labels)
        by_key = entity.key_label is not None and ends is not None and entity.key_label == ends[1]
        on = entity.col("key") == far_key if by_key else entity.col("id") == far
        state = replace(state, df=state.df.join(df, on), scope={**state.scope, name: entity})
        return self.having(state, entity, node.props)

    def bind_path(self, state: State, pattern: t.PathPattern, names: list[str], rels: dict[int, Entity]) -> State:
        """A path value from its nodes and relationships; within variable lengths, nodes come from the lists."""
        node_list, rel_list = [], []
        first = F.array(self.entity_struct(state.scope[names[0]], path=True))
        node_list.append(first)
        for k in range(len(pattern.rels)):
            rel = rels[k]
            if rel.kind == "rel":
                rel_list.append(F.array(self.entity_struct(rel, path=True)))
                node_list.append(F.array(self.entity_struct(state.scope[names[k + 1]], path=True)))
            else:
                rel_list.append(rel.col("list"))
                node_list.append(c(f"{rel.prefix}$nodes"))
        none = F.array().cast(T.ArrayType(self.rel_type()))
        value = F.struct(F.concat(*node_list).alias("nodes"), (F.concat(*rel_list) if rel_list else none).alias("relationships"))
        name = self.fresh("p")
        return replace(state, df=state.df.withColumn(name, value), scope={**state.scope, pattern.var: name})

    # .. whole entities

    def node_type(self) -> T.StructType:
        props = T.StructType([T.StructField(k, v) for k, v in sorted(self.graph.node_props().items())])
        return T.StructType([T.StructField(NODE, T.StringType()), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("body", T.StringType()), T.StructField("props", props)])

    def rel_type(self) -> T.StructType:
        props = T.StructType([T.StructField(k, v) for k, v in sorted(self.graph.edge_props().items())])
        fields = [(REL, T.StringType()), ("from_id", T.StringType()), ("type", T.StringType()), ("to_id", T.StringType()), ("position", T.LongType()), ("props", props)]
        return T.StructType([T.StructField(k, v) for k, v in fields])

    def entity_struct(self, e: Entity, path: bool = False) -> Column:
        """A node or relationship as one value; in a path, with all properties that the graph knows."""
        if e.kind == "rels":
            return e.col("list")
        wanted = (self.graph.node_props() if e.kind == "node" else self.graph.edge_props()) if path else e.props
        props = [(e.prop(k) if k in e.props else F.lit(None).cast(v)).alias(k) for k, v in sorted(wanted.items())]
        props = F.struct(*props) if props else F.struct(F.lit(None).cast("string").alias("none"))
        if e.kind == "node":
            value = F.struct(e.col("id").alias(NODE), e.col("labels").alias("labels"), e.col("body").alias("body"), props.alias("props"))
        else:
            value = F.struct(e.col("id").alias(REL), e.col("from").alias("from_id"), e.col("type").alias("type"), e.col("to").alias("to_id"), e.col("position").alias("position"), props.alias("props"))
        return F.when(e.col("id").isNotNull(), value)

    def val(self, col: Column, state: State, known: T.DataType | None = None) -> Val:
        return Val(col, col, state.df.schema, self.typer, known)

    def whole(self, state: State, name: str) -> Val:
        b = state.scope[name]
        return self.val(self.entity_struct(b) if isinstance(b, Entity) else c(b), state)

    def alive(self, e: Entity, v: Val, what: str) -> Val:
        """A value read from a node or relationship, an error on rows where it was deleted."""
        if not e.gone:
            return v
        error = F.raise_error(F.lit(f"{what} of a deleted node or relationship"))
        return make(lambda x: F.when(e.col("gone"), error).otherwise(x), v)

    def entity_prop(self, state: State, e: Entity, key: str) -> Val:
        return self.alive(e, self.stored_prop(state, e, key), "a property")

    def stored_prop(self, state: State, e: Entity, key: str) -> Val:
        if e.kind == "node" and key == "body":
            return self.val(e.col("body"), state, T.StringType())
        if e.kind == "rel" and key == "position":
            return self.val(e.col("position"), state, T.LongType())
        if key in e.props:
            return self.val(e.prop(key), state, e.props[key])
        return self.val(F.lit(None), state, T.NullType())

    # -- WHERE and subquery expressions ---------------------------------------

    def where(self, e: t.Expr, state: State) -> State:
        if isinstance(e, t.Binary) and e.op == "AND":
            return self.where(e.right, self.where(e.left, state))
        negated = isinstance(e, t.Unary) and e.op == "NOT" and isinstance(e.of, (t.PatternTest, t.Exists))
        test = e.of if negated else e
        if isinstance(test, (t.PatternTest, t.Exists)):
            keys, found = self.existence(test, state)
            return replace(state, df=self.join_back(state.df, found, keys, "left_anti" if negated else "left_semi"))
        state = self.prepare([e], state)
        v = self.expr(e, state)
        if v.kind not in ("boolean", "null"):
            raise CypherTypeError(f"WHERE takes boolean, not {v.kind}")
        test = v.col.cast("boolean")
        df = state.df.where(test)
        return replace(state, df=df, product=self.tested(state, e, test, df))

    def tested(self, state: State, e: t.Expr, test: Column, df: DataFrame) -> Product | None:
        """The product after a test: one of a single side narrows that side, one by <> is kept, any other may leave few pairs."""
        known = state.product
        if known is None or known.df is not state.df or is_random(e):
            return None
        names = names_in(e)
        for side in ("left", "right"):
            part = getattr(known, side)
            if names <= part.scope.keys():
                return replace(known, df=df, **{side: replace(part, df=part.df.where(test))})
        return replace(known, df=df, tests=(*known.tests, test)) if isinstance(e, t.Binary) and e.op == "<>" else None

    def existence(self, test: t.PatternTest | t.Exists, state: State) -> tuple[list[str], DataFrame]:
        """Columns that a test depends on, and the distinct values of them for which it holds."""
        branches = [[t.Match([test.pattern], None, False)]] if isinstance(test, t.PatternTest) else test.query.branches
        if t.writes(branches):
            raise CypherError("EXISTS may not write")
        refs = self.imports(branches, state)
        keys = self.import_columns(state, refs)
        frames = []
        for clauses in branches:
            inner = (self.free(clauses, refs, state) if len(branches) == 1 else None) or self.import_state(state, refs)
            for clause in clauses:
                if isinstance(clause, t.Project) and clause.final:
                    break
                inner = self.clause(clause, inner)
            frames.append(inner.df.select(*map(c, keys)) if keys else inner.df.select(F.lit(True).alias("$found")))
        found = frames[0]
        for f in frames[1:]:
            found = found.unionByName(f)
        return keys, found.distinct() if keys else found

    def free(self, clauses: list, refs: list[str], state: State) -> State | None:
        """For a test of one pattern around one bound node: the start without that binding.

        The pattern is then found from its relationships alone and joined by the
        node's identity, with no pass over the outer rows.
        """
        if state.hidden or len(refs) != 1 or len(clauses) != 1 or not isinstance(clauses[0], t.Match) or len(clauses[0].patterns) != 1:
            return None
        pattern, e = clauses[0].patterns[0], state.scope[refs[0]]
        if not isinstance(e, Entity) or e.kind != "node" or not e.key_label or pattern.shortest or any(r.length for r in pattern.rels) or not pattern.rels:
            return None
        exprs = [clauses[0].where, *[n.props for n in pattern.nodes], *[r.props for r in pattern.rels]]
        at = [k for k, n in enumerate(pattern.nodes) if n.var == refs[0]]
        if len(at) != 1 or refs[0] in names_in([x for x in exprs if x is not None]) or pattern.nodes[at[0]].labels or pattern.nodes[at[0]].props:
            return None
        df, entity = self.scan(None, [e.key_label], id_only=True)
        cols = [c(f"{entity.prefix}${n}").alias(f"{e.prefix}${n}") for n in ("id", "labels", "body", "key")]
        return State(df.select(*cols), {refs[0]: Entity("node", e.prefix, {}, e.labels, e.key_label)})

    def prepare(self, exprs: list, state: State) -> State:
        """Add a column for each subquery expression and for the nodes of startNode and endNode."""
        for e in exprs:
            for node, around in self.ends_in(e):
                if id(node) not in state.ready:
                    state = self.end_nodes(node, around, state)
            for node in self.subqueries(e):
                if id(node) in state.ready:
                    continue
                name = self.fresh("q")
                if isinstance(node, t.PatternList):
                    state = self.pattern_list(node, name, state)
                else:
                    keys, found = self.existence(node, state)
                    mark = self.join_back(state.df, found.withColumn(name, F.lit(True)) if keys else found.limit(1).select(F.lit(True).alias(name)), keys, "left")
                    state = replace(state, df=mark.withColumn(name, F.coalesce(c(name), F.lit(False))))
                state = replace(state, ready={**state.ready, id(node): name}, unit=False)
        return state

    def subqueries(self, e) -> list:
        if isinstance(e, SUBQUERIES):
            return [e]
        if isinstance(e, (list, tuple)):
            return [x for y in e for x in self.subqueries(y)]
        if isinstance(e, dict):
            return self.subqueries(list(e.values()))
        if hasattr(e, "__dataclass_fields__"):
            found = [x for n in e.__dataclass_fields__ for x in self.subqueries(getattr(e, n))]
            if found and isinstance(e, LAMBDAS) and e.var in names_in(found):
                raise CypherError("a pattern cannot use a list variable")
            return found
        return []

    def ends_in(self, e, around: tuple = ()):
        """Calls of startNode and endNode of which more than the identity is read, inner ones first, each with the lambdas around it."""
        if isinstance(e, SUBQUERIES):
            return
        if isinstance(e, (list, tuple)):
            for x in e:
                yield from self.ends_in(x, around)
        elif isinstance(e, dict):
            yield from self.ends_in(list(e.values()), around)
        elif isinstance(e, LAMBDAS):
            inner = (*around, e)
            for n in e.__dataclass_fields__:
                yield from self.ends_in(getattr(e, n), around if n in ("source", "start") else inner)
        elif hasattr(e, "__dataclass_fields__"):
            for n in e.__dataclass_fields__:
                x = getattr(e, n)
                for y in x if isinstance(x, list) else [x]:
                    yield from self.ends_in(y.args if identity_only(e) and is_end(y) else y, around)
            if is_end(e):
                yield e, around

    def end_nodes(self, e: t.Call, around: tuple, state: State) -> State:
        """Join the nodes at an end of relationships: one a row or, under lambdas, all that these can ask for, by id."""
        from ..operators.paths import all_nodes

        if len(e.args) != 1:
            raise CypherError(f"{e.name} takes one argument")
        bound = names_in(e.args)
        local = [x for x in around if bound & lambda_names(x)]
        if any(isinstance(x, t.Reduce) and x.acc in bound for x in local):
            raise CypherError(f"{e.name} cannot use an accumulator")
        name, at, nodes = self.fresh("q"), self.fresh("q"), all_nodes(self)
        listed = e.args[0]
        for x in reversed(around if local else ()):
            listed = t.Comprehension(x.var, x.source, None, listed, text="")
        v = self.expr(listed, state)
        depth, kind = 0, v.type
        while isinstance(kind, T.ArrayType):
            depth, kind = depth + 1, kind.elementType
        if v.kind == "null" or isinstance(kind, T.NullType):
            return state
        if not isinstance(kind, T.StructType) or REL not in kind.fieldNames():
            raise CypherTypeError(f"{e.name} takes relationship, not {v.kind}")
        if not local:
            scalar.want(v, e.name, "relationship")
            df = state.df.withColumn(at, v.col[ENDS[e.name]])
            df = df.join(nodes.select(c("$far_id").alias(f"{at}$id"), c("$node").alias(name)), c(at) == c(f"{at}$id"), "left").drop(f"{at}$id", at)
            return replace(state, df=df, ready={**state.ready, id(e): name}, unit=False)
        rels = v.col
        for _ in range(depth - 1):
            rels = F.flatten(F.filter(rels, lambda x: x.isNotNull()))
        df = state.df.withColumn(at, F.array_sort(F.array_distinct(F.transform(rels, lambda r: r[ENDS[e.name]]))))
        found = df.select(at).distinct().select(at, F.explode(at).alias("$far_id")).join(nodes, "$far_id")
        found = found.groupBy(at).agg(F.map_from_entries(F.collect_list(F.struct("$far_id", "$node"))).alias(name))
        df = df.join(found, at, "left").drop(at)
        return replace(state, df=df, ready={**state.ready, ("ends", id(e)): name}, unit=False)

    def pattern_list(self, node: t.PatternList, name: str, state: State) -> State:
        """A list per row: the pattern over the distinct imports, collected by them."""
        if node.pattern.shortest:
            pattern = replace(node.pattern, var="__path")
        else:
            pattern = node.pattern
        refs = self.imports([pattern, node.where, node.value], state)
        keys = self.import_columns(state, refs)
        old, self.used = self.used, self.used | names_in([node.value, node.where])
        inner = self.match(t.Match([pattern], node.where, False), self.import_state(state, refs))
        self.used = old
        inner = self.prepare([node.value], inner)
        value = self.expr(node.value, inner)
        items = F.collect_list(F.struct(value.col.alias("v"))).alias(name)
        found = inner.df.groupBy(*map(c, keys)).agg(items)
        df = self.join_back(state.df, found, keys, "left")
        empty = F.array().cast(T.ArrayType(value.type))
        listed = F.coalesce(F.transform(c(name), lambda x: x["v"]), empty)
        if node.pattern.shortest == "one":
            listed = F.get(listed, F.lit(0))
        return replace(state, df=df.withColumn(name, listed))

    # -- UNWIND, CALL --------------------------------------------------------

    def unwind(self, clause: t.Unwind, state: State) -> State:
        state = self.prepare([clause.source], state)
        v = self.expr(clause.source, state)
        name = self.fresh("s")
        if v.kind == "null":
            df = state.df.where(F.lit(False)).withColumn(name, F.lit(None))
        elif v.kind != "list":
            raise CypherTypeError(f"UNWIND takes list, not {v.kind}")
        else:
            df = state.df.select("*", F.explode(v.col).alias(name))
        return replace(state, df=df, scope={**state.scope, clause.var: name}, unit=False)

    def call_query(self, clause: t.CallQuery, state: State) -> State:
        """Run once over the distinct imports of all rows, then join back."""
        first = clause.query.branches[0][0]
        imports: list[str] = []
        if isinstance(first, t.Project) and not first.final:
            imports = list(state.scope) if first.star else [i.expr.name for i in first.items if isinstance(i.expr, t.Var) and i.expr.name in state.scope]
        start = self.import_state(state, imports)
        keys = self.import_columns(state, imports)
        marks = {k: self.fresh("h") for k in keys}
        start = State(start.df.select("*", *[c(k).alias(v) for k, v in marks.items()]), start.scope, tuple(marks.values()), start.unit)
        _, found, names = self.query(clause.query, start)
        if not names:
            return state  # a unit subquery passes its rows through
        if clash := set(names) & set(state.scope):
            raise CypherError(f"{', '.join(clash)} is bound outside the subquery")
        out = {n: self.fresh("s") for n in names}
        found = found.select(*[c(v).alias(k) for k, v in marks.items()], *[c(n).alias(s) for n, s in out.items()])
        df = self.join_back(state.df, found, keys, "inner") if keys else (found if state.unit else state.df.crossJoin(found))
        return replace(state, df=df, scope={**state.scope, **out}, unit=False)

    def call_procedure(self, clause: t.CallProcedure, state: State) -> State:
        from ..operators import procedures

        df, columns = procedures.call(self, clause.name.lower(), [self.constant(a) for a in clause.args])
        wanted = [(n, n) for n in columns] if not clause.yields else clause.yields
        out = {}
        cols = []
        for source, alias in wanted:
            if source not in columns:
                raise CypherError(f"{clause.name} has no column {source}")
            if alias in state.scope or alias in out:
                raise CypherError(f"{alias} is bound already")
            out[alias] = self.fresh("s")
            cols.append(c(source).alias(out[alias]))
        df = df.select(*cols)
        state = replace(state, df=df if state.unit else state.df.crossJoin(df), scope={**state.scope, **out}, unit=False)
        return self.where(clause.where, state) if clause.where is not None else state

    # -- projections -----------------------------------------------------------

    def items(self, p: t.Project, state: State) -> list[t.Item]:
        items = []
        if p.star:
            names = sorted(n for n in state.scope if not n.startswith(" "))
            if not names and p.final:
                raise CypherError("RETURN * has nothing in scope")
            items = [t.Item(t.Var(n, text=n), n) for n in names]
        items += p.items
        seen = [i.name for i in items]
        if len(set(seen)) < len(seen):
            raise CypherError(f"duplicate column in {seen}")
        if not p.final and any(i.alias is None and not isinstance(i.expr, t.Var) for i in items):
            raise CypherError("an expression in WITH needs a name")
        return items

    def project(self, p: t.Project, state: State) -> State:
        items = self.items(p, state)
        hidden = state.hidden
        if any(has_aggregate(i.expr) for i in items):
            state, scope = self.aggregate(items, state)
            both = State(state.df, scope, hidden)
        else:
            state = self.prepare([[i.expr for i in items], [e for e, _ in p.order]], state)
            scope, cols = {}, []
            for i in items:
                if isinstance(i.expr, t.Var) and i.expr.name in state.scope:
                    scope[i.name] = state.scope[i.expr.name]
                else:
                    name = self.fresh("s")
                    cols.append(self.expr(i.expr, state).col.alias(name))
                    scope[i.name] = name
            df = state.df.select("*", *cols)
            both = State(df, {**state.scope, **scope}, hidden, ready=state.ready)
        if p.where is not None:
            both = self.where(p.where, both)
        new = State(both.df, scope, hidden)
        if p.distinct:
            keys = [x for b in scope.values() for x in (b.identity if isinstance(b, Entity) else [b])]
            new = replace(new, df=both.df.select(*map(c, new.columns())).dropDuplicates(list(dict.fromkeys([*hidden, *keys]))))
            both = replace(both, df=new.df, scope=scope)
        df, order = self.ordered(p, items, both, hidden)
        if p.final:
            order = {}
        elif not p.order and not p.distinct and not any(has_aggregate(i.expr) for i in items):
            order = {k: v for k, v in state.scope.items() if k.startswith(ORDER)}
        final = State(df, {**scope, **order}, hidden)
        cols = final.columns()
        return replace(final, df=df.select(*map(c, cols)) if cols else df.select(F.lit(True).alias("$unit")))

    def ordered(self, p: t.Project, items: list[t.Item], state: State, hidden: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
        """ORDER BY, SKIP and LIMIT; in a subquery per group of its imports.

        Of WITH, the keys stay as columns, by which a later collect can put its values in order.
        """
        known = {i.expr.text: i.name for i in items if i.expr.text}
        order, kept = [], {}
        for e, down in p.order:
            e = t.Var(known[e.text], text=e.text) if e.text in known and known[e.text] in state.scope else e
            state = self.prepare([e], state)
            key = sort_key(self.expr(e, state)).col
            if not p.final:
                name = self.fresh("o")
                state = replace(state, df=state.df.withColumn(name, key))
                key, kept[f"{ORDER}{len(order):04d}{'-' if down else '+'}"] = c(name), name
            order.append(key.desc_nulls_first() if down else key.asc_nulls_last())
        skip = self.count_of(p.skip, "SKIP")
        limit = self.count_of(p.limit, "LIMIT")
        df = state.df
        if hidden and (skip is not None or limit is not None):
            place = F.row_number().over(Window.partitionBy(*map(c, hidden)).orderBy(*(order or [F.lit(1)])))
            name = self.fresh("w")
            df = df.withColumn(name, place).where(c(name) > (skip or 0))
            return (df.where(c(name) <= (skip or 0) + limit) if limit is not None else df), kept
        if order:
            df = df.orderBy(*order)
        if skip:
            df = df.offset(skip)
        return (df.limit(limit) if limit is not None else df), kept

    def count_of(self, e: t.Expr | None, what: str) -> int | None:
        if e is None:
            return None
        n = self.constant(e)
        if not isinstance(n, int) or isinstance(n, bool) or n < 0:
            raise CypherError(f"{what} takes a whole number of 0 or more")
        return n

    def constant(self, e: t.Expr):
        if isinstance(e, t.Lit):
            return e.value
        if isinstance(e, t.Param):
            return self.param(e.name)
        if names_in(e):
            raise CypherError(f"{e.text} is not constant")
        state = self.unit()
        return state.df.select(self.expr(e, state).col).first()[0]

    def result(self, p: t.Project, state: State) -> tuple[DataFrame, list[str]]:
        items = self.items(p, state)
        names = [i.name for i in items]
        state = self.project(p, state)
        cols = [self.whole(state, n).col.alias(n) for n in names]
        return state.df.select(*map(c, state.hidden), *cols), names

    def aggregate(self, items: list[t.Item], state: State) -> tuple[State, dict]:
        """Group by the items without aggregates and evaluate the others per group."""
        plain = [i for i in items if not has_aggregate(i.expr)]
        state = self.prepare([i.expr for i in items], state)
        scope: dict[str, Entity | str] = {}
        keys, firsts, pre = list(state.hidden), [], []
        for i in plain:
            if isinstance(i.expr, t.Var) and isinstance(e := state.scope.get(i.expr.name), Entity):
                scope[i.name] = e
                keys += e.identity
                firsts += [x for x in e.columns if x not in e.identity]
            else:
                name = self.fresh("s")
                pre.append(self.expr(i.expr, state).col.alias(name))
                keys.append(name)
                scope[i.name] = name
        known = {i.expr.text: i.name for i in plain}
        aggs: list[Column] = []
        inside: dict[str, str] = {}

        def lift(e):
            """The expression with aggregates, keys and what else it reads as variables of the group."""
            if isinstance(e, t.Call) and e.name in AGGREGATES:
                if any(has_aggregate(a) for a in e.args):
                    raise CypherError("aggregates cannot be nested")
                name = self.fresh("a")
                order = [(c(state.scope[k]), k[-1] == "-") for k in sorted(state.scope) if k.startswith(ORDER)]
                aggs.append(aggregates.build(e, [self.expr(a, state) for a in e.args], self, order).alias(name))
                inside[f" {name}"] = name
                return t.Var(f" {name}", text=e.text)
            if isinstance(e, t.Expr) and e.text and e.text in known:
                return t.Var(known[e.text], text=e.text)
            if id(e) in state.ready and is_end(e):
                name = self.fresh("a")
                aggs.append(F.first(self.expr(e, state).col).alias(name))
                inside[f" {name}"] = name
                return t.Var(f" {name}", text=e.text)
            if isinstance(e, (t.Var, t.Prop)) and not (isinstance(e, t.Var) and e.name in scope):
                if isinstance(e, t.Prop) and isinstance(e.of, t.Var) and e.of.name in scope:
                    return e
                if names_in(e) & state.scope.keys():
                    name = self.fresh("a")
                    aggs.append(F.first(self.expr(e, state).col).alias(name))
                    inside[f" {name}"] = name
                    return t.Var(f" {name}", text=e.text)
                return e
            if isinstance(e, list):
                return [lift(x) for x in e]
            if isinstance(e, tuple):
                return tuple(lift(x) for x in e)
            if isinstance(e, dict):
                return {k: lift(x) for k, x in e.items()}
            if hasattr(e, "__dataclass_fields__"):
                return replace(e, **{n: lift(getattr(e, n)) for n in e.__dataclass_fields__ if n != "text"})
            return e

        lifted = [(i, lift(i.expr)) for i in items if has_aggregate(i.expr)]
        df = state.df.select("*", *pre) if pre else state.df
        extra = [F.first(c(x)).alias(x) for x in dict.fromkeys(firsts)]
        keys = list(dict.fromkeys(keys))
        df = df.groupBy(*map(c, keys)).agg(*aggs, *extra)
        grouped = State(df, {**scope, **inside}, state.hidden)
        cols = []
        for i, e in lifted:
            name = self.fresh("s")
            cols.append(self.expr(e, grouped).col.alias(name))
            scope[i.name] = name
        return State(df.select("*", *cols), {}, state.hidden), {i.name: scope[i.name] for i in items}

    # -- expressions -------------------------------------------------------------

    def param(self, name: str):
        if name not in self.params:
            raise CypherError(f"parameter ${name} is missing")
        return self.params[name]

    def literal(self, value, state: State) -> Val:
        if isinstance(value, (list, tuple)):
            return self.list_of([self.literal(x, state) for x in value], state)
        if isinstance(value, dict):
            return self.map_of({k: self.literal(x, state) for k, x in value.items()}, state)
        col = F.lit(value)
        if isinstance(value, int) and not isinstance(value, bool):
            col = col.cast("long")
        return replace(self.val(col, state), constant=value, is_constant=True)

    def list_of(self, vals: list[Val], state: State) -> Val:
        if not vals:
            return self.val(F.array(), state)
        return make(lambda *x: F.array(*x), *unify(vals))

    def map_of(self, items: dict[str, Val], state: State) -> Val:
        if not items:
            return self.val(F.struct(), state)
        return make(lambda *x: F.struct(*[v.alias(k) for k, v in zip(items, x, strict=True)]), *items.values())

    def expr(self, e: t.Expr, state: State, local: dict[str, Val] | None = None) -> Val:
        local = local or {}
        go = lambda x: self.expr(x, state, local)
        if id(e) in state.ready:
            return self.val(c(state.ready[id(e)]), state)
        match e:
            case t.Lit(value):
                return self.literal(value, state)
            case t.Param(name):
                return self.literal(self.param(name), state)
            case t.Var(name):
                if name in local:
                    return local[name]
                if name not in state.scope:
                    raise CypherError(f"{name} is not defined")
                return self.whole(state, name)
            case t.Prop(of, key):
                if isinstance(of, t.Var) and of.name not in local and isinstance(b := state.scope.get(of.name), Entity) and b.kind != "rels":
                    return self.entity_prop(state, b, key)
                return self.get(go(of), key)
            case t.Index(of, at):
                return self.index(go(of), go(at), at)
            case t.Slice(of, start, stop):
                return scalar.slice_bounds(go(of), go(start) if start is not None else None, go(stop) if stop is not None else None)
            case t.ListOf(items):
                return self.list_of([go(x) for x in items], state)
            case t.MapOf(items):
                return self.map_of({k: go(x) for k, x in items.items()}, state)
            case t.Unary(op, of):
                return self.unary(op, go(of))
            case t.Binary(op, left, right):
                if identity_only(e):
                    return self.binary(op, self.identity(left, state, local), self.identity(right, state, local))
                return self.binary(op, go(left), go(right))
            case t.IsNull(of, negated):
                if isinstance(of, t.Var) and of.name not in local and isinstance(b := state.scope.get(of.name), Entity):
                    v = self.val(b.col("list" if b.kind == "rels" else "id"), state)
                else:
                    v = self.identity(of, state, local)
                return make(lambda x: x.isNotNull() if negated else x.isNull(), v)
            case t.HasLabels(of, labels):
                v = go(of)
                if v.kind != "node":
                    return make(lambda x: F.when(x.isNotNull(), F.lit(False)), v)
                out = None
                for label in labels:
                    one = make(lambda x, label=label: F.array_contains(x["labels"], label), v)
                    out = one if out is None else make(lambda x, y: x & y, out, one)
                return out
            case t.Case():
                return self.case(e, go)
            case t.Comprehension():
                return self.comprehension(e, state, local)
            case t.Quantifier():
                return self.quantifier(e, state, local)
            case t.Reduce():
                return self.reduce(e, state, local)
            case t.Call():
                return self.call(e, state, local)
        raise CypherError(f"{type(e).__name__} cannot stand here")

    def get(self, v: Val, key: str) -> Val:
        if temporal.is_temporal(v.kind):
            return temporal.component(v, key)
        if v.kind == "null":
            return make(lambda x: F.lit(None), v)
        if v.kind in ("node", "relationship"):
            if key == "body" and v.kind == "node":
                return make(lambda x: x["body"], v)
            if key == "position" and v.kind == "relationship":
                return make(lambda x: x["position"], v)
            known = v.type["props"].dataType.fieldNames()
            return make(lambda x: x["props"][key], v) if key in known else make(lambda x: F.lit(None), v)
        if v.kind == "map":
            if isinstance(v.type, T.MapType):
                return make(lambda x: F.try_element_at(x, F.lit(key)), v)
            return make(lambda x: x[key], v) if key in v.type.fieldNames() else make(lambda x: F.lit(None), v)
        raise CypherTypeError(f"{v.kind} has no property {key}")

    def index(self, v: Val, at: Val, e: t.Expr) -> Val:
        if "null" in (v.kind, at.kind):
            return make(lambda x, y: F.lit(None), v, at)
        if v.kind == "list":
            if at.kind != "integer":
                raise CypherTypeError("a list's index is an integer")
            return make(lambda x, i: F.get(x, F.when(i < 0, F.size(x) + i).otherwise(i).cast("int")), v, at)
        if at.kind == "string":
            if at.is_constant:
                return self.get(v, at.constant)
            if isinstance(e, t.Lit):
                return self.get(v, e.value)
            if v.kind == "map" and isinstance(v.type, T.MapType):
                return make(lambda x, k: F.try_element_at(x, k), v, at)
            if v.kind in ("map", "node", "relationship"):
                base = v if v.kind == "map" else make(lambda x: x["props"], v)
                names = base.type.fieldNames()
                parts = unify([self.get(base, n) for n in names])

                def pick(k, *xs):
                    out = F.lit(None)
                    for n, x in zip(names, xs, strict=True):
                        out = F.when(k == n, x).otherwise(out)
                    return out

                return make(pick, at, *parts)
        raise CypherTypeError(f"{v.kind} cannot be indexed by {at.kind}")

    def unary(self, op: str, v: Val) -> Val:
        if op == "NOT":
            if v.kind not in ("boolean", "null"):
                raise CypherTypeError(f"NOT takes boolean, not {v.kind}")
            return make(lambda x: ~x.cast("boolean"), v)
        if not numeric(v.kind) and v.kind != "duration":
            raise CypherTypeError(f"{op} takes a number, not {v.kind}")
        if op == "+" or v.kind == "null":
            return v
        if v.is_constant:
            return replace(make(lambda x: -x, v), constant=-v.constant, is_constant=True)
        return make(lambda x: -x, v)

    def binary(self, op: str, a: Val, b: Val) -> Val:
        if op in ("AND", "OR", "XOR"):
            for v in (a, b):
                if v.kind not in ("boolean", "null"):
                    raise CypherTypeError(f"{op} takes boolean, not {v.kind}")
            # The right side is not looked at where the left one decides.
            fns = {
                "AND": lambda x, y: F.when(~x.cast("boolean"), F.lit(False)).otherwise(x.cast("boolean") & y.cast("boolean")),
                "OR": lambda x, y: F.when(x.cast("boolean"), F.lit(True)).otherwise(x.cast("boolean") | y.cast("boolean")),
                "XOR": lambda x, y: x.cast("boolean") != y.cast("boolean"),
            }
            return make(fns[op], a, b)
        if op == "=":
            return equal(a, b)
        if op == "<>":
            return make(lambda x: ~x, equal(a, b))
        if op in ("<", "<=", ">", ">="):
            return less(op, a, b)
        if op == "+":
            return scalar.add(a, b)
        if op in ("-", "*", "/", "%", "^"):
            return scalar.arithmetic(op, a, b)
        if op == "IN":
            return self.contained(a, b)
        if op in ("STARTS WITH", "ENDS WITH", "CONTAINS"):
            if not a.kind == b.kind == "string":
                return make(lambda x, y: F.lit(None).cast("boolean"), a, b)
            fn = {"STARTS WITH": F.startswith, "ENDS WITH": F.endswith, "CONTAINS": F.contains}[op]
            return make(fn, a, b)
        if op == "=~":
            for v in (a, b):
                scalar.want(v, "=~", "string")
            return make(lambda x, y: F.rlike(x.cast("string"), y.cast("string")), a, b)
        raise CypherError(f"unknown operator {op}")

    def contained(self, a: Val, b: Val) -> Val:
        if b.kind == "null":
            return make(lambda x, y: F.lit(None).cast("boolean"), a, b)
        if b.kind != "list":
            raise CypherTypeError(f"IN takes list, not {b.kind}")
        if isinstance(b.type.elementType, T.NullType):
            return make(lambda x, y: F.when(F.size(y) == 0, F.lit(False)), a, b)
        one, put = element(b, f"__in{len(b.env.fields)}")
        outer = Val(a.col, a.shadow, one.env, a.typer, a.known)

        def fn(x, y):
            return F.when(F.size(y) == 0, F.lit(False)).otherwise(F.exists(y, lambda z: equal(replace_col(outer, x), put(z)).col))

        return make(fn, a, b, known=T.BooleanType())

    def case(self, e: t.Case, go) -> Val:
        subject = go(e.subject) if e.subject is not None else None
        tests = [equal(subject, go(w)) if subject is not None else go(w) for w, _ in e.whens]
        results = unify([*[go(x) for _, x in e.whens], *([go(e.default)] if e.default is not None else [])])

        def fn(*cols):
            conds, values = cols[: len(tests)], cols[len(tests) :]
            out = None
            for cond, value in zip(conds, values[: len(tests)], strict=True):
                out = F.when(cond.cast("boolean"), value) if out is None else out.when(cond.cast("boolean"), value)
            return out.otherwise(values[-1]) if e.default is not None else out

        return make(fn, *tests, *results)

    def inside(self, source: Val, local: dict[str, Val], *more: T.StructField) -> T.StructType:
        """Fields that an expression inside a lambda can see."""
        fields = {f.name: f for v in (source, *local.values()) for f in v.env.fields}
        return T.StructType([*fields.values(), *more])

    def lambda_over(self, var: str, source: Val, bodies: list[t.Expr | None], state: State, local: dict, build) -> Val:
        """A value over a list with a lambda per body; ``build`` gets the list and functions from element to column."""
        outer = self.inside(source, local)
        one = T.StructField(f"__x{len(outer.fields)}", source.type.elementType)
        env = T.StructType([*outer.fields, one])
        stand_in = F.col(one.name)

        def side(src: Column, at: dict[str, Val]) -> Column:
            def body(k: int):
                return lambda z: self.expr(bodies[k], state, {**at, var: Val(z, stand_in, env, self.typer, one.dataType)}).col

            return build(src, [body(k) if b is not None else None for k, b in enumerate(bodies)])

        col = side(source.col, {k: Val(v.col, v.shadow, env, v.typer, v.known) for k, v in local.items()})
        shadow = side(source.shadow, {k: Val(v.shadow, v.shadow, env, v.typer, v.known) for k, v in local.items()}) if local or source.col is not source.shadow else col
        return Val(col, shadow, outer, self.typer)

    def comprehension(self, e: t.Comprehension, state: State, local: dict) -> Val:
        source = self.expr(e.source, state, local)
        if source.kind == "null":
            return source
        scalar.want(source, "a list comprehension", "list")

        def build(x, bodies):
            if bodies[0] is not None:
                x = F.filter(x, bodies[0])
            return F.transform(x, bodies[1]) if bodies[1] is not None else x

        return self.lambda_over(e.var, source, [e.where, e.value], state, local, build)

    def quantifier(self, e: t.Quantifier, state: State, local: dict) -> Val:
        source = self.expr(e.source, state, local)
        if source.kind == "null":
            return make(lambda x: F.lit(None).cast("boolean"), source)
        scalar.want(source, e.kind.lower(), "list")
        where = e.where if e.where is not None else t.Var(e.var)

        def build(x, bodies):
            test = bodies[0]
            if e.kind == "ALL":
                return F.forall(x, test)
            if e.kind == "ANY":
                return F.exists(x, test)
            if e.kind == "NONE":
                return ~F.exists(x, test)
            yes = F.size(F.filter(x, test))
            open_ = F.size(F.filter(x, lambda z: test(z).isNull()))
            return F.when(x.isNotNull(), F.when(yes > 1, False).when(open_ > 0, F.lit(None)).otherwise(yes == 1))

        return self.lambda_over(e.var, source, [where], state, local, build)

    def reduce(self, e: t.Reduce, state: State, local: dict) -> Val:
        source, start = self.expr(e.source, state, local), self.expr(e.start, state, local)
        if source.kind == "null":
            return source
        scalar.want(source, "reduce", "list")
        outer = self.inside(source, {**local, " start": start})
        one = T.StructField(f"__x{len(outer.fields)}", source.type.elementType)
        kind = start.type
        for _ in range(2):  # the accumulator's type is that of its body over its start
            env = T.StructType([*outer.fields, one, T.StructField("__acc", kind)])

            def bind(a, z, at, env=env, kind=kind):
                here = {k: Val(v.shadow if at else v.col, v.shadow, env, v.typer, v.known) for k, v in local.items()}
                return {**here, e.acc: Val(a, F.col("__acc"), env, self.typer, kind), e.var: Val(z, F.col(one.name), env, self.typer, one.dataType)}

            found = self.expr(e.value, state, bind(F.col("__acc"), F.col(one.name), True)).type
            if found == kind or isinstance(found, T.NullType):
                break
            kind = found

        def side(src: Column, first: Column, at: bool) -> Column:
            return F.aggregate(src, first.cast(kind), lambda a, z: self.expr(e.value, state, bind(a, z, at)).col.cast(kind))

        col = side(source.col, start.col, False)
        plain = not local and source.col is source.shadow and start.col is start.shadow
        return Val(col, col if plain else side(source.shadow, start.shadow, True), outer, self.typer, kind)

    def call(self, e: t.Call, state: State, local: dict) -> Val:
        if e.name in AGGREGATES:
            raise CypherError(f"{e.name} cannot stand here")
        if e.name == "rand":
            return self.val(F.rand(), state)
        if e.name == "randomuuid":
            return self.val(F.expr("uuid()"), state)
        if e.name == "exists":
            return make(lambda x: x.isNotNull(), self.identity(e.args[0], state, local))
        if len(e.args) == 1 and isinstance(e.args[0], t.Var) and e.args[0].name not in local and isinstance(b := state.scope.get(e.args[0].name), Entity):
            short = {("node", "id"): "id", ("rel", "id"): "id", ("node", "elementid"): "id", ("rel", "elementid"): "id", ("node", "labels"): "labels", ("node", "body"): "body", ("rel", "type"): "type"}
            if b.gone and e.name in ("labels", "properties", "keys"):
                out = scalar.call(e.name, [self.alive(b, self.whole(state, e.args[0].name), e.name)])
                if out is not None:
                    return out
            if (b.kind, e.name) in short:
                return self.val(b.col(short[(b.kind, e.name)]), state)
        args = [self.identity(a, state, local) if identity_only(e) else self.expr(a, state, local) for a in e.args]
        if e.name in ENDS:
            if args[0].kind == "null":
                return args[0]
            scalar.want(args[0], e.name, "relationship")
            if ("ends", id(e)) not in state.ready:
                raise CypherError(f"{e.name} cannot be read here; take it in a WITH before")
            found = self.val(c(state.ready["ends", id(e)]), state)
            return make(lambda r, m: F.try_element_at(m, r[ENDS[e.name]]), args[0], found)
        out = scalar.call(e.name, args)
        if out is None:
            out = temporal.call(e.name, args, self.clock, lambda v: self.literal(v, state))
        if out is None:
            raise CypherError(f"unknown function {e.name}")
        return out

    def identity(self, e: t.Expr, state: State, local: dict) -> Val:
        """An expression of which nothing but the identity is read: an end of a relationship needs no join then."""
        if not is_end(e) or len(e.args) != 1:
            return self.expr(e, state, local)
        v = self.expr(e.args[0], state, local)
        if v.kind == "null":
            return v
        scalar.want(v, e.name, "relationship")
        return make(lambda r: F.when(r.isNotNull(), F.struct(r[ENDS[e.name]].alias(NODE), F.lit(None).cast("array<string>").alias("labels"), F.lit(None).cast("string").alias("body"), F.struct(F.lit(None).cast("string").alias("none")).alias("props"))), v)


def is_end(e) -> bool:
    return isinstance(e, t.Call) and e.name in ENDS


def identity_only(e) -> bool:
    """Whether the expression reads no more of nodes among its parts than which they are."""
    return isinstance(e, t.IsNull) or (isinstance(e, t.Binary) and e.op in ("=", "<>")) or (isinstance(e, t.Call) and e.name in ("id", "elementid", "exists"))


def lambda_names(e) -> set[str]:
    return {e.var, e.acc} if isinstance(e, t.Reduce) else {e.var}


def replace_col(v: Val, col: Column) -> Val:
    return Val(col, v.shadow, v.env, v.typer, v.known or v.type)
