"""CREATE, MERGE, SET, REMOVE and DELETE as changes of node and relationship tables.

A batch works on a staged copy of the graph.  Each writing clause is a set-based
change over all its rows; what it makes or changes is seen by later clauses.  The
batch's result is the difference between the staged and the first graph.
"""

from __future__ import annotations

import secrets
import time
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import Val, equal
from ..plans import tree as t
from ..plans.compiler import Compiler, Entity, State
from ..plans.errors import CypherError, CypherTypeError
from ..plans.parser import parse
from ..sources.graph import NODE, REL, Graph, c, from_rows
from ..sources.store import EDGE_FIXED, NODE_FIXED, Store
from .checkpoints import stored

COUNTERS = ("nodes_created", "relationships_created", "nodes_deleted", "relationships_deleted", "properties_set", "labels_added", "labels_removed")


def new_ids(row: Column) -> Column:
    """Time-ordered ids of version 7: the moment, a random part for the clause, and the row's number."""
    moment = f"{time.time_ns() // 1_000_000:012x}"
    salt = f"{secrets.randbits(12):03x}"
    number = F.lpad(F.lower(F.hex(row)), 15, "0")
    return F.concat(F.lit(f"{moment[:8]}-{moment[8:]}-7{salt}-8"), F.substring(number, 1, 3), F.lit("-"), F.substring(number, 4, 12))


@dataclass
class Batch:
    """A staged graph and what has been counted."""

    graph: Graph
    params: dict | None = None
    counters: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTERS, 0))

    @property
    def nodes(self) -> DataFrame:
        return self.graph.nodes[0].df

    @property
    def edges(self) -> DataFrame:
        return self.graph.edges[0].df

    def count(self, name: str, df: DataFrame) -> None:
        self.counters[name] += df.count()

    # -- staging -----------------------------------------------------------

    def put(self, kind: str, rows: DataFrame) -> None:
        """Rows replace those of their ids; new columns widen the table."""
        old = self.nodes if kind == "nodes" else self.edges
        rest = old.join(rows.select("id"), "id", "left_anti")
        self._set(kind, rest.unionByName(rows, allowMissingColumns=True))

    def drop(self, kind: str, ids: DataFrame) -> None:
        old = self.nodes if kind == "nodes" else self.edges
        self._set(kind, old.join(ids, "id", "left_anti"))

    def _set(self, kind: str, df: DataFrame) -> None:
        df = stored(df)
        nodes, edges = (df, self.edges) if kind == "nodes" else (self.nodes, df)
        self.graph = from_rows(self.graph.spark, nodes, edges, self.graph.revisions)

    # -- clauses -----------------------------------------------------------

    def run(self, statement: t.Statement) -> DataFrame | None:
        comp = Writer(self, self.params)
        comp.used = {x.name for x in t.walk(statement) if isinstance(x, t.Var)} | {x.var for x in t.walk(statement) if isinstance(x, (t.PathPattern, t.NodePattern, t.RelPattern)) and x.var}
        comp.last = {id(branch[-1]) for branch in statement.query.branches}
        _, df, names = comp.query(statement.query, comp.unit())
        out = stored(df) if names else None
        if not names:
            stored(df)
        return out


class Writer(Compiler):
    """The compiler with writing clauses; reads see the batch's staged graph."""

    def __init__(self, batch: Batch, params: dict | None):
        super().__init__(batch.graph, params)
        self.batch = batch
        #: Clauses that nothing follows.
        self.last: set[int] = set()

    def clause(self, clause, state: State) -> State:
        if not isinstance(clause, t.WRITES):
            return super().clause(clause, state)
        row = self.fresh("row")
        df = stored(state.df).withColumn(row, F.monotonically_increasing_id())
        state = replace(state, df=stored(df), unit=False)
        if isinstance(clause, t.Create):
            for p in clause.patterns:
                state = self.create(p, state, row)
        elif isinstance(clause, t.Merge):
            state = self.merge(clause, state, row)
        elif isinstance(clause, t.Set):
            for item in clause.items:
                state = self.set_item(item, state, row)
        elif isinstance(clause, t.Remove):
            for item in clause.items:
                state = self.remove(item, state, row)
        else:
            state = self.delete(clause, state)
        self.graph = self.batch.graph
        return state

    # .. CREATE

    def storable(self, key: str, v: Val) -> Val:
        if v.kind in ("node", "relationship", "path"):
            raise CypherTypeError(f"{v.kind} cannot be stored as {key}")
        return v

    def prop_vals(self, props: t.Expr | None, state: State) -> dict[str, Val]:
        if props is None:
            return {}
        if not isinstance(props, t.MapOf):
            raise CypherError("a pattern's properties are a map")
        vals = {k: self.storable(k, self.expr(e, state)) for k, e in props.items.items()}
        return {k: v for k, v in vals.items() if v.kind != "null"}

    def new_node(self, node: t.NodePattern, state: State, row: str, when: Column | None = None) -> tuple[State, Entity]:
        vals = self.prop_vals(node.props, state)
        prefix = self.fresh("n")
        labels = F.array_sort(F.array_distinct(F.array(*map(F.lit, node.labels)))) if node.labels else F.array().cast("array<string>")
        body = vals.pop("body", None)
        types = {k: v.type for k, v in vals.items()}
        cols = [new_ids(c(row)).alias(f"{prefix}$id"), labels.alias(f"{prefix}$labels"), (F.coalesce(body.col, F.lit("")) if body else F.lit("")).alias(f"{prefix}$body")]
        cols += [v.col.alias(f"{prefix}.{k}") for k, v in vals.items()]
        df = stored(state.df.select("*", *cols))
        entity = Entity("node", prefix, types)
        made = df if when is None else df.where(when)
        rows = made.select(*[entity.col(k).alias(k) for k in NODE_FIXED], *[entity.prop(k).alias(k) for k in types])
        self.batch.put("nodes", rows)
        self.batch.count("nodes_created", rows)
        return replace(state, df=df), entity

    def new_edge(self, rel: t.RelPattern, a: Entity, b: Entity, state: State, row: str) -> tuple[State, Entity]:
        if len(rel.types) != 1 or rel.length is not None:
            raise CypherError("a new relationship has one type and no length")
        vals = self.prop_vals(rel.props, state)
        position = vals.pop("position", None)
        if position is not None and rel.types != ["CHILD"]:
            raise CypherError("only CHILD has a position")
        prefix = self.fresh("r")
        source, target = (b, a) if rel.direction == "in" else (a, b)
        types = {k: v.type for k, v in vals.items()}
        cols = [
            new_ids(c(row)).alias(f"{prefix}$id"),
            source.col("id").alias(f"{prefix}$from"),
            target.col("id").alias(f"{prefix}$to"),
            F.lit(rel.types[0]).alias(f"{prefix}$type"),
            (position.col if position is not None else F.lit(None)).cast("long").alias(f"{prefix}$position"),
        ]
        cols += [v.col.alias(f"{prefix}.{k}") for k, v in vals.items()]
        df = stored(state.df.select("*", *cols))
        entity = Entity("rel", prefix, types)
        rows = df.select(entity.col("id").alias("id"), entity.col("from").alias("from_id"), entity.col("type").alias("type"), entity.col("to").alias("to_id"), entity.col("position").alias("position"), *[entity.prop(k).alias(k) for k in types])
        if not rows.where("from_id IS NULL OR to_id IS NULL").isEmpty():
            raise CypherError("a relationship's end is null")
        self.batch.put("edges", rows)
        self.batch.count("relationships_created", rows)
        return replace(state, df=df), entity

    def create(self, p: t.PathPattern, state: State, row: str) -> State:
        state = self.prepare([x.props for x in (*p.nodes, *p.rels) if x.props is not None], state)
        names = [n.var or f" {self.fresh('anon')}" for n in p.nodes]
        for name, node in zip(names, p.nodes, strict=True):
            if name in state.scope:
                if node.labels or node.props or not p.rels:
                    raise CypherError(f"{name} exists already")
                continue
            state, entity = self.new_node(node, state, row)
            state = replace(state, scope={**state.scope, name: entity})
        made = {}
        for k, rel in enumerate(p.rels):
            if rel.direction == "both":
                raise CypherError("a new relationship has a direction")
            state, entity = self.new_edge(rel, state.scope[names[k]], state.scope[names[k + 1]], state, row)
            made[k] = entity
            if rel.var:
                state = replace(state, scope={**state.scope, rel.var: entity})
        self.graph = self.batch.graph
        if p.var:
            state = self.bind_path(state, p, names, made)
        return replace(state, scope={k: v for k, v in state.scope.items() if not k.startswith(" ")})

    # .. MERGE

    def merge(self, clause: t.Merge, state: State, row: str) -> State:
        """Match or create, once per distinct key; rows after the first of a key see it as matched."""
        p = clause.pattern
        exprs = [*[n.props for n in p.nodes], *[r.props for r in p.rels]]
        state = self.prepare([m for m in exprs if m is not None], state)
        keys = [self.expr(e, state) for m in exprs if m is not None for e in m.items.values()]
        if any(k.kind == "null" for k in keys):
            raise CypherError("MERGE takes no null property")
        names = [f"{row}_k{i}" for i in range(len(keys))]
        bound = [x for n in p.nodes if isinstance(b := state.scope.get(n.var), Entity) for x in b.identity]
        df = stored(state.df.select("*", *[k.col.alias(n) for k, n in zip(keys, names, strict=True)]))
        if names and not df.where(" OR ".join(f"{n} IS NULL" for n in names)).isEmpty():
            raise CypherError("MERGE takes no null property")
        state = replace(state, df=df)
        matched = stored(self.match(t.Match([p], None, False), state).df.select(row).distinct())
        missing = stored(df.join(matched, row, "left_anti"))
        by = [*names, *bound]
        first = missing.groupBy(*map(c, by)).agg(F.min(row).alias(row)).select(row) if by else missing.agg(F.min(row).alias(row)).where(f"{row} IS NOT NULL")
        first = stored(first)
        if not first.isEmpty():
            lead = replace(p, rels=[replace(r, direction="out" if r.direction == "both" else r.direction) for r in p.rels], var=None)
            self.create(lead, replace(state, df=stored(df.join(first, row))), row)
            self.graph = self.batch.graph
        out = self.match(t.Match([p], None, False), state)
        mark = f"{row}_new"
        out = replace(out, df=stored(out.df.join(first.withColumn(mark, F.lit(True)), row, "left").withColumn(mark, F.coalesce(c(mark), F.lit(False)))))
        for items, when in ((clause.on_create, c(mark)), (clause.on_match, ~c(mark))):
            for item in items:
                out = self.set_item(item, out, row, when)
        return out

    # .. SET and REMOVE

    def target(self, e: t.Expr, state: State) -> Entity:
        if isinstance(e, t.Var) and isinstance(b := state.scope.get(e.name), Entity) and b.kind != "rels":
            return b
        raise CypherError(f"{e.text} is no node or relationship")

    def change(self, entity: Entity, state: State, row: str, cols: dict[str, Column], types: dict[str, T.DataType], when: Column | None) -> State:
        """New values for columns of an entity, in the bindings and in the graph; the last row of an id counts."""
        allowed = entity.col("id").isNotNull() if when is None else entity.col("id").isNotNull() & when
        known = {**entity.props, **types}
        wide = replace(entity, props=known)
        df = state.df
        new = {}
        for name in wide.columns:
            old = c(name) if name in df.columns else F.lit(None).cast(known[name.split(".", 1)[1]])
            new[name] = F.when(allowed, cols[name]).otherwise(old) if name in cols else old
        others = [c(x) for x in df.columns if x not in new]
        df = stored(df.select(*others, *[v.alias(k) for k, v in new.items()], allowed.alias(f"{row}_set")))
        # Only what changes is written; a row's other values may be older than the graph's.
        stored_as = {f"{wide.prefix}${k}": k for k in ("labels", "body", "position")} | {f"{wide.prefix}.{k}": k for k in known}
        changed = {name: stored_as[name] for name in cols}
        touched = df.where(c(f"{row}_set"))
        last = touched.groupBy(wide.col("id").alias("id")).agg(F.max_by(F.struct(*[c(k).alias(v) for k, v in changed.items()]), c(row)).alias("s")).select("id", "s.*")
        last = stored(last)
        kind = "nodes" if entity.kind == "node" else "edges"
        before = self.batch.nodes if kind == "nodes" else self.batch.edges
        carried = [x for x in before.columns if x not in last.columns]
        self.batch.put(kind, last.join(before.select("id", *map(c, carried)), "id"))
        self.graph = self.batch.graph
        # All rows of a changed id see its last value.
        mark = f"{row}_last"
        fresh = last.select(c("id").alias(mark), *[c(v).alias(f"{mark}_{v}") for v in changed.values()])
        df = df.join(fresh, wide.col("id") == c(mark), "left")
        cols_now = [F.when(c(mark).isNotNull(), c(f"{mark}_{changed[x]}")).otherwise(c(x)).alias(x) if x in changed else c(x) for x in df.columns if not x.startswith(mark)]
        df = stored(df.select(*cols_now))
        scope = {k: wide if v is entity or (isinstance(v, Entity) and v.prefix == entity.prefix) else v for k, v in state.scope.items()}
        return replace(state, df=df.drop(f"{row}_set"), scope=scope)

    def labels(self, counter: str, e: Entity, changed: Column, df: DataFrame) -> None:
        """Count the labels that change, each once for a node."""
        rows = df.where(e.col("id").isNotNull()).select(e.col("id").alias("id"), F.explode(changed).alias("label"))
        self.batch.count(counter, rows.distinct())

    def set_item(self, item: t.SetItem, state: State, row: str, when: Column | None = None) -> State:
        if not isinstance(item.target, t.HasLabels):
            state = self.prepare([item.value], state)
        if isinstance(item.target, t.HasLabels):
            e = self.target(item.target.of, state)
            self.labels("labels_added", e, F.array_except(F.array(*map(F.lit, item.target.labels)), e.col("labels")), state.df if when is None else state.df.where(when))
            return self.change(e, state, row, {f"{e.prefix}$labels": F.array_sort(F.array_union(e.col("labels"), F.array(*map(F.lit, item.target.labels))))}, {}, when)
        if isinstance(item.target, t.Prop):
            e = self.target(item.target.of, state)
            v = self.storable(item.target.key, self.expr(item.value, state))
            if v.kind == "map":
                raise CypherTypeError("SET of a property takes a scalar or a list")
            return self.set_props(e, {item.target.key: v}, state, row, when)
        e = self.target(item.target, state)
        v = self.expr(item.value, state)
        if v.kind in ("node", "relationship"):
            v = Val(v.col["props"], v.shadow["props"], v.env, v.typer)
        if not isinstance(v.type, T.StructType):
            raise CypherTypeError("SET of an entity takes a map")
        vals = {f.name: Val(v.col[f.name], v.shadow[f.name], v.env, v.typer, f.dataType) for f in v.type.fields if f.name != "none"}
        if not item.add:
            nothing = lambda k: self.val(F.lit(None).cast(e.props[k]), state, T.NullType())
            vals = {**{k: nothing(k) for k in e.props if k not in vals}, **vals}
        return self.set_props(e, vals, state, row, when)

    def set_props(self, e: Entity, vals: dict[str, Val], state: State, row: str, when: Column | None) -> State:
        cols, types = {}, {}
        for k, v in vals.items():
            if (e.kind, k) in (("node", "body"), ("rel", "position")):
                col = F.coalesce(v.col.cast("string"), F.lit("")) if k == "body" else v.col.cast("long")
                cols[f"{e.prefix}${k}"] = col
                continue
            kind = e.props.get(k) or (self.graph.node_props() if e.kind == "node" else self.graph.edge_props()).get(k)
            if v.kind == "null":
                if kind is None:
                    continue
                types[k] = kind
            else:
                if kind is not None and type(kind) is not type(v.type):
                    raise CypherTypeError(f"{k} holds {kind.simpleString()}, not {v.type.simpleString()}")
                types[k] = v.type
            cols[f"{e.prefix}.{k}"] = v.col.cast(types[k])
        if not cols:
            return state
        self.batch.counters["properties_set"] += len(cols) * (state.df if when is None else state.df.where(when)).where(e.col("id").isNotNull()).count()
        return self.change(e, state, row, cols, types, when)

    def remove(self, item: t.Expr, state: State, row: str) -> State:
        if isinstance(item, t.HasLabels):
            e = self.target(item.of, state)
            gone = F.array(*map(F.lit, item.labels))
            self.labels("labels_removed", e, F.array_intersect(e.col("labels"), gone), state.df)
            return self.change(e, state, row, {f"{e.prefix}$labels": F.array_except(e.col("labels"), gone)}, {}, None)
        if not isinstance(item, t.Prop):
            raise CypherError("REMOVE takes a property or labels")
        e = self.target(item.of, state)
        return self.set_props(e, {item.key: self.val(F.lit(None), state, T.NullType())}, state, row, None)

    # .. DELETE

    def delete(self, clause: t.Delete, state: State) -> State:
        """The state in which variables know whether they were deleted, if a clause follows."""
        gone: dict[str, list[DataFrame]] = {"node": [], "rel": []}
        nodes, edges = [], []
        for item in clause.items:
            v = self.expr(item, state)
            flat = state.df.select(v.col.alias("v"))
            kind = v.kind
            if kind == "list":
                flat = flat.select(F.explode("v").alias("v"))
                fields = v.type.elementType.fieldNames()
                kind = "node" if fields[:1] == [NODE] else "relationship" if fields[:1] == [REL] else "other"
            if kind == "node":
                nodes.append(flat.select(F.col("v")[NODE].alias("id")))
            elif kind == "relationship":
                edges.append(flat.select(F.col("v")[REL].alias("id")))
            elif kind == "path":
                nodes.append(flat.select(F.explode("v.nodes").alias("n")).select(F.col("n")[NODE].alias("id")))
                edges.append(flat.select(F.explode("v.relationships").alias("r")).select(F.col("r")[REL].alias("id")))
            elif kind != "null":
                raise CypherTypeError(f"DELETE doesn't take {kind}")
        union = lambda frames: stored(_union(frames).where("id IS NOT NULL").distinct())
        if edges:
            ids = union(edges)
            self.batch.count("relationships_deleted", self.batch.edges.join(ids, "id", "left_semi"))
            self.batch.drop("edges", ids)
            gone["rel"].append(ids)
        if nodes:
            ids = union(nodes)
            all_edges = self.batch.edges
            touching = stored(all_edges.select("id", F.explode(F.array("from_id", "to_id")).alias("end")).join(ids.select(F.col("id").alias("end")), "end", "left_semi").select("id").distinct())
            if not touching.isEmpty():
                if not clause.detach:
                    raise CypherError("a node with relationships is deleted with DETACH only")
                self.batch.count("relationships_deleted", touching)
                self.batch.drop("edges", touching)
                gone["rel"].append(touching)
            self.batch.count("nodes_deleted", self.batch.nodes.join(ids, "id", "left_semi"))
            self.batch.drop("nodes", ids)
            gone["node"].append(ids)
        if id(clause) in self.last:
            return state
        df, scope = state.df, dict(state.scope)
        for name, e in state.scope.items():
            if not isinstance(e, Entity) or not gone.get(e.kind):
                continue
            mark = self.fresh("gone")
            df = df.join(_union(gone[e.kind]).select(F.col("id").alias(mark)).distinct(), e.col("id") == c(mark), "left")
            before = e.col("gone") if e.gone else F.lit(False)
            df = df.withColumn(f"{e.prefix}$gone", before | c(mark).isNotNull()).drop(mark)
            scope[name] = replace(e, gone=True)
        return replace(state, df=df, scope=scope)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def check(graph: Graph) -> None:
    """What must hold before a commit: ends exist, and CHILD is a forest."""
    nodes, edges = graph.nodes[0].df, graph.edges[0].df
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id"))
    if not ends.join(nodes.select("id"), "id", "left_anti").isEmpty():
        raise CypherError("a relationship's end does not exist")
    if not edges.where("position IS NOT NULL AND type <> 'CHILD'").isEmpty():
        raise CypherError("only CHILD has a position")
    child = edges.where("type = 'CHILD'").select("from_id", "to_id")
    if not child.groupBy("to_id").count().where("count > 1").isEmpty():
        raise CypherError("a node has more than one parent")
    # With one parent each, a cycle is what is left after taking leaves away again and again.
    left = stored(child)
    while not left.isEmpty():
        inner = stored(left.join(left.select(F.col("from_id").alias("p")).distinct(), F.col("to_id") == F.col("p"), "left_semi"))
        if inner.count() == left.count():
            raise CypherError("CHILD has a cycle")
        left = inner


def difference(before: DataFrame, after: DataFrame, fixed: dict) -> DataFrame:
    """Rows of ``after`` that are new or changed, and ids that are gone, with a column deleted."""
    names = list(dict.fromkeys([*before.columns, *after.columns]))
    types = {f.name: f.dataType for d in (before, after) for f in d.schema}
    full = lambda d: d.select(*[c(n) if n in d.columns else F.lit(None).cast(types[n]).alias(n) for n in names])
    a, b = full(before), full(after)
    changed = b.join(a, [b[n].eqNullSafe(a[n]) for n in names], "left_anti").withColumn("deleted", F.lit(False))
    gone = a.join(b.select("id"), "id", "left_anti").select(*names).withColumn("deleted", F.lit(True))
    return changed.unionByName(gone)


def execute(store: Store, text: str, params: dict | None = None, actor: str = "", message: str = "") -> tuple[list[DataFrame | None], dict]:
    """Run a batch of statements as one revision; any error leaves the store as it was.

    Returns the statements' results and the summary: counters and the revision, or
    None for it where nothing changed in the end.
    """
    start = store.graph()
    batch = Batch(from_rows(store.spark, stored(start.nodes[0].df), stored(start.edges[0].df), start.revisions), params)
    first = batch.graph
    results = [batch.run(s) for s in parse(text) if s.mode != "explain"]
    check(batch.graph)
    nodes = stored(difference(first.nodes[0].df, batch.nodes, NODE_FIXED))
    edges = stored(difference(first.edges[0].df, batch.edges, EDGE_FIXED))
    revision = None if nodes.isEmpty() and edges.isEmpty() else store.commit(nodes, edges, actor, message)
    return results, {**batch.counters, "revision": revision}
