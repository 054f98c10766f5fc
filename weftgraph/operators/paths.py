"""Variable-length and shortest paths.

Trails of bounded length are unrolled joins, one level each; unbounded ones run
level by level until no trail grows.  Shortest paths search breadth-first from all
starts at once, keeping per (start, node) only the first level that reaches it.
"""

from __future__ import annotations

from dataclasses import replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import tree as t
from ..plans.errors import CypherError
from ..sources.graph import REL, c
from .checkpoints import stored

if TYPE_CHECKING:
    from ..plans.compiler import Compiler, Entity, State

#: Bounded lengths up to this are one plan; longer ones are cut at each level.
UNROLLED = 6
#: Levels of a search are kept as they were written until there are more of them.
MERGED = 16
#: So many nodes at most are sent to all executors, to find their relationships.
BROADCAST = 10_000


def bounds(comp: Compiler, rel: t.RelPattern) -> tuple[int, int | None]:
    low, high = rel.length
    lo = comp.constant(low) if low is not None else 1
    hi = comp.constant(high) if high is not None else None
    for b in (lo, hi):
        if b is not None and (not isinstance(b, int) or b < 0):
            raise CypherError("the bounds of a variable length are whole numbers of 0 or more")
    return lo, hi


def around(comp: Compiler, rel: t.RelPattern, back: bool, labels: frozenset[str] | None) -> frozenset[str] | None:
    """Labels of the nodes that such relationships can lead to, however often, from nodes with these; None: any."""
    ends = [(e.source, e.target) for e in comp.graph.edge_tables(rel.types)]
    if labels is None or any(None in x for x in ends):
        return None
    if rel.direction == "both":
        ends += [(b, a) for a, b in ends]
    elif (rel.direction == "in") != back:
        ends = [(b, a) for a, b in ends]
    while more := frozenset(b for a, b in ends if a in labels) - labels:
        labels |= more
    return labels


def all_nodes(comp: Compiler, labels: frozenset[str] | None = None) -> DataFrame:
    """$far_id and $node: every node with one of the labels as a whole value."""
    df, e = comp.scan(None, [], labels)
    return df.select(e.col("id").alias("$far_id"), comp.entity_struct(e, path=True).alias("$node"))


def variable(comp: Compiler, state: State, near: Entity, rel: t.RelPattern, node: t.NodePattern, far_name: str, back: bool, trail: list, pattern: t.PathPattern):
    from ..plans.compiler import Entity

    lo, hi = bounds(comp, rel)
    prefix = comp.fresh("r")
    anyone = replace(near, labels=around(comp, rel, back, near.labels))
    edges, e, far_labels, _, _ = comp.edge_frame(replace(rel, length=None), back, anyone, [], False)
    whole = bool(pattern.var) or (rel.var is not None and (rel.var in comp.used or "*" in comp.used))
    types = e.labels
    # Along types that cannot form a cycle no relationship comes up twice.
    free = types is not None and types <= comp.graph.acyclic and rel.direction != "both"
    listed = whole or not free
    item = comp.entity_struct(e, path=True) if whole else F.struct(e.col("id").alias(REL))
    element = comp.rel_type() if whole else T.StructType([T.StructField(REL, T.StringType())])
    names = {k: f"{prefix}${k}" for k in ("list", "far", "nodes")}
    cur = state.df.withColumn(names["far"], near.col("id"))
    if listed:
        cur = cur.withColumn(names["list"], F.array().cast(T.ArrayType(element)))
    nodes = all_nodes(comp, anyone.labels) if pattern.var else None
    if nodes is not None:
        cur = cur.withColumn(names["nodes"], F.array(comp.entity_struct(near, path=True)))
    keep = cur.columns
    found, level = ([cur] if lo == 0 else []), 0
    while (hi is None or level < hi) and not (hi is not None and lo > hi):
        level += 1
        nxt = cur.join(edges, c(names["far"]) == c(f"{e.prefix}$near"))
        if listed and not free:
            nxt = nxt.where(~F.exists(c(names["list"]), lambda r: r[REL] == e.col("id")))
        for other in trail:
            if other.kind == "rel":
                nxt = nxt.where(other.col("id") != e.col("id"))
            else:
                nxt = nxt.where(~F.exists(other.col("list"), lambda r: r[REL] == e.col("id")))
        nxt = comp.having(replace(state, df=nxt), e, rel.props).df
        if listed:
            nxt = nxt.withColumn(names["list"], F.concat(c(names["list"]), F.array(item)))
        nxt = nxt.withColumn(names["far"], c(f"{e.prefix}$far"))
        if nodes is not None:
            nxt = nxt.join(nodes, c(names["far"]) == c("$far_id")).withColumn(names["nodes"], F.concat(c(names["nodes"]), F.array(c("$node"))))
        cur = nxt.select(*map(c, keep))
        if hi is None or hi > UNROLLED:
            cur = stored(cur)
            if cur.isEmpty():
                break
        if level >= lo:
            found.append(cur)
    df = found[0] if found else cur.where(F.lit(False))
    for f in found[1:]:
        df = df.unionByName(f)
    if listed and back:
        df = df.withColumn(names["list"], F.reverse(c(names["list"])))
    if nodes is not None:
        ordered = F.reverse(c(names["nodes"])) if back else c(names["nodes"])
        df = df.withColumn(names["nodes"], F.slice(ordered, 2, F.size(ordered)))
    entity = Entity("rels", prefix, {}, types)
    scope = dict(state.scope)
    if rel.var:
        scope[rel.var] = entity
    if listed:
        trail.append(entity)
    labels = None
    if far_labels is not None and None not in far_labels:
        labels = far_labels | (near.labels or frozenset() if lo == 0 else frozenset())
        labels = None if lo == 0 and near.labels is None else labels
    state = comp.far_end(replace(state, df=df, scope=scope, unit=False), entity, node, far_name, labels, None, False, pattern)
    return state, entity


def shortest(comp: Compiler, pattern: t.PathPattern, state: State) -> State:
    """The shortest path of each input row, or all of that length.

    One relationship pattern of length 0 or 1 and more is searched breadth-first;
    any other pattern is matched in full and its shortest paths kept.
    """
    imports = comp.import_columns(state, list(state.scope))
    name = pattern.var or f" {comp.fresh('path')}"
    rel = pattern.rels[0] if len(pattern.rels) == 1 else None
    lo, hi = (bounds(comp, rel) if rel.length is not None else (1, 1)) if rel is not None else (2, None)
    if lo > 1:
        state = comp.path(replace(pattern, shortest=None, var=name), state)
        path, fixed = state.scope[name], False
    else:
        state, path, fixed = breadth_first(comp, pattern, state, rel, lo, hi)
    df = state.df
    if not fixed:
        # Over all starts and ends of a row, the least length counts.
        place = comp.fresh("w")
        order = [F.size(c(path)["relationships"]), F.transform(c(path)["relationships"], lambda r: r[REL])]
        window = Window.partitionBy(*map(c, imports)) if imports else Window.partitionBy(F.lit(1))
        rank = F.row_number().over(window.orderBy(*order)) if pattern.shortest == "one" else F.rank().over(window.orderBy(order[0]))
        df = df.withColumn(place, rank).where(c(place) == 1).drop(place)
    scope = {k: v for k, v in state.scope.items() if not k.startswith(" ")}
    if pattern.var:
        scope[pattern.var] = path
    if lo <= 1 and rel.var:
        rels = comp.fresh("s")
        df = df.withColumn(rels, c(path)["relationships"])
        scope[rel.var] = rels
    return replace(state, df=df, scope=scope, unit=False)


def breadth_first(comp: Compiler, pattern: t.PathPattern, state: State, rel: t.RelPattern, lo: int, hi: int | None) -> tuple[State, str, bool]:
    """Both ends and a path column, and whether the ends were bound before."""
    ends = [n.var or f" {comp.fresh('anon')}" for n in pattern.nodes]
    fixed = all(n in state.scope for n in ends)
    for name, node in zip(ends, pattern.nodes, strict=True):
        if name in state.scope:
            state = comp.narrow(state, state.scope[name], node)
        else:
            df, entity = comp.scan(name, node.labels)
            state = replace(state, df=df if state.unit else state.df.crossJoin(df), scope={**state.scope, name: entity}, unit=False)
            state = comp.having(state, entity, node.props)
    a, b = state.scope[ends[0]], state.scope[ends[1]]
    # Where only lengths are asked of a path between given ends, no step of it is carried.
    narrow = fixed and not (rel.var and (rel.var in comp.used or "*" in comp.used)) and (not pattern.var or pattern.var in comp.measured)
    if narrow and state.product is not None and (parts := state.product.parts(state, *ends)):
        df, name = between(comp, state, a, b, parts, rel, lo, hi, pattern.shortest)
        return replace(state, df=df), name, fixed
    found = search(comp, state, a, b, rel, lo, hi, pattern.shortest, narrow)
    name = comp.fresh("p")
    df = state.df.join(found, (a.col("id") == c("$src")) & (b.col("id") == c("$dst"))).withColumn(name, c("$path")).drop("$src", "$dst", "$path")
    return replace(state, df=df), name, fixed


def between(comp: Compiler, state: State, a: Entity, b: Entity, parts: list[State], rel: t.RelPattern, lo: int, hi: int | None, kind: str) -> tuple[DataFrame, str]:
    """Bindings with a narrow path, from all nodes of one table to all of another, of which no pairs are made."""
    one = replace(rel, length=None)
    keyed = a.key_label is not None and b.key_label is not None and all(single_tables(comp, one, back, e.key_label) for back, e in ((False, a), (True, b)))
    own = [e.col("key" if keyed else "id") for e in (a, b)]
    sides = [stored(part.df.select(x.alias("$id")).where(c("$id").isNotNull()).distinct()) for part, x in zip(parts, own, strict=True)]
    sizes = [s.count() for s in sides]
    # The search goes from the side with fewer nodes.
    back = sizes[1] < sizes[0]
    near, far = (b, a) if back else (a, b)
    if back:
        sides, sizes = sides[::-1], sizes[::-1]
    found = counted(comp, state, one, back, near, far, *sides, sizes[1], lo, hi, kind, keyed)
    if back:
        found = found.select(c("$dst").alias("$src"), c("$src").alias("$dst"), "$level", "$n")
    df = parts[0].df.join(found, own[0] == c("$src")).join(parts[1].df, own[1] == c("$dst"))
    for test in state.product.tests:
        df = df.where(test)
    if kind == "all":
        # A row for each path, in lists of bounded length.
        df = df.withColumn("$part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(`$n` - 1) div 1000"))))
        df = df.withColumn("$one", F.explode(F.sequence(F.lit(1).cast("long"), F.least(c("$n") - c("$part") * 1000, F.lit(1000)))))
    name = comp.fresh("p")
    steps = F.array_repeat(F.struct(F.lit(None).cast("string").alias(REL)), c("$level"))
    path = F.struct(F.array().cast("array<string>").alias("nodes"), steps.alias("relationships"))
    return df.withColumn(name, path).drop("$src", "$dst", "$level", "$n", "$part", "$one"), name


def single_tables(comp: Compiler, rel: t.RelPattern, back: bool, label: str) -> bool:
    """Whether each step from nodes with a label reads one table, so that a level's nodes are told apart by their key."""
    from ..plans.compiler import Entity

    known: set[str] = set()
    while label not in known:
        known.add(label)
        ends = comp.edge_frame(rel, back, Entity("node", "none", {}, frozenset({label})), [], False)[3]
        if ends is None or ends[1] is None:
            return False
        label = ends[1]
    return True


def counted(comp: Compiler, state: State, rel: t.RelPattern, back: bool, near: Entity, far: Entity, starts: DataFrame, ends: DataFrame, size: int, lo: int, hi: int | None, kind: str, keyed: bool) -> DataFrame:
    """$src, $dst, $level and $n: the length of the shortest paths from each start to each end, and how many there are.

    A level holds each (start, node) once, with the number of paths to it.
    """
    label, labels = near.key_label, near.labels
    few = size <= BROADCAST
    frontier = starts.select(c("$id").alias("$src"), c("$id").alias("$at"), F.lit(1).cast("long").alias("$n"))
    seen, hits, level, rows = [(label, frontier.select("$src", "$at"))], [], 0, starts.count()
    # A start is no end of its own but by a path of length 0.
    itself = F.lit(0) if lo == 0 else c("$end").isNotNull().cast("int")
    goals = starts.join(ends.select(c("$id").alias("$end")), c("$id") == c("$end"), "left").select(c("$id").alias("$src"), (F.lit(size) - itself).alias("$goal"))

    def wanted(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(ends) if few else ends, c("$at") == c("$id"), "left_semi")

    if lo == 0 and (not keyed or label == far.key_label):
        hits.append(wanted(frontier).withColumn("$level", F.lit(0)))
    while hi is None or level < hi:
        level += 1
        if hits:  # a start that has found every end is searched on no more
            got = together(hits).groupBy("$src").agg(F.count(F.lit(1)).alias("$got"))
            open_ = goals.join(got, "$src", "left").where(F.coalesce(c("$got"), F.lit(0)) < c("$goal"))
            frontier = frontier.join(open_, "$src", "left_semi")
        edges, e, far_labels, tables, _ = comp.edge_frame(rel, back, replace(near, labels=labels), [], False)
        if keyed:
            label, labels = tables[1], frozenset({tables[1]})
        else:
            label, labels = None, far_labels if far_labels is None or None not in far_labels else None
        edges = comp.having(replace(state, df=edges, scope={}, product=None), e, rel.props).df
        x, y = (f"{e.prefix}${n}{'_key' if keyed else ''}" for n in ("near", "far"))
        edges = edges.select(c(x).alias("$near"), c(y).alias("$to"))
        if rows <= BROADCAST:
            # The relationships of few nodes are picked before they are dealt out.
            edges = edges.join(F.broadcast(frontier.select("$at").distinct()), c("$near") == c("$at"), "left_semi")
            frontier = F.broadcast(frontier)
        nxt = edges.join(frontier, c("$near") == c("$at")).select("$src", c("$to").alias("$at"), "$n")
        last = level == hi
        if last and few:
            nxt = wanted(nxt)
        nxt = nxt.groupBy("$src", "$at").agg((F.sum("$n") if kind == "all" else F.lit(1).cast("long")).alias("$n"))
        before = [s for k, s in seen if not keyed or k == label]
        if before:
            nxt = nxt.join(together(before).select(c("$src").alias("$s"), c("$at").alias("$seen")), (c("$src") == c("$s")) & (c("$at") == c("$seen")), "left_anti")
        if last:
            if not keyed or label == far.key_label:
                hits.append((nxt if few else wanted(nxt)).withColumn("$level", F.lit(level)))
            break
        frontier = stored(nxt)
        rows = frontier.count()
        if not rows:
            break
        if not keyed or label == far.key_label:
            hits.append(stored(wanted(frontier).withColumn("$level", F.lit(level))))
        seen.append((label, frontier.select("$src", "$at")))
        if len(seen) > MERGED:
            kinds = {k for k, _ in seen}
            seen = [(k, stored(together([s for other, s in seen if other == k]))) for k in kinds]
            hits = [stored(together(hits))] if hits else []
    if not hits:
        hits = [frontier.where(F.lit(False)).withColumn("$level", F.lit(0))]
    return together(hits).select("$src", c("$at").alias("$dst"), "$level", "$n")


def together(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def search(comp: Compiler, state: State, a: Entity, b: Entity, rel: t.RelPattern, lo: int, hi: int | None, kind: str, narrow: bool) -> DataFrame:
    """$src, $dst, $path for the wanted pairs, breadth first; a narrow path has relationships without values."""
    from ..plans.compiler import Entity

    pairs = stored(state.df.select(a.col("id").alias("$src"), b.col("id").alias("$dst")).where(c("$src").isNotNull() & c("$dst").isNotNull()).distinct())
    near = Entity("node", "none", {}, around(comp, rel, False, a.labels))
    edges, e, _, _, _ = comp.edge_frame(replace(rel, length=None), False, near, [], False)
    edges = comp.having(replace(state, df=edges, scope={}), e, rel.props).df
    edges = edges.select(c(f"{e.prefix}$near").alias("$near"), c(f"{e.prefix}$far").alias("$far_id"), *([] if narrow else [comp.entity_struct(e, path=True).alias("$rel")]))
    starts = pairs.select("$src").distinct()
    steps = [] if narrow else ["$nodes", "$rels"]
    if narrow:
        frontier = stored(starts.select("$src", c("$src").alias("$at")))
    else:
        nodes = all_nodes(comp, near.labels)
        none = F.array().cast(T.ArrayType(comp.rel_type()))
        starts = starts.join(nodes.select(c("$far_id").alias("$src"), c("$node").alias("$first")), "$src")
        frontier = stored(starts.select("$src", c("$src").alias("$at"), F.array("$first").alias("$nodes"), none.alias("$rels")))
    seen, hits, left, level = [frontier.select("$src", "$at")], [], pairs, 0

    def found(level: int, at: DataFrame) -> DataFrame:
        ends = at.join(left.select(c("$src").alias("$s"), "$dst"), (c("$src") == c("$s")) & (c("$at") == c("$dst")))
        if narrow:
            one = T.ArrayType(T.StructType([T.StructField(REL, T.StringType())]))
            empty = F.array_repeat(F.struct(F.lit(None).cast("string").alias(REL)), level).cast(one)
            return ends.select("$src", "$dst", F.array().cast("array<string>").alias("$nodes"), empty.alias("$rels"))
        return ends.select("$src", "$dst", *steps)

    if lo == 0:
        hits.append(stored(found(0, frontier)))
        left = stored(pairs.where(c("$src") != c("$dst")))
    while hi is None or level < hi:
        level += 1
        # What a start still looks for decides whether it is searched on.
        going = frontier.join(left.select(c("$src").alias("$s")).distinct(), c("$src") == c("$s"), "left_semi")
        before = seen[0]
        for s in seen[1:]:
            before = before.unionByName(s)
        nxt = going.join(edges, c("$at") == c("$near")).join(before.select(c("$src").alias("$s"), c("$at").alias("$seen")), (c("$src") == c("$s")) & (c("$far_id") == c("$seen")), "left_anti")
        if level == hi:  # nothing is searched from here on, so only wanted ends count
            nxt = nxt.join(left.select(c("$src").alias("$s"), c("$dst").alias("$d")), (c("$src") == c("$s")) & (c("$far_id") == c("$d")), "left_semi")
        if narrow:
            nxt = nxt.select("$src", c("$far_id").alias("$at"))
            nxt = nxt.distinct() if kind == "one" else nxt
        else:
            nxt = nxt.select("$src", "$far_id", "$nodes", F.concat("$rels", F.array("$rel")).alias("$rels"))
            if kind == "one":
                key = F.transform("$rels", lambda r: r[REL])
                nxt = nxt.groupBy("$src", "$far_id").agg(F.min_by(F.struct("$nodes", "$rels"), key).alias("$best")).select("$src", "$far_id", "$best.$nodes", "$best.$rels")
            nxt = nxt.join(nodes, "$far_id").select("$src", c("$far_id").alias("$at"), F.concat("$nodes", F.array("$node")).alias("$nodes"), "$rels")
        frontier = stored(nxt)
        if frontier.isEmpty():
            break
        here = stored(found(level, frontier))
        hits.append(here)
        left = stored(left.join(here.select("$src", "$dst").distinct(), ["$src", "$dst"], "left_anti"))
        if left.isEmpty():
            break
        seen.append(frontier.select("$src", "$at").distinct())
        if len(seen) > MERGED:
            merged = seen[0]
            for s in seen[1:]:
                merged = merged.unionByName(s)
            seen = [stored(merged)]
    if not hits:
        hits = [found(0, frontier).where(F.lit(False))]
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out.select("$src", "$dst", F.struct(c("$nodes").alias("nodes"), c("$rels").alias("relationships")).alias("$path"))
