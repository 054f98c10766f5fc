"""Procedures: what labels, types, properties, nodes, relationships and revisions there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.errors import CypherError
from ..sources.graph import c, merged


def call(comp, name: str, args: list) -> tuple[DataFrame, list[str]]:
    graph, spark = comp.graph, comp.spark
    if name == "db.labels":
        frames = [n.canonical().select(F.explode("$labels").alias("label")) if n.label is None else n.df.limit(1).select(F.lit(n.label).alias("label")) for n in graph.nodes]
        return merged(frames).distinct().orderBy("label"), ["label"]
    if name == "db.relationshiptypes":
        frames = [e.canonical().select(c("$type").alias("relationshipType")) if e.type is None else e.df.limit(1).select(F.lit(e.type).alias("relationshipType")) for e in graph.edges]
        return merged(frames).distinct().orderBy("relationshipType"), ["relationshipType"]
    if name == "db.propertykeys":
        return property_keys(graph), ["propertyKey"]
    if name == "graph.nodes":
        df, e = comp.scan(None, [])
        return df.select(comp.entity_struct(e, path=True).alias("node")), ["node"]
    if name == "graph.edges":
        frames = []
        for e in graph.edges:
            from ..plans.compiler import Entity

            entity = Entity("rel", "x", e.prop_types)
            df = e.canonical().select(*[c(f"${n}").alias(f"x${n}") for n in ("id", "from", "to", "type", "position")], *[c(p).alias(f"x.{p}") for p in e.prop_types])
            frames.append(df.select(comp.entity_struct(entity, path=True).alias("relationship")))
        return merged(frames), ["relationship"]
    if name == "graph.revisions":
        return revisions(graph, *args), ["revision", "time", "actor", "message", "next"]
    raise CypherError(f"unknown procedure {name}")


def property_keys(graph) -> DataFrame:
    """Names of properties that some node or relationship has; body and position where set."""
    frames = []
    for table in [*graph.nodes, *graph.edges]:
        df = table.canonical()
        props = list(table.props if hasattr(table, "canonical") and hasattr(table, "label") else table.prop_types)
        tests = [F.max(c(p).isNotNull()).alias(p) for p in props]
        if hasattr(table, "label"):
            tests.append(F.max(c("$body") != "").alias("body"))
        else:
            tests.append(F.max(c("$position").isNotNull()).alias("position"))
        row = df.agg(*tests)
        frames.append(row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("propertyKey"), c(n).alias("set")) for n in row.columns])).alias("k")).where("k.set").select("k.propertyKey"))
    return merged(frames).distinct().orderBy("propertyKey")


def revisions(graph, limit: int = 100, cursor: int | None = None, order: str = "asc") -> DataFrame:
    """A page of revisions in order, each with the cursor after it where more follow."""
    if not 0 <= limit <= 1000:
        raise CypherError("a page has 0 to 1000 revisions")
    if graph.revisions is None:
        raise CypherError("this graph has no history")
    up = str(order).lower() != "desc"
    df = graph.revisions
    if cursor is not None:
        df = df.where(F.col("revision") > cursor if up else F.col("revision") < cursor)
    by = F.col("revision").asc() if up else F.col("revision").desc()
    page = df.orderBy(by).limit(limit + 1)
    last = page.orderBy(by).limit(limit).agg((F.max if up else F.min)("revision").alias("at"), F.lit(None).alias("x")).select("at")
    more = page.agg(F.count("*").alias("n"))
    return page.orderBy(by).limit(limit).crossJoin(F.broadcast(last)).crossJoin(F.broadcast(more)).select("revision", F.col("time"), "actor", "message", F.when(F.col("n") > limit, F.col("at")).alias("next"))
