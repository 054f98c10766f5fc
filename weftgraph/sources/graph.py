"""Graphs as tables: labelled nodes and typed relationships over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE, REL = "__node", "__rel"


def c(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class NodeTable:
    """Nodes of one label, by a unique key; or, without a label, nodes with columns id, labels, body."""

    df: DataFrame
    label: str | None = None
    key: str | None = None

    @property
    def props(self) -> dict[str, T.DataType]:
        skip = {"id", "labels", "body"} if self.label is None else set()
        return {f.name: f.dataType for f in self.df.schema if f.name not in skip}

    def canonical(self) -> DataFrame:
        """id, labels, body, key and the properties."""
        if self.label is None:
            return self.df.select(c("id").alias("$id"), c("labels").alias("$labels"), c("body").alias("$body"), c("id").alias("$key"), *map(c, self.props))
        key = c(self.key)
        return self.df.select(F.concat(F.lit(f"{self.label}:"), key.cast("string")).alias("$id"), F.array(F.lit(self.label)).alias("$labels"), F.lit("").alias("$body"), key.alias("$key"), *map(c, self.props))


@dataclass
class EdgeTable:
    """Relationships of one type between nodes of two labels, by their keys.

    Without a type: columns id, from_id, type, to_id, position and properties.
    ``key`` is what makes an edge unique among those of its table: a column, or a
    text and a column's name.  ``node_end`` says that the table is also the node
    table of one end, so that an edge's row holds that node's properties.
    """

    df: DataFrame
    type: str | None = None
    source: str | None = None
    target: str | None = None
    source_key: str | None = None
    target_key: str | None = None
    key: Column | tuple[str, str] | None = None
    props: tuple[str, ...] = ()
    position: str | None = None
    node_end: str | None = None

    @property
    def prop_types(self) -> dict[str, T.DataType]:
        if self.type is None:
            return {f.name: f.dataType for f in self.df.schema if f.name not in {"id", "from_id", "type", "to_id", "position"}}
        return {f.name: f.dataType for f in self.df.schema if f.name in self.props}

    def key_text(self, column: Callable[[str], Column]) -> Column:
        text, name = self.key
        return F.concat(F.lit(text), column(name).cast("string"))

    def canonical(self, with_node: bool = False) -> DataFrame:
        """$id, $from, $to, $type, $position, $from_key, $to_key, properties; with_node adds the end's as node.<name>."""
        if self.type is None:
            return self.df.select(c("id").alias("$id"), c("from_id").alias("$from"), c("to_id").alias("$to"), c("type").alias("$type"), c("position").alias("$position"), c("from_id").alias("$from_key"), c("to_id").alias("$to_key"), *map(c, self.prop_types))
        near, far = c(self.source_key), c(self.target_key)
        key = self.key_text(c) if isinstance(self.key, tuple) else self.key if self.key is not None else F.concat_ws("|", near.cast("string"), far.cast("string"))
        cols = [
            F.concat(F.lit(f"{self.type}:"), key.cast("string")).alias("$id"),
            F.concat(F.lit(f"{self.source}:"), near.cast("string")).alias("$from"),
            F.concat(F.lit(f"{self.target}:"), far.cast("string")).alias("$to"),
            F.lit(self.type).alias("$type"),
            (c(self.position) if self.position else F.lit(None)).cast("long").alias("$position"),
            near.alias("$from_key"),
            far.alias("$to_key"),
        ]
        cols += [c(p) for p in self.prop_types]
        if with_node:
            cols += [c(f.name).alias(f"node.{f.name}") for f in self.df.schema]
        return self.df.where(near.isNotNull() & far.isNotNull()).select(*cols)


def merged(frames: list[DataFrame]) -> DataFrame:
    """Union by name; a column that some lack is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


@dataclass
class Graph:
    """A readable graph at one revision."""

    spark: SparkSession
    nodes: list[NodeTable]
    edges: list[EdgeTable]
    revisions: DataFrame | None = None
    acyclic: frozenset[str] = field(default_factory=frozenset)

    def node_props(self) -> dict[str, T.DataType]:
        return {k: v for n in self.nodes for k, v in n.props.items()}

    def edge_props(self) -> dict[str, T.DataType]:
        return {k: v for e in self.edges for k, v in e.prop_types.items()}

    def node_tables(self, labels: Iterable[str], among: frozenset[str] | None = None) -> list[NodeTable]:
        want = set(labels)
        return [n for n in self.nodes if n.label is None or (want <= {n.label} and (among is None or n.label in among))]

    def edge_tables(self, types: list[str]) -> list[EdgeTable]:
        return [e for e in self.edges if not types or e.type is None or e.type in types]


def over_tables(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of the driver's tables."""
    from pyspark.sql import Window

    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    region, nation, customer, supplier, part, orders, lineitem, events, documents, turns = map(
        read, ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")
    )
    turns = turns.withColumn("turn_key", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    nodes = [
        NodeTable(region, "Region", "r_regionkey"),
        NodeTable(nation, "Nation", "n_nationkey"),
        NodeTable(customer, "Customer", "c_custkey"),
        NodeTable(supplier, "Supplier", "s_suppkey"),
        NodeTable(part, "Part", "p_partkey"),
        NodeTable(orders, "Order", "o_orderkey"),
        NodeTable(events.select("user_id").distinct(), "User", "user_id"),
        NodeTable(events, "Event", "event_id"),
        NodeTable(documents, "Document", "doc_id"),
        NodeTable(turns, "Turn", "turn_key"),
    ]
    items = list(lineitem.columns)
    # Lines have no key: equal ones are told apart by their number among equals.
    numbered = lineitem.withColumn("line_copy", F.row_number().over(Window.partitionBy(*items).orderBy(F.lit(1))))
    line_key = F.concat_ws("|", *[F.col(k).cast("string") for k in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "line_copy")])
    following = events.withColumn("next_event", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    after = turns.withColumn("next_turn", F.lead("turn_key").over(Window.partitionBy("conv_id").orderBy("turn")))
    edges = [
        EdgeTable(nation, "CHILD", "Region", "Nation", "n_regionkey", "n_nationkey", ("n", "n_nationkey"), node_end="target"),
        EdgeTable(customer, "CHILD", "Nation", "Customer", "c_nationkey", "c_custkey", ("c", "c_custkey"), node_end="target"),
        EdgeTable(orders, "CHILD", "Customer", "Order", "o_custkey", "o_orderkey", ("o", "o_orderkey"), node_end="target"),
        EdgeTable(orders, "PLACED", "Customer", "Order", "o_custkey", "o_orderkey", ("", "o_orderkey"), node_end="target"),
        EdgeTable(numbered, "CONTAINS", "Order", "Part", "l_orderkey", "l_partkey", line_key, props=tuple(items)),
        EdgeTable(lineitem.select("l_suppkey", "l_partkey").distinct(), "SUPPLIES", "Supplier", "Part", "l_suppkey", "l_partkey"),
        EdgeTable(supplier, "LOCATED_IN", "Supplier", "Nation", "s_suppkey", "s_nationkey", ("", "s_suppkey"), node_end="source"),
        EdgeTable(events, "DID", "User", "Event", "user_id", "event_id", ("", "event_id"), node_end="target"),
        EdgeTable(following, "NEXT", "Event", "Event", "event_id", "next_event", F.concat(F.lit("e"), F.col("event_id").cast("string"))),
        EdgeTable(after, "NEXT", "Turn", "Turn", "turn_key", "next_turn", F.concat(F.lit("t"), F.col("turn_key"))),
    ]
    return Graph(spark, nodes, edges, acyclic=frozenset({"CHILD", "NEXT"}))


def from_rows(spark: SparkSession, nodes: DataFrame, edges: DataFrame, revisions: DataFrame | None = None) -> Graph:
    """A graph of two tables: id, labels, body, properties; and id, from_id, type, to_id, position, properties."""
    return Graph(spark, [NodeTable(nodes)], [EdgeTable(edges)], revisions)
