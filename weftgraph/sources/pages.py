"""Pages of nodes and relationships by key, with cursors bound to what they continue."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..plans.errors import CypherError
from .graph import Graph, c, merged

DEFAULT, MOST = 100, 1000


def where_nodes(graph: Graph, ids=None, labels=(), props=None) -> DataFrame:
    """Nodes that have an id of ids, all labels and all property values."""
    frames = []
    for table in graph.node_tables(labels):
        df = table.canonical().drop("$key")
        if table.label is None:
            for label in labels:
                df = df.where(F.array_contains("$labels", label))
        frames.append(_matching(df, table.props, ids, props))
    return _named(frames)


def where_edges(graph: Graph, ids=None, from_ids=None, to_ids=None, types=(), props=None) -> DataFrame:
    """Relationships; fields must all hold, and of a field's values one."""
    frames = []
    for table in graph.edge_tables(list(types)):
        df = table.canonical().drop("$from_key", "$to_key")
        if table.type is None and types:
            df = df.where(c("$type").isin(list(types)))
        for name, values in (("$from", from_ids), ("$to", to_ids)):
            if values is not None:
                df = df.where(c(name).isin(list(values)))
        frames.append(_matching(df, table.prop_types, ids, props))
    return _named(frames)


def _matching(df: DataFrame, known: dict, ids, props) -> DataFrame:
    if ids is not None:
        df = df.where(c("$id").isin(list(ids)))
    for k, v in (props or {}).items():
        df = df.where(c(k) == F.lit(v)) if k in known else df.where(F.lit(False))
    return df


def _named(frames: list[DataFrame]) -> DataFrame:
    if not frames:
        raise CypherError("no such label or type")
    df = merged(frames)
    return df.select(*[c(n).alias(n.removeprefix("$")) for n in df.columns])


def page(df: DataFrame, fingerprint: str, revision: int = 0, limit: int = DEFAULT, cursor: str | None = None) -> tuple[list[Row], str | None]:
    """Up to ``limit`` rows by id after the cursor, and the next cursor or None.

    ``fingerprint`` names the query; a cursor continues only the query and revision
    that it came from.
    """
    if not 1 <= limit <= MOST:
        raise CypherError(f"a page has 1 to {MOST} rows")
    mark = hashlib.sha256(f"{revision}:{fingerprint}:{df.columns}".encode()).hexdigest()[:16]
    if cursor is not None:
        try:
            held = json.loads(base64.urlsafe_b64decode(cursor))
        except ValueError as e:
            raise CypherError("not a cursor") from e
        if held.get("mark") != mark:
            raise CypherError("the cursor belongs to another query or revision")
        df = df.where(F.col("id") > held["after"])
    rows = df.orderBy("id").limit(limit + 1).collect()
    if len(rows) <= limit:
        return rows, None
    return rows[:limit], base64.urlsafe_b64encode(json.dumps({"mark": mark, "after": rows[limit - 1]["id"]}).encode()).decode()
