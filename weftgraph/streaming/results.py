"""Results row by row, without holding them in memory."""

from __future__ import annotations

from collections.abc import Iterator

from ..cypher import read
from ..plans import tree as t
from ..plans.errors import CypherError
from ..plans.parser import parse
from ..sources.graph import Graph


def stream(graph: Graph, text: str, params: dict | None = None) -> Iterator[tuple[str, object]]:
    """("start", columns), ("row", values) for each row, ("end", number of rows).

    A failure ends the events without "end"; what came before is a valid prefix.
    Writing statements are refused, to be run as a batch instead.  One partition at
    a time is held, and the next is fetched ahead.
    """
    statements = parse(text)
    if len(statements) != 1 or t.writes(statements[0]):
        raise CypherError("one reading statement can be streamed")
    df = read(graph, statements[0], params)
    yield "start", df.columns
    n = 0
    for row in df.toLocalIterator(prefetchPartitions=True):
        n += 1
        yield "row", tuple(row)
    yield "end", n
