"""A generated work graph of any size, the same for the same numbers."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .graph import Graph, from_rows


def work_graph(spark: SparkSession, nodes: int = 1_000_000, links: int = 3_000_000) -> Graph:
    """Tasks, bugs, notes and epics in a random tree of CHILD, with links to popular nodes.

    70 % of nodes are tasks, 20 % bugs, 8 % notes, 2 % epics; half of the links are
    DEPENDS_ON, the others RELATES_TO or BLOCKS; targets follow a power law.
    """
    draw = lambda salt, col="id": F.pmod(F.xxhash64(F.lit(salt), F.col(col)), F.lit(1_000_000)) / 1_000_000.0
    name = lambda n: F.concat(F.lit("n"), F.lpad(n.cast("string"), 12, "0"))
    base = spark.range(nodes)
    kind = F.when(draw("kind") < 0.7, "Task").when(draw("kind") < 0.9, "Bug").when(draw("kind") < 0.98, "Note").otherwise("Epic")
    status = F.element_at(F.array(*map(F.lit, ("todo", "doing", "done"))), (F.col("id") % 3 + 1).cast("int"))
    rows = base.select(
        name(F.col("id")).alias("id"),
        F.array(kind).alias("labels"),
        F.concat(F.lit("# Item "), F.col("id").cast("string")).alias("body"),
        F.format_string("item-%06d", "id").alias("title"),
        status.alias("status"),
        F.floor(draw("priority") * 5).cast("long").alias("priority"),
        F.format_string("user-%03d", F.floor(draw("who") * 500).cast("int")).alias("assignee"),
        F.col("id").alias("rank"),
    )
    tree = base.where("id > 0").select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), name(F.floor(draw("parent") * F.col("id"))).alias("from_id"), F.lit("CHILD").alias("type"), name(F.col("id")).alias("to_id"), F.col("id").alias("position"))
    link = F.when(draw("type") < 0.5, "DEPENDS_ON").when(draw("type") < 0.75, "RELATES_TO").otherwise("BLOCKS")
    more = spark.range(links).select(F.concat(F.lit("l"), F.col("id").cast("string")).alias("id"), name(F.floor(draw("from") * nodes)).alias("from_id"), link.alias("type"), name(F.floor(F.pow(draw("to"), 3) * nodes)).alias("to_id"), F.lit(None).cast("long").alias("position"))
    return from_rows(spark, rows, tree.unionByName(more))
