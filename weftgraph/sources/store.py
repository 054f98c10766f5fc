"""Versioned graphs on shared storage.

A commit writes the changed nodes and relationships of one revision into folders of
its own, then the revision, which names them; what no revision names was never
committed and is not read, whatever number it carries.  The
graph at a revision is, per id, the last change up to it, unless that is a deletion.
Nothing is rewritten, so a commit costs what it changes.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.errors import CypherError
from .graph import Graph, c, from_rows

NODE_FIXED = {"id": T.StringType(), "labels": T.ArrayType(T.StringType()), "body": T.StringType()}
EDGE_FIXED = {"id": T.StringType(), "from_id": T.StringType(), "type": T.StringType(), "to_id": T.StringType(), "position": T.LongType()}
REVISION = "revision long, committed_ns long, actor string, message string, folder string"
#: Partition column of a commit's folder; its values read as text.
FOLDER = "__commit"
LOG = {"revision": T.LongType(), "deleted": T.BooleanType()}


def empty(spark: SparkSession, fixed: dict[str, T.DataType]) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField(k, v) for k, v in fixed.items()]))


@dataclass
class Store:
    """A graph's history in a folder of any file system that Spark reaches.

    One writer at a time is assumed; readers are never blocked.
    """

    spark: SparkSession
    folder: str

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def revisions(self) -> DataFrame:
        """revision, time, committed_ns, actor, message, folder."""
        path = f"{self.folder}/revisions"
        if not self._exists(path):
            return self.spark.createDataFrame([], REVISION).withColumn("time", F.timestamp_micros(F.lit(0)))
        df = self.spark.read.parquet(path)
        return df.withColumn("time", F.timestamp_micros(F.floor(F.col("committed_ns") / 1000)))

    def last(self) -> int:
        return self.revisions().agg(F.max("revision")).first()[0] or 0

    def resolve(self, revision: int | None = None, at_ns: int | None = None) -> int:
        """A revision by number, or the latest at a time (0 before the first), or the current one."""
        if revision is not None and at_ns is not None:
            raise CypherError("a snapshot is chosen by revision or by time, not both")
        if revision is not None:
            if revision and self.revisions().where(F.col("revision") == revision).isEmpty():
                raise CypherError(f"there is no revision {revision}")
            return revision
        if at_ns is not None:
            return self.revisions().where(F.col("committed_ns") <= at_ns).agg(F.max("revision")).first()[0] or 0
        return self.last()

    def log(self, kind: str) -> DataFrame:
        """All changes of committed revisions."""
        fixed = {**LOG, **(NODE_FIXED if kind == "nodes" else EDGE_FIXED)}
        path = f"{self.folder}/{kind}"
        if not self._exists(path):
            return empty(self.spark, fixed)
        df = self.spark.read.option("mergeSchema", "true").parquet(path)
        named = self.revisions().select("revision", F.col("folder").alias(FOLDER))
        return df.join(named, ["revision", FOLDER], "left_semi").select(*[c(x) for x in df.columns if x != FOLDER])

    def at(self, kind: str, revision: int) -> DataFrame:
        log = self.log(kind).where(F.col("revision") <= revision)
        rest = [x for x in log.columns if x != "id"]
        last = log.groupBy("id").agg(F.max_by(F.struct(*map(c, rest)), "revision").alias("last"))
        return last.select("id", "last.*").where(~F.col("deleted")).drop("revision", "deleted")

    def graph(self, revision: int | None = None, at_ns: int | None = None) -> Graph:
        at = self.resolve(revision, at_ns)
        return from_rows(self.spark, self.at("nodes", at), self.at("edges", at), self.revisions().where(F.col("revision") <= at))

    def history(self, kind: str = "nodes") -> DataFrame:
        """Versions with the half-open interval of revisions in which they hold."""
        w = Window.partitionBy("id").orderBy("revision")
        df = self.log(kind).withColumns({"valid_from": F.col("revision"), "valid_to": F.lead("revision").over(w)})
        return df.where(~F.col("deleted")).drop("revision", "deleted")

    def status(self) -> dict:
        g = self.graph()
        return {"revision": self.last(), "nodes": g.nodes[0].df.count(), "edges": g.edges[0].df.count()}

    def commit(self, nodes: DataFrame, edges: DataFrame, actor: str = "", message: str = "") -> int:
        """Append changes (with a column deleted) as the next revision; returns it.

        A failure at any point leaves the store as it was: the revision's row comes
        last and names the folder, so what a failed commit has left is never read.
        """
        revision = self.last() + 1
        latest = self.revisions().agg(F.max("committed_ns")).first()[0] or 0
        folder = f"c{uuid.uuid4().hex}"
        self.verify(nodes, edges)
        for kind, df in (("nodes", nodes), ("edges", edges)):
            df.withColumn("revision", F.lit(revision).cast("long")).write.parquet(f"{self.folder}/{kind}/{FOLDER}={folder}")
        row = [(revision, max(time.time_ns(), latest + 1), actor, message, folder)]
        self.spark.createDataFrame(row, REVISION).coalesce(1).write.mode("append").parquet(f"{self.folder}/revisions")
        return revision

    def verify(self, nodes: DataFrame, edges: DataFrame) -> None:
        """What must hold of changes before they are stored; only what they touch is looked at."""
        for kind, df in (("node", nodes), ("relationship", edges)):
            if not df.groupBy("id").count().where("count > 1 OR id IS NULL").isEmpty():
                raise CypherError(f"a {kind} is changed twice in one commit")
        live, gone = edges.where("NOT deleted"), nodes.where("deleted").select("id")
        if not live.where("position IS NOT NULL AND type <> 'CHILD'").isEmpty():
            raise CypherError("only CHILD has a position")
        ends = live.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
        open_ = ends.join(nodes.where("NOT deleted").select("id"), "id", "left_anti")
        if not open_.isEmpty():
            known = self.at("nodes", self.last()).select("id").join(gone, "id", "left_anti")
            if not open_.join(known, "id", "left_anti").isEmpty():
                raise CypherError("a relationship's end does not exist")
        child = live.where("type = 'CHILD'")
        if gone.isEmpty() and child.isEmpty():
            return
        kept = self.at("edges", self.last()).select("id", "from_id", "type", "to_id").join(edges.select("id"), "id", "left_anti")
        for end in ("from_id", "to_id"):
            if not kept.join(gone.select(F.col("id").alias(end)), end, "left_semi").isEmpty():
                raise CypherError("a deleted node has relationships")
        tree = kept.where("type = 'CHILD'").select("from_id", "to_id").unionByName(child.select("from_id", "to_id"))
        if not tree.join(child.select("to_id").distinct(), "to_id", "left_semi").groupBy("to_id").count().where("count > 1").isEmpty():
            raise CypherError("a node has more than one parent")

    def problems(self) -> DataFrame:
        """what, id: whatever the stored history holds that no commit should have let in."""
        nodes, edges = self.at("nodes", self.last()), self.at("edges", self.last())
        found = [
            self.log(kind).groupBy("revision", "id").count().where("count > 1").select(F.lit(f"{kind}: changed twice in a revision").alias("what"), "id") for kind in ("nodes", "edges")
        ]
        ends = edges.select("id", F.explode(F.array("from_id", "to_id")).alias("end"))
        found.append(ends.join(nodes.select(F.col("id").alias("end")), "end", "left_anti").select(F.lit("edges: an end does not exist").alias("what"), "id").distinct())
        found.append(edges.where("position IS NOT NULL AND type <> 'CHILD'").select(F.lit("edges: a position outside CHILD").alias("what"), "id"))
        found.append(edges.where("type = 'CHILD'").groupBy("to_id").count().where("count > 1").select(F.lit("nodes: more than one parent").alias("what"), F.col("to_id").alias("id")))
        numbers = self.revisions().select(F.col("revision").cast("string").alias("id"), "revision", "committed_ns")
        before = numbers.select((F.col("revision") + 1).alias("revision"), F.col("committed_ns").alias("earlier"))
        order = numbers.join(before, "revision", "left").where("revision > 1 AND (earlier IS NULL OR earlier >= committed_ns)")
        found.append(order.select(F.lit("revisions: a gap or a step back in time").alias("what"), "id"))
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out
