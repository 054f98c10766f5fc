"""Connected components of a link table, and cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables that ``written`` has made, for ``forget``.
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names.

    Only a local master gets a folder of our own where none is named: on a cluster
    each executor would write to its own disk.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def steady(df: DataFrame) -> DataFrame:
    """``df`` such that row numbers by place are the same in each evaluation.

    What is more than a scan, selection and filter of files is stored first.  Spark
    derives a scan's splits from the cores at hand, which change when executors are
    lost; the session keeps the number that holds now, unless it names one.
    """
    spark, key = df.sparkSession, "spark.sql.files.minPartitionNum"
    if not _plain_scan(df._jdf.queryExecution().optimizedPlan()):
        return stored(df)
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))
    return df


def _plain_scan(plan) -> bool:
    """Whether the plan only reads, filters and selects from files or held rows."""
    children = plan.children()
    if not children.size():
        return plan.nodeName().split()[0] in ("LogicalRelation", "Relation", "LocalRelation", "DataSourceV2ScanRelation")
    return plan.nodeName() in ("Project", "Filter") and plan.deterministic() and all(_plain_scan(children.apply(k)) for k in range(children.size()))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: smaller than a checkpoint, and read again by columns."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by way of Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def forget(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that are written inside, once what follows from them is stored."""
    first = len(_made)
    yield
    while len(_made) > first:
        remove(spark, _made.pop())


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node that links reach, for each node with links.

    Alternates two star steps: every node hands its larger neighbours, and then its
    smaller ones, to the smallest node it knows.  Each is an aggregation with
    map-side combination and a join; rounds grow with the logarithm of the longest
    chain.  Null ends and loops are left out.  No links: no rows.
    """
    edges = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = stored(small)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
