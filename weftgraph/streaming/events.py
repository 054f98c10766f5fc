"""Event streams as graph updates, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Events per user and time window; windows close ``late`` after the newest event."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "user_id").agg(F.count("*").alias("events")).select("w.start", "w.end", "user_id", "events")


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """New event files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def append(events: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of events (event_id, ts, user_id, event_type) as one revision: users, events and DID.

    A batch that is run again after a failure is recognised by its stream and number in
    the revision's message and not committed twice.  A stream is known by its
    checkpoint folder, which no two streams share, so several may feed one store in turn.
    """

    def commit(batch: DataFrame, number: int) -> None:
        message = f"stream {checkpoint} batch {number}"
        if not store.revisions().where(F.col("message") == message).isEmpty():
            return
        batch = batch.dropDuplicates(["event_id"])
        user = F.concat(F.lit("User:"), F.col("user_id").cast("string"))
        event = F.concat(F.lit("Event:"), F.col("event_id").cast("string"))
        live = F.lit(False).alias("deleted")
        users = batch.select("user_id").distinct().select(user.alias("id"), F.array(F.lit("User")).alias("labels"), F.lit("").alias("body"), "user_id", live)
        rows = batch.select(event.alias("id"), F.array(F.lit("Event")).alias("labels"), F.lit("").alias("body"), "event_id", "ts", "event_type", live)
        edges = batch.select(F.concat(F.lit("DID:"), F.col("event_id").cast("string")).alias("id"), user.alias("from_id"), F.lit("DID").alias("type"), event.alias("to_id"), F.lit(None).cast("long").alias("position"), live)
        store.commit(users.unionByName(rows, allowMissingColumns=True), edges, "stream", message)

    return events.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
