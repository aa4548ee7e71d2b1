"""Live counters and claim states over an append-only log folder.

The file source takes new files; its checkpoint replaces byte offsets and a
resumed run goes on where the last one ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.rdf import json_rows

SCHEMA = "event_id BIGINT, ts TIMESTAMP, session_id STRING, event_type STRING, payload STRING"


def tail(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """STR-1: the log as a stream; lines that are no JSON are skipped."""
    return json_rows(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path), SCHEMA)


def counters(events: DataFrame) -> DataFrame:
    """STR-7: events by session and type, repeated event_ids once."""
    return events.dropDuplicates(["event_id"]).groupBy("session_id", "event_type").agg(F.count("*").alias("events"))


def windowed(events: DataFrame, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """An extra of this engine: events by window and type, late ones up to ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """STR-5 as sessions: runs of events of a session without a gap."""
    return events.withWatermark("ts", gap).groupBy(F.session_window("ts", gap), "session_id").agg(F.count("*").alias("events"))


def claim_states(events: DataFrame) -> DataFrame:
    """STR-2: (proposal_id, status, ts): the last status a proposal was given, as a
    keyed maximum that a stream keeps as state."""
    field = lambda path: F.get_json_object("payload", path)
    key = F.when(F.col("event_type") == "propose", field("$.proposal.proposal_id")).otherwise(field("$.proposal_id"))
    status = F.when((F.col("event_type") == "propose") & (field("$.proposal.reasoner_verdict") == "inconsistent"), "inconsistent").when(
        F.col("event_type") == "commit", F.when(field("$.committed") == "true", "committed").otherwise("rejected")
    )
    rows = events.where(F.col("event_type").isin("propose", "commit")).select(key.alias("proposal_id"), status.alias("status"), "ts", "event_id").where("proposal_id is not null")
    last = F.max_by("status", F.when(F.col("status").isNotNull(), F.struct("ts", "event_id")))
    return rows.groupBy("proposal_id").agg(F.coalesce(last, F.lit("pending")).alias("status"), F.max("ts").alias("ts"))


def checkpoints(events: DataFrame, every: int = 250) -> DataFrame:
    """STR-3, batch form: (session_id, checkpoint, commits, until): committed events in
    runs of ``every``."""
    from pyspark.sql import Window

    order = Window.partitionBy("session_id").orderBy("ts", "event_id")
    rows = events.where("event_type = 'commit'").withColumn("n", F.row_number().over(order))
    return rows.groupBy("session_id", F.floor((F.col("n") - 1) / every).alias("checkpoint")).agg(F.count("*").alias("commits"), F.max("ts").alias("until"))


def run_once(stream: DataFrame, checkpoint: str, mode: str = "complete", name: str = "live") -> None:
    """Takes all that is there and stops; the next call goes on from the checkpoint."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
