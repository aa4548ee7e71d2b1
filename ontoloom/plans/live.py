"""Queries that run the streaming operators over a table as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources.tables import table
from ..streaming import live


def _stream(operator, mode: str = "complete"):
    """Runs an operator over the session log as a stream, to the end of what is there."""

    def run(spark, d):
        name = f"live_{uuid.uuid4().hex}"
        log = table(spark, d, "session_log")
        folder, file = log.inputFiles()[0].rsplit("/", 1)
        reader = spark.readStream.schema(log.schema)  # a table is a file, or a folder of files
        stream = reader.option("pathGlobFilter", file).parquet(folder) if file.startswith("session_log") else reader.parquet(folder)
        live.run_once(operator(stream.where("event_id is not null")), f"{shared_folder(spark).rstrip('/')}/{name}", mode, name)
        return spark.table(name)

    return run


QUERIES = {
    "live_counters": _stream(live.counters),
    "live_claim_states": _stream(lambda e: live.claim_states(e.where(F.expr("try_parse_json(payload) is not null"))).select("proposal_id", "status")),
    "live_checkpoints": lambda spark, d: live.checkpoints(table(spark, d, "session_log").dropDuplicates(["event_id"]), 50).select("session_id", "checkpoint", "commits"),
}

SQL = {
    "live_counters": "WITH e AS (SELECT DISTINCT * FROM session_log WHERE event_id IS NOT NULL) SELECT session_id, event_type, count(*) AS events FROM e GROUP BY 1, 2",
    "live_claim_states": """WITH e AS (SELECT DISTINCT * FROM session_log WHERE json_valid(payload) AND event_id IS NOT NULL), u AS (SELECT payload->>'$.proposal.proposal_id' AS proposal_id, CASE WHEN payload->>'$.proposal.reasoner_verdict' = 'inconsistent' THEN 'inconsistent' END AS status, ts, event_id FROM e WHERE event_type = 'propose'
        UNION ALL SELECT payload->>'$.proposal_id', CASE WHEN payload->>'$.committed' = 'true' THEN 'committed' ELSE 'rejected' END, ts, event_id FROM e WHERE event_type = 'commit')
        SELECT proposal_id, coalesce(arg_max(status, (ts, event_id)) FILTER (WHERE status IS NOT NULL), 'pending') AS status FROM u WHERE proposal_id IS NOT NULL GROUP BY 1""",
    "live_checkpoints": """WITH e AS (SELECT DISTINCT * FROM session_log WHERE event_type = 'commit'), n AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS n FROM e)
        SELECT session_id, (n - 1) // 50 AS checkpoint, count(*) AS commits FROM n GROUP BY 1, 2""",
}
