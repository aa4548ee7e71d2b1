"""Analytics of the session log, the claims of a job and hash-chained logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clause_kind


def events(session_log: DataFrame) -> DataFrame:
    """SRC-3: the log's valid rows, each event once; payloads that are no JSON are
    skipped."""
    return session_log.where(F.expr("try_parse_json(payload) is not null") & F.col("event_id").isNotNull()).dropDuplicates(["event_id"])


def field(path: str) -> Column:
    return F.get_json_object("payload", path)


def event_histogram(session_log: DataFrame) -> DataFrame:
    """LOG-1: rows and sessions by event type."""
    return events(session_log).groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"))


def verdict_histogram(session_log: DataFrame) -> DataFrame:
    """AGG-7: verdicts of the proposals whose payload holds an object."""
    rows = events(session_log).where("event_type = 'propose'")
    return rows.groupBy(F.coalesce(field("$.proposal.reasoner_verdict"), F.lit("none")).alias("verdict")).agg(F.count("*").alias("proposals"), F.count_distinct(field("$.proposal.utterance")).alias("utterances"))


def replay(session_log: DataFrame) -> DataFrame:
    """LOG-3: (proposal_id, status) after the last event that sets one: a proposal
    found inconsistent, a commit, a commit that failed. Proposing again without a
    clash resets nothing."""
    rows = events(session_log)
    proposed = rows.where("event_type = 'propose'").select(
        field("$.proposal.proposal_id").alias("proposal_id"), F.when(field("$.proposal.reasoner_verdict") == "inconsistent", "inconsistent").alias("status"), F.lit(True).alias("proposed"), "ts", "event_id"
    )
    committed = rows.where("event_type = 'commit'").select(
        field("$.proposal_id").alias("proposal_id"), F.when(field("$.committed") == "true", "committed").otherwise("rejected").alias("status"), F.lit(False).alias("proposed"), "ts", "event_id"
    )
    both = proposed.unionAll(committed).where("proposal_id is not null")
    last = F.max_by("status", F.when(F.col("status").isNotNull(), F.struct("ts", "event_id")))
    return both.groupBy("proposal_id").agg(F.coalesce(last, F.lit("pending")).alias("status"), F.count_if("proposed").alias("proposals"))


def first_quotes(claims: DataFrame) -> DataFrame:
    """LOG-5: (section, claim_key, quote): the first quote of each section."""
    rows = claims.where("section is not null and source_quote <> ''")
    first = F.min(F.struct("claim_key", F.substring("source_quote", 1, 200).alias("quote")))
    return rows.groupBy("section").agg(first.alias("f")).select("section", "f.claim_key", "f.quote")


def gate_preservation(claims: DataFrame) -> DataFrame:
    """AGG-21: by job, proposals that clashed and those of them that were
    recovered; the last row of a proposal decides."""
    last = claims.where("proposal_id is not null").groupBy("job_id", "proposal_id").agg(
        F.max_by("status", F.struct("updated_at", "claim_key")).alias("status"), F.bool_or(F.coalesce(F.col("verdict") == "inconsistent", F.lit(False))).alias("clashed")
    )
    return last.groupBy("job_id").agg(F.count("*").alias("proposals"), F.count_if("clashed").alias("clashes"), F.count_if(F.col("clashed") & (F.col("status") == "committed")).alias("recovered"))


def claim_timing_totals(session_log: DataFrame) -> DataFrame:
    """X-18: milliseconds by phase of the logged claims, repeats summed."""
    rows = events(session_log).where("event_type = 'claim_timing'").select(F.from_json(field("$.ms"), "map<string,double>").alias("ms"))
    return rows.select(F.explode("ms").alias("phase", "ms")).where("ms is not null").groupBy("phase").agg(F.count("*").alias("n"), F.round(F.sum("ms"), 1).alias("ms"))


def stalls(session_log: DataFrame, seconds: int = 1800) -> DataFrame:
    """STR-5: by session, gaps between events longer than ``seconds``."""
    order = Window.partitionBy("session_id").orderBy("ts", "event_id")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(order))
    rows = events(session_log).where("session_id is not null").withColumn("gap", gap)
    return rows.groupBy("session_id").agg(F.count_if(F.col("gap") > seconds).alias("stalls"), F.max("gap").alias("longest"))


# ---------------------------------------------------------------- claims of a job

STATUSES = ("pending", "committed", "inconsistent", "needs_review", "error", "rejected")


def each_claim(claims: DataFrame) -> DataFrame:
    return claims.where("claim_key is not null").dropDuplicates(["claim_key"])


def status_counts(claims: DataFrame) -> DataFrame:
    """AGG-6."""
    return each_claim(claims).groupBy("job_id").agg(F.count("*").alias("claims"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def feed_priority(claims: DataFrame) -> DataFrame:
    """WIN-5: new ids of the pending claims of a job: definitions, then what an act
    establishes, confers or covers, then its norms, recitals last; within a tier by old
    id, numbered from above the ids that stay."""
    rows = each_claim(claims)
    kind = clause_kind(F.coalesce("source_quote", F.lit("")))
    tier = F.when(F.coalesce(F.col("section").startswith("rec_"), F.lit(False)), 3).when(kind == "definition", 0).when(kind.isin("establishment", "conferral", "scope"), 1).otherwise(2)
    fixed = rows.where("status <> 'pending'").groupBy("job_id").agg(F.max("id").alias("top"))
    order = Window.partitionBy("job_id").orderBy("tier", "id", "claim_key")
    pending = rows.where("status = 'pending'").withColumn("tier", tier).withColumn("place", F.row_number().over(order)).join(fixed, "job_id", "left")
    return pending.select("job_id", "claim_key", "id", (F.coalesce("top", F.lit(-1)) + F.col("place")).alias("new_id"))


def next_pending(claims: DataFrame, n: int) -> DataFrame:
    """FLT-6: the next claims of each job that are pending and approved."""
    order = Window.partitionBy("job_id").orderBy("id", "claim_key")
    return each_claim(claims).where("status = 'pending' and approved").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("job_id", "claim_key", "id")


def suspect_window(claims: DataFrame, low: int | None, high: int) -> DataFrame:
    """WIN-8: committed claims in (low, high] turn to needs_review; null is the start."""
    inside = (F.col("id") <= high) & (F.lit(True) if low is None else F.col("id") > low) & (F.col("status") == "committed")
    return each_claim(claims).groupBy("job_id").agg(F.count_if(inside).alias("flipped"), F.count_if((F.col("status") == "needs_review") | inside).alias("needs_review"))


def approval(claims: DataFrame) -> DataFrame:
    """FLT-8: the default (high confidence, no recital) against what is stored."""
    default = (F.col("confidence") == "high") & ~F.coalesce(F.col("section").startswith("rec_"), F.lit(False))
    return each_claim(claims).groupBy(F.coalesce(default, F.lit(False)).alias("default_approved"), "approved").agg(F.count("*").alias("claims"))


# ---------------------------------------------------------------- hash chains

GENESIS = "sha256:" + "0" * 64


def chain_breaks(log: DataFrame) -> DataFrame:
    """LOG-6: (file, first_break) over ``log(file, line_no, line, prev)``: the first
    line whose ``prev`` is not the digest of the line before it, null if intact."""
    order = Window.partitionBy("file").orderBy("line_no")
    before = F.coalesce(F.concat(F.lit("sha256:"), F.sha2(F.lag("line").over(order), 256)), F.lit(GENESIS))
    rows = log.withColumn("expected", before)
    return rows.groupBy("file").agg(F.count("*").alias("lines"), F.min(F.when(~F.col("prev").eqNullSafe(F.col("expected")), F.col("line_no"))).alias("first_break"))


def chained(log: DataFrame) -> DataFrame:
    """WIN-7, SNK-8: ``log(file, line_no, line)`` with the digest of the line before."""
    order = Window.partitionBy("file").orderBy("line_no")
    return log.withColumn("prev", F.coalesce(F.concat(F.lit("sha256:"), F.sha2(F.lag("line").over(order), 256)), F.lit(GENESIS)))


def largest_gaps(session_log: DataFrame) -> DataFrame:
    """WIN-11: by session, the event with the longest wait until the next one; the
    first of equal waits."""
    order = Window.partitionBy("session_id").orderBy("ts", "event_id")
    rows = events(session_log).where("session_id is not null").withColumn("wait", F.unix_timestamp(F.lead("ts").over(order)) - F.unix_timestamp("ts"))
    best = F.max_by("event_id", F.struct("wait", (-F.unix_timestamp("ts")).alias("early"), (-F.col("event_id")).alias("low")))
    return rows.where("wait is not null").groupBy("session_id").agg(F.max("wait").alias("wait"), best.alias("event_id"))


def grounded_answers(session_log: DataFrame) -> DataFrame:
    """FLT-11, AGG-23: what answers say of their grounding against the names they
    cite: grounded is at least one cited and none missing."""
    rows = events(session_log).where("event_type = 'query'")
    size = lambda path: F.coalesce(F.json_array_length(field(path)), F.lit(0))
    found = (size("$.referenced_iris") > 0) & (size("$.missing_iris") == 0)
    return rows.groupBy(F.coalesce(field("$.grounded"), F.lit("none")).alias("said"), found.alias("found")).agg(F.count("*").alias("answers"))
