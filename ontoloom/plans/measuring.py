"""Queries of measures, logs and job claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import logs, measures
from ..sources import adapters as A
from ..sources.tables import table

FIND = """f AS (SELECT 'K-' || l_returnflag || CASE WHEN l_linestatus = 'O' THEN '1' ELSE '2' END AS code,
    CASE WHEN l_returnflag = 'N' THEN 'coverage' ELSE 'defect' END AS kind,
    CASE l_returnflag WHEN 'A' THEN 3.0::DOUBLE WHEN 'R' THEN 1.5 ELSE 0 END AS weight, 'L' || l_linenumber AS locus, l_partkey AS subject,
    CASE WHEN l_discount < 0.03 THEN 'translation' WHEN l_discount < 0.07 THEN 'source' ELSE 'undetermined' END AS attribution,
    'line of ' || l_returnflag || ' shipped in ' || year(l_shipdate) AS detail FROM lineitem),
s AS (SELECT *, substr(regexp_replace(detail, '^[^ ]* [^ ]* ', ''), 1, 60) AS shape FROM f),
bl AS (SELECT code, shape, count(*) AS findings FROM s GROUP BY 1, 2 HAVING count(*) >= 40)"""
BIND = "b AS (SELECT DISTINCT l_linenumber AS locus, l_partkey AS class FROM lineitem), m AS (SELECT class, count(*) AS loci FROM b GROUP BY 1)"
JAC = """z AS (SELECT locus, count(*) AS n FROM b GROUP BY 1), j AS (SELECT x.locus AS a, y.locus AS b, count(*) AS shared FROM b x JOIN b y ON x.class = y.class AND x.locus < y.locus GROUP BY 1, 2),
jj AS (SELECT j.a, j.b, round(shared / (za.n + zb.n - shared), 6) AS jaccard FROM j JOIN z za ON za.locus = j.a JOIN z zb ON zb.locus = j.b)"""
DISP = """d AS (SELECT count(*) AS bound, round(avg(loci), 6) AS mean_multiplicity, median(loci)::DOUBLE AS median_multiplicity, max(loci) AS max_multiplicity,
    round(count(*) FILTER (WHERE loci = 1) / count(*), 6) AS exclusivity, round(100 * (SELECT max(n) FROM (SELECT count(*) AS n FROM b GROUP BY locus)) / count(*), 6) AS capture FROM m)"""
LOG = "e AS (SELECT DISTINCT * FROM session_log WHERE json_valid(payload) AND event_id IS NOT NULL)"
CLAIMS = "c AS (SELECT DISTINCT * FROM claims WHERE claim_key IS NOT NULL)"


REGISTRY = [("K-A1", "defect", 3.0), ("K-A2", "defect", 3.0), ("K-R1", "defect", 1.5), ("K-R2", "defect", 1.5), ("K-N1", "coverage", 0.0), ("K-N2", "coverage", 0.0)]


def _debt(spark, d):
    """Debt against all line items; of returned lines more are known than were found."""
    totals = spark.createDataFrame([("K-R2", 10_000_000), ("K-R1", 1)], "code STRING, total BIGINT")
    return measures.debt(A.findings(spark, d), spark.createDataFrame(REGISTRY, "code STRING, kind STRING, weight DOUBLE"), table(spark, d, "lineitem").count(), totals)


def _findings(operator):
    return lambda spark, d: operator(A.findings(spark, d))


def _bindings(operator):
    return lambda spark, d: operator(A.bindings(spark, d))


def _timings(operator):
    return lambda spark, d: operator(A.timings(spark, d))


def _log(operator):
    return lambda spark, d: operator(table(spark, d, "session_log"))


def _claims(operator):
    return lambda spark, d: operator(table(spark, d, "claims"))


def _completeness(spark, d):
    registry = spark.createDataFrame([("K-A1", True), ("K-A2", True), ("K-N1", True), ("K-R2", True), ("K-Z1", True), ("K-Z2", False)], "code STRING, applies BOOLEAN")
    return measures.completeness(registry, A.findings(spark, d))


def _coverage(spark, d):
    rows = logs.each_claim(table(spark, d, "claims"))
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return measures.coverage(rows, quote=filled("source_quote"), section=filled("section"), verdict=filled("verdict"))


def _chain(spark, d):
    """Logs of the users; every line with an id that 97 divides carries a wrong digest."""
    log = table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("line_no"), F.concat_ws(",", F.col("event_id").cast("string"), "event_type", "props").alias("line"))
    broken = logs.chained(log).withColumn("prev", F.when(F.col("line_no") % 97 == 0, "sha256:bad").otherwise(F.col("prev")))
    return logs.chain_breaks(broken)


QUERIES = {
    "finding_counts": _findings(measures.counts),
    "finding_blanket_shapes": _findings(measures.blanket_shapes),
    "finding_locus_density": _findings(measures.locus_density),
    "finding_debt": _debt,
    "finding_completeness": _completeness,
    "finding_coverage": _coverage,
    "audit_precision_wilson": lambda spark, d: measures.precision(table(spark, d, "norm_tuples").dropDuplicates(["tuple_id"]), "corpus_id", F.col("confidence") == "high"),
    "audit_stratified_sample": _findings(lambda f: measures.stratified_sample(f, 60, 7)),
    "bind_dispersion": _bindings(measures.dispersion),
    "bind_jaccard": _bindings(measures.jaccards),
    "bind_gates": _bindings(measures.gates),
    "bind_top_multiplicity": _bindings(measures.top_multiplicity),
    "timing_phase_stats": _timings(measures.phase_stats),
    "timing_quartile_means": _timings(measures.quartile_means),
    "timing_quartile_growth": _timings(measures.quartile_growth),
    "eval_modal_agreement": _timings(lambda t: measures.modal_agreement(t, "run", "phase")),
    "eval_mean_sd": _timings(lambda t: measures.mean_sd(t, "phase", "ms")),
    "usage_costs": lambda spark, d: measures.costs(A.usage(spark, d)),
    "log_event_histogram": _log(logs.event_histogram),
    "log_verdict_histogram": _log(logs.verdict_histogram),
    "log_replay_state": _log(logs.replay),
    "log_claim_timings": _log(logs.claim_timing_totals),
    "log_stalls": _log(logs.stalls),
    "log_largest_gaps": _log(logs.largest_gaps),
    "log_grounded_answers": _log(logs.grounded_answers),
    "log_first_quote": _claims(logs.first_quotes),
    "log_gate_preservation": _claims(logs.gate_preservation),
    "job_status_counts": _claims(logs.status_counts),
    "job_feed_priority": _claims(logs.feed_priority),
    "job_next_pending": _claims(lambda c: logs.next_pending(c, 5)),
    "job_suspect_window": _claims(lambda c: logs.suspect_window(c, 10, 40)),
    "job_approval": _claims(logs.approval),
    "chain_hash_verify": _chain,
}

SQL = {
    "finding_counts": f"WITH {FIND} SELECT code, locus, count(*) AS findings FROM f GROUP BY 1, 2",
    "finding_blanket_shapes": f"WITH {FIND} SELECT * FROM bl",
    "finding_locus_density": f"WITH {FIND} SELECT locus, count(*) AS findings, count(*) FILTER (WHERE bl.code IS NULL) AS specific FROM s LEFT JOIN bl USING (code, shape) GROUP BY 1",
    "finding_debt": f"""WITH {FIND}, reg(code, kind, weight) AS (VALUES {", ".join(f"('{c}', '{k}', {w}::DOUBLE)" for c, k, w in REGISTRY)}), tot(code, total) AS (VALUES ('K-R2', 10000000), ('K-R1', 1)),
        g AS (SELECT code, count(*) FILTER (WHERE attribution <> 'translation') AS seen, count(*) FILTER (WHERE attribution = 'undetermined') AS open, count(*) FILTER (WHERE attribution = 'translation') AS translation FROM f GROUP BY 1),
        h AS (SELECT code, kind, weight, greatest(coalesce(seen, 0), coalesce(total, 0))::BIGINT AS findings, (coalesce(open, 0) + greatest(coalesce(total, 0) - coalesce(seen, 0), 0))::BIGINT AS undetermined, coalesce(translation, 0) AS translation FROM g FULL JOIN tot USING (code) LEFT JOIN reg USING (code)),
        i AS (SELECT *, round(findings / (SELECT count(*) FROM lineitem), 6) AS rate FROM h)
        SELECT code, findings, undetermined, translation, rate, rate > 0.5 AS saturated, CASE WHEN rate > 0.5 OR kind = 'coverage' THEN 0.0::DOUBLE ELSE round(weight * findings, 6) END AS debt FROM i""",
    "finding_completeness": f"""WITH {FIND} SELECT r.code, CASE WHEN count(f.code) > 0 THEN 'instrumented' WHEN r.applies THEN 'silent_by_principle' ELSE 'not_applicable' END AS state, count(f.code) AS findings
        FROM (VALUES ('K-A1', true), ('K-A2', true), ('K-N1', true), ('K-R2', true), ('K-Z1', true), ('K-Z2', false)) r(code, applies) LEFT JOIN f ON f.code = r.code GROUP BY r.code, r.applies""",
    "finding_coverage": f"""WITH {CLAIMS}, t AS (SELECT unnest([{{'metric': 'quote', 'ok': coalesce(source_quote, '') <> ''}}, {{'metric': 'section', 'ok': coalesce(section, '') <> ''}}, {{'metric': 'verdict', 'ok': coalesce(verdict, '') <> ''}}]) AS u FROM c)
        SELECT u.metric AS metric, count(*) FILTER (WHERE u.ok) AS present, count(*) FILTER (WHERE NOT u.ok) AS missing, round(100 * count(*) FILTER (WHERE u.ok) / count(*), 2) AS pct FROM t GROUP BY 1""",
    "audit_precision_wilson": """WITH g AS (SELECT corpus_id, count(DISTINCT tuple_id) FILTER (WHERE confidence = 'high') AS k, count(DISTINCT coalesce(tuple_id, '')) AS n FROM norm_tuples GROUP BY 1), q AS (SELECT *, k / n::DOUBLE AS p, 1.959963985::DOUBLE AS z FROM g)
        SELECT corpus_id, k, n, round(p, 6) AS rate, round((p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS low, round((p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS high FROM q""",
    "audit_stratified_sample": f"""WITH {FIND}, k AS (SELECT DISTINCT code, locus, subject, md5(concat_ws('|', subject, code, locus, detail, '7')) AS key FROM f),
        r AS (SELECT *, row_number() OVER (PARTITION BY code, locus ORDER BY key, subject)::INT AS turn FROM k) SELECT code, locus, subject, turn FROM r ORDER BY turn, key, subject LIMIT 60""",
    "bind_dispersion": f"WITH {BIND}, {DISP} SELECT * FROM d",
    "bind_jaccard": f"WITH {BIND}, {JAC} SELECT * FROM jj",
    "bind_gates": f"""WITH {BIND}, {DISP}, {JAC}, v AS (SELECT unnest([{{'gate': 'mean_multiplicity', 'value': mean_multiplicity, 'bound': 1.5::DOUBLE, 'least': false}}, {{'gate': 'exclusivity', 'value': exclusivity, 'bound': 0.5::DOUBLE, 'least': true}},
        {{'gate': 'capture', 'value': capture, 'bound': 60::DOUBLE, 'least': false}}, {{'gate': 'max_jaccard', 'value': (SELECT max(jaccard) FROM jj), 'bound': 0.6::DOUBLE, 'least': false}}]) AS g FROM d)
        SELECT g.gate AS gate, g.value AS value, g.bound AS bound, CASE WHEN g.least THEN g.value >= g.bound ELSE g.value <= g.bound END AS passed FROM v""",
    "bind_top_multiplicity": f"WITH {BIND} SELECT class, loci FROM m ORDER BY loci DESC, class LIMIT 10",
    "timing_phase_stats": """WITH g AS (SELECT event_type AS phase, count(*) AS n, round(avg(value), 6) AS mean, list_sort(list(value)) AS v, round(sum(value), 4) AS sum FROM events GROUP BY 1)
        SELECT phase, n, mean, v[round_even(0.5 * (n - 1), 0)::INT + 1] AS p50, v[round_even(0.95 * (n - 1), 0)::INT + 1] AS p95, sum, round(sum / (SELECT sum(sum) FROM g), 6) AS share FROM g""",
    "timing_quartile_means": """WITH r AS (SELECT user_id AS run, value AS ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
        SELECT run, (least(i // (n // 4), 3) + 1)::INT AS quartile, round(avg(ms), 6) AS mean FROM r WHERE n >= 8 GROUP BY 1, 2""",
    "timing_quartile_growth": """WITH r AS (SELECT user_id AS run, event_type AS phase, value AS ms, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)
        SELECT run, phase, round(avg(ms) FILTER (WHERE i > n - greatest(1, n // 4)) / nullif(avg(ms) FILTER (WHERE i <= greatest(1, n // 4)), 0), 6) AS growth FROM r GROUP BY 1, 2""",
    "eval_modal_agreement": "WITH g AS (SELECT user_id AS run, event_type, count(*) AS c FROM events GROUP BY 1, 2) SELECT run, sum(c)::BIGINT AS n, round(max(c) / sum(c), 6) AS agreement FROM g GROUP BY 1",
    "eval_mean_sd": "SELECT event_type AS phase, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd FROM events GROUP BY 1",
    "usage_costs": """WITH u AS (SELECT 'phase_' || l_returnflag AS phase, trunc(l_extendedprice)::BIGINT AS i, trunc(l_extendedprice * l_discount * 5)::BIGINT AS c, trunc(l_quantity)::BIGINT AS o FROM lineitem),
        g AS (SELECT phase, sum(i)::BIGINT AS input_tokens, sum(c)::BIGINT AS cached_tokens, sum(o)::BIGINT AS output_tokens FROM u GROUP BY 1),
        k AS (SELECT *, ((input_tokens - cached_tokens) * 3e-6 + cached_tokens * 3e-7 + output_tokens * 1.5e-5)::DOUBLE AS a, (input_tokens * 3e-6 + output_tokens * 1.5e-5)::DOUBLE AS nv FROM g)
        SELECT phase, input_tokens, cached_tokens, output_tokens, round(a, 4) AS actual, round(nv, 4) AS naive, round(cached_tokens / input_tokens, 6) AS hit_ratio, round(nv - a, 4) AS saved FROM k""",
    "log_event_histogram": f"WITH {LOG} SELECT event_type, count(*) AS events, count(DISTINCT session_id) AS sessions FROM e GROUP BY 1",
    "log_verdict_histogram": f"WITH {LOG} SELECT coalesce(payload->>'$.proposal.reasoner_verdict', 'none') AS verdict, count(*) AS proposals, count(DISTINCT payload->>'$.proposal.utterance') AS utterances FROM e WHERE event_type = 'propose' GROUP BY 1",
    "log_replay_state": f"""WITH {LOG}, u AS (SELECT payload->>'$.proposal.proposal_id' AS proposal_id, CASE WHEN payload->>'$.proposal.reasoner_verdict' = 'inconsistent' THEN 'inconsistent' END AS status, true AS proposed, ts, event_id FROM e WHERE event_type = 'propose'
        UNION ALL SELECT payload->>'$.proposal_id', CASE WHEN payload->>'$.committed' = 'true' THEN 'committed' ELSE 'rejected' END, false, ts, event_id FROM e WHERE event_type = 'commit')
        SELECT proposal_id, coalesce(arg_max(status, (ts, event_id)) FILTER (WHERE status IS NOT NULL), 'pending') AS status, count(*) FILTER (WHERE proposed) AS proposals FROM u WHERE proposal_id IS NOT NULL GROUP BY 1""",
    "log_claim_timings": f"""WITH {LOG}, k AS (SELECT payload->'$.ms' AS ms, unnest(json_keys(payload->'$.ms')) AS phase FROM e WHERE event_type = 'claim_timing'), v AS (SELECT phase, TRY_CAST(json_extract_string(ms, '$."' || phase || '"') AS DOUBLE) AS ms FROM k)
        SELECT phase, count(*) AS n, round(sum(ms), 1) AS ms FROM v WHERE ms IS NOT NULL GROUP BY 1""",
    "log_stalls": f"""WITH {LOG}, g AS (SELECT session_id, floor(epoch(ts))::BIGINT - lag(floor(epoch(ts))::BIGINT) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS gap FROM e WHERE session_id IS NOT NULL)
        SELECT session_id, count(*) FILTER (WHERE gap > 1800) AS stalls, max(gap) AS longest FROM g GROUP BY 1""",
    "log_largest_gaps": f"""WITH {LOG}, g AS (SELECT session_id, event_id, ts, lead(floor(epoch(ts))::BIGINT) OVER (PARTITION BY session_id ORDER BY ts, event_id) - floor(epoch(ts))::BIGINT AS wait FROM e WHERE session_id IS NOT NULL)
        SELECT session_id, max(wait) AS wait, arg_max(event_id, (wait, -floor(epoch(ts))::BIGINT, -event_id)) AS event_id FROM g WHERE wait IS NOT NULL GROUP BY 1""",
    "log_grounded_answers": f"""WITH {LOG} SELECT coalesce(payload->>'$.grounded', 'none') AS said, coalesce(json_array_length(payload->'$.referenced_iris'), 0) > 0 AND coalesce(json_array_length(payload->'$.missing_iris'), 0) = 0 AS found, count(*) AS answers FROM e WHERE event_type = 'query' GROUP BY 1, 2""",
    "log_first_quote": "SELECT section, min(claim_key) AS claim_key, arg_min(substr(source_quote, 1, 200), claim_key) AS quote FROM claims WHERE section IS NOT NULL AND source_quote <> '' GROUP BY 1",
    "log_gate_preservation": """WITH l AS (SELECT job_id, proposal_id, arg_max(status, (updated_at, claim_key)) AS status, bool_or(coalesce(verdict = 'inconsistent', false)) AS clashed FROM claims WHERE proposal_id IS NOT NULL GROUP BY 1, 2)
        SELECT job_id, count(*) AS proposals, count(*) FILTER (WHERE clashed) AS clashes, count(*) FILTER (WHERE clashed AND status = 'committed') AS recovered FROM l GROUP BY 1""",
    "job_status_counts": f"WITH {CLAIMS} SELECT job_id, count(*) AS claims, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in logs.STATUSES) + " FROM c GROUP BY 1",
    "job_feed_priority": f"""WITH {CLAIMS}, t AS (SELECT *, CASE WHEN starts_with(section, 'rec_') THEN 3 {" ".join(f"WHEN regexp_matches(lower(coalesce(source_quote, '')), '{p}') THEN {dict(definition=0, establishment=1, conferral=1, scope=1).get(k, 2)}" for k, p in T.CLAUSE_KINDS)} ELSE 2 END AS tier FROM c WHERE status = 'pending'), x AS (SELECT job_id, max(id) AS top FROM c WHERE status <> 'pending' GROUP BY 1)
        SELECT t.job_id, claim_key, id, coalesce(top, -1) + row_number() OVER (PARTITION BY t.job_id ORDER BY tier, id, claim_key) AS new_id FROM t LEFT JOIN x ON x.job_id = t.job_id""",
    "job_next_pending": f"WITH {CLAIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY id, claim_key) AS i FROM c WHERE status = 'pending' AND approved) SELECT job_id, claim_key, id FROM r WHERE i <= 5",
    "job_suspect_window": f"WITH {CLAIMS} SELECT job_id, count(*) FILTER (WHERE id > 10 AND id <= 40 AND status = 'committed') AS flipped, count(*) FILTER (WHERE status = 'needs_review' OR (id > 10 AND id <= 40 AND status = 'committed')) AS needs_review FROM c GROUP BY 1",
    "job_approval": f"WITH {CLAIMS} SELECT coalesce(confidence = 'high' AND NOT coalesce(section LIKE 'rec\\_%' ESCAPE '\\', false), false) AS default_approved, approved, count(*) AS claims FROM c GROUP BY 1, 2",
    "chain_hash_verify": """WITH l AS (SELECT user_id AS file, event_id AS line_no, concat_ws(',', event_id, event_type, props) AS line FROM events),
        p AS (SELECT *, coalesce('sha256:' || sha256(lag(line) OVER (PARTITION BY file ORDER BY line_no)), 'sha256:' || repeat('0', 64)) AS expected FROM l)
        SELECT file, count(*) AS lines, min(CASE WHEN (CASE WHEN line_no % 97 = 0 THEN 'sha256:bad' ELSE expected END) <> expected THEN line_no END) AS first_break FROM p GROUP BY 1""",
}
