"""Queries of the small reports."""

from __future__ import annotations

from ..operators import summaries
from ..sources.tables import table
from . import gating


def _arms(spark, d):
    claims, chunks = table(spark, d, "claims"), table(spark, d, "chunks")
    return summaries.compare_arms(claims.selectExpr("section as key"), chunks.selectExpr("section as key"))


QUERIES = {
    "report_acts": lambda spark, d: summaries.acts(table(spark, d, "documents")),
    "report_arms": _arms,
    "report_triage": lambda spark, d: summaries.triage(gating.QUERIES["gate_construction"](spark, d)),
    "report_first_chunk": lambda spark, d: summaries.first_with(table(spark, d, "chunks"), "jointly"),
    "report_months": lambda spark, d: summaries.months(table(spark, d, "session_log").dropDuplicates(["event_id"]), "ts"),
}

SQL = {
    "report_acts": "SELECT act_id, count(*) AS documents, count(DISTINCT locator) AS locators, coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind), '') AS kinds FROM documents GROUP BY 1",
    "report_arms": """WITH a AS (SELECT DISTINCT section AS k FROM claims WHERE section IS NOT NULL), b AS (SELECT DISTINCT section AS k FROM chunks WHERE section IS NOT NULL), f AS (SELECT a.k AS x, b.k AS y FROM a FULL JOIN b ON a.k = b.k)
        SELECT count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS both, count(*) FILTER (WHERE y IS NULL) AS only_one, count(*) FILTER (WHERE x IS NULL) AS only_two, round(count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) / count(*), 6) AS jaccard FROM f""",
    "report_triage": f"SELECT tier, code, count(DISTINCT proposal_id) AS proposals, count(*) AS violations FROM ({gating.SQL['gate_construction']}) GROUP BY 1, 2",
    "report_first_chunk": "SELECT section, min(chunk_id) AS chunk_id FROM chunks WHERE contains(text, 'jointly') GROUP BY 1",
    "report_months": "SELECT strftime(ts, '%Y-%m') AS month, count(DISTINCT event_id) AS rows FROM session_log GROUP BY 1",
}
