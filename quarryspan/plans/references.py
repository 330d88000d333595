"""Queries p6_..: references to missing, deleted or later records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryspan.operators.references import Reference, orphan_references, orphan_report
from quarryspan.tables import load


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    results = load(spark, folder, "evidence_results", "id", "session_id", "run_id", "created_at")
    sessions = load(spark, folder, "research_sessions", "session_id", "created_at")
    return orphan_references(
        [
            Reference("evidence_results", results, "session_id", "research_sessions"),
            Reference("raw_evidence_items", load(spark, folder, "raw_evidence_items", "id", "run_id", "created_at"), "run_id", "evidence_results"),
            Reference("evaluation_candidate_decisions", load(spark, folder, "evaluation_candidate_decisions", "id", "run_id", "created_at"), "run_id", "evidence_results"),
        ],
        {"research_sessions": (sessions, "session_id", "created_at"), "evidence_results": (results, "run_id", "created_at")},
        load(spark, folder, "deleted_keys", "key_table", "key_value"),
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each referring row whose parent is missing, deleted or late."""
    return _orphans(spark, folder).select("table_name", "id", "kind")


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """The same counted by table, month and kind."""
    return orphan_report(_orphans(spark, folder))


_SQL = """
WITH parent AS (
  SELECT 'research_sessions' AS parent, session_id AS key, min(created_at) AS first FROM research_sessions GROUP BY 2
  UNION ALL SELECT 'evidence_results', run_id, min(created_at) FROM evidence_results GROUP BY 2),
ref AS (
  SELECT DISTINCT 'evidence_results' AS table_name, id, 'research_sessions' AS parent, session_id AS key, created_at FROM evidence_results
  UNION ALL SELECT DISTINCT 'raw_evidence_items', id, 'evidence_results', run_id, created_at FROM raw_evidence_items
  UNION ALL SELECT DISTINCT 'evaluation_candidate_decisions', id, 'evidence_results', run_id, try_cast(created_at AS TIMESTAMPTZ) FROM evaluation_candidate_decisions),
gone AS (SELECT DISTINCT key_table, key_value FROM deleted_keys),
kinds AS (
  SELECT r.table_name, r.id, r.created_at,
    CASE WHEN p.key IS NULL AND g.key_value IS NOT NULL THEN 'deleted' WHEN p.key IS NULL THEN 'missing' WHEN p.first > r.created_at THEN 'late' END AS kind
  FROM ref r LEFT JOIN parent p ON p.parent = r.parent AND p.key = r.key
  LEFT JOIN gone g ON g.key_table = r.parent AND g.key_value = r.key WHERE r.key <> '')
"""

QUERIES = {"p6_found": p6_found, "p6_report": p6_report}
ORACLE = {
    "p6_found": _SQL + "SELECT table_name, id, kind FROM kinds WHERE kind IS NOT NULL",
    "p6_report": _SQL + "SELECT table_name, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS month, kind, count(*) AS orphans FROM kinds WHERE kind IS NOT NULL GROUP BY ALL",
}
