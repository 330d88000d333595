"""Queries of problems 2, 4 and 5: groups of duplicates, top rows of groups, look-alike texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryspan.llm.lookalike import same_looking_classes, same_looking_pairs
from quarryspan.llm.representative import FIELDS, GROUP, best_representative
from quarryspan.llm.topn import top_n
from quarryspan.tables import load


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving item of each group of duplicates, and the item its provider comes from; both by the stated order, not by the model."""
    return best_representative(load(spark, folder, "raw_evidence_items"), fields=()).select("id", "provider_from_id")


def p2_fused(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving record of each group with the field values judged true by the latent model."""
    fused = best_representative(load(spark, folder, "raw_evidence_items"))
    return fused.select(*GROUP, "id", *[F.col("fused")[f].alias(f"{f}_values") for f in FIELDS])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The three items with the highest relevance of each session and source."""
    items = load(spark, folder, "raw_evidence_items", "session_id", "source_type", "id", "relevance_score")
    return top_n(items, ["session_id", "source_type"], "relevance_score", "id", 3)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of sessions, and of items of a session, whose query or title looks the same but differs."""
    sessions = same_looking_pairs(load(spark, folder, "research_sessions", "session_id", "original_query"), [], "session_id", "original_query")
    items = same_looking_pairs(load(spark, folder, "raw_evidence_items", "session_id", "id", "title"), ["session_id"], "id", "title")
    return sessions.select(F.lit("original_query").alias("field_name"), F.col("a").alias("key_a"), F.col("b").alias("key_b")).unionByName(
        items.select(F.lit("title").alias("field_name"), F.col("a").cast("string").alias("key_a"), F.col("b").cast("string").alias("key_b")))


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The members of each class of look-alike titles of a session, and of queries of all sessions: membership instead of pairs."""
    sessions = same_looking_classes(load(spark, folder, "research_sessions", "session_id", "original_query"), [], "session_id", "original_query")
    items = same_looking_classes(load(spark, folder, "raw_evidence_items", "session_id", "id", "title"), ["session_id"], "id", "title")
    return sessions.select(F.lit("original_query").alias("field_name"), F.col("session_id").alias("key"), "form", "first_key", "texts").unionByName(
        items.select(F.lit("title").alias("field_name"), F.col("id").cast("string").alias("key"), "form", F.col("first_key").cast("string").alias("first_key"), "texts"))


_KEY = r"""
nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(canonical_id)),
 '#.*$', ''), '^\s*[a-z][a-z0-9+.\-]*://', ''), '^www[0-9]*\.', ''), '^(dx\.)?doi\.[a-z.]+/(10\.)', '\2'), '^(doi|patent|pn|urn|hdl|arxiv)\s*:\s*', ''),
 '([?&])(utm_[a-z_]*|gclid|fbclid|msclkid|dclid|yclid|gbraid|wbraid|mc_cid|mc_eid|igshid|_ga|_gl|vero_id|spm)=[^&]*', '\1', 'g'), '[^\p{L}\p{N}]+', '', 'g'), '')
"""

QUERIES = {"p2_found": p2_found, "p2_fused": p2_fused, "p4_found": p4_found, "p5_found": p5_found, "p5_classes": p5_classes}
ORACLE = {
    "p2_found": f"""
WITH items AS (SELECT DISTINCT id, session_id, source_type, provider, coalesce(verified_url, 0) AS v, CASE WHEN NOT isnan(evidence_quality_score) THEN evidence_quality_score END AS q, created_at, {_KEY} AS k FROM raw_evidence_items),
ranked AS (SELECT *, count(*) OVER g AS n,
  row_number() OVER (PARTITION BY session_id, source_type, k ORDER BY v DESC, q DESC NULLS LAST, created_at DESC, id) AS r
  FROM items WHERE k IS NOT NULL WINDOW g AS (PARTITION BY session_id, source_type, k))
SELECT min(id) FILTER (r = 1) AS id, coalesce(arg_min(id, r) FILTER (trim(provider) <> ''), min(id) FILTER (r = 1)) AS provider_from_id
FROM ranked WHERE n > 1 GROUP BY session_id, source_type, k""",
    "p4_found": """
SELECT session_id, source_type, rank_no, id FROM (
  SELECT session_id, source_type, id, row_number() OVER (PARTITION BY session_id, source_type ORDER BY relevance_score DESC, id) AS rank_no
  FROM (SELECT DISTINCT session_id, source_type, id, relevance_score FROM raw_evidence_items) WHERE relevance_score IS NOT NULL AND NOT isnan(relevance_score))
WHERE rank_no <= 3""",
}
