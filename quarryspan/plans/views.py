"""Rows that many queries begin with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryspan.functions.text import discriminative, subject_anchors, tokens
from quarryspan.tables import load


def items(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Evidence items, each once."""
    wanted = ("id", *[c for c in columns if c != "id"])
    return load(spark, folder, "raw_evidence_items", *wanted).dropDuplicates(["id"])


def attempts(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Results of attempts, each once."""
    wanted = ("id", *[c for c in columns if c != "id"])
    return load(spark, folder, "evidence_results", *wanted).dropDuplicates(["id"])


def decisions(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Decisions on candidates, each once."""
    wanted = ("id", *[c for c in columns if c != "id"])
    return load(spark, folder, "evaluation_candidate_decisions", *wanted).dropDuplicates(["id"])


def sessions(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return load(spark, folder, "research_sessions", "session_id", *[c for c in columns if c != "session_id"])


def pool(spark: SparkSession, folder: str, *columns: str, every: bool = False) -> DataFrame:
    """Each item as a candidate for the query of its session: session_id, source_type, id, query, text and more columns.

    The query has its tokens q, the telling ones d, and the anchors a. Items of sessions that have no row have no query and are
    no candidates; with every, they stay, with a null query.
    """
    rows = items(spark, folder, "session_id", "source_type", "title", "summary", *columns)
    queries = sessions(spark, folder, "original_query").select("session_id", F.col("original_query").alias("query"), tokens(F.col("original_query")).alias("q"))
    queries = queries.withColumn("d", discriminative(F.col("q"))).withColumn("a", subject_anchors(F.col("d")))
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("summary", F.lit("")))
    return rows.join(queries, "session_id", "left" if every else "inner").withColumn("text", text)


def benchmark(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by id and text."""
    return load(spark, folder, "documents", "doc_id", "text")
