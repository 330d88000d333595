"""Queries st02_, st04_, st10_..: the streams, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryspan.streaming import events as E

#: How far apart repeated deliveries are at most; a row delivered again later than this would count again.
REPEATED = "30 days"


def st04_daily_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events counted by day and type by a stream."""
    counts = E.windowed_counts(E.stream_of(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    return E.run_to_table(counts, "complete").select(F.unix_seconds("start").alias("day"), "event_type", "n")


def st10_without_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence items once each from a stream in which some come twice, up to REPEATED apart in event time: state older than that is dropped."""
    rows = E.stream_of(spark, folder, "raw_evidence_items").select("id", "source_type", "created_at")
    return E.run_to_table(E.without_repeats(rows, ["id"], "created_at", REPEATED)).groupBy("source_type").agg(F.count("*").alias("n"))


def st02_attempt_states(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts of each session and source, folded by a stateful stream."""
    rows = E.stream_of(spark, folder, "evidence_results").select("id", "session_id", "source_type", "attempt", "status")
    out = E.run_to_table(E.attempt_states(rows), "update", ["session_id", "source_type"])
    return out.select("session_id", "source_type", "attempts", "last_attempt", "outcome")


QUERIES = {f.__name__: f for f in (st02_attempt_states, st04_daily_events, st10_without_repeats)}
ORACLE = {
    "st02_attempt_states": "WITH a AS (SELECT DISTINCT * FROM evidence_results) SELECT session_id, source_type, count(*) AS attempts, max(attempt) AS last_attempt, arg_max(status, (attempt, id)) AS outcome FROM a GROUP BY ALL",
    "st04_daily_events": "SELECT epoch(date_trunc('day', ts))::BIGINT AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "st10_without_repeats": "SELECT source_type, count(DISTINCT id) AS n FROM raw_evidence_items GROUP BY ALL",
}
