"""Queries of problem 3: languages of queries and of their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryspan.llm import langid
from quarryspan.tables import load


def _labelled(sessions: DataFrame) -> DataFrame:
    return sessions.select("session_id", "original_query", F.get_json_object("query_envelope_json", "$.language").alias("label"))


def _samples(spark: SparkSession, folder: str) -> tuple[list[str], list[str]]:
    """Labelled text: the queries by their own labels, and documents, which have all languages even where queries are few."""
    sessions = _labelled(load(spark, folder, "research_sessions"))
    queries = langid.labelled_sample(sessions, "session_id", "original_query", F.col("label"))
    documents = langid.labelled_sample(load(spark, folder, "documents", "doc_id", "text", "lang"), "doc_id", "text", F.when(F.trim("lang") != "", F.col("lang")), rows=3_000)
    return queries[0] + documents[0], queries[1] + documents[1]


def _found(spark: SparkSession, folder: str) -> DataFrame:
    net = langid.train(*langid.labelled_windows(*_samples(spark, folder)))
    cores = spark.sparkContext.defaultParallelism
    # repeated rows lie in one partition after the only shuffle
    sessions = _labelled(load(spark, folder, "research_sessions")).repartition(4 * cores, "session_id").dropDuplicates(["session_id"])
    return langid.text_segments(sessions, net, "session_id", "original_query", F.col("label"))


def p3_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every segment of every query with its language and a confidence."""
    return _found(spark, folder).select(F.col("key").alias("session_id"), "segment_no", "lang", "confidence")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Queries without the right language label, and the segments of mixed ones."""
    wrong = (F.col("segments") > 1) | F.col("labelled").isNull() | (F.col("labelled") != F.col("lang"))
    return _found(spark, folder).where(wrong).select(F.col("key").alias("session_id"), "segment_no", "lang")


def p3_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy on texts that were held out of training: of windows, whole texts, and two texts in a row."""
    return spark.createDataFrame(langid.validate(*_samples(spark, folder)), "measure string, lang string, cases long, right long")


QUERIES = {"p3_found": p3_found, "p3_segments": p3_segments, "p3_validation": p3_validation}
ORACLE: dict[str, str] = {}
