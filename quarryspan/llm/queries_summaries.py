"""Queries of problems 1 and 7: residue and cut texts among the summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryspan.llm.residue import find_residue, fitted, labelled_sample, residue_of, validate
from quarryspan.llm.truncation import cut_texts, source_of
from quarryspan.tables import load


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items whose summary is residue of a template or no content."""
    return find_residue(load(spark, folder, "raw_evidence_items", "id", "summary", "title", "url"))


def p1_validation(spark: SparkSession, folder: str) -> DataFrame:
    """How well the classifier does on hosts it has not seen."""
    got = validate(labelled_sample(load(spark, folder, "raw_evidence_items", "id", "summary", "title", "url")))
    return spark.createDataFrame([(k, v) for k, v in got.items()], "measure string, value double")


def _cut(spark: SparkSession, folder: str) -> DataFrame:
    items = load(spark, folder, "raw_evidence_items", "id", "summary", "title", "url", "provider")
    # what p1_found finds is no case: the same model, the same decision
    model = fitted(labelled_sample(items))
    return cut_texts(items, title="title", left_out=residue_of(model))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items whose summary lost its end."""
    return _cut(spark, folder).select("id")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """For each provider, how many summaries it has, how many are cut, their share, and how many each rule tells."""
    items = load(spark, folder, "raw_evidence_items", "id", "summary", "provider").where(F.trim("summary") != "")
    counts = items.select("id", source_of(F.col("provider")).alias("source")).distinct().groupBy("source").agg(F.count("*").alias("summaries"))
    cut = _cut(spark, folder).groupBy("source").agg(F.count("*").alias("cut"), *[F.count_if(F.col("rule") == r).alias(f"by_{r}") for r in ("limit", "mark", "ending")])
    some = [F.coalesce(c, F.lit(0)).alias(c) for c in ("cut", "by_limit", "by_mark", "by_ending")]
    return counts.join(cut, "source", "left").select("source", "summaries", *some, (F.coalesce("cut", F.lit(0)) / F.col("summaries")).alias("share"))


QUERIES = {"p1_found": p1_found, "p1_validation": p1_validation, "p7_found": p7_found, "p7_shares": p7_shares}
ORACLE: dict[str, str] = {}
