"""Queries r01_ to r03_, r07_, k03_, st07_: packs of evidence as a whole, one of all sources, and results saved by merging."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryspan.functions import ids as U
from quarryspan.functions import structured as X
from quarryspan.operators import packs as P
from quarryspan.operators import scoring as O
from quarryspan.operators.quality import graded, hit_quality, relevance_label
from quarryspan.operators.ranking import best_rows
from quarryspan.plans import quality
from quarryspan.plans.more import patent_labels
from quarryspan.plans.quality import _atoms
from quarryspan.plans.views import attempts, items, pool, sessions
from quarryspan.session import checkpoint_dir, cut
from quarryspan.sources import store

KEY = ["session_id", "source_type"]


def _packs(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """Packs of one source from the best search of each session: candidates scored in their pool, labelled, covered, and ordered."""
    rows = cut(pool(spark, folder, "evidence_level", "canonical_id", "url", "verified_url").where(F.col("source_type") == source))
    scores = O.gates(O.scored(rows))
    if source == "patent":
        label = patent_labels(scores)
    elif source == "publication":
        label = scores.select("id", F.when(F.col("reason") == "accepted", "focused").when(F.col("shared") > 0, "adjacent").otherwise("generic").alias("label"))
    else:
        label = scores.select("id", relevance_label(F.col("score")).alias("label"))
    hits = rows.join(scores.select("id", F.col("level_score").alias("score")), "id").join(label, "id")
    hits = hits.select(*KEY, "id", "title", "url", U.exact_number(F.regexp_replace("canonical_id", "^patent:", "")).alias("number"), "evidence_level", "summary", (F.coalesce("verified_url", F.lit(0)) == 1).alias("verified"), "label", "score", "text")
    searches = attempts(spark, folder, *KEY, "attempt", "status", "completed", "reliable_no_results", "warning_count").where(F.col("source_type") == source)
    searches = best_rows(searches, KEY, [F.desc("attempt"), F.desc("id")]).select(*KEY, "status", (F.col("completed") == 1).alias("completed"), (F.col("reliable_no_results") == 1).alias("reliable_no_results"), F.coalesce("warning_count", F.lit(0)).alias("warnings"))
    return P.evidence_packs(P.covered(hits, _atoms(spark, folder)), searches)


def r01_patent_packs(spark: SparkSession, folder: str) -> DataFrame:
    return _packs(spark, folder, "patent")


def r02_publication_packs(spark: SparkSession, folder: str) -> DataFrame:
    return _packs(spark, folder, "publication")


def r03_web_packs(spark: SparkSession, folder: str) -> DataFrame:
    return _packs(spark, folder, "web")


def r07_final_packs(spark: SparkSession, folder: str) -> DataFrame:
    """One row a session with the packs of its three sources and their overall status."""
    every = r01_patent_packs(spark, folder).unionByName(r02_publication_packs(spark, folder)).unionByName(r03_web_packs(spark, folder))
    return P.merged(every, sessions(spark, folder))


def k03_merged_packs(spark: SparkSession, folder: str) -> DataFrame:
    """The results' payloads as merged packs, whatever they are wrapped in, by status; a payload that is none is a failed pack."""
    rows = attempts(spark, folder, "normalized_json").withColumn("pack", X.pack_column("normalized_json"))
    return rows.groupBy(F.get_json_object("pack", "$.overall_status").alias("overall_status"), F.get_json_object("pack", "$.errors[0].type").alias("error")).agg(F.count("*").alias("n"))


def st07_saved_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Results saved with their grade and number of hits by merging: in two deliveries, the second of which repeats the first."""
    key = [*KEY, "attempt"]
    rows = attempts(spark, folder, *key, "run_id", "status", "completed", "reliable_no_results", "error_count", "created_at")
    last = best_rows(rows, key, [F.desc("id")]).drop("rank_no")
    hits = items(spark, folder, *key, "evidence_level", "relevance_score", "verified_url")
    hits = hits.withColumn("label", relevance_label(F.col("relevance_score"))).withColumn("class", U.level_class(F.col("evidence_level"))).withColumn("verified", F.col("verified_url"))
    hits = hits.withColumn("quality", hit_quality(F.col("relevance_score"), F.col("evidence_level"), F.col("label"), F.col("verified_url")))
    saved = cut(graded(hits, last.drop("id", "run_id", "created_at"), key).select(*key, "status", "hits", "grade").join(last.select(*key, "id", "run_id"), key))
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    store.merge(saved.where("attempt = 1"), path, key, "id")
    store.merge(saved, path, key, "id")
    return store.read(spark, path).groupBy("source_type", "grade").agg(F.count("*").alias("attempts"), F.sum("hits").alias("hits"))


QUERIES = {f.__name__: f for f in (r01_patent_packs, r02_publication_packs, r03_web_packs, r07_final_packs, k03_merged_packs, st07_saved_evidence)}
ORACLE = {"st07_saved_evidence": f"SELECT source_type, grade, count(*) AS attempts, sum(hits)::BIGINT AS hits FROM ({quality.ORACLE['a07_grades']}) GROUP BY ALL"}
