"""Packs of evidence: for each session and source its best hits with level, label, score and coverage, and the state of its search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryspan import dims
from quarryspan.functions import text as T
from quarryspan.operators.quality import requirement_matches
from quarryspan.operators.ranking import best_rows, case_rank

KEY = ["session_id", "source_type"]
HIT = "array<struct<rank_no:int,id:bigint,title:string,url:string,number:string,evidence_level:string,summary:string,verified_url:boolean,relevance:string,relevance_score:double,coverage:double,matched:int,exact:boolean>>"


def kept_level(level: Column, snippet: Column) -> Column:
    """The level of evidence, but a failed fetch leaves the snippet of a search as evidence, if it has eight words."""
    return F.when(level.isin("fetch_timeout", "fetch_failed") & (F.size(T.word_list(snippet)) >= 8), "search_snippet_only").otherwise(level)


def covered(hits: DataFrame, atoms: DataFrame) -> DataFrame:
    """Hits (session_id, id, text..) with matched and coverage: how many, and which share, of their session's requirements their text has."""
    asked = atoms.groupBy("session_id").agg(F.count("*").alias("_asked"))
    found = requirement_matches(hits.select("session_id", "id", "text"), atoms, ["session_id"]).where("full").groupBy("id").agg(F.count("*").cast("int").alias("matched"))
    rows = hits.join(found, "id", "left").join(asked, "session_id", "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    return rows.withColumn("coverage", F.coalesce(T.rounded(F.expr("try_divide(matched, _asked)"), 4), F.lit(0.0)))


def evidence_packs(hits: DataFrame, searches: DataFrame, most: int = 10) -> DataFrame:
    """One row for each session and source that was searched: status, completed, reliable_no_results, hits (at most so many, best first), warnings.

    hits: session_id, source_type, id, title, url, number, evidence_level, summary, verified (boolean), label, score, matched, coverage.
    searches: session_id, source_type, status, completed (boolean), reliable_no_results (boolean), warnings (number). A search that failed has a failed pack; one with
    warnings, or with a hit that couldn't be fetched, is partial, and so are publications without a focused hit; a web pack without
    hits failed. Order: the label, the score, the id. Only the rows that a pack shows are collected.
    """
    covers = (F.col("coverage") >= 1.0) & F.col("evidence_level").isin(*dims.STRONG, *dims.MEDIUM)
    rows = hits.withColumn("_failed", F.col("evidence_level").isin("fetch_timeout", "fetch_failed")).withColumn("evidence_level", kept_level(F.col("evidence_level"), F.col("summary")))
    rows = rows.withColumn("score", F.coalesce(F.when(~F.isnan("score"), F.col("score")), F.lit(0.0))).withColumn("exact", covers).withColumn("_label", case_rank(F.col("label"), dims.RELEVANCE_RANK, 0))
    state = rows.groupBy(*KEY).agg(F.count("*").alias("found"), F.max("_failed").alias("_unverified"), F.max(F.col("label").isin("focused", "direct")).alias("_focused"))
    best = best_rows(rows, KEY, [F.desc("_label"), F.desc("score"), F.asc("id")], most)
    hit = F.struct(F.col("rank_no").cast("int").alias("rank_no"), F.col("id").cast("long").alias("id"), "title", "url", "number", "evidence_level", T.trim_words(F.col("summary"), 120).alias("summary"), F.col("verified").alias("verified_url"), F.col("label").alias("relevance"), F.col("score").alias("relevance_score"), "coverage", F.col("matched").cast("int").alias("matched"), "exact")
    shown = best.groupBy(*KEY).agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    packs = searches.join(state, KEY, "left").join(shown, KEY, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    weak = (F.col("source_type") == "publication") & (F.col("found") > 0) & ~F.coalesce("_focused", F.lit(False))
    partial = (F.col("status") == "partial_failure") | (F.col("warnings") > 0) | F.coalesce("_unverified", F.lit(False)) | weak
    none = (F.col("source_type") == "web") & (F.col("found") == 0)
    status = F.when(F.col("status") == "failed", "failed").when(partial, "partial_failure").when(none, "failed").otherwise("ok")
    done = F.when(F.col("source_type") == "web", F.col("completed")).otherwise(F.col("completed") & (status == "ok"))
    notes = F.filter(F.array(F.when(weak, F.lit("publication hits are weak or adjacent to the query")), F.when(F.coalesce("_unverified", F.lit(False)), F.lit("some hits could not be fetched"))), lambda x: x.isNotNull())
    return packs.select(*KEY, status.alias("status"), done.alias("completed"), F.col("reliable_no_results"), "found", F.coalesce("hits", F.array().cast(HIT)).alias("hits"), notes.alias("notes"))


def merged(packs: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row a session: overall status, and the pack of each source; an absent one counts as failed, with a note of its own."""
    sources = ("patent", "publication", "web")
    inner = F.struct("status", "completed", "reliable_no_results", "found", "hits", "notes")
    per = packs.groupBy("session_id").agg(*[F.any_value(F.when(F.col("source_type") == s, inner), True).alias(s) for s in sources])
    rows = sessions.select("session_id").join(per, "session_id", "left")
    missing = F.struct(F.lit("failed").alias("status"), F.lit(False).alias("completed"), F.lit(False).alias("reliable_no_results"), F.lit(0).cast("long").alias("found"), F.array().cast(HIT).alias("hits"), F.array(F.lit("no input received")).alias("notes"))
    rows = rows.select("session_id", *[F.coalesce(F.col(s), missing).alias(s) for s in sources])
    each = [F.col(f"{s}.status") for s in sources]
    good = sum((c == "ok").cast("int") for c in each)
    bad = sum((c == "failed").cast("int") for c in each)
    return rows.select("session_id", F.when(good == 3, "ok").when(bad == 3, "failed").otherwise("partial_failure").alias("overall_status"), *sources)
