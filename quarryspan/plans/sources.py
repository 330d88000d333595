"""Queries s01_.. to s21_: payloads, inverted indexes, pages, enrichment and liveness, made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryspan.functions import ids as U
from quarryspan.operators.ranking import best_rows
from quarryspan.plans import sql as S
from quarryspan.plans.views import benchmark, items
from quarryspan.sources import snapshots


def s01_patent_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Patents wrapped as search payloads, one each, and flattened again."""
    rows = items(spark, folder, "session_id", "source_type", "canonical_id", "title", "summary").where("source_type = 'patent'")
    patent = F.struct(F.struct(F.col("canonical_id").alias("publication_number"), F.col("title"), F.col("summary").alias("snippet")).alias("patent"))
    raw = rows.select(F.to_json(F.struct(F.struct(F.array(F.struct(F.array(patent).alias("result"))).alias("cluster")).alias("results"))).alias("payload"))
    out = snapshots.patent_payloads(raw)
    return out.groupBy("publication_number").agg(F.count("*").alias("n"), F.max(F.length("snippet")).alias("longest"))


def s04_enrichment(spark: SparkSession, folder: str) -> DataFrame:
    """Patents without an address get one from another item with exactly the same publication number."""
    rows = items(spark, folder, "source_type", "canonical_id", "url").where("source_type = 'patent'").withColumn("number", U.exact_number(F.regexp_replace(F.trim("canonical_id"), "^patent:", "")))
    known = rows.where("number <> '' AND trim(url) <> ''").groupBy("number").agg(F.min_by("url", "id").alias("found"))
    lacking = rows.where("number <> '' AND coalesce(trim(url), '') = ''")
    return lacking.join(known, "number", "left").select("id", "number", F.coalesce("found", F.lit("")).alias("url"))


def s07_scholarly(spark: SparkSession, folder: str) -> DataFrame:
    """Publications wrapped as scholarly payloads and read again."""
    rows = items(spark, folder, "source_type", "canonical_id", "title", "summary").where("source_type = 'publication'")
    raw = rows.select(F.to_json(F.struct(F.array("title").alias("title"), F.concat(F.lit("<jats:p>"), F.regexp_replace("summary", "[<>]", ""), F.lit("</jats:p>")).alias("abstract"), F.col("canonical_id").alias("DOI"))).alias("payload"))
    return snapshots.scholarly_payloads(raw).groupBy("doi").agg(F.count("*").alias("n"), F.min(F.length("abstract")).alias("shortest"))


def s09_inverted_index(spark: SparkSession, folder: str) -> DataFrame:
    """Documents taken apart into inverted indexes and put together again."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), " ")
    placed = benchmark(spark, folder).select("doc_id", F.posexplode(words).alias("pos", "word"))
    index = placed.groupBy("doc_id", "word").agg(F.collect_list("pos").alias("at")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("inverted"))
    return snapshots.inverted_abstracts(index).select("doc_id", F.sha2("text", 256).alias("text_hash"))


def s16_page_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Pages made of items, and the level that their meta tags give."""
    rows = items(spark, folder, "title", "summary")
    quoteless = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[\"'<>]", "")
    html = F.concat(F.lit("<html><head><meta name=\"citation_title\" content=\""), quoteless("title"), F.lit("\"><meta name=\"description\" content=\""), quoteless("summary"), F.lit("\"></head></html>"))
    return snapshots.page_metadata(rows.select("id", html.alias("html"))).select("id", "level")


def s17_upgrade_chain(spark: SparkSession, folder: str) -> DataFrame:
    """For each document of a session, the fetch with the strongest level; of equals the first."""
    rows = items(spark, folder, "session_id", "canonical_id", "evidence_level", "attempt").where("trim(canonical_id) <> ''").withColumn("doc", F.lower(F.trim("canonical_id"))).withColumn("w", U.level_weight(F.col("evidence_level")))
    return best_rows(rows, ["session_id", "doc"], [F.desc("w"), F.asc("attempt"), F.asc("id")]).select("session_id", "doc", "id", "evidence_level")


def s18_liveness(spark: SparkSession, folder: str) -> DataFrame:
    """Of each session's first ten distinct addresses, which are alive (by their items' verification)."""
    rows = items(spark, folder, "session_id", "url", "verified_url").withColumn("address", U.canonical_url(F.col("url"))).where("address <> ''")
    per = rows.groupBy("session_id", "address").agg(F.min("id").alias("first"), F.max(F.coalesce("verified_url", F.lit(0))).alias("alive"))
    return best_rows(per, ["session_id"], [F.asc("first")], 10).select("session_id", "rank_no", "address", (F.col("alive") == 1).alias("alive"))


_URL = f"""u AS (SELECT *, rtrim(trim(coalesce(url, '')), '.,;') AS u FROM items),
q AS (SELECT *, regexp_extract(u, '^([^?#]*)', 1) AS base, list_filter(string_split({S.query_part('u')}, '&'), lambda p: p <> '' AND lower(string_split(p, '=')[1]) NOT IN ('fbclid', 'gclid', 'igshid', 'mc_cid', 'mc_eid', 'srsltid') AND NOT starts_with(lower(string_split(p, '=')[1]), 'utm_')) AS l FROM u),
c AS (SELECT *, CASE WHEN len(l) > 0 THEN base || '?' || array_to_string(l, '&') ELSE base END AS address FROM q)"""
QUERIES = {f.__name__: f for f in (s01_patent_payloads, s04_enrichment, s07_scholarly, s09_inverted_index, s16_page_metadata, s17_upgrade_chain, s18_liveness)}
ORACLE = {
    "s01_patent_payloads": rf"WITH {S.ITEMS}, p AS (SELECT regexp_replace(upper(coalesce(canonical_id, '')), '[^A-Z0-9]', '', 'g') AS publication_number, array_to_string(list_slice(string_split({S.squeezed('summary')}, ' '), 1, 60), ' ') AS snippet FROM items WHERE source_type = 'patent') SELECT publication_number, count(*) AS n, max(length(snippet)) AS longest FROM p WHERE publication_number <> '' GROUP BY ALL",
    "s04_enrichment": f"""
WITH {S.ITEMS}, n AS (SELECT id, url, upper(regexp_replace(coalesce(regexp_replace(trim(canonical_id), '^patent:', ''), ''), '[^A-Za-z0-9]', '', 'g')) AS number FROM items WHERE source_type = 'patent'),
k AS (SELECT number, arg_min(url, id) AS found FROM n WHERE number NOT IN ('', 'UNKNOWN') AND trim(url) <> '' GROUP BY ALL) SELECT n.id, n.number, coalesce(found, '') AS url FROM n LEFT JOIN k USING (number) WHERE number NOT IN ('', 'UNKNOWN') AND coalesce(trim(url), '') = ''""",
    "s07_scholarly": f"WITH {S.ITEMS}, p AS (SELECT lower(canonical_id) AS doi, trim(regexp_replace(summary, '[<>]', '', 'g')) AS a FROM items WHERE source_type = 'publication') SELECT doi, count(*) AS n, min(length(a)) AS shortest FROM p WHERE a <> '' GROUP BY ALL",
    "s09_inverted_index": f"SELECT doc_id, sha256({S.squeezed('text')}) AS text_hash FROM documents",
    "s16_page_metadata": rf"WITH {S.ITEMS}, p AS (SELECT id, regexp_replace(coalesce(title, ''), '[\x22\x27<>]', '', 'g') AS t, regexp_replace(coalesce(summary, ''), '[\x22\x27<>]', '', 'g') AS a FROM items) SELECT id, CASE WHEN a <> '' AND len(regexp_split_to_array(trim(a), '\s+')) >= 12 THEN 'abstract_verified' WHEN t <> '' THEN 'verified_metadata' ELSE 'fetch_failed' END AS level FROM p",
    "s17_upgrade_chain": f"WITH {S.ITEMS}, d AS (SELECT id, session_id, lower(trim(canonical_id)) AS doc, evidence_level, row_number() OVER (PARTITION BY session_id, lower(trim(canonical_id)) ORDER BY {S.level_weight('evidence_level')} DESC, attempt, id) AS r FROM items WHERE trim(canonical_id) <> '') SELECT session_id, doc, id, evidence_level FROM d WHERE r = 1",
    "s18_liveness": f"WITH {S.ITEMS}, {_URL}, g AS (SELECT session_id, address, min(id) AS first, max(coalesce(verified_url, 0)) AS alive FROM c WHERE address <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first) AS rank_no FROM g) SELECT session_id, rank_no, address, alive = 1 AS alive FROM r WHERE rank_no <= 10",
}
