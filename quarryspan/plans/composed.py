"""Queries q07_, q08_, d09_, s05_, s19_ to s22_: phrases and requirements of queries, unions of providers, sealed and appended tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryspan import dims
from quarryspan.functions import decompose as D
from quarryspan.functions import ids as U
from quarryspan.functions import structured as X
from quarryspan.functions import text as T
from quarryspan.operators import ranking as R
from quarryspan.plans import identity as Q
from quarryspan.plans import sql as S
from quarryspan.plans.ranking import publication_keys
from quarryspan.plans.views import items, pool, sessions
from quarryspan.session import checkpoint_dir
from quarryspan.sources import snapshots

def q07_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The phrases of each query in order, and whether each has a verb of its own; depends on the parts before, so without SQL."""
    rows = sessions(spark, folder, "original_query")
    return rows.select("session_id", F.posexplode(D.phrases_column(F.col("original_query"))).alias("pos", "p")).select("session_id", "pos", "p.phrase", "p.clause")


def q08_requirements(spark: SparkSession, folder: str) -> DataFrame:
    """The requirements of each query in order: kind, label, terms, and whether they are too many for a search of their own."""
    rows = sessions(spark, folder, "original_query")
    return rows.select("session_id", F.posexplode(D.requirements_column(F.col("original_query"))).alias("pos", "a")).select("session_id", "pos", "a.category", "a.label", F.array_join("a.terms", " ").alias("terms"), "a.too_broad")


def q12_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """The whole description of each query: its form and language, terms, facets, requirements, synonyms, variants by source, and whether it is too generic."""
    clean = F.regexp_replace(T.squeezed(F.col("original_query")), r"(?i)^(?:query|question|input)\s*:\s*", "")
    rows = sessions(spark, folder, "original_query").select("session_id", clean.alias("original_query")).withColumn("query", Q.without_framing(F.col("original_query")))
    telling = F.array_sort(T.discriminative(T.tokens(F.col("query"))))
    rows = rows.withColumn("u", D.understood_column(F.col("query"))).withColumn("telling", telling)
    # two small lists a session
    named = Q.synonyms(rows).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rank_no", "replacement")))["replacement"].alias("synonyms"))
    more = Q.synonym_variants(rows).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rank_no", "variant")))["variant"].alias("more"))
    none = F.array().cast("array<string>")
    rows = rows.join(named, "session_id", "left").join(more, "session_id", "left").withColumn("more", F.coalesce("more", none))
    several = lambda *lists, n: F.slice(F.array_distinct(F.filter(F.concat(*lists), lambda v: v != "")), 1, n)
    searched = several(F.slice("u.base_variants", 1, 3), F.col("more"), n=5)
    generic = (F.size("u.critical_requirements_atomic") == 0) & (F.size(F.array_except("telling", F.array(*map(F.lit, [*dims.GENERIC_NOUNS, *dims.PHRASE_FILLER])))) == 0)
    language = F.when(F.col("original_query").rlike(r"[^\x00-\x7f]"), "non_english").otherwise("en")
    facets = ("key_terms", "core_subject", "function", "mechanism_or_principle", "critical_requirements", "critical_requirements_atomic", "negative_requirements")
    return rows.select("session_id", "original_query", X.query_form(F.col("original_query")).alias("normalized_query"), language.alias("language"), F.col("query").alias("understanding_query"), F.slice("telling", 1, 20).alias("discriminative_terms"), *[F.col(f"u.{f}").alias(f) for f in facets], F.coalesce("synonyms", none).alias("synonyms"), searched.alias("patent_variants"), searched.alias("publication_variants"), several(F.col("u.web_variants"), F.col("more"), n=7).alias("web_variants"), generic.alias("query_too_generic"))


def f10_generic_queries(spark: SparkSession, folder: str) -> DataFrame:
    """For each source of a session whose envelope says that its query is too generic: the result without a search, ok and reliably none."""
    flag = F.get_json_object("query_envelope_json", "$.query_too_generic") == "true"
    rows = sessions(spark, folder, "query_envelope_json").where(flag).select("session_id", F.explode(F.array(F.lit("patent"), F.lit("publication"), F.lit("web"))).alias("source_type"))
    return rows.select("session_id", "source_type", F.lit("ok").alias("status"), F.lit(True).alias("completed"), F.lit(True).alias("reliable_no_results"))


PROVIDERS = ["scholarnet", "bibliofeed", "openpaperix", "preprintly"]


def d09_publication_search(spark: SparkSession, folder: str) -> DataFrame:
    """Publications of all providers in their fixed order, the first of each identifier or title, by weighted score; sequential, so without SQL."""
    from quarryspan.operators import scoring as O

    rows = pool(spark, folder, "evidence_level", "canonical_id", "provider").where("source_type = 'publication'")
    name = F.lower(F.trim(F.coalesce("provider", F.lit(""))))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PROVIDERS)), name), F.lit(0)), F.lit(len(PROVIDERS) + 1))
    keys = publication_keys(rows).withColumn("at", place * F.lit(1_000_000_000_000) + F.col("id"))
    kept = R.greedy_first(keys, ["session_id"], "at", ["doi_key", "title_key"]).select("session_id", F.expr("at % 1000000000000").alias("id"))
    scores = O.gates(O.scored(rows.join(kept, ["session_id", "id"], "left_semi"))).where("reason = 'accepted'")
    return R.best_rows(scores, ["session_id"], [F.desc("score"), F.asc("id")], 20).select("session_id", "rank_no", "id", "score")


def s05_web_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Web results as (address, title, snippet): canonical address, policy applied, a note for a blank snippet."""
    rows = items(spark, folder, "source_type", "url", "title", "summary").where("source_type = 'web'")
    rows = rows.where(U.keep_web(F.col("url"), F.col("title")))
    snippet = F.when(T.squeezed(F.col("summary")) == "", "No snippet was returned.").otherwise(T.squeezed(F.col("summary")))
    return rows.select("id", U.canonical_url(F.col("url")).alias("address"), snippet.alias("snippet"))


def _place(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"


def s19_gold_set(spark: SparkSession, folder: str) -> DataFrame:
    """Items written as a gold set in JSON (verified ones relevant) and read back; a query with many candidates is several objects."""
    rows = pool(spark, folder, "verified_url").where("source_type = 'publication'")
    parts = rows.groupBy("session_id").agg(F.count("*").alias("n")).select("session_id", F.ceil(F.col("n") / 200).alias("parts"))
    candidate = F.struct(F.coalesce("verified_url", F.lit(0)).alias("label"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("summary", F.lit("")).alias("text"))
    sets = rows.join(parts, "session_id").groupBy("session_id", "query", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")).agg(F.collect_list(candidate).alias("candidates"))
    gold = sets.select(F.array(F.struct(F.col("session_id").alias("id"), "query", F.lit("publication").alias("source_type"), "candidates")).alias("queries"))
    path = _place(spark)
    snapshots.write_once(gold, path, "json")
    return snapshots.read_gold(spark, path, lines=True).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("label").alias("relevant"))


def s20_sealed_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions written once, sealed by their digest, and read back under it."""
    from quarryspan.plans.views import decisions

    rows, path = decisions(spark, folder, "decision_stage", "retained"), _place(spark)
    snapshots.write_once(rows, path)
    sealed = snapshots.read_snapshot(spark, path, snapshots.digest(rows), ["id", "decision_stage", "retained"])
    return sealed.groupBy("decision_stage").agg(F.count("*").alias("n"), F.count("retained").alias("judged"))


def s21_event_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Items appended in two parts to a table partitioned by source, one partition of it read back."""
    rows, path = items(spark, folder, "source_type", "attempt"), _place(spark)
    snapshots.append_events(rows.where("attempt = 1"), path)
    snapshots.append_events(rows.where("attempt <> 1"), path)
    return spark.read.parquet(path).where("source_type = 'patent'").groupBy("attempt").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (q07_phrases, q08_requirements, q12_envelopes, f10_generic_queries, d09_publication_search, s05_web_rows, s19_gold_set, s20_sealed_snapshot, s21_event_sink)}
ORACLE = {
    "s05_web_rows": f"""
WITH k AS ({Q.ORACLE['u03_url_policy']}), c AS ({Q.ORACLE['u01_canonical_url']}), {S.ITEMS}
SELECT i.id, c.canonical_url AS address, CASE WHEN {S.squeezed('summary')} = '' THEN 'No snippet was returned.' ELSE {S.squeezed('summary')} END AS snippet
FROM items i JOIN k ON k.id = i.id JOIN c ON c.id = i.id WHERE source_type = 'web' AND k.kept""",
    "f10_generic_queries": "SELECT session_id, source_type, 'ok' AS status, true AS completed, true AS reliable_no_results FROM research_sessions, (SELECT unnest(['patent', 'publication', 'web']) AS source_type) WHERE (try_cast(nullif(trim(query_envelope_json), '') AS JSON) ->> '$.query_too_generic') = 'true'",
    "s19_gold_set": f"WITH {S.POOL} SELECT p.session_id AS query_id, count(*) AS n, sum(coalesce(i.verified_url, 0))::BIGINT AS relevant FROM pool p JOIN items i USING (id) WHERE p.source_type = 'publication' GROUP BY ALL",
    "s20_sealed_snapshot": "WITH d AS (SELECT DISTINCT * FROM evaluation_candidate_decisions) SELECT decision_stage, count(*) AS n, count(retained) AS judged FROM d GROUP BY ALL",
    "s21_event_sink": f"WITH {S.ITEMS} SELECT attempt, count(*) AS n FROM items WHERE source_type = 'patent' GROUP BY ALL",
}
