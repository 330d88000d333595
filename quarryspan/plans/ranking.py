"""Queries w01_.. to w10_, d01_.. to d07_, a15_, a23_, a24_, st01_.., k07_: ranks, duplicates, attempts, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryspan import dims
from quarryspan.functions import ids as U
from quarryspan.functions import text as T
from quarryspan.operators import ranking as R
from quarryspan.operators.quality import relevance_label
from quarryspan.plans import sql as S
from quarryspan.plans.views import attempts, decisions, items, sessions

KEY = ["session_id", "source_type"]


def _score():
    """The relevance score; NaN counts as none."""
    return F.when(~F.isnan("relevance_score"), F.col("relevance_score"))


def w01_latest_attempt(spark: SparkSession, folder: str) -> DataFrame:
    rows = attempts(spark, folder, *KEY, "attempt", "status")
    return R.best_rows(rows, KEY, [F.desc("attempt"), F.desc("id")]).select(*KEY, "id", "attempt", "status")


def w02_best_attempt(spark: SparkSession, folder: str) -> DataFrame:
    rows = attempts(spark, folder, *KEY, "attempt", "status", "quality_grade", "hit_count")
    order = [R.case_rank(F.col("quality_grade"), dims.GRADE_RANK).desc(), R.case_rank(F.col("status"), dims.STATUS_RANK).desc(), F.desc_nulls_last("hit_count"), F.desc("attempt"), F.asc("id")]
    return R.best_rows(rows, KEY, order).select(*KEY, "id", "quality_grade", "status")


def w03_best_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """For each session, source and document the best item: verified first, then by score."""
    rows = items(spark, folder, *KEY, "canonical_id", "url", "verified_url", "relevance_score").withColumn("doc", F.coalesce(F.expr("nullif(canonical_id, '')"), F.coalesce("url", F.lit(""))))
    return R.best_rows(rows, [*KEY, "doc"], [F.desc_nulls_last("verified_url"), _score().desc_nulls_last(), F.asc("id")]).select(*KEY, "doc", "id")


def w05_hit_order(spark: SparkSession, folder: str) -> DataFrame:
    """All items of each session and source by relevance label and score, ties in the order of arrival. The tables have no label, so it comes from the score."""
    rows = items(spark, folder, *KEY, "relevance_score")
    return R.hit_order(rows, KEY, relevance_label(F.col("relevance_score")), F.col("relevance_score"), "id")


def w06_web_order(spark: SparkSession, folder: str) -> DataFrame:
    """Web items by score, kind of host, host and address; ten a session."""
    rows = items(spark, folder, *KEY, "url", "relevance_score").where("source_type = 'web' AND url <> ''")
    order = [F.coalesce(_score(), F.lit(0.0)).desc(), U.domain_rank(F.col("url")).asc(), U.host(F.col("url")).asc(), F.asc("url"), F.asc("id")]
    return R.best_rows(rows, ["session_id"], order, 10).select("session_id", "rank_no", "id")


# Weights of publication providers by place in the list.
WEIGHTS = {"scholarnet": 1.0, "bibliofeed": 1.0, "openpaperix": 0.95, "preprintly": 0.90}


def w07_provider_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """Publications by score weighted by provider; twenty a session."""
    rows = items(spark, folder, *KEY, "provider", "relevance_score").where("source_type = 'publication'")
    name = F.lower(F.trim(F.coalesce("provider", F.lit(""))))
    weight = F.lit(0.8)
    for p, w in WEIGHTS.items():
        weight = F.when(name == p, F.lit(w)).otherwise(weight)
    rows = rows.withColumn("weighted", T.rounded(F.coalesce(_score(), F.lit(0.0)) * weight, 4))
    return R.best_rows(rows, ["session_id"], [F.desc("weighted"), F.asc("id")], 20).select("session_id", "rank_no", "id", "weighted")


#: The rule's name, which is part of every message, a seed as an example, and how many of a stratum are taken first.
SAMPLING_RULE, SEED, QUOTA = "stratified_hmac_original_query.v1", "000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f", 30


def w08_stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The queries of each stratum (the source) in the order of a keyed hash of rule, stratum and fingerprint; the first QUOTA are taken, the others in reserve."""
    rows = decisions(spark, folder, "source_type", "query_fingerprint").select("source_type", "query_fingerprint").distinct()
    message = F.to_json(F.array(F.lit(SAMPLING_RULE), "source_type", "query_fingerprint"))
    rows = rows.withColumn("key", R.keyed_hash(bytes.fromhex(SEED), message))
    return R.numbered(rows, ["source_type"], [F.asc("key"), F.asc("query_fingerprint")]).select("source_type", "rank_no", "query_fingerprint", (F.col("rank_no") > QUOTA).alias("reserve"))


def w10_snapshot_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of the results of each session in the order of their creation."""
    rows = attempts(spark, folder, "session_id", "created_at")
    return rows.select("id", "session_id", F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "id")).alias("snapshot_no"))


def a15_attempt_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = attempts(spark, folder, *KEY, "attempt", "warning_count", "error_count")
    return rows.groupBy(*KEY).agg(F.count("*").alias("attempts"), F.max("attempt").alias("last_attempt"), (F.max("attempt") + 1).alias("next_attempt"), F.sum("warning_count").alias("warnings"), F.sum("error_count").alias("errors"))


def patent_keys(rows: DataFrame) -> DataFrame:
    """Patents that have a number or an address, with the keys by which they are the same: the number without its kind code or
    else the address, and a title of twelve characters or more."""
    number = U.family_number(F.regexp_replace("canonical_id", "^patent:", ""))
    number = F.when(number != "", number).otherwise(F.trim(F.coalesce("url", F.lit(""))))
    title = U.title_key(F.col("title"))
    keyed = rows.withColumn("number_key", F.when(number.rlike("[A-Za-z0-9]"), number).otherwise(""))
    return keyed.withColumn("title_key", F.when(F.length(title) >= 12, title).otherwise("")).where("number_key <> ''")


def d01_greedy_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Patents of each session, first wins on number (or address) or title; sequential, so without SQL.

    The reference caps single calls of providers, and the union of these not at all. The tables hold what the calls gave,
    and not which call gave a row, so there is nothing left to cap.
    """
    rows = patent_keys(items(spark, folder, *KEY, "canonical_id", "title", "url").where("source_type = 'patent'"))
    return R.greedy_first(rows, ["session_id"], "id", ["number_key", "title_key"]).select("session_id", "id")


def publication_keys(rows: DataFrame) -> DataFrame:
    """Publications with the keys by which they are the same: the DOI, and the title apart from case and blanks."""
    doi = F.rtrim(F.regexp_extract(F.lower(F.coalesce("canonical_id", F.lit(""))), r"(10\.[0-9]+/\S+)", 1), F.lit(".,;"))
    return rows.withColumn("doi_key", doi).withColumn("title_key", F.lower(T.squeezed(F.col("title"))))


def d02_publication_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Publications of each session, first wins on identifier or title."""
    rows = publication_keys(items(spark, folder, *KEY, "canonical_id", "title").where("source_type = 'publication'"))
    return R.greedy_first(rows, ["session_id"], "id", ["doi_key", "title_key"]).select("session_id", "id")


def d03_first_per_url(spark: SparkSession, folder: str) -> DataFrame:
    """The first accepted item of each session and address; rejected ones don't stand in the way."""
    rows = items(spark, folder, "session_id", "url", "relevance_score").where(_score() >= 5.0).withColumn("address", U.canonical_url(F.col("url"))).where("address <> ''")
    return R.best_rows(rows, ["session_id", "address"], [F.asc("id")]).select("session_id", "address", "id")


def d05_merged_pack(spark: SparkSession, folder: str) -> DataFrame:
    """One row a session with the status of its three sources' best attempts; an absent source counts as failed."""
    best = w02_best_attempt(spark, folder)
    rows = sessions(spark, folder).select("session_id").join(best, "session_id", "left")
    out = rows.groupBy("session_id").agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), F.count("source_type").alias("present"))
    status = F.when(F.col("ok") == 3, "ok").when(F.col("failed") + 3 - F.col("present") == 3, "failed").otherwise("partial_failure")
    return out.select("session_id", "present", (3 - F.col("present")).alias("absent"), status.alias("overall_status"))


def d06_insert_stats(spark: SparkSession, folder: str) -> DataFrame:
    """By session, source and attempt: items inserted (first of their identifier in the attempt), and identifiers known from earlier attempts."""
    rows = items(spark, folder, *KEY, "attempt", "canonical_id").where("trim(canonical_id) <> ''").withColumn("doc", F.lower(F.trim("canonical_id")))
    per = rows.groupBy(*KEY, "attempt", "doc").agg(F.count("*").alias("n"))
    first = F.min("attempt").over(Window.partitionBy(*KEY, "doc"))
    per = per.withColumn("known", first < F.col("attempt"))
    return per.groupBy(*KEY, "attempt").agg(F.count("*").alias("inserted"), F.sum(F.col("n") - 1).alias("skipped"), F.count_if("known").alias("known_before"))


def d07_providers_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """Providers of each session and source, in the order in which they first appear."""
    rows = items(spark, folder, *KEY, "provider").withColumn("name", F.lower(F.trim("provider"))).where("name <> ''")
    first = rows.groupBy(*KEY, "name").agg(F.min("id").alias("at"))
    return first.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), ",").alias("providers"))


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder, *KEY, "relevance_score", "verified_url").withColumn("score", F.coalesce(_score(), F.lit(0.0)))


def a23_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall, F1, P@k, average precision and reciprocal rank of each pool; verified items are the relevant ones."""
    rows = _judged(spark, folder)
    out = R.average_precision(rows, KEY, F.col("score"), F.coalesce(F.col("verified_url"), F.lit(0)) == 1, F.col("score") >= 3.0, "id")
    return out.select(*KEY, "n", "relevant", "accepted", *[T.rounded(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1", "p_at_k", "ap", "rr")])


def e07_metric_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The metrics of each pool as a line of a report."""
    two = lambda c: F.format_string("%.2f", T.rounded(F.col(c)))
    parts = [F.concat(F.lit(f"{name}="), two(c)) for name, c in (("precision", "precision"), ("recall", "recall"), ("F1", "f1"), ("P@k", "p_at_k"), ("AP", "ap"), ("RR", "rr"))]
    head = F.concat(F.lit("["), F.col("session_id"), F.lit(" "), F.col("source_type"), F.lit("] accepted "), F.col("accepted").cast("string"), F.lit(" of "), F.col("n").cast("string"))
    return a23_metrics(spark, folder).select(*KEY, F.concat_ws("  ", head, *parts).alias("line"))


def a24_threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Macro means of precision, recall and F1 at each of seven thresholds, from one count a pool."""
    rows = _judged(spark, folder).withColumn("rel", F.coalesce(F.col("verified_url"), F.lit(0)))
    counts = [F.struct(F.lit(t).alias("threshold"), F.count_if(F.col("score") >= t).alias("acc"), F.count_if((F.col("score") >= t) & (F.col("rel") == 1)).alias("hit")) for t in dims.SWEEP]
    per = rows.groupBy(*KEY).agg(F.sum("rel").alias("rel"), F.array(*counts).alias("x")).select("rel", F.explode("x").alias("x")).select("rel", "x.*")
    p, r = F.coalesce(F.expr("try_divide(hit, acc)"), F.lit(0.0)), F.coalesce(F.expr("try_divide(hit, rel)"), F.lit(0.0))
    per = per.withColumn("p", p).withColumn("r", r).withColumn("f", F.coalesce(F.expr("try_divide(2 * p * r, p + r)"), F.lit(0.0)))
    return per.groupBy("threshold").agg(*[T.rounded(F.avg(a), 6).alias(b) for a, b in (("p", "precision"), ("r", "recall"), ("f", "f1"))])


def a25_provider_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Items by provider, and each provider's share of its source; dominant above 0.7."""
    rows = items(spark, folder, "source_type", "provider").withColumn("name", F.coalesce(F.lower(F.trim("provider")), F.lit("")))
    out = rows.groupBy("source_type", "name").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("source_type"))
    return out.select("source_type", "name", "n", T.rounded(share, 6).alias("share"), (share > 0.7).alias("dominant"))


def st01_ttl_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Requests that a cache of 300 seconds for each source answers: an entry keeps the time at which it was stored."""
    rows = attempts(spark, folder, "source_type", "query_hash", "created_at")
    return R.cache_hits(rows, ["source_type"], "query_hash", "created_at", "id", 300).groupBy("source_type", "cached").agg(F.count("*").alias("n"))


def st01_bounded_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The same with room for 64 entries; what is used longest ago goes first, which SQL can't express."""
    rows = attempts(spark, folder, "source_type", "query_hash", "created_at")
    return R.cache_hits(rows, ["source_type"], "query_hash", "created_at", "id", 300, 64).groupBy("source_type", "cached").agg(F.count("*").alias("n"))


def st03_sessions_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """For each session of the results: its first query that is not blank, and its last time."""
    rows = attempts(spark, folder, "session_id", "query", "created_at")
    at = F.struct("created_at", "id")
    return rows.groupBy("session_id").agg(F.min_by("query", F.when(F.trim("query") != "", at)).alias("first_query"), F.count("*").alias("n"))


def st06_decision_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions by stage and reason, with how many were kept."""
    rows = decisions(spark, folder, "decision_stage", "decision_reason", "retained", "score_at_decision")
    return rows.groupBy("decision_stage", "decision_reason").agg(F.count("*").alias("n"), F.coalesce(F.sum("retained"), F.lit(0)).alias("kept"), F.count(F.when(F.col("score_at_decision").isNotNull() & ~F.isnan("score_at_decision"), 1)).alias("with_score"))


_A = "a AS (SELECT DISTINCT * FROM evidence_results)"
_J = f"{S.ITEMS}, j AS (SELECT id, session_id, source_type, coalesce(CASE WHEN isnan(relevance_score) THEN NULL ELSE relevance_score END, 0.0) AS score, coalesce(verified_url, 0) AS rel FROM items)"
_R = "CASE WHEN isnan(relevance_score) THEN NULL ELSE relevance_score END"


def _rank(x: str, ranks: dict[str, int]) -> str:
    return f"CASE lower(trim(coalesce({x}, ''))) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ranks.items()) + " ELSE -1 END"


_BEST = f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, source_type ORDER BY {_rank('quality_grade', dims.GRADE_RANK)} DESC, {_rank('status', dims.STATUS_RANK)} DESC, hit_count DESC NULLS LAST, attempt DESC, id) AS r FROM a) WHERE r = 1)"
_HOST_RANK = f"CASE WHEN h IN ({S.quoted(dims.PATENT_HOSTS)}) OR ends_with(h, '.patents.google.com') THEN 3 WHEN ends_with(h, '.gov') OR ends_with(h, '.edu') THEN 0 WHEN contains(h, 'docs.') OR contains(h, 'developer.') OR contains(h, 'support.') OR contains(h, 'github.io') THEN 1 ELSE 2 END"

QUERIES = {f.__name__: f for f in (w01_latest_attempt, w02_best_attempt, w03_best_evidence, w05_hit_order, w06_web_order, w07_provider_weighted, w08_stratified_sample, w10_snapshot_numbers, a15_attempt_stats, d01_greedy_dedupe, d02_publication_dedupe, d03_first_per_url, d05_merged_pack, d06_insert_stats, d07_providers_in_order, a23_metrics, e07_metric_lines, a24_threshold_sweep, a25_provider_shares, st01_ttl_cache, st01_bounded_cache, st03_sessions_upsert, st06_decision_counts)}
ORACLE = {
    "w01_latest_attempt": f"WITH {_A} SELECT session_id, source_type, id, attempt, status FROM (SELECT *, row_number() OVER (PARTITION BY session_id, source_type ORDER BY attempt DESC, id DESC) AS r FROM a) WHERE r = 1",
    "w02_best_attempt": f"WITH {_A}, {_BEST} SELECT session_id, source_type, id, quality_grade, status FROM best",
    "w03_best_evidence": f"WITH {S.ITEMS}, d AS (SELECT *, coalesce(nullif(canonical_id, ''), coalesce(url, '')) AS doc FROM items) SELECT session_id, source_type, doc, id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, source_type, doc ORDER BY verified_url DESC NULLS LAST, {_R} DESC NULLS LAST, id) AS r FROM d) WHERE r = 1",
    "w05_hit_order": f"""
WITH {S.ITEMS}, h AS (SELECT session_id, source_type, id, {_R} AS s FROM items)
SELECT session_id, source_type, id, row_number() OVER (PARTITION BY session_id, source_type ORDER BY CASE WHEN s >= 7 THEN 3 WHEN s >= 3 THEN 2 ELSE 1 END DESC, coalesce(s, 0) DESC, id) AS rank_no FROM h""",
    "w06_web_order": f"WITH {S.ITEMS}, u AS (SELECT *, {S.host('url')} AS h FROM items WHERE source_type = 'web' AND url <> '') SELECT session_id, rank_no, id FROM (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY coalesce({_R}, 0) DESC, {_HOST_RANK}, h, url, id) AS rank_no FROM u) WHERE rank_no <= 10",
    "w07_provider_weighted": f"WITH {S.ITEMS}, p AS (SELECT session_id, id, round_even(coalesce({_R}, 0.0) * CASE lower(trim(coalesce(provider, ''))) " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS.items()) + " ELSE 0.8::DOUBLE END, 4) AS weighted FROM items WHERE source_type = 'publication') SELECT session_id, rank_no, id, weighted FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY weighted DESC, id) AS rank_no FROM p) WHERE rank_no <= 20",
    "w08_stratified_sample": f"""
WITH q AS (SELECT DISTINCT source_type, query_fingerprint FROM evaluation_candidate_decisions),
k AS (SELECT *, {S.keyed_hash(SEED, f"to_json(['{SAMPLING_RULE}', source_type, query_fingerprint])::VARCHAR")} AS key FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY key, query_fingerprint) AS rank_no FROM k)
SELECT source_type, rank_no, query_fingerprint, rank_no > {QUOTA} AS reserve FROM r""",
    "w10_snapshot_numbers": f"WITH {_A} SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS snapshot_no FROM a",
    "a15_attempt_stats": f"WITH {_A} SELECT session_id, source_type, count(*) AS attempts, max(attempt) AS last_attempt, max(attempt) + 1 AS next_attempt, sum(warning_count)::BIGINT AS warnings, sum(error_count)::BIGINT AS errors FROM a GROUP BY ALL",
    "d03_first_per_url": rf"""
WITH {S.ITEMS}, u AS (SELECT *, rtrim(trim(coalesce(url, '')), '.,;') AS u FROM items WHERE {_R} >= 5.0),
q AS (SELECT *, regexp_extract(u, '^([^?#]*)', 1) AS base, list_filter(string_split({S.query_part('u')}, '&'), lambda p: p <> '' AND lower(string_split(p, '=')[1]) NOT IN ({S.quoted(dims.URL_TRACKING)}) AND NOT starts_with(lower(string_split(p, '=')[1]), 'utm_')) AS l FROM u),
c AS (SELECT session_id, id, CASE WHEN len(l) > 0 THEN base || '?' || array_to_string(l, '&') ELSE base END AS address FROM q)
SELECT session_id, address, min(id) AS id FROM c WHERE address <> '' GROUP BY ALL""",
    "d05_merged_pack": f"""
WITH {_A}, {_BEST}, o AS (SELECT s.session_id, count(*) FILTER (b.status = 'ok') AS ok, count(*) FILTER (b.status = 'failed') AS failed, count(b.source_type) AS present FROM research_sessions s LEFT JOIN best b USING (session_id) GROUP BY ALL)
SELECT session_id, present, 3 - present AS absent, CASE WHEN ok = 3 THEN 'ok' WHEN failed + 3 - present = 3 THEN 'failed' ELSE 'partial_failure' END AS overall_status FROM o""",
    "d06_insert_stats": f"""
WITH {S.ITEMS}, p AS (SELECT session_id, source_type, attempt, lower(trim(canonical_id)) AS doc, count(*) AS n FROM items WHERE trim(canonical_id) <> '' GROUP BY ALL),
k AS (SELECT *, min(attempt) OVER (PARTITION BY session_id, source_type, doc) < attempt AS known FROM p)
SELECT session_id, source_type, attempt, count(*) AS inserted, sum(n - 1)::BIGINT AS skipped, count(*) FILTER (known) AS known_before FROM k GROUP BY ALL""",
    "d07_providers_in_order": f"WITH {S.ITEMS}, f AS (SELECT session_id, source_type, lower(trim(provider)) AS name, min(id) AS pos FROM items WHERE trim(provider) <> '' GROUP BY ALL) SELECT session_id, source_type, string_agg(name, ',' ORDER BY pos, name) AS providers FROM f GROUP BY ALL",
    "a23_metrics": f"""
WITH {_J}, r AS (SELECT *, (score >= 3.0)::INT AS acc, row_number() OVER w AS i, sum(rel) OVER (w ROWS UNBOUNDED PRECEDING) AS hits, sum(rel) OVER (PARTITION BY session_id, source_type) AS k FROM j WINDOW w AS (PARTITION BY session_id, source_type ORDER BY score DESC, id)),
g AS (SELECT session_id, source_type, count(*) AS n, sum(rel)::BIGINT AS relevant, sum(acc)::BIGINT AS accepted, sum(rel * acc) AS hit, sum(CASE WHEN i <= k THEN rel ELSE 0 END) AS top, sum(CASE WHEN rel = 1 THEN hits / i END) AS ps, min(CASE WHEN rel = 1 THEN i END) AS first FROM r GROUP BY ALL),
m AS (SELECT *, coalesce(hit / nullif(accepted, 0), 0) AS p, coalesce(hit / nullif(relevant, 0), 0) AS c FROM g)
SELECT session_id, source_type, n, relevant, accepted, round_even(p, 6) AS precision, round_even(c, 6) AS recall, round_even(coalesce(2 * p * c / nullif(p + c, 0), 0), 6) AS f1,
  round_even(coalesce(top / nullif(relevant, 0), 0), 6) AS p_at_k, round_even(coalesce(ps / nullif(relevant, 0), 0), 6) AS ap, round_even(coalesce(1.0::DOUBLE / first, 0), 6) AS rr FROM m""",
    "a24_threshold_sweep": f"""
WITH {_J}, t AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in dims.SWEEP)}]) AS threshold),
g AS (SELECT threshold, session_id, source_type, sum(rel) AS rel, count(*) FILTER (score >= threshold) AS acc, count(*) FILTER (score >= threshold AND rel = 1) AS hit FROM j, t GROUP BY ALL),
m AS (SELECT threshold, coalesce(hit / nullif(acc, 0), 0) AS p, coalesce(hit / nullif(rel, 0), 0) AS r FROM g)
SELECT threshold, round_even(avg(p), 6) AS precision, round_even(avg(r), 6) AS recall, round_even(avg(coalesce(2 * p * r / nullif(p + r, 0), 0)), 6) AS f1 FROM m GROUP BY ALL""",
    "a25_provider_shares": f"WITH {S.ITEMS}, g AS (SELECT source_type, coalesce(lower(trim(provider)), '') AS name, count(*) AS n FROM items GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY source_type) AS share FROM g) SELECT source_type, name, n, round_even(share, 6) AS share, share > 0.7 AS dominant FROM s",
    "st01_ttl_cache": f"""
WITH RECURSIVE {_A}, o AS (SELECT source_type, query_hash, id, epoch_us(created_at) AS t, row_number() OVER (PARTITION BY source_type, query_hash ORDER BY created_at, id) AS i FROM a),
r AS (SELECT source_type, query_hash, i, t AS stored, false AS cached FROM o WHERE i = 1
  UNION ALL SELECT o.source_type, o.query_hash, o.i, CASE WHEN o.t - r.stored <= 300000000 THEN r.stored ELSE o.t END, o.t - r.stored <= 300000000 FROM r JOIN o ON o.source_type = r.source_type AND o.query_hash = r.query_hash AND o.i = r.i + 1)
SELECT source_type, cached, count(*) AS n FROM r GROUP BY ALL""",
    "st03_sessions_upsert": f"WITH {_A}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN trim(query) <> '' THEN 0 ELSE 1 END, created_at, id) AS i FROM a) SELECT session_id, max(CASE WHEN i = 1 AND trim(query) <> '' THEN query END) AS first_query, count(*) AS n FROM r GROUP BY ALL",
    "st06_decision_counts": "WITH d AS (SELECT DISTINCT * FROM evaluation_candidate_decisions) SELECT decision_stage, decision_reason, count(*) AS n, coalesce(sum(retained), 0)::BIGINT AS kept, count(*) FILTER (score_at_decision IS NOT NULL AND NOT isnan(score_at_decision)) AS with_score FROM d GROUP BY ALL",
}

_TWO = lambda c: f"printf('%.2f', round_even({c}, 2))"
ORACLE["e07_metric_lines"] = f"SELECT session_id, source_type, concat_ws('  ', '[' || session_id || ' ' || source_type || '] accepted ' || accepted || ' of ' || n, 'precision=' || {_TWO('precision')}, 'recall=' || {_TWO('recall')}, 'F1=' || {_TWO('f1')}, 'P@k=' || {_TWO('p_at_k')}, 'AP=' || {_TWO('ap')}, 'RR=' || {_TWO('rr')}) AS line FROM ({ORACLE['a23_metrics']})"
