"""Queries d08_, f06_, f11_, a17_, w09_, t09_, t13_, t19_, u10_, u15_, u17_, st08_: further operators over items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryspan import dims
from quarryspan.functions import ids as U
from quarryspan.functions import text as T
from quarryspan.operators import ranking as R
from quarryspan.operators import scoring as O
from quarryspan.plans import sql as S
from quarryspan.plans.ranking import patent_keys
from quarryspan.plans.scoring import _SC
from quarryspan.plans.views import attempts, decisions, items, pool

BANNED = ["javascript:", "void(0)", "cookie", "privacy policy", "terms of service", "all rights reserved"]


def t09_clean_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by line, without lines of one word that are no label, and lines with phrases of page furniture."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: T.squeezed(x))
    label = lambda x: x.rlike(r"^[A-Z][A-Z0-9_ -]{1,48}:")
    low = lambda x: F.lower(x)
    bad = lambda x: F.exists(F.array(*map(F.lit, BANNED)), lambda b: F.contains(low(x), b))
    kept = F.filter(lines, lambda x: (x == "") | ((F.contains(x, F.lit(" ")) | label(x)) & ~bad(x)))
    from quarryspan.plans.views import benchmark

    return benchmark(spark, folder).select("doc_id", F.btrim(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"), F.lit("\n ")).alias("body"))


def t13_first_match(spark: SparkSession, folder: str) -> DataFrame:
    """The first of several patterns that a text has: a figure, a claim or a type; Unknown without any."""
    found = [F.nullif(F.regexp_extract(F.coalesce("summary", F.lit("")), p, 1), F.lit("")) for p in (r"(?i)\bclaim ([0-9]+)", r"(?i)\bfig\. ([0-9]+)", r"\btype ([A-Z]{2}-[0-9]+)")]
    return items(spark, folder, "summary").select("id", F.coalesce(*found, F.lit("Unknown")).alias("found"))


def t19_sanitized(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries of at most 120 characters: cut at the last sentence beyond 60 %, else at the last word."""
    s = T.squeezed(F.col("summary"))
    head = F.left(s, F.lit(120))
    stop = F.length(F.regexp_extract(head, r"^(.*[.!?])(?:\s.*)?$", 1))
    word = F.regexp_extract(head, r"^(.*) \S*$", 1)
    out = F.when(F.length(s) <= 120, s).when(stop >= 72, F.left(head, stop)).when(word != "", word).otherwise(head)
    return items(spark, folder, "summary").select("id", out.alias("summary"))


def u10_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The section of each document under its heading of background, up to the next blank line."""
    from quarryspan.plans.views import benchmark

    section = F.regexp_extract(F.coalesce("text", F.lit("")), r"(?:^|\n)(?:Background|Prior art)\n+([^\n]+)", 1)
    return benchmark(spark, folder).select("doc_id", F.when(F.size(T.word_list(section)) >= 20, F.sha2(section, 256)).otherwise("").alias("section"))


def u15_doi_from_url(spark: SparkSession, folder: str) -> DataFrame:
    """DOIs of addresses that hold one."""
    found = F.regexp_extract(F.lower(F.coalesce("canonical_id", F.lit(""))), r"(?:^|doi\.[a-z.]+/|doi:\s*)(10\.[0-9]{4,9}/[^\s?#]+)", 1)
    return items(spark, folder, "canonical_id").where(found != "").select("id", F.rtrim(found, F.lit(".,;")).alias("doi"))


def u17_reconciled(spark: SparkSession, folder: str) -> DataFrame:
    """Patents with the number of their address, if it has one, before their own."""
    own = U.exact_number(F.regexp_replace(F.trim("canonical_id"), "^patent:", ""))
    address = F.upper(F.regexp_extract(F.coalesce("url", F.lit("")), r"/patent/([A-Za-z]{2}[0-9]{4,}[A-Za-z0-9]*)", 1))
    return items(spark, folder, "source_type", "canonical_id", "url").where("source_type = 'patent'").select("id", F.when(address != "", address).otherwise(own).alias("number"))


def f06_keep_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Web items that have a term of their query as a word, and enough terms: three of six, two of three, else one."""
    rows = pool(spark, folder).where("source_type = 'web'")
    terms = T.web_terms(F.col("query"))
    n = F.size(terms)
    need = F.when(n >= 6, 3).when(n >= 3, 2).when(n >= 1, 1).otherwise(0)
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9][a-z0-9-]*"), F.lit(0))
    return rows.select("id", ((n == 0) | (F.arrays_overlap(terms, words) & (T.substring_coverage(terms, F.col("text")) >= need))).alias("kept"))


def f11_failed_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts whose text says that they failed."""
    said = F.lower(F.concat_ws(" ", "status", "error_type"))
    return attempts(spark, folder, "status", "error_type").groupBy(said.rlike(r"\b(?:failed|timeout|error)\b|_error\b").alias("looks_failed")).agg(F.count("*").alias("n"))


def patent_labels(scores: DataFrame) -> DataFrame:
    """(id, label) of scored patents: focused, adjacent or generic, by the share of the query that they cover."""
    share = F.expr("try_divide(shared, nq)")
    verified = F.col("evidence_level").isin(*dims.STRONG)
    label = F.when((F.col("na") > 0) & (F.col("anchor") == 0), "generic").when((share >= 0.55) | (verified & (share >= 0.30) & (F.col("shared") >= 4)), "focused").when(F.col("shared") > 0, "adjacent").otherwise("generic")
    return scores.select("id", label.alias("label"))


def a17_relevance_labels(spark: SparkSession, folder: str) -> DataFrame:
    """focused, adjacent or generic for patents, by the share of the query that they cover."""
    return patent_labels(O.scored(pool(spark, folder, "evidence_level")).where("source_type = 'patent' AND nq > 0"))


def d08_patent_search(spark: SparkSession, folder: str) -> DataFrame:
    """The whole search over patents: all providers' rows in order, duplicates out, scored, off topic out, tiers, ten best."""
    rows = pool(spark, folder, "evidence_level", "canonical_id", "url").where("source_type = 'patent'")
    kept = R.greedy_first(patent_keys(rows), ["session_id"], "id", ["number_key", "title_key"]).select("session_id", "id")
    scores = O.tiered(O.scored(rows.join(kept, ["session_id", "id"], "left_semi")).where(O.on_topic()), ["session_id"], floor=True)
    return R.best_rows(scores, ["session_id"], [F.desc("score"), F.asc("id")], 10).select("session_id", "rank_no", "id", "score")


#: A seed as an example; a real one is a secret.
BLIND_SEED = "ffeeddccbbaa99887766554433221100ffeeddccbbaa99887766554433221100"


def w09_blinded_representatives(spark: SparkSession, folder: str) -> DataFrame:
    """For each candidate of a session and source the first decision (attempt, then id), under a keyed hash in place of its identity."""
    rows = decisions(spark, folder, "session_id", "source_type", "candidate_identity", "attempt").where("candidate_identity <> ''")
    first = rows.groupBy("session_id", "source_type", "candidate_identity").agg(F.min(F.struct("attempt", "id"))["id"].alias("id"))
    return first.select("id", R.keyed_hash(bytes.fromhex(BLIND_SEED), F.to_json(F.array("session_id", "source_type", "candidate_identity"))).alias("blind"))


def st08_answer_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Answers that need not be made again: results whose input has the hash of an earlier one of the session and source."""
    rows = attempts(spark, folder, "session_id", "source_type", "query_hash", "evidence_json")
    from pyspark.sql.window import Window

    key = F.sha2(F.concat_ws("|", "query_hash", "evidence_json"), 256)
    rank = F.row_number().over(Window.partitionBy("session_id", "source_type", "h").orderBy("id"))
    return rows.withColumn("h", key).withColumn("r", rank).groupBy("source_type", (F.col("r") > 1).alias("from_cache")).agg(F.count("*").alias("n"))


_A = "a AS (SELECT DISTINCT * FROM evidence_results)"
_BAD = " OR ".join(f"contains(lower(x), '{b}')" for b in BANNED)
_WEB = f"list_filter(list_distinct(regexp_extract_all(lower(coalesce(query, '')), '[a-z0-9][a-z0-9-]{{3,}}')), lambda t: t NOT IN ({S.quoted(dims.WEB_STOPWORDS)}))"
QUERIES = {f.__name__: f for f in (t09_clean_lines, t13_first_match, t19_sanitized, u10_sections, u15_doi_from_url, u17_reconciled, f06_keep_hits, f11_failed_attempts, a17_relevance_labels, d08_patent_search, w09_blinded_representatives, st08_answer_cache)}
ORACLE = {
    "t09_clean_lines": rf"""
WITH l AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {S.squeezed('x')}) AS l FROM documents)
SELECT doc_id, trim(regexp_replace(array_to_string(list_filter(l, lambda x: x = '' OR ((contains(x, ' ') OR regexp_matches(x, '^[A-Z][A-Z0-9_ -]{{1,48}}:')) AND NOT ({_BAD}))), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || ' ') AS body FROM l""",
    "t13_first_match": rf"WITH {S.ITEMS} SELECT id, coalesce(nullif(regexp_extract(coalesce(summary, ''), '\bclaim ([0-9]+)', 1, 'i'), ''), nullif(regexp_extract(coalesce(summary, ''), '\bfig\. ([0-9]+)', 1, 'i'), ''), nullif(regexp_extract(coalesce(summary, ''), '\btype ([A-Z]{{2}}-[0-9]+)', 1), ''), 'Unknown') AS found FROM items",
    "t19_sanitized": rf"""
WITH {S.ITEMS}, s AS (SELECT id, {S.squeezed('summary')} AS s FROM items), h AS (SELECT *, left(s, 120) AS h FROM s), p AS (SELECT *, length(regexp_extract(h, '^(.*[.!?])(?:\s.*)?$', 1)) AS stop, regexp_extract(h, '^(.*) \S*$', 1) AS word FROM h)
SELECT id, CASE WHEN length(s) <= 120 THEN s WHEN stop >= 72 THEN left(h, stop) WHEN word <> '' THEN word ELSE h END AS summary FROM p""",
    "u10_sections": rf"WITH x AS (SELECT doc_id, regexp_extract(coalesce(text, ''), '(?:^|\n)(?:Background|Prior art)\n+([^\n]+)', 1) AS s FROM documents) SELECT doc_id, CASE WHEN len({S.words('s')}) >= 20 THEN sha256(s) ELSE '' END AS section FROM x",
    "u15_doi_from_url": rf"WITH {S.ITEMS}, d AS (SELECT id, regexp_extract(lower(coalesce(canonical_id, '')), '(?:^|doi\.[a-z.]+/|doi:\s*)(10\.[0-9]{{4,9}}/[^\s?#]+)', 1) AS d FROM items) SELECT id, rtrim(d, '.,;') AS doi FROM d WHERE d <> ''",
    "u17_reconciled": f"""
WITH {S.ITEMS}, n AS (SELECT id, upper(regexp_extract(coalesce(url, ''), '/patent/([A-Za-z]{{2}}[0-9]{{4,}}[A-Za-z0-9]*)', 1)) AS u, upper(regexp_replace(coalesce(regexp_replace(trim(canonical_id), '^patent:', ''), ''), '[^A-Za-z0-9]', '', 'g')) AS o FROM items WHERE source_type = 'patent')
SELECT id, CASE WHEN u <> '' THEN u WHEN o = 'UNKNOWN' THEN '' ELSE o END AS number FROM n""",
    "f06_keep_hits": f"""
WITH {S.POOL}, t AS (SELECT id, lower(text) AS text, {_WEB} AS l FROM pool WHERE source_type = 'web')
SELECT id, len(l) = 0 OR (list_has_any(l, regexp_extract_all(text, '[a-z0-9][a-z0-9-]*')) AND len(list_filter(l, lambda x: contains(text, x))) >= CASE WHEN len(l) >= 6 THEN 3 WHEN len(l) >= 3 THEN 2 WHEN len(l) >= 1 THEN 1 ELSE 0 END) AS kept FROM t""",
    "f11_failed_attempts": rf"WITH {_A} SELECT regexp_matches(lower(concat_ws(' ', status, error_type)), '\b(?:failed|timeout|error)\b|_error\b') AS looks_failed, count(*) AS n FROM a GROUP BY ALL",
    "a17_relevance_labels": f"WITH {_SC} SELECT id, CASE WHEN na > 0 AND anchor = 0 THEN 'generic' WHEN shared / nq >= 0.55 OR (evidence_level IN ({S.quoted(dims.STRONG)}) AND shared / nq >= 0.30 AND shared >= 4) THEN 'focused' WHEN shared > 0 THEN 'adjacent' ELSE 'generic' END AS label FROM s WHERE source_type = 'patent' AND nq > 0",
    "w09_blinded_representatives": f"""
WITH d AS (SELECT DISTINCT * FROM evaluation_candidate_decisions), f AS (SELECT *, row_number() OVER (PARTITION BY session_id, source_type, candidate_identity ORDER BY attempt, id) AS r FROM d WHERE candidate_identity <> '')
SELECT id, {S.keyed_hash(BLIND_SEED, "to_json([session_id, source_type, candidate_identity])::VARCHAR")} AS blind FROM f WHERE r = 1""",
    "st08_answer_cache": f"WITH {_A}, h AS (SELECT source_type, row_number() OVER (PARTITION BY session_id, source_type, concat_ws('|', query_hash, evidence_json) ORDER BY id) > 1 AS from_cache FROM a) SELECT source_type, from_cache, count(*) AS n FROM h GROUP BY ALL",
}
