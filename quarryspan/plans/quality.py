"""Queries a05_.. to a20_, f07_, f08_, k01_.. to k08_, e01_.. to e06_, r08_: quality, coverage, JSON, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryspan import dims
from quarryspan.functions import ids as U
from quarryspan.functions import structured as X
from quarryspan.functions import text as T
from quarryspan.operators import contracts as C
from quarryspan.operators import quality as O
from quarryspan.operators.ranking import best_rows
from quarryspan.plans import identity as Q
from quarryspan.plans import sql as S
from quarryspan.plans.ranking import _BEST, _A, w01_latest_attempt, w02_best_attempt
from quarryspan.plans.views import attempts, decisions, items, sessions
from quarryspan.tables import load

KEY = ["session_id", "source_type", "attempt"]


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    rows = items(spark, folder, *KEY, "evidence_level", "relevance_score", "verified_url", "title", "summary", "url", "canonical_id")
    rows = rows.withColumn("label", O.relevance_label(F.col("relevance_score"))).withColumn("class", U.level_class(F.col("evidence_level"))).withColumn("verified", F.col("verified_url"))
    return rows.withColumn("quality", O.hit_quality(F.col("relevance_score"), F.col("evidence_level"), F.col("label"), F.col("verified_url")))


def a06_hit_quality(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder).select("id", "label", "quality")


def _graded(spark: SparkSession, folder: str) -> DataFrame:
    rows = attempts(spark, folder, *KEY, "status", "completed", "reliable_no_results", "error_count")
    rows = best_rows(rows, KEY, [F.desc("id")]).drop("rank_no", "id")
    return O.graded(_hits(spark, folder), rows, KEY)


def a07_grades(spark: SparkSession, folder: str) -> DataFrame:
    """The grade of every attempt, from its hits."""
    return _graded(spark, folder).select(*KEY, "hits", "top_quality", "grade", "search_incomplete")


def _latest_grades(spark: SparkSession, folder: str) -> DataFrame:
    rows = _graded(spark, folder)
    return best_rows(rows, ["session_id", "source_type"], [F.desc("attempt")]).drop("rank_no")


def a08_retrieval_state(spark: SparkSession, folder: str) -> DataFrame:
    """The state of retrieval of each session from its sources' latest attempts."""
    return O.retrieval_state(_latest_grades(spark, folder), ["session_id"])


def a10_source_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of each session by source, as columns."""
    rows = items(spark, folder, "session_id", "source_type")
    return rows.groupBy("session_id").agg(*[F.count_if(F.col("source_type") == s).alias(s) for s in ("patent", "publication", "web")])


def _atoms(spark: SparkSession, folder: str) -> DataFrame:
    schema = "critical_requirements_atomic array<struct<label:string,terms:array<string>>>"
    rows = sessions(spark, folder, "query_envelope_json").select("session_id", F.posexplode(F.from_json("query_envelope_json", schema)["critical_requirements_atomic"]))
    terms = F.filter(F.transform("col.terms", lambda t: F.lower(F.trim(t))), lambda t: t != "")
    return rows.select("session_id", F.col("pos").alias("atom_no"), terms.alias("terms")).where(F.size("terms") > 0)


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder, "session_id", "source_type", "title", "summary", "verified_url", "evidence_level").withColumn("text", F.concat_ws(" ", "title", "summary"))


def a05_atom_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """The share of its session's requirements that each item has in full."""
    m = O.requirement_matches(_texts(spark, folder), _atoms(spark, folder), ["session_id"])
    return m.groupBy("id").agg(F.count_if("full").alias("matched"), T.rounded(F.avg(F.col("full").cast("double")), 4).alias("coverage"))


def a11_requirement_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How many requirements of a session any verified item of each source has in full."""
    hits = _texts(spark, folder).where("verified_url = 1")
    m = O.requirement_matches(hits.select("session_id", "source_type", "id", "text"), _atoms(spark, folder).withColumn("source_type", F.explode(F.array(*map(F.lit, ("patent", "publication", "web"))))), ["session_id", "source_type"])
    return m.groupBy("session_id", "source_type", "atom_no").agg(F.max("full").alias("any")).groupBy("session_id", "source_type").agg(F.count_if("any").alias("covered"), F.count("*").alias("requirements"))


def a12_single_hit(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions with an item that has all requirements in full."""
    m = O.requirement_matches(_texts(spark, folder), _atoms(spark, folder), ["session_id"])
    return m.groupBy("session_id", "id").agg(F.min("full").alias("all")).groupBy("session_id").agg(F.max("all").alias("single_hit"))


def a13_requirement_status(spark: SparkSession, folder: str) -> DataFrame:
    """For each requirement the first item that has it: by source (patent, publication, web), then in order."""
    hits = _texts(spark, folder)
    m = O.requirement_matches(hits, _atoms(spark, folder), ["session_id"]).where("full").join(hits.select("id", "source_type", F.coalesce("verified_url", F.lit(0)).alias("v")), "id")
    rank = F.when(F.col("source_type") == "patent", 0).when(F.col("source_type") == "publication", 1).otherwise(2)
    first = m.groupBy("session_id", "atom_no").agg(F.min(F.struct((-F.col("v")).alias("v"), rank.alias("r"), F.col("id").alias("id"))).alias("f"))
    out = _atoms(spark, folder).join(first, ["session_id", "atom_no"], "left")
    return out.select("session_id", "atom_no", F.when(F.col("f").isNull(), "not_verified").when(F.col("f.v") == -1, "verified").otherwise("partially_indicated").alias("status"), F.col("f.id").alias("id"))


def a16_overall_status(spark: SparkSession, folder: str) -> DataFrame:
    """ok, failed or partial of each session's latest attempts, and whether absence of results is reliable."""
    rows = attempts(spark, folder, "session_id", "source_type", "attempt", "status", "completed", "reliable_no_results")
    rows = best_rows(rows, ["session_id", "source_type"], [F.desc("attempt"), F.desc("id")])
    out = rows.groupBy("session_id").agg(F.min(F.col("status") == "ok").alias("ok"), F.min(F.col("status") == "failed").alias("failed"), F.min((F.col("completed") == 1) & (F.col("reliable_no_results") == 1)).alias("can_claim_no"))
    return out.select("session_id", F.when(F.col("ok"), "ok").when(F.col("failed"), "failed").otherwise("partial_failure").alias("status"), "can_claim_no")


def a18_collective(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts with two or more web items of a session, one of them fetched, and none direct: their best item is promoted; the first such host."""
    rows = _hits(spark, folder).where("source_type = 'web'").withColumn("domain", U.registrable(F.col("url"))).where("domain <> ''")
    direct = F.max(F.col("label") == "direct").over(Window.partitionBy("session_id"))
    by = rows.withColumn("any_direct", direct).where("NOT any_direct").groupBy("session_id", "domain").agg(F.count("*").alias("n"), F.max(F.col("evidence_level").isin("fetched_excerpt", "verified_page")).alias("fetched"), F.min("id").alias("first"), F.min(F.struct((-F.col("quality")).alias("q"), F.col("id").alias("id")))["id"].alias("best"))
    return best_rows(by.where("n >= 2 AND fetched"), ["session_id"], [F.asc("first")]).select("session_id", "domain", F.col("best").alias("id"))


def corroborated(rows: DataFrame) -> DataFrame:
    """(session_id, doc_id, sources, n) of documents (session_id, source_type, id, doc_ids: all that a hit is known by) that several kinds of source of a session have."""
    ids = rows.select("session_id", "source_type", "id", F.explode(F.array_distinct("doc_ids")).alias("doc_id"))
    return ids.groupBy("session_id", "doc_id").agg(F.array_join(F.array_sort(F.collect_set("source_type")), ", ").alias("sources"), F.count("*").alias("n"), F.countDistinct("source_type").alias("k")).where("k >= 2").drop("k")


def a19_corroboration(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, by identifier, address or title, that two or more kinds of source have, over all sessions: within one session the tables have none."""
    rows = items(spark, folder, "source_type", "title", "url", "canonical_id")
    ids = F.filter(F.array(F.concat(F.lit("id:"), F.lower(F.trim("canonical_id"))), F.concat(F.lit("url:"), U.identity_url(F.col("url"))), F.concat(F.lit("title:"), U.title_key(F.col("title")))), lambda x: x.isNotNull() & ~x.rlike("^(?:id|url|title):$"))
    return corroborated(rows.select(F.lit("all").alias("session_id"), "source_type", "id", ids.alias("doc_ids"))).drop("session_id")


def a20_uncovered_atoms(spark: SparkSession, folder: str) -> DataFrame:
    """Requirements for which no item of the session contains every term."""
    atoms = _atoms(spark, folder)
    texts = _texts(spark, folder).select("session_id", F.lower("text").alias("text"))
    hit = atoms.join(texts, "session_id").where(F.forall("terms", lambda t: F.contains(F.col("text"), t))).select("session_id", "atom_no")
    return atoms.join(hit, ["session_id", "atom_no"], "left_anti").select("session_id", "atom_no", F.array_join("terms", " ").alias("terms"))


def a21_unchanged_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts that brought the same documents as the one before."""
    rows = items(spark, folder, *KEY, "canonical_id").where("trim(canonical_id) <> ''").groupBy(*KEY).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.lower(F.trim("canonical_id")))), "|"), 256).alias("signature"))
    before = F.lag("signature").over(Window.partitionBy("session_id", "source_type").orderBy("attempt"))
    return rows.withColumn("unchanged", F.coalesce(F.col("signature") == before, F.lit(False))).select(*KEY, "unchanged")


def f07_verification_queue(spark: SparkSession, folder: str) -> DataFrame:
    """The first six items with an address of each attempt."""
    rows = items(spark, folder, *KEY, "url").where("trim(url) <> ''")
    return best_rows(rows, KEY, [F.asc("id")], 6).select(*KEY, "rank_no", "id")


def f08_visible_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Items that a report shows: none of a failed level, and of snippets only direct ones."""
    shown = (F.col("class") != "failed") & ((F.col("evidence_level") != "search_snippet_only") | (F.col("label") == "direct"))
    return _hits(spark, folder).groupBy("session_id", "source_type").agg(F.count_if(shown).alias("visible"), F.count_if((F.col("verified_url") == 1) & (F.col("class") == "strong")).alias("verified"))


def f09_valid_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Items with any of title, address, summary, level or verification."""
    filled = [F.coalesce(F.trim(c), F.lit("")) != "" for c in ("title", "url", "summary", "evidence_level")]
    valid = filled[0] | filled[1] | filled[2] | filled[3] | F.coalesce(F.col("verified_url") == 1, F.lit(False))
    return items(spark, folder, "title", "url", "summary", "evidence_level", "verified_url").select("id", valid.alias("valid"))


def k04_status_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Status lines written and read back for each attempt."""
    flag = lambda c: F.when(F.col(c) == 1, "TRUE").otherwise("FALSE")
    head = F.concat_ws("\n", F.concat(F.lit("STATUS: "), F.upper("status")), F.concat(F.lit("COMPLETED: "), flag("completed")), F.concat(F.lit("RELIABLE_NO_RESULTS: "), flag("reliable_no_results")), F.concat(F.lit("ERROR_COUNT: "), F.col("error_count").cast("string")))
    rows = attempts(spark, folder, "status", "completed", "reliable_no_results", "error_count").withColumn("head", head)
    return rows.select("id", F.lower(F.regexp_extract("head", r"(?im)^STATUS:\s*([A-Z_]+)\s*$", 1)).alias("status"), (F.regexp_extract("head", r"(?im)^COMPLETED:\s*(TRUE|FALSE)\s*$", 1) == "TRUE").alias("completed"), F.regexp_extract("head", r"(?im)^ERROR_COUNT:\s*(\d+)\s*$", 1).cast("int").alias("errors"))


def k05_attempt_log(spark: SparkSession, folder: str) -> DataFrame:
    """Steps of the items' logs by provider and status, with their mean time."""
    schema = "array<struct<provider:string,attempt:int,status:string,elapsed_ms:int>>"
    rows = items(spark, folder, "attempt_log_json").select(F.explode(F.from_json("attempt_log_json", schema)).alias("x")).select("x.*")
    return rows.groupBy("provider", "status").agg(F.count("*").alias("n"), T.rounded(F.avg("elapsed_ms"), 4).alias("mean_ms"))


def k01_parsed_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each session's envelope parses as it is, and its core subject."""
    rows = sessions(spark, folder, "query_envelope_json")
    parsed = F.try_parse_json("query_envelope_json")
    return rows.select("session_id", parsed.isNotNull().alias("parsed"), F.get_json_object("query_envelope_json", "$.core_subject").alias("core_subject"))


def k01_repaired_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Every envelope's value, repaired where it nearly is JSON, under the key raw where it is none; null for a blank one. Repairs look ahead, which SQL can't."""
    return sessions(spark, folder, "query_envelope_json").select("session_id", X.parsed_column("query_envelope_json").alias("value"))


def k08_result_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Results by the status inside their normalised payload."""
    rows = attempts(spark, folder, "normalized_json")
    return rows.groupBy(F.get_json_object("normalized_json", "$.status").alias("inner_status"), F.get_json_object("normalized_json", "$.source_type").alias("inner_source")).agg(F.count("*").alias("n"))


def e01_manifest_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Rules that decisions break, with the number of rows: uniqueness, known stages and sources, times, references."""
    d = decisions(spark, folder, "source_type", "decision_stage", "candidate_identity", "candidate_identity_kind", "retained", "example_id", "run_id", "score_at_decision", "threshold_at_decision")
    rules = {
        "source": ~F.col("source_type").isin("patent", "publication", "web"), "identity_kind": (F.col("candidate_identity") == "") != (F.col("candidate_identity_kind") == ""),
        "example": ~F.col("example_id").rlike("^[0-9a-f]{32}$"), "retained": F.col("retained").isNotNull() & ~F.col("retained").isin(0, 1), "run": F.col("run_id") == "",
    }
    counts = d.agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*rules)))).select(F.col("key").alias("rule"), F.col("value").alias("broken"))


def e01_decision_rules(spark: SparkSession, folder: str) -> DataFrame:
    """For each rule of a decision the number of decisions that break it: known meanings by source, identities, numbers, and outcomes that agree with their reason."""
    d = decisions(spark, folder, "source_type", "attempt", "decision_stage", "decision_reason", "candidate_identity", "candidate_identity_kind", "retained", "dataset_eligible", "score_at_decision", "threshold_at_decision")
    return C.broken(d, C.decision_rules())


def e01_decision_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions by source and kind."""
    d = decisions(spark, folder, "source_type", "decision_stage", "dataset_eligible")
    return d.groupBy("source_type", C.decision_kind(F.col("decision_stage"), F.col("dataset_eligible")).alias("kind")).agg(F.count("*").alias("n"))


def e03_split_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates (as families) whose decisions fall into more than one split, when queries are split by their hash."""
    d = decisions(spark, folder, "candidate_identity", "query_fingerprint").where("candidate_identity <> ''")
    split = F.when(F.substring("query_fingerprint", 1, 1) < "8", "train").otherwise("test")
    return C.split_families(d.select(F.col("candidate_identity").alias("intent_family_id"), split.alias("split")))


def e05_quota_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Sampled items of each stratum, and whether the strata's numbers differ by one at most."""
    rows = items(spark, folder, "source_type", "evidence_level").groupBy("source_type", "evidence_level").agg(F.least(F.count("*"), F.lit(3)).alias("n"))
    return rows.groupBy("source_type").agg(F.sum("n").alias("total"), (F.max("n") - F.min("n") <= 1).alias("balanced"))


def r08_status_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Sources whose best attempt isn't the latest, where the latest failed or was partial."""
    best, latest = w02_best_attempt(spark, folder), w01_latest_attempt(spark, folder)
    rows = latest.alias("l").join(best.alias("b"), ["session_id", "source_type"]).where("l.id <> b.id AND l.status IN ('failed', 'partial_failure')")
    return rows.select("session_id", "source_type", F.format_string("%s: attempt %d was %s; the best earlier result is used", F.col("source_type"), F.col("l.attempt"), F.col("l.status")).alias("note"))


_H = f"""{S.ITEMS}, h0 AS (SELECT id, session_id, source_type, attempt, evidence_level, verified_url, url, title, summary, CASE WHEN isnan(relevance_score) THEN NULL ELSE relevance_score END AS s, {S.level_class('evidence_level')} AS class FROM items),
h AS (SELECT *, CASE WHEN s >= 7 THEN 'direct' WHEN s >= 3 THEN 'adjacent' ELSE 'generic' END AS label,
  round_even(greatest(0.0, least(10.0, (CASE WHEN coalesce(s, 0) <= 0 THEN CASE class WHEN 'strong' THEN 7.0 WHEN 'medium' THEN 5.0 WHEN 'weak' THEN 3.0 WHEN 'failed' THEN 0.5 ELSE 2.0 END::DOUBLE ELSE s END)
   * (CASE WHEN coalesce(s, 0) = 0 THEN {S.level_weight('evidence_level')} ELSE 1.0::DOUBLE END) * (CASE WHEN s >= 7 THEN 1.1::DOUBLE WHEN s >= 3 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) + CASE WHEN coalesce(verified_url, 0) = 1 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)), 2) AS quality FROM h0)"""
_G = f"""{_H}, {_A}, att AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, source_type, attempt ORDER BY id DESC) AS r FROM a) WHERE r = 1),
per AS (SELECT session_id, source_type, attempt, count(*) AS n, max(quality) AS top, bool_or(class = 'strong' AND label <> 'generic') AS strong, bool_or(class = 'medium' AND label <> 'generic') AS medium,
  count(*) FILTER (evidence_level = 'search_snippet_only' AND coalesce(verified_url, 0) = 1 AND label <> 'generic') AS snippets, bool_and(class = 'failed') AS all_failed, count(*) FILTER (label <> 'direct') AS aside FROM h GROUP BY ALL),
g1 AS (SELECT t.session_id, t.source_type, t.attempt, t.status, t.status = 'partial_failure' AS part, t.error_count, t.completed, t.reliable_no_results, n, top, aside,
  CASE WHEN strong THEN 'strong' WHEN medium OR snippets >= 2 THEN 'medium' WHEN all_failed THEN 'failed_retrieval' ELSE 'weak' END AS g FROM att t LEFT JOIN per p ON p.session_id = t.session_id AND p.source_type = t.source_type AND p.attempt = t.attempt),
g2 AS (SELECT * REPLACE (CASE WHEN g IN ('strong', 'medium') AND part AND aside = n THEN 'weak' WHEN g = 'strong' AND aside * 2 > n THEN 'medium' ELSE g END AS g) FROM g1),
g3 AS (SELECT * REPLACE (CASE WHEN g = 'strong' AND part AND top < 5 THEN 'medium' ELSE g END AS g) FROM g2), g4 AS (SELECT * REPLACE (CASE WHEN g = 'medium' AND part AND top < 3.5 THEN 'weak' ELSE g END AS g) FROM g3),
graded AS (SELECT session_id, source_type, attempt, coalesce(n, 0) AS hits, coalesce(top, 0.0) AS top_quality, CASE WHEN n IS NULL THEN CASE WHEN status = 'ok' AND completed = 1 AND reliable_no_results = 1 THEN 'reliable_no_results' ELSE 'failed_retrieval' END ELSE g END AS grade, part AND error_count > 0 AS search_incomplete FROM g4)"""
_STEM = S.requirement_stem("p")
_M = f"""{S.ITEMS}, x AS (SELECT id, session_id, source_type, coalesce(verified_url, 0) AS v, concat_ws(' ', title, summary) AS text FROM items),
b AS (SELECT *, list_distinct(list_concat({S.raw_tokens('text')}, list_transform({S.raw_tokens('text')}, lambda p: {_STEM}))) AS blob, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS joined FROM x),
j AS (SELECT session_id, try_cast(nullif(trim(query_envelope_json), '') AS JSON) AS e FROM research_sessions),
l AS (SELECT session_id, from_json(e -> '$.critical_requirements_atomic', '[{{"label":"VARCHAR","terms":["VARCHAR"]}}]') AS l FROM j),
u AS (SELECT session_id, unnest(l) AS a, generate_subscripts(l, 1) - 1 AS atom_no FROM l),
atoms AS (SELECT session_id, atom_no, list_filter(list_transform(a.terms, lambda t: lower(trim(t))), lambda t: t <> '') AS terms FROM u WHERE len(list_filter(list_transform(a.terms, lambda t: lower(trim(t))), lambda t: t <> '')) > 0),
te AS (SELECT session_id, atom_no, len(terms) AS nt, unnest(terms) AS term FROM atoms),
tp AS (SELECT session_id, atom_no, nt, term, regexp_extract_all(term, '[a-z0-9]+') AS parts FROM te),
mt AS (SELECT b.session_id, b.source_type, b.v, b.id, atom_no, nt, len(parts) > 0 AND ((len(parts) > 1 AND contains(joined, array_to_string(parts, ''))) OR len(list_filter(parts, lambda p: NOT (list_contains(blob, p) OR list_contains(blob, {_STEM})))) = 0) AS ok FROM b JOIN tp USING (session_id)),
m AS (SELECT session_id, source_type, v, id, atom_no, bool_and(ok) AS whole FROM mt GROUP BY ALL)"""

QUERIES = {f.__name__: f for f in (a05_atom_coverage, a06_hit_quality, a07_grades, a08_retrieval_state, a10_source_counts, a11_requirement_coverage, a12_single_hit, a13_requirement_status, a16_overall_status, a18_collective, a19_corroboration, a20_uncovered_atoms, a21_unchanged_evidence, f07_verification_queue, f08_visible_hits, f09_valid_hits, k01_parsed_payloads, k01_repaired_payloads, k04_status_headers, k05_attempt_log, k08_result_summaries, e01_manifest_checks, e01_decision_rules, e01_decision_kinds, e03_split_leaks, e05_quota_checks, r08_status_notes)}
ORACLE = {
    "a05_atom_coverage": f"WITH {_M} SELECT id, count(*) FILTER (whole) AS matched, round_even(avg(whole::INT), 4) AS coverage FROM m GROUP BY ALL",
    "a06_hit_quality": f"WITH {_H} SELECT id, label, quality FROM h",
    "a07_grades": f"WITH {_G} SELECT * FROM graded",
    "a08_retrieval_state": f"""
WITH {_G}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, source_type ORDER BY attempt DESC) AS r FROM graded) WHERE r = 1)
SELECT session_id, CASE WHEN bool_and(grade = 'reliable_no_results') THEN 'reliable_no_results' WHEN bool_and(grade = 'failed_retrieval') THEN 'failed' WHEN bool_and(grade IN ('strong', 'medium', 'reliable_no_results')) THEN CASE WHEN bool_or(search_incomplete) THEN 'degraded' ELSE 'complete' END
  WHEN bool_or(grade IN ('strong', 'medium')) AND bool_or(grade = 'failed_retrieval') THEN 'degraded' WHEN bool_or(grade IN ('strong', 'medium')) AND bool_or(grade = 'weak') THEN 'mixed_partial' ELSE 'partial' END AS retrieval,
  count(*) FILTER (grade = 'strong') AS strong, count(*) FILTER (grade = 'medium') AS medium FROM l GROUP BY session_id""",
    "a10_source_counts": f"WITH {S.ITEMS} SELECT session_id, count(*) FILTER (source_type = 'patent') AS patent, count(*) FILTER (source_type = 'publication') AS publication, count(*) FILTER (source_type = 'web') AS web FROM items GROUP BY ALL",
    "a11_requirement_coverage": f"WITH {_M}, y AS (SELECT session_id, source_type, atom_no, bool_or(whole) AS any FROM m WHERE v = 1 GROUP BY ALL) SELECT session_id, source_type, count(*) FILTER (\"any\") AS covered, count(*) AS requirements FROM y GROUP BY ALL",
    "a12_single_hit": f"WITH {_M}, y AS (SELECT session_id, id, bool_and(whole) AS \"all\" FROM m GROUP BY ALL) SELECT session_id, bool_or(\"all\") AS single_hit FROM y GROUP BY ALL",
    "a13_requirement_status": f"""
WITH {_M}, f AS (SELECT session_id, atom_no, v, id, row_number() OVER (PARTITION BY session_id, atom_no ORDER BY v DESC, CASE source_type WHEN 'patent' THEN 0 WHEN 'publication' THEN 1 ELSE 2 END, id) AS r FROM m WHERE whole)
SELECT a.session_id, a.atom_no, CASE WHEN f.id IS NULL THEN 'not_verified' WHEN f.v = 1 THEN 'verified' ELSE 'partially_indicated' END AS status, f.id FROM atoms a LEFT JOIN f ON f.session_id = a.session_id AND f.atom_no = a.atom_no AND f.r = 1""",
    "a16_overall_status": f"WITH {_A}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, source_type ORDER BY attempt DESC, id DESC) AS r FROM a) WHERE r = 1) SELECT session_id, CASE WHEN bool_and(status = 'ok') THEN 'ok' WHEN bool_and(status = 'failed') THEN 'failed' ELSE 'partial_failure' END AS status, bool_and(completed = 1 AND reliable_no_results = 1) AS can_claim_no FROM l GROUP BY ALL",
    "a18_collective": rf"""
WITH {_H}, w AS (SELECT *, regexp_replace({S.host('url')}, '^www\.', '') AS domain FROM h WHERE source_type = 'web'), d AS (SELECT *, bool_or(label = 'direct') OVER (PARTITION BY session_id) AS any_direct FROM w WHERE domain <> ''),
g AS (SELECT session_id, domain, count(*) AS n, bool_or(evidence_level IN ('fetched_excerpt', 'verified_page')) AS fetched, min(id) AS first, arg_min(id, (-quality, id)) AS best FROM d WHERE NOT any_direct GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first) AS k FROM g WHERE n >= 2 AND fetched) SELECT session_id, domain, best AS id FROM r WHERE k = 1""",
    "a19_corroboration": f"""
WITH {S.ITEMS}, {Q._IU}, k AS (SELECT id, source_type, 'id:' || lower(trim(canonical_id)) AS doc_id FROM items UNION SELECT id, source_type, 'title:' || trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) FROM items UNION SELECT id, source_type, 'url:' || identity_url FROM ident JOIN items USING (id))
SELECT doc_id, string_agg(DISTINCT source_type, ', ' ORDER BY source_type) AS sources, count(*) AS n FROM k WHERE doc_id NOT IN ('id:', 'url:', 'title:') GROUP BY doc_id HAVING count(DISTINCT source_type) >= 2""",
    "a20_uncovered_atoms": f"WITH {_M} SELECT session_id, atom_no, array_to_string(terms, ' ') AS terms FROM atoms a WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.session_id = a.session_id AND len(list_filter(a.terms, lambda t: NOT contains(lower(x.text), t))) = 0)",
    "a21_unchanged_evidence": f"WITH {S.ITEMS}, s AS (SELECT session_id, source_type, attempt, list_sort(list_distinct(list(lower(trim(canonical_id))))) AS g FROM items WHERE trim(canonical_id) <> '' GROUP BY ALL) SELECT session_id, source_type, attempt, coalesce(g = lag(g) OVER (PARTITION BY session_id, source_type ORDER BY attempt), false) AS unchanged FROM s",
    "f07_verification_queue": f"WITH {S.ITEMS} SELECT session_id, source_type, attempt, rank_no, id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, source_type, attempt ORDER BY id) AS rank_no FROM items WHERE trim(url) <> '') WHERE rank_no <= 6",
    "f08_visible_hits": f"WITH {_H} SELECT session_id, source_type, count(*) FILTER (class <> 'failed' AND (evidence_level <> 'search_snippet_only' OR label = 'direct')) AS visible, count(*) FILTER (verified_url = 1 AND class = 'strong') AS verified FROM h GROUP BY ALL",
    "f09_valid_hits": f"WITH {S.ITEMS} SELECT id, coalesce(trim(title), '') <> '' OR coalesce(trim(url), '') <> '' OR coalesce(trim(summary), '') <> '' OR coalesce(trim(evidence_level), '') <> '' OR coalesce(verified_url = 1, false) AS valid FROM items",
    "k01_parsed_payloads": "SELECT session_id, try_cast(query_envelope_json AS JSON) IS NOT NULL AND query_envelope_json IS NOT NULL AND trim(query_envelope_json) <> '' AS parsed, try_cast(nullif(trim(query_envelope_json), '') AS JSON) ->> '$.core_subject' AS core_subject FROM research_sessions",
    "k04_status_headers": f"WITH {_A} SELECT id, status, completed = 1 AS completed, error_count AS errors FROM a",
    "k05_attempt_log": f"WITH {S.ITEMS}, x AS (SELECT unnest(from_json(try_cast(nullif(attempt_log_json, '') AS JSON), '[{{\"provider\":\"VARCHAR\",\"status\":\"VARCHAR\",\"elapsed_ms\":\"INTEGER\"}}]')) AS x FROM items) SELECT x.provider AS provider, x.status AS status, count(*) AS n, round_even(avg(x.elapsed_ms), 4) AS mean_ms FROM x GROUP BY ALL",
    "k08_result_summaries": f"WITH {_A} SELECT try_cast(nullif(normalized_json, '') AS JSON) ->> '$.status' AS inner_status, try_cast(nullif(normalized_json, '') AS JSON) ->> '$.source_type' AS inner_source, count(*) AS n FROM a GROUP BY ALL",
    "e01_manifest_checks": """
WITH d AS (SELECT DISTINCT * FROM evaluation_candidate_decisions), c AS (SELECT count(*) FILTER (source_type NOT IN ('patent', 'publication', 'web')) AS source, count(*) FILTER ((candidate_identity = '') <> (candidate_identity_kind = '')) AS identity_kind,
  count(*) FILTER (NOT regexp_matches(example_id, '^[0-9a-f]{32}$')) AS example, count(*) FILTER (retained NOT IN (0, 1)) AS retained, count(*) FILTER (run_id = '') AS run FROM d)
UNPIVOT c ON source, identity_kind, example, retained, run INTO NAME rule VALUE broken""",
    "e03_split_leaks": "WITH d AS (SELECT DISTINCT * FROM evaluation_candidate_decisions), f AS (SELECT candidate_identity AS intent_family_id, CASE WHEN left(query_fingerprint, 1) < '8' THEN 'train' ELSE 'test' END AS split FROM d WHERE candidate_identity <> '') SELECT intent_family_id, count(DISTINCT split) AS splits, count(*) AS queries FROM f GROUP BY ALL HAVING count(DISTINCT split) > 1",
    "e01_decision_kinds": f"WITH d AS (SELECT DISTINCT * FROM evaluation_candidate_decisions) SELECT source_type, CASE WHEN dataset_eligible <> 1 THEN 'trace_only' WHEN decision_stage = 'fill_back' THEN 'restoration' WHEN decision_stage IN ({S.quoted(dims.TEXT_GATES)}) THEN 'text_gate' WHEN decision_stage IN ({S.quoted(dims.RELEVANCE_GATES)}) THEN 'relevance_gate' ELSE 'structural' END AS kind, count(*) AS n FROM d GROUP BY ALL",
    "e01_decision_rules": f"""
WITH d AS (SELECT DISTINCT * FROM evaluation_candidate_decisions), m AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', '{c}')" for a, st in dims.SEMANTICS.items() for b, r in st.items() for c in r.split())}) t(s, g, r)),
j AS (SELECT d.*, m.s IS NOT NULL AS known, decision_stage IN ({S.quoted(dims.JUDGING_STAGES)}) AS judging, (decision_reason IN ({S.quoted(dims.ACCEPTING_REASONS)}))::INT AS yes FROM d LEFT JOIN m ON s = source_type AND g = decision_stage AND r = decision_reason),
c AS (SELECT count(*) FILTER (id <= 0 OR attempt <= 0) AS identity, count(*) FILTER (source_type IS NULL OR source_type NOT IN ({S.quoted(dims.SOURCES)})) AS source, count(*) FILTER (NOT known) AS semantics,
  count(*) FILTER (candidate_identity_kind IS NULL OR candidate_identity_kind NOT IN ('canonical_id', 'url', 'text_hash') OR trim(candidate_identity) = '') AS identity_kind, count(*) FILTER (candidate_identity_kind = 'text_hash' AND NOT regexp_full_match(candidate_identity, '[0-9a-f]{{32}}')) AS fallback_identity,
  count(*) FILTER (dataset_eligible NOT IN (0, 1)) AS eligible, count(*) FILTER (retained NOT IN (0, 1)) AS retained, count(*) FILTER (NOT isfinite(score_at_decision) OR NOT isfinite(threshold_at_decision)) AS number,
  count(*) FILTER (decision_stage = 'cache_lookup' AND dataset_eligible <> 0) AS cache_eligible, count(*) FILTER (NOT judging AND retained IS NOT NULL) AS structural_judged, count(*) FILTER (judging AND retained IS DISTINCT FROM yes) AS outcome FROM j)
UNPIVOT c ON COLUMNS(*) INTO NAME rule VALUE broken""",
    "e05_quota_checks": f"WITH {S.ITEMS}, g AS (SELECT source_type, evidence_level, least(count(*), 3) AS n FROM items GROUP BY ALL) SELECT source_type, sum(n)::BIGINT AS total, max(n) - min(n) <= 1 AS balanced FROM g GROUP BY ALL",
    "r08_status_notes": f"WITH {_A}, {_BEST}, lat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, source_type ORDER BY attempt DESC, id DESC) AS k FROM a) WHERE k = 1) SELECT l.session_id, l.source_type, l.source_type || ': attempt ' || l.attempt || ' was ' || l.status || '; the best earlier result is used' AS note FROM lat l JOIN best b ON b.session_id = l.session_id AND b.source_type = l.source_type WHERE l.id <> b.id AND l.status IN ('failed', 'partial_failure')",
}
