"""Queries q02_.. to q21_ and u01_.. to u18_: queries, addresses, identities and levels of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryspan import dims
from quarryspan.functions import ids as U
from quarryspan.functions import structured as X
from quarryspan.functions import text as T
from quarryspan.operators.ranking import case_rank
from quarryspan.plans import sql as S
from quarryspan.plans.views import attempts, decisions, items, sessions


def _queries(spark: SparkSession, folder: str) -> DataFrame:
    return sessions(spark, folder, "original_query").withColumnRenamed("original_query", "query")


def q02_normalized(spark: SparkSession, folder: str) -> DataFrame:
    """Queries of all sessions in one form: compatibility form, single blanks, lower case; without SQL, which lacks that form."""
    return _queries(spark, folder).select("session_id", X.query_form(F.col("query")).alias("normalized"))


def q03_query_hash(spark: SparkSession, folder: str) -> DataFrame:
    """The hashes of the queries of all sessions, over the same form."""
    form = F.col("normalized")
    return q02_normalized(spark, folder).select("session_id", U.sha_prefix(form, 24).alias("query_hash"), U.sha_prefix(form, 32).alias("fingerprint"), F.sha2(form, 256).alias("input_hash"))


def q02_hash_of_plain_form(spark: SparkSession, folder: str) -> DataFrame:
    """The hash of every query's plain form (single blanks, lower case), and whether the query is ASCII, where that is the whole form."""
    form = F.lower(T.squeezed(F.col("query")))
    return _queries(spark, folder).select("session_id", F.sha2(form, 256).alias("plain_hash"), (~F.coalesce("query", F.lit("")).rlike(r"[^\x00-\x7f]")).alias("is_ascii"))


def q04_envelope_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct words of a query of three characters or more, without stop words, in order."""
    found = F.regexp_extract_all(F.lower(F.col("query")), F.lit(r"[\p{L}\p{N}_-]{3,}"), F.lit(0))
    kept = F.filter(F.transform(found, lambda t: F.btrim(t, F.lit("_-"))), lambda t: (F.length(t) >= 3) & ~t.isin(*dims.ENVELOPE_STOPWORDS))
    return _queries(spark, folder).select("session_id", F.array_join(F.array_sort(F.array_distinct(kept)), " ").alias("terms"))


def q05_ascii_language(spark: SparkSession, folder: str) -> DataFrame:
    """The coarse label: en for plain ASCII, non_english otherwise."""
    return _queries(spark, folder).select("session_id", F.when(F.col("query").rlike(r"[^\x00-\x7f]"), "non_english").otherwise("en").alias("language"))


def without_framing(query: Column) -> Column:
    """A query without the phrases around it that only ask for a check, three times over; an empty rest gives the query."""
    whole = T.squeezed(query)
    out = whole
    for _ in range(3):
        for pattern, group in dims.FRAMING_BEFORE:
            out = F.ltrim(F.regexp_replace(out, "(?i)" + pattern, f"${group}" if group else ""))
        for pattern in dims.FRAMING_AFTER:
            out = F.rtrim(F.regexp_replace(out, "(?i)" + pattern, ""))
    out = F.trim(F.btrim(F.trim(out), F.lit(",;:")))
    return F.when(out == "", whole).otherwise(out)


def q06_strip_framing(spark: SparkSession, folder: str) -> DataFrame:
    """Queries without the phrases that only ask for a check."""
    return _queries(spark, folder).select("session_id", without_framing(F.col("query")).alias("subject"))


def q09_consolidated_atoms(spark: SparkSession, folder: str) -> DataFrame:
    """Requirements of the envelopes whose set of terms is in no larger set of the same envelope."""
    schema = "critical_requirements_atomic array<struct<category:string,label:string,terms:array<string>>>"
    rows = sessions(spark, folder, "query_envelope_json").select("session_id", F.from_json("query_envelope_json", schema)["critical_requirements_atomic"].alias("atoms"))
    atoms = F.transform("atoms", lambda a: F.struct(a["category"].alias("category"), a["label"].alias("label"), F.array_sort(F.array_distinct(a["terms"])).alias("terms")))
    rows = rows.withColumn("atoms", atoms).where(F.size("atoms") > 0)
    kept = F.filter("atoms", lambda a: ~F.exists("atoms", lambda b: (F.size(b["terms"]) > F.size(a["terms"])) & (F.size(F.array_except(a["terms"], b["terms"])) == 0)))
    return rows.select("session_id", F.explode(kept).alias("a")).select("session_id", "a.category", "a.label", F.array_join("a.terms", " ").alias("terms"))


def _equivalents(spark: SparkSession) -> list:
    """(phrase, ord, replacement): every pair of the fixed tables in both directions, the longest phrase first, then by its first mention."""
    pairs = [*dims.SYNONYMS, *((short.upper(), long) for short, long in dims.ACRONYMS.items())]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "at int, a string, b string")
    both = rows.select("at", F.lower("a").alias("phrase"), F.col("b").alias("replacement"), F.lit(0).alias("side")).unionByName(rows.select("at", F.lower("b").alias("phrase"), F.col("a").alias("replacement"), F.lit(1).alias("side")))
    first = both.groupBy("phrase").agg(F.min(F.struct("at", "side")).alias("first"))
    place = F.dense_rank().over(Window.orderBy(F.desc(F.length("phrase")), "first"))
    return both.select("phrase", "replacement").distinct().join(first, "phrase").select("phrase", (place - 1).alias("ord"), "replacement").orderBy("ord", "replacement").collect()


def _with_synonyms(rows: DataFrame) -> DataFrame:
    """A row for each fixed phrase that a query has, with an equivalent of it."""
    fixed = F.array(*[F.struct(F.lit(x["phrase"]).alias("phrase"), F.lit(x["ord"]).alias("ord"), F.lit(x["replacement"]).alias("replacement")) for x in _equivalents(rows.sparkSession)])
    low = F.lower(F.col("query"))
    found = F.filter(fixed, lambda x: F.regexp_like(low, F.concat(F.lit(r"\b"), x["phrase"], F.lit(r"\b"))))
    return rows.select("session_id", "query", F.explode(found).alias("x")).select("session_id", "query", "x.*")


def synonyms(rows: DataFrame) -> DataFrame:
    """(session_id, rank_no, replacement): equivalents of the phrases in a query, longest phrase first, at most eight, none that it has already."""
    low = F.lower(F.coalesce("query", F.lit("")))
    rows = _with_synonyms(rows)
    rows = rows.where(~F.contains(low, F.lower("replacement"))).groupBy("session_id", F.lower("replacement").alias("key")).agg(F.min(F.struct("ord", "replacement")).alias("m"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("m"))
    return rows.withColumn("rank_no", rank).where("rank_no <= 8").select("session_id", "rank_no", F.col("m.replacement").alias("replacement"))


def synonym_variants(rows: DataFrame) -> DataFrame:
    """(session_id, rank_no, variant): at most two variants of a query, each with one phrase replaced by its first equivalent."""
    rows = _with_synonyms(rows)
    rows = rows.withColumn("variant", F.expr("trim(regexp_replace(regexp_replace(query, concat('(?i)\\\\b', phrase, '\\\\b'), replacement), '\\\\s+', ' '))")).where(F.lower("variant") != F.lower(T.squeezed(F.col("query"))))
    first = rows.groupBy("session_id", "ord").agg(F.min(F.struct("replacement", "variant"))["variant"].alias("variant"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("ord"))
    return first.withColumn("rank_no", rank).where("rank_no <= 2").select("session_id", "rank_no", "variant")


def q13_synonyms(spark: SparkSession, folder: str) -> DataFrame:
    return synonyms(_queries(spark, folder))


def q14_synonym_variants(spark: SparkSession, folder: str) -> DataFrame:
    return synonym_variants(_queries(spark, folder))


def q16_search_plan(spark: SparkSession, folder: str) -> DataFrame:
    """For each session, its distinct queries (two at most) times five hosts, in order, ten at most."""
    rows = attempts(spark, folder, "session_id", "query").groupBy("session_id", F.lower(T.squeezed(F.col("query"))).alias("variant")).agg(F.min("id").alias("first")).where("variant <> ''")
    rows = rows.withColumn("v", F.row_number().over(Window.partitionBy("session_id").orderBy("first"))).where("v <= 2")
    hosts = F.transform(F.array(*map(F.lit, dims.SEARCH_PLAN_HOSTS)), lambda h, i: F.struct(i.alias("i"), h.alias("host")))
    rows = rows.select("session_id", "v", "variant", F.explode(hosts).alias("h"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("v", "h.i"))
    return rows.withColumn("request_no", rank).where("request_no <= 10").select("session_id", "request_no", "variant", F.col("h.host").alias("host"))


def q17_patent_variants(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten words of a query of three letters or more, distinct after the cut."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce("query", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 3)
    return _queries(spark, folder).select("session_id", F.array_join(F.array_sort(F.array_distinct(F.slice(words, 1, 10))), " ").alias("words"))


def q18_publication_query(spark: SparkSession, folder: str) -> DataFrame:
    """At most twelve distinct terms without stop words, a closing s dropped from longer words."""
    words = F.filter(T.raw_tokens(F.col("query")), lambda w: (F.length(w) >= 3) & ~w.isin(*dims.STOPWORDS))
    cut = F.transform(words, lambda w: F.when((F.length(w) > 4) & F.endswith(w, F.lit("s")), F.left(w, F.length(w) - 1)).otherwise(w))
    return _queries(spark, folder).select("session_id", F.array_join(F.slice(F.array_distinct(cut), 1, 12), " ").alias("terms"))


def q19_planned_query(spark: SparkSession, folder: str) -> DataFrame:
    """The variant of the envelope that an attempt of each source would use, the last one when there are no more."""
    schema = "query_variants map<string,array<string>>"
    rows = sessions(spark, folder, "original_query", "query_envelope_json").withColumn("v", F.from_json("query_envelope_json", schema)["query_variants"])
    rows = rows.select("session_id", "original_query", F.explode(F.array(*map(F.lit, ("patent", "publication", "web")))).alias("source_type"), "v")
    variants = F.array_distinct(F.filter(F.concat(F.array("original_query"), F.coalesce(F.try_element_at("v", F.col("source_type")), F.array().cast("array<string>"))), lambda x: F.trim(x) != ""))
    return rows.withColumn("vs", variants).where(F.size("vs") > 0).select("session_id", "source_type", F.size("vs").alias("variants"), F.element_at("vs", F.least(F.lit(2), F.size("vs"))).alias("second"))


def q21_low_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Queries for which finding nothing says little: other than ASCII, or fourteen distinct terms or more."""
    return _queries(spark, folder).select("session_id", (F.col("query").rlike(r"[^\x00-\x7f]") | (F.size(F.array_distinct(T.raw_tokens(F.col("query")))) >= 14)).alias("low_confidence"))


def u01_canonical_url(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder, "url").select("id", U.canonical_url(F.col("url")).alias("canonical_url"))


def u02_identity_url(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder, "url").select("id", U.identity_url(F.col("url")).alias("identity_url"))


def u03_url_policy(spark: SparkSession, folder: str) -> DataFrame:
    rows = items(spark, folder, "url", "title")
    return rows.select("id", U.keep_web(F.col("url"), F.col("title")).alias("kept"))


def u04_domain_rank(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder, "url").select("id", U.domain_rank(F.col("url")).alias("domain_rank"), U.registrable(F.col("url")).alias("domain"))


def u05_patent_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder, "canonical_id", "url").select("id", U.patent_number(F.concat_ws(" ", "canonical_id", "url")).alias("patent_number"))


def u06_dedupe_keys(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder, "title").select("id", U.title_key(F.col("title")).alias("title_key"))


def u07_publication_identity(spark: SparkSession, folder: str) -> DataFrame:
    rows = items(spark, folder, "source_type", "canonical_id").where("source_type = 'patent'")
    number = F.regexp_replace(F.trim("canonical_id"), "^patent:", "")
    return rows.select("id", U.exact_number(number).alias("exact"), U.family_number(number).alias("family"))


def u11_promoted_level(spark: SparkSession, folder: str) -> DataFrame:
    """For each session and document the highest level of evidence in the order of promotion; the first of equals."""
    ranks = {level: i for i, level in enumerate(dims.PROMOTION)}
    rows = items(spark, folder, "session_id", "canonical_id", "evidence_level").where("trim(canonical_id) <> ''").withColumn("doc", F.lower(F.trim("canonical_id")))
    key = F.struct(case_rank(F.col("evidence_level"), ranks), -F.col("id"))
    return rows.groupBy("session_id", "doc").agg(F.max_by("evidence_level", key).alias("level"))


def u12_canonical_id(spark: SparkSession, folder: str) -> DataFrame:
    """The identifier in lower case, else the address, else the title, else a hash."""
    first = F.coalesce(*[F.expr(f"nullif(trim({c}), '')") for c in ("canonical_id", "url", "title")])
    return items(spark, folder, "canonical_id", "url", "title").select("id", F.coalesce(F.lower(first), U.sha_prefix(F.col("id").cast("string"), 24)).alias("canonical"))


def u13_example_id(spark: SparkSession, folder: str) -> DataFrame:
    """Identities of examples: one for each query, source and candidate."""
    rows = decisions(spark, folder, "query_fingerprint", "source_type", "candidate_identity")
    basis = F.concat_ws("\x1e", "query_fingerprint", F.lower(F.trim("source_type")), "candidate_identity")
    return rows.where("candidate_identity <> ''").groupBy(U.sha_prefix(basis, 32).alias("example")).agg(F.count("*").alias("decisions"))


def u16_document_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Identities of each item: pn: for a publication number, doi: for a DOI, url: for an address."""
    rows = items(spark, folder, "source_type", "canonical_id", "url")
    doi = F.regexp_extract(F.lower(F.coalesce("canonical_id", F.lit(""))), r"(10\.[0-9]{4,}/\S+)", 1)
    number = F.when(F.col("source_type") == "patent", F.lower(U.exact_number(F.regexp_replace(F.trim("canonical_id"), "^patent:", ""))))
    address = U.identity_url(F.col("url"))
    found = F.array_compact(F.array(F.when(number != "", F.concat(F.lit("pn:"), number)), F.when(doi != "", F.concat(F.lit("doi:"), doi)), F.when(address != "", F.concat(F.lit("url:"), address))))
    return rows.select("id", F.explode(found).alias("doc_id"))


def u18_level_weight(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder, "evidence_level").groupBy("evidence_level").agg(F.count("*").alias("n")).select("evidence_level", "n", U.level_weight(F.col("evidence_level")).alias("weight"), U.level_class(F.col("evidence_level")).alias("class"))


_IU = rf"""
iu AS (SELECT id, regexp_replace(regexp_replace(trim(coalesce(url, '')), '^https?://', '', 'i'), '^www\.', '', 'i') AS u FROM items),
ip AS (SELECT id, string_split(u, '#')[1] AS u FROM iu),
iq AS (SELECT id, string_split(u, '?')[1] AS p, CASE WHEN contains(u, '?') THEN substr(u, instr(u, '?') + 1) ELSE '' END AS q FROM ip),
ik AS (SELECT id, rtrim(lower(string_split(p, '/')[1]) || substr(p, length(string_split(p, '/')[1]) + 1), '/') AS p, list_filter(string_split(q, '&'), lambda x: x <> '' AND lower(string_split(x, '=')[1]) NOT IN ({S.quoted(dims.IDENTITY_TRACKING)})) AS l FROM iq),
ident AS (SELECT id, CASE WHEN len(l) > 0 THEN p || '?' || array_to_string(l, '&') ELSE p END AS identity_url FROM ik)"""
_PAIRS = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate([*dims.SYNONYMS, *((a.upper(), b) for a, b in dims.ACRONYMS.items())]))
_SYN = f"""pair AS (SELECT * FROM (VALUES {_PAIRS}) t(i, a, b)),
sides AS (SELECT lower(a) AS phrase, b AS replacement, 2 * i AS pos FROM pair UNION ALL SELECT lower(b), a, 2 * i + 1 FROM pair),
firsts AS (SELECT phrase, row_number() OVER (ORDER BY length(phrase) DESC, min(pos)) - 1 AS ord FROM sides GROUP BY phrase),
syn AS (SELECT DISTINCT phrase, ord, replacement FROM sides JOIN firsts USING (phrase))"""
_HOST_RANK = f"CASE WHEN h IN ({S.quoted(dims.PATENT_HOSTS)}) OR ends_with(h, '.patents.google.com') THEN 3 WHEN ends_with(h, '.gov') OR ends_with(h, '.edu') THEN 0 WHEN contains(h, 'docs.') OR contains(h, 'developer.') OR contains(h, 'support.') OR contains(h, 'github.io') THEN 1 ELSE 2 END"
_UNDER = " OR ".join(f"h = '{d}' OR ends_with(h, '.{d}')" for d in dims.MARKET_HOSTS)
_BLOCK = " OR ".join(f"ends_with(h, '{d}')" for d in dims.BLOCKED_HOSTS)
_STRIP = "f0"
for _ in range(3):
    for _p, _g in dims.FRAMING_BEFORE:
        _STRIP = f"ltrim(regexp_replace({_STRIP}, '{_p}', '{chr(92) + _g if _g else ''}', 'i'))"
    for _p in dims.FRAMING_AFTER:
        _STRIP = f"rtrim(regexp_replace({_STRIP}, '{_p}', '', 'i'))"
_STRIP = f"trim(trim(trim({_STRIP}), ',;:'))"

QUERIES = {f.__name__: f for f in (q02_normalized, q02_hash_of_plain_form, q03_query_hash, q04_envelope_terms, q05_ascii_language, q06_strip_framing, q09_consolidated_atoms, q13_synonyms, q14_synonym_variants, q16_search_plan, q17_patent_variants, q18_publication_query, q19_planned_query, q21_low_confidence, u01_canonical_url, u02_identity_url, u03_url_policy, u04_domain_rank, u05_patent_numbers, u06_dedupe_keys, u07_publication_identity, u11_promoted_level, u12_canonical_id, u13_example_id, u16_document_ids, u18_level_weight)}
ORACLE = {
    "q02_hash_of_plain_form": rf"SELECT session_id, sha256(lower({S.squeezed('original_query')})) AS plain_hash, NOT regexp_matches(coalesce(original_query, ''), '[^\x00-\x7f]') AS is_ascii FROM research_sessions",
    "q04_envelope_terms": rf"SELECT session_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(lower(original_query), '[\p{{L}}\p{{N}}_-]{{3,}}'), lambda t: trim(t, '_-')), lambda t: length(t) >= 3 AND t NOT IN ({S.quoted(dims.ENVELOPE_STOPWORDS)})))), ' ') AS terms FROM research_sessions",
    "q05_ascii_language": r"SELECT session_id, CASE WHEN regexp_matches(original_query, '[^\x00-\x7f]') THEN 'non_english' ELSE 'en' END AS language FROM research_sessions",
    "q06_strip_framing": f"WITH f AS (SELECT session_id, {S.squeezed('original_query')} AS f0 FROM research_sessions), g AS (SELECT session_id, f0, {_STRIP} AS s FROM f) SELECT session_id, CASE WHEN s = '' THEN f0 ELSE s END AS subject FROM g",
    "q09_consolidated_atoms": """
WITH j AS (SELECT session_id, try_cast(query_envelope_json AS JSON) AS e FROM research_sessions WHERE trim(query_envelope_json) <> ''),
a AS (SELECT session_id, unnest(from_json(e -> '$.critical_requirements_atomic', '[{"category":"VARCHAR","label":"VARCHAR","terms":["VARCHAR"]}]')) AS x FROM j),
n AS (SELECT session_id, x.category AS category, x.label AS label, list_sort(list_distinct(x.terms)) AS terms, row_number() OVER () AS i FROM a)
SELECT session_id, category, label, array_to_string(terms, ' ') AS terms FROM n WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.session_id = n.session_id AND len(b.terms) > len(n.terms) AND list_has_all(b.terms, n.terms))""",
    "q13_synonyms": rf"""
WITH {_SYN}, m AS (SELECT session_id, lower(replacement) AS key, min((ord, replacement)) AS m FROM research_sessions, syn WHERE regexp_matches(lower(original_query), '\b' || phrase || '\b') AND NOT contains(lower(original_query), lower(replacement)) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY m) AS rank_no FROM m) SELECT session_id, rank_no, m[2] AS replacement FROM r WHERE rank_no <= 8""",
    "q14_synonym_variants": rf"""
WITH {_SYN}, m AS (SELECT session_id, ord, replacement, trim(regexp_replace(regexp_replace(original_query, '\b' || phrase || '\b', replacement, 'gi'), '\s+', ' ', 'g')) AS variant, original_query FROM research_sessions, syn WHERE regexp_matches(lower(original_query), '\b' || phrase || '\b')),
f AS (SELECT session_id, ord, arg_min(variant, (replacement, variant)) AS variant FROM m WHERE lower(variant) <> lower({S.squeezed('original_query')}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS rank_no FROM f) SELECT session_id, rank_no, variant FROM r WHERE rank_no <= 2""",
    "q16_search_plan": f"""
WITH a AS (SELECT DISTINCT * FROM evidence_results), v AS (SELECT session_id, lower({S.squeezed('query')}) AS variant, min(id) AS first FROM a GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first) AS v FROM v WHERE variant <> ''), h AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{d}')" for i, d in enumerate(dims.SEARCH_PLAN_HOSTS))}) t(i, host)),
p AS (SELECT session_id, variant, host, row_number() OVER (PARTITION BY session_id ORDER BY v, i) AS request_no FROM r, h WHERE v <= 2) SELECT session_id, request_no, variant, host FROM p WHERE request_no <= 10""",
    "q17_patent_variants": "SELECT session_id, array_to_string(list_sort(list_distinct(list_slice(list_filter(regexp_extract_all(lower(coalesce(original_query, '')), '[a-z0-9]+'), lambda w: length(w) >= 3), 1, 10))), ' ') AS words FROM research_sessions",
    "q18_publication_query": f"""
WITH w AS (SELECT session_id, list_transform(list_filter({S.raw_tokens('original_query')}, lambda w: length(w) >= 3 AND w NOT IN ({S.quoted(dims.STOPWORDS)})), lambda w: CASE WHEN length(w) > 4 AND right(w, 1) = 's' THEN left(w, length(w) - 1) ELSE w END) AS l FROM research_sessions),
e AS (SELECT session_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM w), f AS (SELECT session_id, w, min(i) AS i FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY i) AS k FROM f),
g AS (SELECT session_id, string_agg(w, ' ' ORDER BY i) AS terms FROM r WHERE k <= 12 GROUP BY ALL) SELECT s.session_id, coalesce(terms, '') AS terms FROM research_sessions s LEFT JOIN g USING (session_id)""",
    "q19_planned_query": """
WITH j AS (SELECT session_id, original_query, try_cast(nullif(trim(query_envelope_json), '') AS JSON) AS e FROM research_sessions),
s AS (SELECT session_id, original_query, source_type, coalesce(from_json(e -> ('$.query_variants.' || source_type), '["VARCHAR"]'), []) AS v FROM j, (VALUES ('patent'), ('publication'), ('web')) t(source_type)),
c AS (SELECT session_id, source_type, list_filter(list_concat([original_query], v), lambda x: trim(x) <> '') AS l FROM s),
e AS (SELECT session_id, source_type, unnest(l) AS q, generate_subscripts(l, 1) AS i FROM c), f AS (SELECT session_id, source_type, q, min(i) AS i FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, source_type ORDER BY i) AS k, count(*) OVER (PARTITION BY session_id, source_type) AS n FROM f)
SELECT session_id, source_type, n AS variants, q AS second FROM r WHERE k = least(2, n)""",
    "q21_low_confidence": rf"SELECT session_id, regexp_matches(original_query, '[^\x00-\x7f]') OR len(list_distinct({S.raw_tokens('original_query')})) >= 14 AS low_confidence FROM research_sessions",
    "u01_canonical_url": f"""
WITH {S.ITEMS}, u AS (SELECT id, rtrim(trim(coalesce(url, '')), '.,;') AS u FROM items),
q AS (SELECT id, regexp_extract(u, '^([^?#]*)', 1) AS base, list_filter(string_split({S.query_part('u')}, '&'), lambda p: p <> '' AND lower(string_split(p, '=')[1]) NOT IN ({S.quoted(dims.URL_TRACKING)}) AND NOT starts_with(lower(string_split(p, '=')[1]), 'utm_')) AS l FROM u)
SELECT id, CASE WHEN len(l) > 0 THEN base || '?' || array_to_string(l, '&') ELSE base END AS canonical_url FROM q""",
    "u02_identity_url": f"WITH {S.ITEMS}, {_IU} SELECT id, identity_url FROM ident",
    "u03_url_policy": f"""
WITH {S.ITEMS}, h AS (SELECT id, {S.host('url')} AS h, {S.path('url')} AS p, title, list_transform(string_split({S.query_part('url')}, '&'), lambda x: lower(string_split(x, '=')[1])) AS names FROM items)
SELECT id, h <> '' AND NOT (((h IN ({S.quoted(dims.SEARCH_HOSTS)}) OR ends_with(h, 'google.com')) AND starts_with(lower(p), '/search')) OR regexp_matches(lower(p), '/(?:search|results)(?:/|$)')
  OR CASE WHEN {_UNDER} THEN NOT regexp_matches(p, '^/(?:dp/[a-z0-9]+(?:/|$)|gp/product/[a-z0-9]+(?:/|$)|itm/|listing/[0-9]+|ip/|product-detail/)', 'i') ELSE ends_with(rtrim(lower(p), '/'), '/s') AND list_has_any(names, ['k', 'q', 'query', 'search']) END)
  AND NOT ({_BLOCK}) AND NOT (h IN ({S.quoted(dims.PATENT_HOSTS)}) AND NOT contains(lower(coalesce(title, '')), 'patent')) AS kept FROM h""",
    "u04_domain_rank": rf"WITH {S.ITEMS}, h AS (SELECT id, {S.host('url')} AS h FROM items) SELECT id, {_HOST_RANK} AS domain_rank, regexp_replace(h, '^www\.', '') AS domain FROM h",
    "u05_patent_numbers": rf"WITH {S.ITEMS}, t AS (SELECT id, upper(concat_ws(' ', canonical_id, url)) AS t FROM items) SELECT id, coalesce(nullif(regexp_extract(t, '\b((?:US|EP|WO|CN|JP|KR)[0-9]{{4,}}[A-Z0-9]*)\b', 1), ''), 'Unknown') AS patent_number FROM t",
    "u06_dedupe_keys": f"WITH {S.ITEMS} SELECT id, trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) AS title_key FROM items",
    "u07_publication_identity": f"""
WITH {S.ITEMS}, n AS (SELECT id, upper(regexp_replace(coalesce(regexp_replace(trim(canonical_id), '^patent:', ''), ''), '[^A-Za-z0-9]', '', 'g')) AS n FROM items WHERE source_type = 'patent'), x AS (SELECT id, CASE WHEN n = 'UNKNOWN' THEN '' ELSE n END AS n FROM n)
SELECT id, n AS exact, regexp_replace(n, '([A-Z]{{2}}[0-9]{{4,}})[A-Z][0-9]?$', '\\1') AS family FROM x""",
    "u11_promoted_level": f"""
WITH {S.ITEMS}, p AS (SELECT id, session_id, lower(trim(canonical_id)) AS doc, evidence_level, CASE lower(trim(evidence_level)) {' '.join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(dims.PROMOTION))} ELSE -1 END AS r FROM items WHERE trim(canonical_id) <> '')
SELECT session_id, doc, level FROM (SELECT session_id, doc, evidence_level AS level, row_number() OVER (PARTITION BY session_id, doc ORDER BY r DESC, id) AS k FROM p) WHERE k = 1""",
    "u12_canonical_id": f"WITH {S.ITEMS} SELECT id, coalesce(lower(coalesce(nullif(trim(canonical_id), ''), nullif(trim(url), ''), nullif(trim(title), ''))), left(sha256(id::VARCHAR), 24)) AS canonical FROM items",
    "u13_example_id": "WITH d AS (SELECT DISTINCT * FROM evaluation_candidate_decisions) SELECT left(sha256(concat_ws(chr(30), query_fingerprint, lower(trim(source_type)), candidate_identity)), 32) AS example, count(*) AS decisions FROM d WHERE candidate_identity <> '' GROUP BY ALL",
    "u16_document_ids": rf"""
WITH {S.ITEMS}, {_IU}, n AS (SELECT i.id, CASE WHEN source_type = 'patent' THEN lower(regexp_replace(regexp_replace(trim(canonical_id), '^patent:', ''), '[^A-Za-z0-9]', '', 'g')) END AS pn, regexp_extract(lower(coalesce(canonical_id, '')), '(10\.[0-9]{{4,}}/\S+)', 1) AS doi, identity_url AS u FROM items i JOIN ident ON ident.id = i.id)
SELECT id, 'pn:' || pn AS doc_id FROM n WHERE pn <> '' AND pn <> 'unknown' UNION ALL SELECT id, 'doi:' || doi FROM n WHERE doi <> '' UNION ALL SELECT id, 'url:' || u FROM n WHERE u <> ''""",
    "u18_level_weight": f"WITH {S.ITEMS}, g AS (SELECT evidence_level, count(*) AS n FROM items GROUP BY ALL) SELECT evidence_level, n, {S.level_weight('evidence_level')} AS weight, {S.level_class('evidence_level')} AS class FROM g",
}
