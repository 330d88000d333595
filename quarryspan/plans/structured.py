"""Queries q01_, q10_, q11_, q15_, q20_, t10_, t16_, t25_, u08_, u09_, u14_, k02_, k06_, k07_, e02_, e04_, e06_, r06_: structured text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryspan import dims
from quarryspan.functions import ids as U
from quarryspan.functions import structured as X
from quarryspan.functions import text as T
from quarryspan.plans import identity as Q
from quarryspan.plans import sql as S
from quarryspan.plans.views import attempts, decisions, items, sessions
from quarryspan.sources import snapshots


def q01_coerced(spark: SparkSession, folder: str) -> DataFrame:
    """Queries wrapped as JSON, read back as text."""
    rows = sessions(spark, folder, "original_query").select("session_id", F.to_json(F.struct(F.struct(F.col("original_query").alias("query"), F.lit(3).alias("limit")).alias("input"))).alias("raw"))
    return rows.select("session_id", X.query_column("raw").alias("query"))


def q10_negations(spark: SparkSession, folder: str) -> DataFrame:
    """What a query excludes: up to four words after a negation."""
    low = F.lower(F.coalesce("original_query", F.lit("")))
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(low, F.lit(rf"\b{n}\s+(\w+(?:\s+\w+){{0,3}})"), F.lit(1)) for n in dims.NEGATIONS]))
    return sessions(spark, folder, "original_query").select("session_id", F.array_join(found, "|").alias("negative"))


def q11_atom_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Variants of a query: itself, and all labels of its requirements (32 words at most)."""
    schema = "critical_requirements_atomic array<struct<label:string>>"
    rows = sessions(spark, folder, "original_query", "query_envelope_json").withColumn("labels", F.array_join(F.transform(F.from_json("query_envelope_json", schema)["critical_requirements_atomic"], lambda a: a["label"]), " "))
    both = F.array(T.squeezed(F.col("original_query")), F.array_join(F.slice(T.word_list(F.col("labels")), 1, 32), " "))
    return rows.select("session_id", F.posexplode(F.array_distinct(F.filter(both, lambda v: v != ""))).alias("pos", "variant"))


def q15_plan_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Variants in a labelled section of a plan text made of a session's queries: ordered, distinct apart from case, two at most."""
    rows = attempts(spark, folder, "session_id", "query")
    plan = rows.groupBy("session_id").agg(F.concat(F.lit("NOTES: x\nPATENT_QUERIES:\n- "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "query"))), lambda x: T.squeezed(x["query"])), "\n- "), F.lit("\nWEB_QUERIES: y")).alias("plan"))
    lines = plan.select("session_id", F.posexplode(F.split("plan", "\n")).alias("pos", "line"))
    header = F.regexp_extract("line", r"^([A-Z][A-Z0-9_ -]{1,48}):", 1)
    section = F.last(F.when(header != "", header), ignorenulls=True).over(Window.partitionBy("session_id").orderBy("pos"))
    found = lines.withColumn("section", section).where((F.col("section") == "PATENT_QUERIES") & (header == "")).withColumn("variant", F.btrim(F.regexp_replace("line", r"^[-*]\s*", ""), F.lit(" .:-"))).where("variant <> ''")
    first = found.groupBy("session_id", F.lower("variant").alias("k")).agg(F.min("pos").alias("pos"))
    return first.withColumn("rank_no", F.row_number().over(Window.partitionBy("session_id").orderBy("pos"))).where("rank_no <= 2").select("session_id", "rank_no", F.col("k").alias("variant"))


def q20_envelope_hash(spark: SparkSession, folder: str) -> DataFrame:
    """A hash of the requirements of each envelope in canonical JSON."""
    atoms = F.get_json_object("query_envelope_json", "$.critical_requirements_atomic")
    return sessions(spark, folder, "query_envelope_json").select("session_id", F.substring(X.sha_column(atoms), 1, 32).alias("hash"))


def t10_unescaped(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder, "summary").select("id", F.length(X.unescaped(F.col("summary"))).alias("length"))


def t16_page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The date and main text of pages made of items, without their navigation."""
    rows = items(spark, folder, "summary", "created_at")
    html = F.concat(F.lit("<html><head><meta name='pubdate' content='"), F.date_format("created_at", "yyyy-MM-dd"), F.lit("'></head><nav>Menu and links that nobody reads at all</nav><main><p>"), F.regexp_replace(F.coalesce("summary", F.lit("")), "[<>&]", ""), F.lit("</p></main></html>"))
    return snapshots.page_texts(rows.select(F.col("id").cast("string").alias("id"), html.alias("html")), "id").select(F.col("key").alias("id"), "date", F.length("text").alias("length"))


def t25_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with secrets (key=value, bearer tokens, credentials in addresses) blotted out."""
    s = F.coalesce("url", F.lit(""))
    s = F.regexp_replace(s, r"(?i)(https?://)[^/\s:@]+:[^/\s@]+@", "$1***@")
    s = F.regexp_replace(s, r"(?i)\b(bearer|basic)\s+[A-Za-z0-9._~+/=-]+", "$1 ***")
    s = F.regexp_replace(s, r"(?i)\b(api[_-]?key|token|secret|password|utm_source)=[^&\s#]+", "$1=***")
    return items(spark, folder, "url").select("id", s.alias("url"))


def u08_header_publication(spark: SparkSession, folder: str) -> DataFrame:
    """The first publication number in the first 1,600 characters of what lies before a document's citations."""
    front = F.regexp_extract(F.concat_ws(" ", "canonical_id", "text"), r"(?is)^(.*?)(?:references cited|patent citations|similar documents|$)", 1)
    head = F.substring(front, 1, 1600)
    found = F.regexp_extract(head, r"(?i)(?:^|[^A-Za-z0-9])((?:US|EP|WO|DE|SK)[ -]*[0-9][0-9,./]*[ -]*(?:[A-Z][0-9]{0,2})?)(?:[^A-Za-z0-9]|$)", 1)
    from quarryspan.tables import load

    return load(spark, folder, "documents", "doc_id", "canonical_id", "text").select("doc_id", U.exact_number(found).alias("publication"))


def u09_identity_basis(spark: SparkSession, folder: str) -> DataFrame:
    """On what a patent's identity rests: its own number, its number in the text, its address, or nothing."""
    rows = items(spark, folder, "source_type", "canonical_id", "url", "title", "summary").where("source_type = 'patent'")
    number = U.exact_number(F.regexp_replace(F.trim("canonical_id"), "^patent:", ""))
    content = U.exact_number(F.concat_ws(" ", "title", "summary"))
    basis = F.when(number == "", "none").when(F.contains(content, number), "normalised_number_in_content").when(F.contains(U.exact_number(F.col("url")), U.family_number(number)), "canonical_url").otherwise("structured_lookup")
    return rows.groupBy(basis.alias("basis")).agg(F.count("*").alias("n"))


def u14_public_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses that may be fetched: http or https, no credentials, no private host, usual port."""
    u = F.trim(F.coalesce("url", F.lit("")))
    h = F.regexp_replace(U.host(F.col("url")), r":[0-9]+$", "")
    private = h.rlike(r"^(?:localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|0\.|\[)") | F.endswith(h, F.lit(".local")) | F.endswith(h, F.lit(".internal"))
    port = F.regexp_extract(U.host(F.col("url")), r":([0-9]+)$", 1)
    public = u.rlike(r"(?i)^https?://") & ~F.contains(U.host(F.col("url")), F.lit("@")) & (h != "") & F.contains(h, F.lit(".")) & ~private & port.isin("", "80", "443")
    return items(spark, folder, "url").select("id", public.alias("public"))


def k02_embedded_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads found again within text around them."""
    rows = attempts(spark, folder, "normalized_json").where("normalized_json <> ''")
    wrapped = F.concat(F.lit("result {broken: "), F.col("normalized_json"), F.lit(" } trailing"))
    return rows.select("id", F.get_json_object(X.object_column(wrapped), "$.status").alias("status"))


def k06_candidate_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates written as labelled blocks of text, texts of some hundred blocks at most, and parsed again."""
    rows = items(spark, folder, "session_id", "source_type", "title", "url").where("source_type = 'web' AND trim(url) <> ''")
    block = F.concat(F.lit("Title: "), T.squeezed(F.col("title")), F.lit("\nSource page URL: "), F.col("url"), F.lit("\nRank: "), F.col("id").cast("string"))
    # a hot session is as many texts as its rows need
    pages = rows.groupBy("session_id").agg(F.count("*").alias("n")).select("session_id", F.ceil(F.col("n") / 200).alias("pages"))
    texts = rows.join(pages, "session_id").groupBy("session_id", F.pmod(F.xxhash64("id"), F.col("pages")).alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("body"))
    blocks = texts.select("session_id", F.explode(F.split("body", r"\n\s*\n")).alias("b"))
    return blocks.select(F.regexp_extract("b", r"(?m)^Rank: (\d+)$", 1).cast("long").alias("id"), F.regexp_extract("b", r"(?m)^Source page URL: (.*)$", 1).alias("url"))


def k07_canonical_json(spark: SparkSession, folder: str) -> DataFrame:
    """The hash of each decision's payload in canonical JSON; null for what is no JSON."""
    return decisions(spark, folder, "payload_json").select("id", X.sha_column("payload_json").alias("hash"))


def e02_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions joined to the attempts and sessions that they belong to: examples with their number of events, and why others are excluded."""
    d = decisions(spark, folder, "example_id", "session_id", "run_id", "source_type", "dataset_eligible")
    runs = attempts(spark, folder, "run_id").where("run_id <> ''").select("run_id").distinct().withColumn("has_run", F.lit(True))
    known = sessions(spark, folder).select("session_id").distinct().withColumn("has_session", F.lit(True))
    rows = d.join(runs, "run_id", "left").join(known, "session_id", "left")
    reason = F.when(F.col("dataset_eligible") != 1, "not_eligible").when(F.col("has_session").isNull(), "no_session").when(F.col("has_run").isNull(), "no_run").otherwise("included")
    return rows.groupBy("source_type", reason.alias("outcome")).agg(F.count("*").alias("events"), F.countDistinct("example_id").alias("examples"))


def e04_projected_text(spark: SparkSession, folder: str) -> DataFrame:
    """The first and the last line of each document, with a mark for what lies between."""
    from quarryspan.plans.views import benchmark

    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    out = F.when(F.size(lines) <= 2, F.array_join(lines, "\n")).otherwise(F.concat(F.element_at(lines, 1), F.lit("\n[... "), (F.size(lines) - 2).cast("string"), F.lit(" lines omitted ...]\n"), F.element_at(lines, -1)))
    return benchmark(spark, folder).where("text IS NOT NULL").select("doc_id", F.when(F.size(lines) == 0, "").otherwise(out).alias("visible"))


def e06_locators(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the items with more than one address, which lack a single locator."""
    rows = items(spark, folder, "session_id", "canonical_id", "url").where("trim(canonical_id) <> '' AND trim(url) <> ''")
    out = rows.groupBy("session_id", F.lower(F.trim("canonical_id")).alias("doc")).agg(F.countDistinct(U.identity_url(F.col("url"))).alias("locators"))
    return out.where("locators > 1")


def r06_session_report(spark: SparkSession, folder: str) -> DataFrame:
    """The three best items of each session and source as lines of a report."""
    from quarryspan.operators.ranking import best_rows

    score = F.when(~F.isnan("relevance_score"), F.col("relevance_score"))
    rows = best_rows(items(spark, folder, "session_id", "source_type", "title", "relevance_score"), ["session_id", "source_type"], [score.desc_nulls_last(), F.asc("id")], 3)
    line = F.concat(F.lit("- "), F.col("source_type"), F.lit(" "), F.col("rank_no").cast("string"), F.lit(": "), T.squeezed(F.col("title")))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_type", "rank_no", line.alias("l")))), lambda x: x["l"]), "\n").alias("report"))


_A = "a AS (SELECT DISTINCT * FROM evidence_results)"
_D = "d AS (SELECT DISTINCT * FROM evaluation_candidate_decisions)"
_NUM = "upper(regexp_replace(coalesce({}, ''), '[^A-Za-z0-9]', '', 'g'))"
QUERIES = {f.__name__: f for f in (q01_coerced, q10_negations, q11_atom_variants, q15_plan_sections, q20_envelope_hash, t10_unescaped, t16_page_texts, t25_redacted, u08_header_publication, u09_identity_basis, u14_public_urls, k02_embedded_objects, k06_candidate_blocks, k07_canonical_json, e02_bundle, e04_projected_text, e06_locators, r06_session_report)}
ORACLE = {
    "u08_header_publication": rf"""
WITH f AS (SELECT doc_id, left(regexp_extract(concat_ws(' ', canonical_id, text), '(?is)^(.*?)(?:references cited|patent citations|similar documents|$)', 1), 1600) AS head FROM documents),
n AS (SELECT doc_id, upper(regexp_replace(regexp_extract(head, '(?i)(?:^|[^A-Za-z0-9])((?:US|EP|WO|DE|SK)[ -]*[0-9][0-9,./]*[ -]*(?:[A-Z][0-9]{{0,2}})?)(?:[^A-Za-z0-9]|$)', 1), '[^A-Za-z0-9]', '', 'g')) AS n FROM f)
SELECT doc_id, CASE WHEN n = 'UNKNOWN' THEN '' ELSE n END AS publication FROM n""",
    "e06_locators": f"""
WITH {S.ITEMS}, {Q._IU} SELECT session_id, lower(trim(canonical_id)) AS doc, count(DISTINCT identity_url) AS locators FROM items JOIN ident USING (id) WHERE trim(canonical_id) <> '' AND trim(url) <> '' GROUP BY ALL HAVING count(DISTINCT identity_url) > 1""",
    "q10_negations": f"SELECT session_id, array_to_string(list_transform(list_filter(l, lambda x, i: NOT list_contains(l[1:i - 1], x)), lambda x: x), '|') AS negative FROM (SELECT session_id, {' || '.join(f"regexp_extract_all(lower(coalesce(original_query, '')), '" + chr(92) + f"b{n}" + chr(92) + "s+(" + chr(92) + "w+(?:" + chr(92) + "s+" + chr(92) + "w+){0,3})', 1)" for n in dims.NEGATIONS)} AS l FROM research_sessions)",
    "q11_atom_variants": f"""
WITH j AS (SELECT session_id, original_query, from_json(try_cast(nullif(trim(query_envelope_json), '') AS JSON) -> '$.critical_requirements_atomic', '[{{"label":"VARCHAR"}}]') AS l FROM research_sessions),
l AS (SELECT session_id, {S.squeezed('original_query')} AS a, coalesce(array_to_string(list_transform(l, lambda x: x.label), ' '), '') AS labels FROM j),
v AS (SELECT session_id, a, array_to_string(list_slice({S.words('labels')}, 1, 32), ' ') AS b FROM l)
SELECT session_id, 0 AS pos, a AS variant FROM v WHERE a <> '' UNION ALL SELECT session_id, CASE WHEN a = '' THEN 0 ELSE 1 END, b FROM v WHERE b <> '' AND b <> a""",
    "q15_plan_sections": f"""
WITH {_A}, v AS (SELECT session_id, lower(trim({S.squeezed('query')}, ' .:-')) AS variant, min(id) AS pos FROM a GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS rank_no FROM v WHERE variant <> '') SELECT session_id, rank_no, variant FROM r WHERE rank_no <= 2""",
    "t25_redacted": rf"WITH {S.ITEMS} SELECT id, regexp_replace(regexp_replace(regexp_replace(coalesce(url, ''), '(https?://)[^/\s:@]+:[^/\s@]+@', '\1***@', 'gi'), '\b(bearer|basic)\s+[A-Za-z0-9._~+/=-]+', '\1 ***', 'gi'), '\b(api[_-]?key|token|secret|password|utm_source)=[^&\s#]+', '\1=***', 'gi') AS url FROM items",
    "u09_identity_basis": rf"""
WITH {S.ITEMS}, n AS (SELECT CASE WHEN {_NUM.format("regexp_replace(trim(canonical_id), '^patent:', '')")} = 'UNKNOWN' THEN '' ELSE {_NUM.format("regexp_replace(trim(canonical_id), '^patent:', '')")} END AS n, {_NUM.format("concat_ws(' ', title, summary)")} AS c, {_NUM.format('url')} AS u FROM items WHERE source_type = 'patent')
SELECT CASE WHEN n = '' THEN 'none' WHEN contains(c, n) THEN 'normalised_number_in_content' WHEN contains(u, regexp_replace(n, '([A-Z]{{2}}[0-9]{{4,}})[A-Z][0-9]?$', '\1')) THEN 'canonical_url' ELSE 'structured_lookup' END AS basis, count(*) AS n FROM n GROUP BY 1""",
    "u14_public_urls": rf"""
WITH {S.ITEMS}, h AS (SELECT id, trim(coalesce(url, '')) AS u, {S.host('url')} AS full_host FROM items), p AS (SELECT *, regexp_replace(full_host, ':[0-9]+$', '') AS h, regexp_extract(full_host, ':([0-9]+)$', 1) AS port FROM h)
SELECT id, regexp_matches(u, '^https?://', 'i') AND NOT contains(full_host, '@') AND h <> '' AND contains(h, '.') AND NOT (regexp_matches(h, '^(?:localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|0\.|\[)') OR ends_with(h, '.local') OR ends_with(h, '.internal')) AND port IN ('', '80', '443') AS public FROM p""",
    "k02_embedded_objects": f"WITH {_A} SELECT id, try_cast(normalized_json AS JSON) ->> '$.status' AS status FROM a WHERE normalized_json <> ''",
    "k06_candidate_blocks": f"WITH {S.ITEMS} SELECT id, url FROM items WHERE source_type = 'web' AND trim(url) <> ''",
    "e02_bundle": f"""
WITH {_A}, {_D}, r AS (SELECT DISTINCT run_id FROM a WHERE run_id <> ''), s AS (SELECT DISTINCT session_id FROM research_sessions)
SELECT d.source_type, CASE WHEN dataset_eligible <> 1 THEN 'not_eligible' WHEN s.session_id IS NULL THEN 'no_session' WHEN r.run_id IS NULL THEN 'no_run' ELSE 'included' END AS outcome, count(*) AS events, count(DISTINCT example_id) AS examples
FROM d LEFT JOIN r ON r.run_id = d.run_id LEFT JOIN s ON s.session_id = d.session_id GROUP BY 1, 2""",
    "e04_projected_text": r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN len(l) <= 2 THEN array_to_string(l, chr(10)) ELSE l[1] || chr(10) || '[... ' || (len(l) - 2) || ' lines omitted ...]' || chr(10) || l[-1] END AS visible FROM l""",
    "r06_session_report": f"""
WITH {S.ITEMS}, r AS (SELECT session_id, source_type, title, row_number() OVER (PARTITION BY session_id, source_type ORDER BY CASE WHEN isnan(relevance_score) THEN NULL ELSE relevance_score END DESC NULLS LAST, id) AS k FROM items)
SELECT session_id, string_agg('- ' || source_type || ' ' || k || ': ' || {S.squeezed('title')}, chr(10) ORDER BY source_type, k) AS report FROM r WHERE k <= 3 GROUP BY ALL""",
}
