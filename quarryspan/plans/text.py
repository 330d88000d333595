"""Queries t01_.. to t27_..: text functions over the documents and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryspan import dims
from quarryspan.functions import text as T
from quarryspan.plans import sql as S
from quarryspan.plans.views import benchmark, items, pool


def _set(lst: Column) -> Column:
    return F.array_join(F.array_sort(lst), " ")


def t01_stems(spark: SparkSession, folder: str) -> DataFrame:
    """How often each word occurs, with its stem."""
    words = benchmark(spark, folder).select(F.explode(T.raw_tokens(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).select("word", T.stem(F.col("word")).alias("stem"), "n")


def t02_token_sets(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark(spark, folder).select("doc_id", _set(T.tokens(F.col("text"))).alias("tokens"))


def t03_discriminative(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark(spark, folder).select("doc_id", _set(T.discriminative(T.tokens(F.col("text")))).alias("tokens"))


def t04_subject_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark(spark, folder).select("doc_id", _set(T.subject_anchors(T.tokens(F.col("text")))).alias("anchors"))


def t05_blob_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark(spark, folder).select("doc_id", _set(T.blob_tokens(F.col("text"))).alias("blob"))


TERMS = ["charging docks", "pressure", "log", "spring-loaded"]


def t06_match_strength(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark(spark, folder).select("doc_id", T.match_strength(TERMS, F.col("text")).alias("strength"))


def t07_coverage_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark(spark, folder).select("doc_id", T.coverage_tokens(F.col("text")).alias("tokens"))


def t08_trim_words(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark(spark, folder).select("doc_id", T.trim_words(F.col("text"), 60).alias("snippet"))


def t11_collapse_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated words and phrases collapsed; back-references have no counterpart in the SQL engine."""
    return items(spark, folder, "summary").select("id", T.collapse_repeats(F.col("summary")).alias("summary"))


def t12_without_title(spark: SparkSession, folder: str) -> DataFrame:
    rows = items(spark, folder, "title", "summary")
    return rows.select("id", T.strip_leading_title(F.concat_ws(" ", "title", "summary"), F.col("title")).alias("body"))


def t12_boilerplate(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder, "summary").select("id", T.strip_boilerplate(F.col("summary")).alias("body"))


def t14_abstract_excerpt(spark: SparkSession, folder: str) -> DataFrame:
    """The best sentences within a budget of words; the greedy budget has no counterpart in SQL."""
    return pool(spark, folder, every=True).select("id", T.abstract_excerpt(F.col("summary"), T.tokens(F.col("query"))).alias("excerpt"))


def t15_compact_content(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences with most terms of the query; look-behind has no counterpart in the SQL engine."""
    return pool(spark, folder, every=True).select("id", T.compact_content(F.col("summary"), T.web_terms(F.col("query")), 450, 8).alias("excerpt"))


def t17_content_flags(spark: SparkSession, folder: str) -> DataFrame:
    flags = T.content_flags(F.col("summary"))
    return items(spark, folder, "summary").select("id", *[flags[k].alias(k) for k in ("is_error", "has_content", "is_limited")])


def t18_substantive(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with twelve or more words of letters, eight or more of them different."""
    words = F.regexp_extract_all(F.lower(F.coalesce("summary", F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    return items(spark, folder, "summary").select("id", ((F.size(words) >= 12) & (F.size(F.array_distinct(words)) >= 8)).alias("substantive"))


def t20_word_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of 500 words at most: whole lines as long as they fit, then the beginning of the next one with three dots."""
    return benchmark(spark, folder).select("doc_id", F.sha2(T.trim_lines(F.col("text"), 500), 256).alias("body_hash"))


def t21_cut_at_marker(spark: SparkSession, folder: str) -> DataFrame:
    """Texts without a tail of serialised JSON, from the first marker of the list (in its order) that lies within them, and without punctuation around."""
    return items(spark, folder, "summary").select("id", T.without_json_tail(F.col("summary")).alias("body"))


def t26_provider_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of providers by their type only, with their number."""
    from quarryspan.plans.views import attempts

    rows = attempts(spark, folder, "error_type").where("error_type <> ''")
    return rows.groupBy(F.concat(F.lit("error: "), F.lower("error_type")).alias("message")).agg(F.count("*").alias("n"))


def t27_web_coverage(spark: SparkSession, folder: str) -> DataFrame:
    rows = pool(spark, folder).where("source_type = 'web'")
    terms = T.web_terms(F.col("query"))
    n = F.size(terms)
    return rows.select("id", n.alias("terms"), T.substring_coverage(terms, F.col("text")).alias("covered"), F.greatest(F.lit(3), F.least(F.lit(6), ((n + 1) / 2).cast("int"))).alias("required"))


_TOK = S.tokens("text")
_BLOB = f"list_distinct(list_concat({S.raw_tokens('text')}, list_transform({S.raw_tokens('text')}, lambda t: {S.requirement_stem('t')})))"


def _matches(term: str) -> str:
    import re

    parts = re.findall("[a-z0-9]+", term)
    each = " AND ".join(f"(list_contains(blob, '{p}') OR list_contains(blob, {S.requirement_stem(chr(39) + p + chr(39))}))" for p in parts)
    return f"(({each})" + (f" OR contains(joined, '{''.join(parts)}'))" if len(parts) > 1 else ")")


QUERIES = {f.__name__: f for f in (t01_stems, t02_token_sets, t03_discriminative, t04_subject_anchors, t05_blob_tokens, t06_match_strength, t07_coverage_tokens, t08_trim_words, t11_collapse_repeats, t12_without_title, t12_boilerplate, t14_abstract_excerpt, t15_compact_content, t17_content_flags, t18_substantive, t20_word_budget, t21_cut_at_marker, t26_provider_errors, t27_web_coverage)}
_MARK = [m.replace("'", "''") for m in dims.JSON_TAIL]
_CUT = " ".join(f"WHEN instr(coalesce(summary, ''), '{m}') > 1 THEN left(coalesce(summary, ''), instr(coalesce(summary, ''), '{m}') - 1)" for m in _MARK)
_N = " + ".join(f"CAST({_matches(t)} AS INT)" for t in TERMS)
_WEB = f"list_filter(list_distinct(regexp_extract_all(lower(coalesce(query, '')), '[a-z0-9][a-z0-9-]{{3,}}')), lambda t: t NOT IN ({S.quoted(dims.WEB_STOPWORDS)}))"
_PLAIN = "coalesce(summary, '')"
for _pattern in dims.BOILERPLATE:
    _PLAIN = f"regexp_replace({_PLAIN}, '{_pattern}', ' ', 'g')"
ORACLE = {
    "t12_boilerplate": rf"WITH {S.ITEMS} SELECT id, trim(regexp_replace({_PLAIN}, '\s+', ' ', 'g'), ' .,;:|-–—') AS body FROM items",
    "t01_stems": f"SELECT word, {S.derived('sing')} AS stem, n FROM (SELECT word, {S.singular('word')} AS sing, count(*) AS n FROM (SELECT unnest({S.raw_tokens('text')}) AS word FROM documents) GROUP BY ALL)",
    "t02_token_sets": f"SELECT doc_id, {S.sorted_text(_TOK)} AS tokens FROM documents",
    "t03_discriminative": f"SELECT doc_id, {S.sorted_text(S.discriminative(_TOK))} AS tokens FROM documents",
    "t04_subject_anchors": f"SELECT doc_id, {S.sorted_text(f'list_filter({_TOK}, lambda t: NOT {S.mechanism(chr(116))})')} AS anchors FROM documents",
    "t05_blob_tokens": f"SELECT doc_id, {S.sorted_text(_BLOB)} AS blob FROM documents",
    "t06_match_strength": f"WITH b AS (SELECT doc_id, {_BLOB} AS blob, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '', 'g') AS joined FROM documents), c AS (SELECT doc_id, {_N} AS n FROM b) SELECT doc_id, CASE WHEN n = {len(TERMS)} THEN 'full' WHEN n > 0 THEN 'partial' ELSE 'none' END AS strength FROM c",
    "t07_coverage_tokens": """
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9-]{1,}') AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM t), f AS (SELECT doc_id, w, min(i) AS i FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f),
g AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS tokens FROM r WHERE k <= 2500 GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.tokens, '') AS tokens FROM documents d LEFT JOIN g USING (doc_id)""",
    "t08_trim_words": f"SELECT doc_id, {S.trim_words('text', 60)} AS snippet FROM documents",
    "t12_without_title": rf"""
WITH {S.ITEMS}, b AS (SELECT id, {S.squeezed("concat_ws(' ', title, summary)")} AS body, {S.squeezed('title')} AS head FROM items)
SELECT id, CASE WHEN length(head) >= 8 AND starts_with(lower(body), lower(head)) THEN ltrim(substr(body, length(head) + 1), ' .,:;–—-|') ELSE body END AS body FROM b""",
    "t17_content_flags": rf"""
WITH {S.ITEMS}, b AS (SELECT id, lower({S.squeezed('summary')}) AS s FROM items)
SELECT id, regexp_matches(s, '\b(?:403 forbidden|404 not found|target url returned error 40[34])\b') AS is_error,
  CASE WHEN s = '' THEN 0 ELSE len(string_split(s, ' ')) END >= 12 AS has_content,
  regexp_matches(s, 'captcha|access denied|forbidden|temporarily blocked|automated queries') AS is_limited FROM b""",
    "t18_substantive": rf"WITH {S.ITEMS}, w AS (SELECT id, regexp_extract_all(lower(coalesce(summary, '')), '\p{{L}}+') AS l FROM items) SELECT id, len(l) >= 12 AND len(list_distinct(l)) >= 8 AS substantive FROM w",
    "t20_word_budget": rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
w AS (SELECT *, regexp_extract_all(line, '[^ \t\n\x0b\f\r]+') AS t FROM l), r AS (SELECT *, sum(len(t)) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM w),
f AS (SELECT doc_id, max(used) AS total, min(CASE WHEN used > 500 THEN i END) AS over FROM r GROUP BY ALL),
p AS (SELECT r.doc_id, i, CASE WHEN used <= 500 THEN line ELSE rtrim(array_to_string(list_slice(t, 1, (500 - (used - len(t)))::BIGINT), ' '), ' .,;') || '...' END AS line, used, used - len(t) AS before, total FROM r JOIN f USING (doc_id) WHERE total <= 500 OR i < over OR (i = over AND rtrim(array_to_string(list_slice(t, 1, (500 - (used - len(t)))::BIGINT), ' '), ' .,;') <> ''))
SELECT d.doc_id, sha256(rtrim(coalesce(b.body, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS body_hash FROM documents d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS body FROM p GROUP BY ALL) b USING (doc_id)""",
    "t21_cut_at_marker": rf"""WITH {S.ITEMS}, c AS (SELECT id, trim(CASE {_CUT} ELSE coalesce(summary, '') END, ' ,{{}}[]''"\') AS t FROM items) SELECT id, {S.squeezed('t')} AS body FROM c""",
    "t26_provider_errors": "SELECT 'error: ' || lower(error_type) AS message, count(*) AS n FROM (SELECT DISTINCT * FROM evidence_results) WHERE error_type <> '' GROUP BY ALL",
    "t27_web_coverage": f"""
WITH {S.POOL}, t AS (SELECT id, text, {_WEB} AS l FROM pool WHERE source_type = 'web')
SELECT id, len(l) AS terms, len(list_filter(l, lambda x: contains(lower(text), x))) AS covered, greatest(3, least(6, (len(l) + 1) // 2)) AS required FROM t""",
}
