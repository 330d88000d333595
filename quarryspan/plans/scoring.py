"""Queries a01_.. to a04_.., f01_.. to f07_.., w04_, d04_, st05_: scores, gates and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryspan import dims
from quarryspan.functions import text as T
from quarryspan.operators import scoring as O
from quarryspan.operators.ranking import best_rows
from quarryspan.plans import sql as S
from quarryspan.plans.views import pool
from quarryspan.session import cut

KEY = O.POOL_KEY


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return O.scored(pool(spark, folder, "evidence_level"))


def a01_idf(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of the query's tokens in each pool."""
    return O.pool_weights(O.tokenised(pool(spark, folder))).select(*KEY, "token", "n", "df", T.rounded(F.col("weight"), 6).alias("weight"))


def a02_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("id", "nq", "shared", "long", "score")


def a03_level_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("id", "level_score")


def a04_phrase_score(spark: SparkSession, folder: str) -> DataFrame:
    return pool(spark, folder).where("source_type = 'patent'").select("id", O.phrase_score(F.col("query"), F.col("text")).alias("phrase_score"))


def w04_salient(spark: SparkSession, folder: str) -> DataFrame:
    return O.pool_weights(O.tokenised(pool(spark, folder))).where("salient").select(*KEY, "token")


def f01_relevant(spark: SparkSession, folder: str) -> DataFrame:
    """The gate that each candidate fails first, or accepted."""
    return O.gates(_scored(spark, folder)).select("id", "reason")


def f02_web_gate(spark: SparkSession, folder: str) -> DataFrame:
    need = F.greatest(F.lit(1), F.least(F.lit(5), ((F.col("nq") + 1) / 2).cast("int")))
    return _scored(spark, folder).where("source_type = 'web'").select("id", ((F.col("nq") > 0) & (F.col("shared") >= need) & (F.col("score") >= dims.WEB_GATE)).alias("kept"))


def f03_shares_discriminative(spark: SparkSession, folder: str) -> DataFrame:
    rows = O.tokenised(pool(spark, folder))
    return rows.select("id", ((F.size("d") == 0) | F.arrays_overlap("d", "shared")).alias("shares"))


def f04_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """All patents on the topic under the threshold of their session, by three tiers, the last one where none passes the others."""
    rows = _scored(spark, folder).where("source_type = 'patent'").where(O.on_topic()).select("session_id", "id", "score")
    return O.tiered(rows, ["session_id"], floor=True).select("session_id", "id", "score", "threshold")


def f05_publication_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Publications above their gate, best first, at most twenty a session."""
    rows = O.gates(_scored(spark, folder)).where(f"source_type = 'publication' AND reason = 'accepted' AND score >= {dims.PUBLICATION_GATE}")
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank_no", rank).where("rank_no <= 20").select("session_id", "rank_no", "id", "score")


def d04_fill_back(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted publications; where fewer than three, the best rejected ones up to three."""
    rows = O.gates(_scored(spark, folder)).where("source_type = 'publication'").withColumn("kept", F.col("reason") == "accepted").select("session_id", "id", "score", "kept")
    rows = cut(O.with_totals(rows, ["session_id"], n=F.count_if("kept")))
    # three rejected ones of a session at most are ranked, which a partial limit leaves of each task's rows
    rejected = best_rows(rows.where("NOT kept AND n < 3"), ["session_id"], [F.desc("score"), F.asc("id")], 3).where("rank_no <= 3 - n")
    return rows.where("kept").select("session_id", "id", "score", "kept").unionByName(rejected.select("session_id", "id", "score", "kept"))


def d03_restore_all(spark: SparkSession, folder: str) -> DataFrame:
    """Web candidates accepted by the gates; all of a session where none is."""
    rows = O.gates(_scored(spark, folder)).where("source_type = 'web'").withColumn("kept", F.col("reason") == "accepted")
    return O.with_totals(rows, ["session_id"], n=F.count_if("kept")).where("kept OR n = 0").select("session_id", "id", "kept")


def st05_lineage(spark: SparkSession, folder: str) -> DataFrame:
    """How many candidates each gate kept or rejected, by source: the lineage of all decisions."""
    rows = O.gates(_scored(spark, folder))
    return rows.groupBy("source_type", "reason").agg(F.count("*").alias("n"), F.sum(F.rint(F.col("score") * 100).cast("long")).alias("score_cents"))


_W = f"""{S.POOL},
tok AS (SELECT *, {S.tokens('query')} AS q, {S.tokens('text')} AS t FROM pool),
base AS (SELECT *, list_filter(q, lambda x: list_contains(t, x)) AS shared, {S.discriminative('q')} AS d FROM tok),
df AS (SELECT session_id, source_type, token, count(*) AS df FROM (SELECT session_id, source_type, unnest(shared) AS token FROM base) GROUP BY ALL),
size AS (SELECT session_id, source_type, any_value(q) AS q, any_value(len(d)) AS nd, count(*) FILTER (trim(regexp_replace(text, '\\s', '', 'g')) <> '') AS n FROM base GROUP BY ALL),
asked AS (SELECT session_id, source_type, n, nd, unnest(q) AS token FROM size),
w0 AS (SELECT a.*, coalesce(f.df, 0) AS df, length(token) >= 3 AND token NOT IN ({S.quoted(dims.BROAD)}) AS telling,
  CASE WHEN n < 3 OR f.df IS NULL THEN 1.0::DOUBLE ELSE ln(1.0 + n / (1.0 + f.df)) END AS weight FROM asked a LEFT JOIN df f USING (session_id, source_type, token)),
w AS (SELECT *, (telling OR nd = 0) AND n >= 3 AND row_number() OVER (PARTITION BY session_id, source_type, telling OR nd = 0 ORDER BY weight DESC, token) <= 6 AS salient FROM w0)"""
_BONUS = " ".join(f"WHEN source_type = '{k}' AND list_has_any(t, [{S.quoted(v)}]) THEN {0.3 if k == 'web' else 0.5}" for k, v in dims.STRUCTURAL.items())
_SC = f"""{_W},
tot AS (SELECT session_id, source_type, sum(weight) AS total, count(*) FILTER (salient) AS n_salient FROM w GROUP BY ALL),
b AS (SELECT session_id, source_type, id, evidence_level, len(q) AS nq, len(t) AS nt, len(d) AS nd, list_filter(d, lambda x: NOT {S.mechanism('x')}) AS a, shared, d, CASE {_BONUS} ELSE 0 END AS bonus FROM base),
got AS (SELECT id, sum(weight) AS matched, count(*) FILTER (salient) AS salient FROM (SELECT id, session_id, source_type, unnest(shared) AS token FROM b) JOIN w USING (session_id, source_type, token) GROUP BY ALL),
r AS (SELECT b.session_id, b.source_type, b.id, evidence_level, nq, nt, nd, len(a) AS na, len(shared) AS shared, len(list_filter(shared, lambda x: list_contains(d, x))) AS disc, len(list_filter(shared, lambda x: list_contains(a, x))) AS anchor,
  len(list_filter(shared, lambda x: length(x) >= 6)) AS long, coalesce(salient, 0) AS salient, coalesce(n_salient, 0) AS n_salient, coalesce(matched, 0) / total * 8.0 + bonus + least(len(list_filter(shared, lambda x: length(x) >= 6)) * 0.3, 1.0) AS raw
  FROM b LEFT JOIN got ON got.id = b.id LEFT JOIN tot ON tot.session_id = b.session_id AND tot.source_type = b.source_type),
s AS (SELECT *, CASE WHEN nq = 0 OR nt = 0 THEN 0 ELSE round_even(greatest(0.0, least(raw, 10.0)), 2) END AS score,
  CASE WHEN nq = 0 OR nt = 0 THEN 0 ELSE round_even(greatest(0.0, least(raw * {S.level_weight('evidence_level')}, 10.0)), 2) END AS level_score FROM r),
g AS (SELECT *, CASE
  WHEN source_type = 'publication' AND nq >= 4 AND shared < CASE WHEN nq >= 6 THEN 3 ELSE 2 END THEN 'below_overlap_gate'
  WHEN source_type = 'publication' AND nd > 0 AND disc < least(nd, greatest(2, least(3, (nd + 1) // 2))) THEN 'no_discriminative_term'
  WHEN source_type = 'publication' AND na > 0 AND anchor = 0 THEN 'no_subject_anchor'
  WHEN n_salient > 0 AND salient = 0 THEN 'no_salient_term'
  WHEN score < CASE source_type WHEN 'patent' THEN 3.0 WHEN 'publication' THEN 3.0 WHEN 'web' THEN 2.8 END THEN 'below_threshold' ELSE 'accepted' END AS reason FROM s)"""

_GRAMS = " ".join(f"WHEN len(w) >= {k} AND len(list_filter(list_transform(range(1, greatest(len(w) - {k} + 1, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + {k} - 1), ' ')), lambda x: contains(low, x))) > 0 THEN {k} / len(w)" for k in (5, 4, 3, 2))

QUERIES = {f.__name__: f for f in (a01_idf, a02_scores, a03_level_scores, a04_phrase_score, w04_salient, f01_relevant, f02_web_gate, f03_shares_discriminative, f04_tiers, f05_publication_filter, d03_restore_all, d04_fill_back, st05_lineage)}
ORACLE = {
    "a01_idf": f"WITH {_W} SELECT session_id, source_type, token, n, df, round_even(weight, 6) AS weight FROM w",
    "a02_scores": f"WITH {_SC} SELECT id, nq, shared, long, score FROM s",
    "a03_level_scores": f"WITH {_SC} SELECT id, level_score FROM s",
    "a04_phrase_score": f"""
WITH {S.POOL}, p AS (SELECT id, lower(text) AS low, lower(coalesce(query, '')) AS q FROM pool WHERE source_type = 'patent'),
t AS (SELECT *, list_filter(string_split(trim(regexp_replace(q, '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 3) AS w FROM p)
SELECT id, round_even(least(1.5, least(1.2, 0.4 * len(list_filter(list_distinct(w), lambda x: contains(low, x))))
  + CASE WHEN len(list_filter(list_filter(list_transform(regexp_split_to_array(q, '[,;|]'), lambda x: trim(x)), lambda x: length(x) >= 6), lambda x: contains(low, x))) > 0 THEN 1.0 {_GRAMS} ELSE 0 END), 2) AS phrase_score FROM t""",
    "w04_salient": f"WITH {_W} SELECT session_id, source_type, token FROM w WHERE salient",
    "f01_relevant": f"WITH {_SC} SELECT id, reason FROM g",
    "f02_web_gate": f"WITH {_SC} SELECT id, nq > 0 AND shared >= greatest(1, least(5, (nq + 1) // 2)) AND score >= 5.0 AS kept FROM s WHERE source_type = 'web'",
    "f03_shares_discriminative": f"WITH {_W} SELECT id, len(d) = 0 OR list_has_any(d, t) AS shares FROM base",
    "f04_tiers": f"""
WITH {_SC}, p AS (SELECT session_id, id, score FROM s WHERE source_type = 'patent' AND (nd = 0 OR disc > 0)),
t AS (SELECT session_id, count(*) FILTER (score >= 2.8) AS a, count(*) FILTER (score >= 2.2) AS b FROM p GROUP BY ALL),
k AS (SELECT session_id, CASE WHEN b = 0 THEN 1.5 WHEN a < 3 AND b > a THEN 2.2 ELSE 2.8 END::DOUBLE AS threshold FROM t)
SELECT session_id, id, score, threshold FROM p JOIN k USING (session_id) WHERE score >= threshold""",
    "f05_publication_filter": f"""
WITH {_SC}, o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, id) AS rank_no FROM g WHERE source_type = 'publication' AND reason = 'accepted' AND score >= 3.5)
SELECT session_id, rank_no, id, score FROM o WHERE rank_no <= 20""",
    "d03_restore_all": f"WITH {_SC}, o AS (SELECT session_id, id, reason = 'accepted' AS kept, count(*) FILTER (reason = 'accepted') OVER (PARTITION BY session_id) AS n FROM g WHERE source_type = 'web') SELECT session_id, id, kept FROM o WHERE kept OR n = 0",
    "d04_fill_back": f"""
WITH {_SC}, o AS (SELECT *, reason = 'accepted' AS kept FROM g WHERE source_type = 'publication'),
k AS (SELECT *, count(*) FILTER (kept) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id, kept ORDER BY score DESC, id) AS i FROM o)
SELECT session_id, id, score, kept FROM k WHERE kept OR i <= 3 - n""",
    "st05_lineage": f"WITH {_SC} SELECT source_type, reason, count(*) AS n, sum(round_even(score * 100, 0)::BIGINT)::BIGINT AS score_cents FROM g GROUP BY ALL",
}
