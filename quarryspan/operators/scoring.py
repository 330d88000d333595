"""Relevance of candidates to the query of their session, weighted by how rare a term is in their pool.

A pool is all candidates of one session and source. Only tokens that a candidate shares with its query are
exploded, so no pair of a query and a document is built beyond those that exist; a hot session's
rows are spread over its tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryspan import dims
from quarryspan.functions import text as T
from quarryspan.functions.ids import level_weight
from quarryspan.session import cut

POOL_KEY = ["session_id", "source_type"]


def tokenised(pool: DataFrame) -> DataFrame:
    """Candidates by their tokens only: pool key, id, evidence_level, q, d and a (tokens of the query, telling ones, anchors), nt, bonus, filled, shared.

    The query's tokens are made once a session, before candidates are joined. The result is narrow (no texts)
    and is read several times, so it is written once.
    """
    rows = pool.withColumn("t", T.tokens(F.col("text")))
    bonus = F.lit(0.0)
    for source, words in dims.STRUCTURAL.items():
        has = F.arrays_overlap("t", F.split(F.lit(" ".join(words)), " "))
        bonus = F.when((F.col("source_type") == source) & has, F.lit(0.3 if source == "web" else 0.5)).otherwise(bonus)
    level = "evidence_level" if "evidence_level" in pool.columns else F.lit(None).cast("string").alias("evidence_level")
    filled = F.regexp_replace("text", r"\s", "") != ""
    return cut(rows.select(*POOL_KEY, "id", level, "q", "d", "a", F.size("t").alias("nt"), bonus.alias("bonus"), filled.alias("filled"), F.array_intersect("q", "t").alias("shared")))


def pool_weights(rows: DataFrame) -> DataFrame:
    """(pool, token, weight, salient): weights of the query's tokens in each pool, and which are the most telling."""
    hits = rows.select(*POOL_KEY, F.explode("shared").alias("token")).groupBy(*POOL_KEY, "token").agg(F.count("*").alias("df"))
    size = rows.groupBy(*POOL_KEY).agg(F.count_if("filled").alias("n"), F.first("q").alias("q"), F.first("d").alias("d"))
    asked = size.select(*POOL_KEY, "n", "d", F.explode("q").alias("token"))
    out = asked.join(hits, [*POOL_KEY, "token"], "left")
    weight = F.when(F.col("df").isNull(), F.lit(1.0)).otherwise(F.log(1.0 + F.col("n") / (1.0 + F.col("df"))))
    telling = F.array_contains("d", F.col("token"))
    out = out.withColumn("weight", F.when(F.col("n") >= dims.MIN_POOL, weight).otherwise(1.0)).withColumn("telling", telling).withColumn("candidate", telling | (F.size("d") == 0))
    rank = F.row_number().over(Window.partitionBy(*POOL_KEY, "candidate").orderBy(F.desc("weight"), "token"))
    return out.select(*POOL_KEY, "token", "weight", "n", F.coalesce("df", F.lit(0)).alias("df"), "telling", (F.col("candidate") & (rank <= dims.TOP_SALIENT) & (F.col("n") >= dims.MIN_POOL)).alias("salient"))


def scored(pool: DataFrame) -> DataFrame:
    """One row a candidate: its score and the counts that the gates compare.

    Columns: pool key, id, evidence_level, nq (tokens of the query), nd (telling ones), na (anchors), shared, disc, anchor, long,
    salient (shared salient tokens), n_salient, score, level_score. Candidates of empty texts, or for empty queries, score 0.
    """
    rows = tokenised(pool)
    # the weights of a pool are as many as its query has tokens: one map, which meets its candidates in one join
    entry = F.struct("token", F.struct("weight", "salient"))
    pools = pool_weights(rows).groupBy(*POOL_KEY).agg(F.map_from_entries(F.collect_list(entry)).alias("w"), F.sum("weight").alias("total"), F.count_if("salient").alias("n_salient"))
    found = F.filter(F.transform("shared", lambda t: F.try_element_at("w", t)), lambda x: x.isNotNull())
    rows = rows.join(pools, POOL_KEY, "left").withColumn("found", F.coalesce(found, F.array().cast("array<struct<weight:double,salient:boolean>>")))
    out = rows.select(*POOL_KEY, "id", "evidence_level", F.size("q").alias("nq"), "nt", F.size("d").alias("nd"), F.size("a").alias("na"), F.size("shared").alias("shared"), F.size(F.array_intersect("shared", "d")).alias("disc"), F.size(F.array_intersect("shared", "a")).alias("anchor"), F.size(F.filter("shared", lambda t: F.length(t) >= 6)).alias("long"), "bonus", "total", "n_salient", F.aggregate("found", F.lit(0.0), lambda total, x: total + x["weight"]).alias("matched"), F.size(F.filter("found", lambda x: x["salient"])).alias("salient"))
    ratio = F.coalesce(F.expr("try_divide(coalesce(matched, 0), total)"), F.lit(0.0))
    raw = ratio * 8.0 + F.col("bonus") + F.least(F.col("long") * 0.3, F.lit(1.0))
    empty = (F.col("nq") == 0) | (F.col("nt") == 0)
    clamp = lambda x: T.rounded(F.greatest(F.lit(0.0), F.least(x, F.lit(10.0))))
    return out.select(*POOL_KEY, "id", "evidence_level", "nq", "nd", "na", "shared", "disc", "anchor", "long", F.coalesce("salient", F.lit(0)).alias("salient"), F.coalesce("n_salient", F.lit(0)).alias("n_salient"), F.when(empty, 0.0).otherwise(clamp(raw)).alias("score"), F.when(empty, 0.0).otherwise(clamp(raw * level_weight(F.col("evidence_level")))).alias("level_score"))


def on_topic() -> Column:
    """Whether a scored candidate shares a telling word with its query, if that has any."""
    return (F.col("nd") == 0) | (F.col("disc") > 0)


def with_totals(rows: DataFrame, group: list[str], **totals: Column) -> DataFrame:
    """Rows with aggregates of their group, joined back: partial sums meet, never a group's rows."""
    sums = rows.groupBy(*group).agg(*[c.alias(n) for n, c in totals.items()])
    return rows.join(sums, group)


def tiered(scores: DataFrame, group: list[str], floor: bool) -> DataFrame:
    """Rows at or above the threshold of their group, with it: the second tier where the first leaves fewer than three
    and it keeps more; with floor, the third one where no row passes the others. Rows off the topic have to be out before."""
    first, second, third = dims.PATENT_TIERS
    rows = with_totals(scores, group, _n1=F.count_if(F.col("score") >= first), _n2=F.count_if(F.col("score") >= second))
    tier = F.when((F.col("_n1") < 3) & (F.col("_n2") > F.col("_n1")), second).otherwise(first)
    if floor:
        tier = F.when(F.col("_n2") == 0, third).otherwise(tier)
    return rows.withColumn("threshold", tier.cast("double")).where(F.col("score") >= F.col("threshold")).select(*scores.columns, "threshold")


def gates(scores: DataFrame) -> DataFrame:
    """The first gate that each candidate fails, or accepted; every candidate keeps its row (its lineage)."""
    need_shared = F.when(F.col("nq") >= 6, 3).otherwise(2)
    need_disc = F.least(F.col("nd"), F.greatest(F.lit(2), F.least(F.lit(3), ((F.col("nd") + 1) / 2).cast("int"))))
    publication = F.col("source_type") == "publication"
    threshold = F.lit(None).cast("double")
    for source, t in dims.ACCEPT.items():
        threshold = F.when(F.col("source_type") == source, F.lit(t)).otherwise(threshold)
    reason = (
        F.when(publication & (F.col("nq") >= 4) & (F.col("shared") < need_shared), "below_overlap_gate")
        .when(publication & (F.col("nd") > 0) & (F.col("disc") < need_disc), "no_discriminative_term")
        .when(publication & (F.col("na") > 0) & (F.col("anchor") == 0), "no_subject_anchor")
        .when((F.col("n_salient") > 0) & (F.col("salient") == 0), "no_salient_term")
        .when(F.col("score") < threshold, "below_threshold")
        .otherwise("accepted")
    )
    return scores.withColumn("threshold", threshold).withColumn("reason", reason)


def phrase_score(query: Column, text: Column) -> Column:
    """Terms found anywhere, and the longest run of two to five words of the query, or a phrase between commas."""
    low = F.lower(F.coalesce(text, F.lit("")))
    q = F.lower(F.coalesce(query, F.lit("")))
    words = F.filter(F.split(F.trim(F.regexp_replace(q, "[^a-z0-9]+", " ")), " "), lambda w: F.length(w) >= 3)
    found = F.least(F.lit(1.2), 0.4 * F.size(F.filter(F.array_distinct(words), lambda w: F.contains(low, w))))
    phrase = F.exists(F.filter(F.transform(F.split(q, "[,;|]"), lambda p: F.trim(p)), lambda p: F.length(p) >= 6), lambda p: F.contains(low, p))
    n = F.size(words)
    runs = None

    def grams_of(size: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, size), " "))

    for size in (5, 4, 3, 2):
        grams = grams_of(size)
        hit = (n >= size) & F.exists(grams, lambda g: F.contains(low, g))
        runs = F.when(hit, size / n) if runs is None else runs.when(hit, size / n)
    return T.rounded(F.least(F.lit(1.5), found + F.when(phrase, 1.0).otherwise(F.coalesce(runs, F.lit(0.0)))))


def evaluate_gold(gold: DataFrame, sweep: list[float] | None = None) -> DataFrame:
    """Metrics of a gold set (query_id, query, source_type, pos, label, text), by query and threshold.

    Without thresholds, candidates are accepted by the gates; with thresholds, by gates with each as the least score.
    """
    from quarryspan.operators.ranking import average_precision

    queries = gold.select("query_id", "query").distinct().withColumn("q", T.tokens(F.col("query")))
    queries = queries.withColumn("d", T.discriminative(F.col("q"))).withColumn("a", T.subject_anchors(F.col("d"))).drop("query")
    rows = gold.join(queries, "query_id").select(F.col("query_id").alias("session_id"), "source_type", F.col("pos").alias("id"), "text", "label", "q", "d", "a")
    judged = gates(scored(rows)).select("session_id", "id", "score", "reason").join(rows.select("session_id", "id", "label"), ["session_id", "id"])
    steps = F.array(*map(F.lit, sweep)) if sweep else F.array(F.lit(None).cast("double"))
    judged = judged.withColumn("threshold", F.explode(steps))
    passed = F.col("reason").isin("accepted", "below_threshold")
    accepted = F.when(F.col("threshold").isNull(), F.col("reason") == "accepted").otherwise(passed & (F.col("score") >= F.col("threshold")))
    return average_precision(judged, ["session_id", "threshold"], F.col("score"), F.col("label") == 1, accepted, "id")
