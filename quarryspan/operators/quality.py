"""Quality of evidence: scores of hits, grades of sources, state of retrieval, coverage of requirements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryspan import dims
from quarryspan.functions import text as T
from quarryspan.functions.ids import level_class, level_weight


def relevance_label(score: Column) -> Column:
    """direct, adjacent or generic, from the relevance score; NaN and null are generic."""
    s = F.when(~F.isnan(score), score)
    return F.when(s >= 7.0, "direct").when(s >= 3.0, "adjacent").otherwise("generic")


def hit_quality(score: Column, level: Column, label: Column, verified: Column) -> Column:
    """A bounded score: the relevance, or (where it is none or zero) a base by class of evidence times its weight."""
    s = F.when(~F.isnan(score), score)
    missing = F.coalesce(s, F.lit(0.0)) == 0.0
    kind = level_class(level)
    base = F.lit(dims.LEVEL_BASE["other"])
    for name in ("strong", "medium", "weak", "failed"):
        base = F.when(kind == name, F.lit(dims.LEVEL_BASE[name])).otherwise(base)
    value = F.when(F.coalesce(s, F.lit(0.0)) <= 0, base).otherwise(s)
    value = F.when(missing, value * level_weight(level)).otherwise(value)
    value = value * F.when(label == "generic", 0.5).when(label == "direct", 1.1).otherwise(1.0)
    value = value + F.when(F.coalesce(verified, F.lit(0)) == 1, 0.2).otherwise(0.0)
    return T.rounded(F.greatest(F.lit(0.0), F.least(value, F.lit(10.0))))


def graded(hits: DataFrame, attempts: DataFrame, key: list[str]) -> DataFrame:
    """A grade for each attempt: from its hits' evidence, lowered where the retrieval was partial or the hits are beside the point.

    hits: key, quality, class, label, verified, evidence_level. attempts: key, status, completed, reliable_no_results, error_count.
    An attempt without hits is reliable_no_results or failed_retrieval.
    """
    per = hits.groupBy(*key).agg(
        F.count("*").alias("n"), F.max("quality").alias("top"),
        F.max((F.col("class") == "strong") & (F.col("label") != "generic")).alias("strong"),
        F.max((F.col("class") == "medium") & (F.col("label") != "generic")).alias("medium"),
        F.count_if((F.col("evidence_level") == "search_snippet_only") & (F.coalesce("verified", F.lit(0)) == 1) & (F.col("label") != "generic")).alias("snippets"),
        F.min(F.col("class") == "failed").alias("all_failed"), F.count_if(F.col("label") != "direct").alias("aside"),
    )
    rows = attempts.join(per, key, "left")
    partial = F.col("status") == "partial_failure"
    g1 = F.when(F.col("strong"), "strong").when(F.col("medium") | (F.col("snippets") >= 2), "medium").when(F.col("all_failed"), "failed_retrieval").otherwise("weak")
    g2 = F.when(g1.isin("strong", "medium") & partial & (F.col("aside") == F.col("n")), "weak").when((g1 == "strong") & (F.col("aside") * 2 > F.col("n")), "medium").otherwise(g1)
    g3 = F.when((g2 == "strong") & partial & (F.col("top") < 5.0), "medium").otherwise(g2)
    g4 = F.when((g3 == "medium") & partial & (F.col("top") < 3.5), "weak").otherwise(g3)
    none = F.when((F.col("status") == "ok") & (F.col("completed") == 1) & (F.col("reliable_no_results") == 1), "reliable_no_results").otherwise("failed_retrieval")
    return rows.select(*key, "status", F.coalesce("n", F.lit(0)).alias("hits"), F.coalesce("top", F.lit(0.0)).alias("top_quality"), F.when(F.col("n").isNull(), none).otherwise(g4).alias("grade"), (partial & (F.col("error_count") > 0)).alias("search_incomplete"))


def retrieval_state(grades: DataFrame, key: list[str]) -> DataFrame:
    """The state of retrieval of each session from the grades of its sources."""
    good = F.col("grade").isin("strong", "medium")
    usable = F.col("grade").isin("strong", "medium", "reliable_no_results")
    agg = grades.groupBy(*key).agg(
        F.min(F.col("grade") == "reliable_no_results").alias("none"), F.min(F.col("grade").isin("failed_retrieval", "missing")).alias("failed"), F.min(usable).alias("usable"), F.max("search_incomplete").alias("incomplete"),
        F.max(good).alias("good"), F.max(F.col("grade").isin("failed_retrieval", "missing")).alias("some_failed"), F.max(F.col("grade") == "weak").alias("some_weak"), F.count_if(F.col("grade") == "strong").alias("strong"), F.count_if(F.col("grade") == "medium").alias("medium"),
    )
    state = (
        F.when(F.col("none"), "reliable_no_results").when(F.col("failed"), "failed").when(F.col("usable"), F.when(F.col("incomplete"), "degraded").otherwise("complete"))
        .when(F.col("good") & F.col("some_failed"), "degraded").when(F.col("good") & F.col("some_weak"), "mixed_partial").otherwise("partial")
    )
    return agg.select(*key, state.alias("retrieval"), "strong", "medium")


def requirement_matches(hits: DataFrame, atoms: DataFrame, key: list[str]) -> DataFrame:
    """(key, id, atom_no, full): whether a hit's text has all terms of each of its session's requirements.

    atoms: key, atom_no, terms. Terms of one part match a token or its stem; of several, also together.
    """
    rows = hits.select(*key, "id", T.blob_tokens(F.col("text")).alias("blob"), T.compact(F.col("text")).alias("joined")).join(atoms, key)

    def has(term: Column) -> Column:
        parts = T.raw_tokens(term)
        each = F.forall(parts, lambda p: F.array_contains(F.col("blob"), p) | F.array_contains(F.col("blob"), T.requirement_stem(p)))
        return (F.size(parts) > 0) & (each | ((F.size(parts) > 1) & F.contains(F.col("joined"), F.array_join(parts, ""))))

    return rows.select(*key, "id", "atom_no", F.forall("terms", has).alias("full"))
