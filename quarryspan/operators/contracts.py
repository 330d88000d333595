"""Contracts of offline tables: for each rule the number of rows that break it. All rules of a table are one pass; keys are aggregates, references anti-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryspan import dims

COUNTS = "rule string, broken long"


def broken(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, broken): how many rows meet each condition that none should; a null condition is not met."""
    counts = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*rules)))).select(F.col("key").alias("rule"), F.col("value").alias("broken"))


def repeated(rows: DataFrame, rule: str, *key: str) -> DataFrame:
    """How many keys occur more than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("broken")).select(F.lit(rule).alias("rule"), "broken")


def dangling(rows: DataFrame, rule: str, columns: list[str], parent: DataFrame, key: list[str]) -> DataFrame:
    """How many rows refer to no row of the parent; all columns of the reference have to agree."""
    known = parent.select(*[F.col(k).alias(c) for k, c in zip(key, columns)])
    return rows.join(known, columns, "left_anti").agg(F.count("*").alias("broken")).select(F.lit(rule).alias("rule"), "broken")


def conflicting(rows: DataFrame, rule: str, group: list[str], value: str) -> DataFrame:
    """How many groups have more than one value, where all their rows should agree."""
    spread = rows.groupBy(*group).agg((F.min(value) != F.max(value)).alias("two"))
    return spread.agg(F.count_if("two").alias("broken")).select(F.lit(rule).alias("rule"), "broken")


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _blank(*names: str) -> Column:
    """Whether any of these texts is missing, empty, or has blanks around it."""
    return reduce(lambda a, b: a | b, [F.col(n).isNull() | (F.col(n) == "") | (F.col(n) != F.trim(n)) for n in names])


def _other(name: str, allowed: list[str]) -> Column:
    return F.col(name).isNull() | ~F.col(name).isin(*allowed)


def truth_catalog(truths: DataFrame, mappings: DataFrame, assessments: DataFrame) -> DataFrame:
    """Rules of a catalog of labels: truths about versions of documents, examples mapped to them, assessments of what was seen.

    truths: truth_id, query_id, document_entity_id, document_version_id, rubric_version, label. mappings: example_id, source_type, query_id,
    truth_id. assessments: representation_id, example_id, evidence_basis, assessment.
    """
    known = ["query_id", "document_entity_id", "document_version_id", "rubric_version"]
    return _all(
        broken(truths, {"truth_text": _blank("truth_id", *known), "truth_label": _other("label", dims.TRUTH_LABELS)}),
        repeated(truths, "truth_id_repeated", "truth_id"), repeated(truths, "truth_repeated", *known),
        broken(mappings, {"mapping_text": _blank("example_id", "query_id", "truth_id"), "mapping_source": _other("source_type", dims.SOURCES)}),
        dangling(mappings, "mapping_truth", ["truth_id", "query_id"], truths, ["truth_id", "query_id"]), repeated(mappings, "example_repeated", "example_id"),
        broken(assessments, {"assessment_text": _blank("representation_id", "example_id"), "assessment_basis": _other("evidence_basis", dims.EVIDENCE_BASES), "assessment_value": _other("assessment", dims.ASSESSMENTS),
                             "unavailable_judged": (F.col("evidence_basis") == "unavailable") & (F.col("assessment") != "insufficient_information")}),
        dangling(assessments, "assessment_example", ["example_id"], mappings, ["example_id"]), repeated(assessments, "assessment_repeated", "example_id", "representation_id"))


def split_families(queries: DataFrame) -> DataFrame:
    """Families (intent_family_id) whose queries lie in more than one split, with their splits and number of queries."""
    return queries.groupBy("intent_family_id").agg(F.countDistinct("split").alias("splits"), F.count("*").alias("queries")).where("splits > 1")


def registry(queries: DataFrame) -> DataFrame:
    """Rules of a register of queries: query_id, original_query, query_fingerprint, intent_family_id, stratum, language, topic_card, registered_at."""
    name = r"^[A-Za-z0-9_.-]{1,100}$"
    form = F.sha2(F.lower(F.trim(F.regexp_replace("original_query", r"\s+", " "))), 256)
    plain = ~F.col("original_query").rlike(r"[^\x00-\x7f]")
    when = F.col("registered_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$") & F.try_to_timestamp(F.regexp_replace("registered_at", "[TZ]", " ")).isNotNull()
    rules = {"identifier": ~(F.col("query_id").rlike(name) & F.col("intent_family_id").rlike(name)), "text": _blank("original_query", "language", "topic_card"), "stratum": _other("stratum", dims.STRATA),
             "fingerprint": plain & (F.col("query_fingerprint") != F.substring(form, 1, 32)), "registered_at": ~when}
    return _all(broken(queries, rules), *[repeated(queries, f"{c}_repeated", c) for c in ("query_id", "query_fingerprint", "intent_family_id")])


def allocation(queries: DataFrame, quotas: dict[str, int], pilots: list[str]) -> DataFrame:
    """(rule, broken) of a plan: quotas that are even and sum to 25 to 30, three pilots that are registered, and enough other queries in each stratum."""
    left = {r["stratum"]: r["n"] for r in queries.where(~F.col("query_id").isin(*pilots)).groupBy("stratum").agg(F.count("*").alias("n")).where(F.col("stratum").isin(*dims.STRATA)).collect()}  # three numbers
    known = queries.where(F.col("query_id").isin(*pilots)).select("query_id").distinct().count()
    sizes = list(quotas.values())
    found = {"strata": set(quotas) != set(dims.STRATA), "total": not 25 <= sum(sizes) <= 30, "even": bool(sizes) and max(sizes) - min(sizes) > 1, "pilots": len(set(pilots)) != 3 or known != 3, "enough": any(left.get(s, 0) < n for s, n in quotas.items())}
    return queries.sparkSession.createDataFrame([(k, int(v)) for k, v in found.items()], COUNTS)


def decision_kind(stage: Column, eligible: Column) -> Column:
    """What a decision tells: nothing about a candidate, a restoration, a gate on text or on relevance, or structure."""
    return F.when(eligible != 1, "trace_only").when(stage == "fill_back", "restoration").when(stage.isin(*dims.TEXT_GATES), "text_gate").when(stage.isin(*dims.RELEVANCE_GATES), "relevance_gate").otherwise("structural")


def decision_rules() -> dict[str, Column]:
    """Conditions that no decision should meet, on the columns of the decisions' table."""
    allowed = F.array(*[F.lit(f"{source}|{stage}|{reason}") for source, stages in dims.SEMANTICS.items() for stage, reasons in stages.items() for reason in reasons.split()])
    judging = F.col("decision_stage").isin(*dims.JUDGING_STAGES)
    accepted = F.col("decision_reason").isin(*dims.ACCEPTING_REASONS)
    odd = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return {
        "identity": (F.col("id") <= 0) | (F.col("attempt") <= 0), "source": _other("source_type", dims.SOURCES),
        "semantics": ~F.array_contains(allowed, F.concat_ws("|", "source_type", "decision_stage", "decision_reason")),
        "identity_kind": _other("candidate_identity_kind", ["canonical_id", "url", "text_hash"]) | (F.trim("candidate_identity") == ""),
        "fallback_identity": (F.col("candidate_identity_kind") == "text_hash") & ~F.col("candidate_identity").rlike("^[0-9a-f]{32}$"),
        "eligible": ~F.col("dataset_eligible").isin(0, 1), "retained": F.col("retained").isNotNull() & ~F.col("retained").isin(0, 1),
        "number": F.coalesce(odd(F.col("score_at_decision")), F.lit(False)) | F.coalesce(odd(F.col("threshold_at_decision")), F.lit(False)),
        "cache_eligible": (F.col("decision_stage") == "cache_lookup") & (F.col("dataset_eligible") != 0),
        "structural_judged": ~judging & F.col("retained").isNotNull(), "outcome": judging & ~F.col("retained").eqNullSafe(accepted.cast("int")),
    }
