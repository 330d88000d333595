"""Contracts on fixtures that break each rule, and corroboration within a session."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from quarryspan import dims
from quarryspan.operators import contracts as C
from quarryspan.plans.quality import corroborated


def counts(df):
    return {r["rule"]: r["broken"] for r in df.collect()}


def test_truth_catalog(spark):
    truths = "truth_id string, query_id string, document_entity_id string, document_version_id string, rubric_version string, label string"
    maps, seen = "example_id string, source_type string, query_id string, truth_id string", "representation_id string, example_id string, evidence_basis string, assessment string"
    good = ([("t1", "q", "d", "v", "r", "relevant")], [("e1", "web", "q", "t1")], [("p1", "e1", "abstract", "supports_relevant")])
    frame = lambda rows: [spark.createDataFrame(r, s) for r, s in zip(rows, (truths, maps, seen))]
    assert set(counts(C.truth_catalog(*frame(good))).values()) == {0}
    bad = ([*good[0], ("t1", "q", "d", "v", "r", "maybe"), ("t2", " q", "d", None, "r", "uncertain")], [*good[1], ("e1", "radio", "q", "t1"), ("e2", "web", "other", "t1"), ("e3", "web", "q", "t9")], [*good[2], *good[2], ("p2", "e9", "unavailable", "supports_relevant"), ("", "e1", "rumour", "none")])
    got = counts(C.truth_catalog(*frame(bad)))
    assert got == {"truth_text": 1, "truth_label": 1, "truth_id_repeated": 1, "truth_repeated": 1, "mapping_text": 0, "mapping_source": 1, "mapping_truth": 2, "example_repeated": 1, "assessment_text": 1, "assessment_basis": 1, "assessment_value": 1, "unavailable_judged": 1, "assessment_example": 1, "assessment_repeated": 1}


def test_families_in_one_split(spark):
    df = spark.createDataFrame([("f1", "train"), ("f1", "train"), ("f2", "train"), ("f2", "test"), ("f2", "test")], "intent_family_id string, split string")
    assert [tuple(r) for r in C.split_families(df).collect()] == [("f2", 2, 3)]
    assert C.split_families(df.limit(0)).count() == 0


def test_registry_and_allocation(spark):
    print_of = lambda q: hashlib.sha256(" ".join(q.split()).lower().encode()).hexdigest()[:32]
    row = lambda i, s: (f"q{i}", f"Query {i}", print_of(f"Query {i}"), f"f{i}", s, "en", "card", "2025-01-01T00:00:00Z")
    schema = "query_id string, original_query string, query_fingerprint string, intent_family_id string, stratum string, language string, topic_card string, registered_at string"
    rows = [row(i, dims.STRATA[i % 3]) for i in range(33)]
    df = spark.createDataFrame(rows, schema)
    assert set(counts(C.registry(df)).values()) == {0}
    quotas = dict(zip(dims.STRATA, (10, 10, 10)))
    assert set(counts(C.allocation(df, quotas, ["q0", "q1", "q2"])).values()) == {0}
    odd = [("q0", "x", "0" * 32, "f 0", "leisure", "", "c", "2025-13-01T00:00:00Z"), ("q0", "Query 1", print_of("Query 1"), "f1", "scientific", "en", "c", "yesterday")]
    assert counts(C.registry(spark.createDataFrame([*rows, *odd], schema))) == {"identifier": 1, "text": 1, "stratum": 1, "fingerprint": 1, "registered_at": 2, "query_id_repeated": 1, "query_fingerprint_repeated": 1, "intent_family_id_repeated": 1}
    assert counts(C.allocation(df, {"invention": 12, "scientific": 10}, ["q0", "q0", "q99"])) == {"strata": 1, "total": 1, "even": 1, "pilots": 1, "enough": 1}


def test_decisions(spark):
    schema = "id long, source_type string, attempt int, decision_stage string, decision_reason string, candidate_identity string, candidate_identity_kind string, retained int, dataset_eligible int, score_at_decision double, threshold_at_decision double"
    good = [(1, "patent", 1, "threshold_filter", "accepted", "us1", "canonical_id", 1, 1, 3.0, 2.8), (2, "web", 1, "content_gate", "below_overlap_gate", "a" * 32, "text_hash", None, 1, None, None), (3, "patent", 1, "cache_lookup", "cache_hit", "u", "url", None, 0, None, None)]
    assert set(counts(C.broken(spark.createDataFrame(good, schema), C.decision_rules())).values()) == {0}
    bad = [(0, "web", 1, "threshold_filter", "accepted", " ", "name", 0, 2, float("nan"), None), (5, "radio", 0, "cache_lookup", "cache_hit", "xyz", "text_hash", 7, 1, None, float("inf"))]
    got = counts(C.broken(spark.createDataFrame(bad, schema), C.decision_rules()))
    assert got == {"identity": 2, "source": 1, "semantics": 2, "identity_kind": 1, "fallback_identity": 1, "eligible": 1, "retained": 1, "number": 2, "cache_eligible": 1, "structural_judged": 1, "outcome": 1}
    kinds = spark.createDataFrame([*good, (9, "web", 1, "fill_back", "x", "", "", 1, 1, None, None)], schema).select(C.decision_kind(F.col("decision_stage"), F.col("dataset_eligible")))
    assert sorted(r[0] for r in kinds.collect()) == ["relevance_gate", "restoration", "text_gate", "trace_only"]


def test_documents_of_several_sources_of_a_session(spark):
    rows = [("a", "patent", 1, ["id:x", "title:t"]), ("a", "web", 2, ["url:u", "id:x", "id:x"]), ("a", "web", 3, ["title:t"]), ("b", "patent", 4, ["id:x"]), ("b", "patent", 5, ["id:x"]), ("c", "web", 6, [])]
    df = spark.createDataFrame(rows, "session_id string, source_type string, id int, doc_ids array<string>")
    assert sorted(tuple(r) for r in corroborated(df).collect()) == [("a", "id:x", "patent, web", 2), ("a", "title:t", "patent, web", 2)]
