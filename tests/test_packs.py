"""Packs, merged tables and payloads in wrappers."""

from __future__ import annotations

import json

import pytest

from quarryspan.functions import structured as X
from quarryspan.operators import packs as P
from quarryspan.sources import store

HITS = "session_id string, source_type string, id long, title string, url string, number string, evidence_level string, summary string, verified boolean, label string, score double, matched int, coverage double"
SEARCHES = "session_id string, source_type string, status string, completed boolean, reliable_no_results boolean, warnings int"


def _hit(s, source, i, level="abstract_verified", label="focused", score=1.0, coverage=0.0, summary="a b c d e f g h"):
    return (s, source, i, f"t{i}", None, "", level, summary, True, label, score, 1, coverage)


def test_packs_by_rules_of_each_source(spark):
    hits = [_hit("a", "patent", i, score=i / 10) for i in range(15)] + [_hit("a", "patent", 99, label="adjacent", score=9.0, coverage=1.0)]
    hits += [_hit("b", "patent", 1, level="fetch_failed"), _hit("c", "publication", 1, label="adjacent"), _hit("d", "patent", 1, level="fetch_failed", summary="short", score=float("nan"))]
    searches = [(s, "patent", "ok", True, False, 0) for s in "abd"] + [("c", "publication", "ok", True, False, 0), ("a", "web", "ok", True, True, 0), ("b", "web", "failed", False, False, 0), ("e", "patent", "ok", True, True, 2)]
    got = {(r["session_id"], r["source_type"]): r for r in P.evidence_packs(spark.createDataFrame(hits, HITS), spark.createDataFrame(searches, SEARCHES)).collect()}
    a = got["a", "patent"]
    assert (a["status"], a["completed"], a["found"]) == ("ok", True, 16)
    assert [h["id"] for h in a["hits"]] == list(range(14, 4, -1)) and [h["rank_no"] for h in a["hits"]] == list(range(1, 11))
    assert (got["b", "patent"]["status"], got["b", "patent"]["hits"][0]["evidence_level"]) == ("partial_failure", "search_snippet_only")
    assert (got["d", "patent"]["hits"][0]["evidence_level"], got["d", "patent"]["hits"][0]["relevance_score"]) == ("fetch_failed", 0.0)
    assert got["c", "publication"]["status"] == "partial_failure" and got["c", "publication"]["completed"] is False
    assert got["a", "web"]["status"] == "failed" and got["a", "web"]["completed"] and got["b", "web"]["status"] == "failed"
    assert got["e", "patent"]["status"] == "partial_failure" and got["e", "patent"]["hits"] == []
    merged = {r["session_id"]: r for r in P.merged(spark.createDataFrame(list(got.values()), P.evidence_packs(spark.createDataFrame(hits, HITS), spark.createDataFrame(searches, SEARCHES)).schema), spark.createDataFrame([("a",), ("z",)], "session_id string")).collect()}
    assert merged["a"]["overall_status"] == "partial_failure" and merged["z"]["overall_status"] == "failed" and merged["z"]["web"]["notes"] == ["no input received"]


def test_merging_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(k, i, f"v{i}") for i, k in enumerate("abcabc")]
    df = spark.createDataFrame(rows, "k string, i int, v string")
    for _ in range(2):
        store.merge(df, path, ["k"], "i", parts=3)
    store.merge(spark.createDataFrame([("d", 9, "new"), ("a", 1, "older")], df.schema), path, ["k"], "i", parts=3)
    assert sorted(tuple(r) for r in store.read(spark, path).select("k", "i", "v").collect()) == [("a", 3, "v3"), ("b", 4, "v4"), ("c", 5, "v5"), ("d", 9, "new")]


PACK = {"source_type": "merged_evidence_pack", "overall_status": "ok"}


@pytest.mark.parametrize("text", [
    json.dumps(PACK), json.dumps(json.dumps(PACK)), json.dumps([{"type": "text", "text": json.dumps(PACK)}]), json.dumps({"result": {"output": PACK}}),
    json.dumps({"content": [{"type": "text", "text": json.dumps(PACK)}]}), "Here it is. MERGED_RESEARCH_PACK_JSON: " + json.dumps(PACK) + " and more", json.dumps({"text": "MERGED_RESEARCH_PACK_JSON:\n" + json.dumps(PACK)}),
])
def test_packs_in_wrappers(text):
    assert json.loads(X.pack_of(text)) == PACK


@pytest.mark.parametrize("text", ["", "  ", "none here", "{}", "[]", "null", '{"text": "x"}', "{" * 5000, json.dumps({"result": None})])
def test_no_pack(text):
    assert json.loads(X.pack_of(text))["errors"][0]["type"] == "missing_or_malformed_merged_pack"


def test_repairs():
    assert X.parsed('{"a": "x\\d"}') == {"a": "x\\d"} and X.parsed("oops") == {"raw": "oops"} and X.parsed(" ") is None
    assert X.parsed('{"hits": [{"verified_url": true], "errors": []}') == {"hits": [{"verified_url": True}], "errors": []}
    assert X.parsed('{"a": "b",\\n "c": 1}') == {"a": "b", "c": 1}
