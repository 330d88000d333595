"""Queries taken apart."""

from __future__ import annotations

import pytest

from quarryspan.functions import decompose as D
from quarryspan.plans import composed

DOOR = "Verify whether a smart door lock unlocked by a mobile application, allowing time-limited access codes, logging entry history and notifying the owner already exists"


@pytest.mark.parametrize(("query", "want"), [
    ("smart door lock unlocked by a mobile application", [("smart door lock unlocked", False), ("a mobile application", False)]),
    ("a wind-resistant foldable drone frame that detects cracks and reports vibration, without external power", [("a wind-resistant foldable drone frame", False), ("detects cracks", True), ("reports vibration", True), ("without external power", False)]),
    ("a valve which measures pressure and temperature values", [("a valve measures pressure", True), ("measures temperature values", True)]),
    ("bike lock with GPS and alarm", [("bike lock", False), ("GPS and alarm", False)]),
    ("a device, which measures the load; and records it", [("a device measures the load records it", True)]),
    ("", []), (None, []), ("AI", []), (" , ; ", []),
])
def test_phrases(query, want):
    assert D.phrases(query) == want


def test_requirements():
    found = D.requirements("test rig to verify whether the seal holds under pressure")
    assert [(r["category"], r["label"]) for r in found] == [("object_or_form_factor", "test rig"), ("constraint", "seal holds under pressure")]
    two = D.requirements("heat-resistant long-life battery anode binder")
    assert [(r["label"], r["category"]) for r in two] == [("heat-resistant", "mechanism_or_principle"), ("long-life battery", "mechanism_or_principle"), ("anode binder", "object_or_form_factor")]
    assert D.requirements("system") == [] and D.requirements("lock") == []
    assert [r["too_broad"] for r in D.requirements("quick brown foxes jumping over lazy dogs")] == [True]


def test_exclusions_and_terms():
    assert D.exclusions("a pump without external power supply units, not heavy at all, free of oil") == ["external power supply units", "heavy at all", "oil"]
    assert D.key_terms("The pump and the _valve_ for the pump, ok") == ["pump", "valve"]


def test_envelopes(spark, tmp_path):
    rows = [("a", DOOR), ("b", "system"), ("c", "smart door lock with a mobile application using machine learning"), ("d", None), ("e", "Query: čidlo teploty")]
    spark.createDataFrame(rows, "session_id string, original_query string").write.parquet(str(tmp_path / "research_sessions.parquet"))
    got = {r["session_id"]: r for r in composed.q12_envelopes(spark, str(tmp_path)).collect()}
    assert len(got) == 5
    a, b, c = got["a"], got["b"], got["c"]
    assert a["language"] == "en" and a["critical_requirements_atomic"] and not a["query_too_generic"] and a["web_variants"]
    assert a["understanding_query"].startswith("a smart door lock") and "exist" not in a["understanding_query"]
    assert b["query_too_generic"] and b["synonyms"] == []
    assert {"ML", "intelligent"} <= set(c["synonyms"]) and any("ml" in v.lower().split() for v in c["patent_variants"]) and len(c["web_variants"]) <= 7
    assert got["d"]["query_too_generic"] and got["e"]["language"] == "non_english" and got["e"]["original_query"] == "čidlo teploty"
