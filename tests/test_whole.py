"""Queries without SQL over whole tables, against plain loops over the same rows."""

from __future__ import annotations

import hashlib
import html
import json
import re

import pytest

from quarryspan.functions import decompose as D
from quarryspan.plans import registry
from quarryspan.tables import load

Q = registry.queries()


@pytest.fixture(scope="module")
def items(spark, folder):
    rows = load(spark, folder, "raw_evidence_items").dropDuplicates(["id"]).orderBy("id").collect()
    return [r.asDict() for r in rows]


@pytest.fixture(scope="module")
def sessions(spark, folder):
    return {r["session_id"]: r.asDict() for r in load(spark, folder, "research_sessions").collect()}


def answer(spark, folder, name):
    return [r.asDict() for r in Q[name](spark, folder).collect()]


def title_key(t):
    return re.sub(r"[^a-z0-9]+", " ", (t or "").lower()).strip()


def greedy(rows, keys):
    seen, kept = {}, set()
    for r in rows:
        own = {(i, k) for i, k in enumerate(keys(r)) if k}
        if not own & seen.setdefault(r["session_id"], set()):
            seen[r["session_id"]] |= own
            kept.add(r["id"])
    return kept


def patent_keys(r):
    number = re.sub("[^A-Za-z0-9]", "", re.sub("^patent:", "", r["canonical_id"] or "")).upper()
    number = "" if number == "UNKNOWN" else re.sub(r"([A-Z]{2}[0-9]{4,})[A-Z][0-9]?$", r"\1", number)
    title = title_key(r["title"])
    return number or (r["url"] or "").strip(), title if len(title) >= 12 else ""


def test_patents_once(spark, folder, items):
    rows = [r for r in items if r["source_type"] == "patent" and patent_keys(r)[0]]
    assert {r["id"] for r in answer(spark, folder, "d01_greedy_dedupe")} == greedy(rows, patent_keys)


def test_publications_once(spark, folder, items):
    def keys(r):
        m = re.search(r"10\.[0-9]+/\S+", (r["canonical_id"] or "").lower())
        return m[0].rstrip(".,;") if m else "", " ".join((r["title"] or "").split()).lower()

    rows = [r for r in items if r["source_type"] == "publication"]
    assert {r["id"] for r in answer(spark, folder, "d02_publication_dedupe")} == greedy(rows, keys)
    found = answer(spark, folder, "d09_publication_search")
    assert found and all(1 <= r["rank_no"] <= 20 for r in found)


def test_every_item_has_its_text(spark, folder, items):
    ids = {r["id"] for r in items}
    for name in ("t10_unescaped", "t11_collapse_repeats", "t14_abstract_excerpt", "t15_compact_content"):
        got = answer(spark, folder, name)
        assert len(got) == len(ids) and {r["id"] for r in got} == ids
    lengths = {r["id"]: r["length"] for r in answer(spark, folder, "t10_unescaped")}

    def decoded(s):
        for _ in range(3):
            s = html.unescape(s)
        return s

    assert lengths == {r["id"]: None if r["summary"] is None else len(decoded(r["summary"])) for r in items}
    for r in answer(spark, folder, "t15_compact_content"):
        assert len((r["excerpt"] or "").split()) <= 450


def canonical(text):
    def unique(pairs):
        assert len(dict(pairs)) == len(pairs)
        return dict(pairs)

    try:
        return json.dumps(json.loads(text, object_pairs_hook=unique, parse_constant=lambda x: 1 / 0), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except (ValueError, ArithmeticError, AssertionError):
        return None


def test_hashes_of_json(spark, folder, sessions):
    decisions = {r["id"]: r["payload_json"] for r in load(spark, folder, "evaluation_candidate_decisions", "id", "payload_json").collect()}
    sha = lambda t: None if t is None or canonical(t) is None else hashlib.sha256(canonical(t).encode()).hexdigest()
    assert {r["id"]: r["hash"] for r in answer(spark, folder, "k07_canonical_json")} == {i: sha(p) for i, p in decisions.items()}
    got = {r["session_id"]: r["hash"] for r in answer(spark, folder, "q20_envelope_hash")}
    for s, r in sessions.items():
        envelope = canonical(r["query_envelope_json"] or "")
        atoms = json.loads(envelope).get("critical_requirements_atomic") if envelope and envelope.startswith("{") else None
        if atoms is not None:
            assert got[s] == sha(json.dumps(atoms, ensure_ascii=False))[:32]
    assert set(got) == set(sessions)


def test_queries_of_all_sessions(spark, folder, sessions):
    squeezed = lambda q: " ".join((q or "").split())
    coerced = {r["session_id"]: squeezed(r["query"]) for r in answer(spark, folder, "q01_coerced")}
    # what has a mark of JSON loses the words that are keys of a plan
    assert set(coerced) == set(sessions) and all(coerced[s] == squeezed(r["original_query"]) for s, r in sessions.items() if not re.search(r"[{}\[\]\"`]", r["original_query"] or ""))
    phrases = {}
    for r in sorted(answer(spark, folder, "q07_phrases"), key=lambda r: r["pos"]):
        phrases.setdefault(r["session_id"], []).append((r["phrase"], r["clause"]))
    assert phrases == {s: p for s, r in sessions.items() if (p := D.phrases(r["original_query"]))}
    atoms = answer(spark, folder, "q08_requirements")
    assert len(atoms) == sum(len(D.requirements(r["original_query"])) for r in sessions.values())
    assert {r["session_id"] for r in answer(spark, folder, "q12_envelopes")} == set(sessions)
    values = {r["session_id"]: r["value"] for r in answer(spark, folder, "k01_repaired_payloads")}
    assert all((v is None) == (not (sessions[s]["query_envelope_json"] or "").strip()) for s, v in values.items()) and set(values) == set(sessions)


def test_packs_hold_what_was_searched(spark, folder, items, sessions):
    searched = {(r["session_id"], r["source_type"]) for r in load(spark, folder, "evidence_results", "session_id", "source_type").collect()}
    for name, source in (("r01_patent_packs", "patent"), ("r02_publication_packs", "publication"), ("r03_web_packs", "web")):
        packs = answer(spark, folder, name)
        assert {(r["session_id"], r["source_type"]) for r in packs} == {k for k in searched if k[1] == source}
        for p in packs:
            own = {r["id"] for r in items if (r["session_id"], r["source_type"]) == (p["session_id"], source) and p["session_id"] in sessions}
            assert p["found"] == len(own) and len(p["hits"]) == min(10, len(own)) and {h["id"] for h in p["hits"]} <= own
            assert p["status"] in ("ok", "partial_failure", "failed")
    final = answer(spark, folder, "r07_final_packs")
    assert {r["session_id"] for r in final} == set(sessions)
    counts = {r["error"]: r["n"] for r in answer(spark, folder, "k03_merged_packs")}
    results = load(spark, folder, "evidence_results", "id").distinct().count()
    assert counts == {"missing_or_malformed_merged_pack": results}  # the tables hold packs of one source only


def test_caches_and_pages(spark, folder, items):
    runs = load(spark, folder, "evidence_results", "id").distinct().count()
    assert sum(r["n"] for r in answer(spark, folder, "st01_bounded_cache")) == runs
    pages = answer(spark, folder, "t16_page_texts")
    assert {r["id"]: r["date"] for r in pages} == {str(r["id"]): r["created_at"].strftime("%Y-%m-%d") for r in items}
    got = {r["id"]: r["length"] for r in pages}
    for r in items:
        if r["summary"] is not None:
            words = " ".join(re.sub("[<>&]", "", r["summary"]).split())
            if "\n" not in r["summary"] and len(words.split()) >= 6 and not re.match(r"(?i)(?:menu|skip|cart|sign in|subscribe)\b", words):
                assert got[str(r["id"])] == len(words)
