"""Rows that were judged by too little: endings by their share, fields by the latent model."""

from __future__ import annotations

import datetime
import random
import warnings

import numpy as np
import pytest

pytest.importorskip("quarryspan.llm")

from quarryspan.llm import truncation  # noqa: E402
from quarryspan.llm.queries_groups import p2_fused  # noqa: E402
from quarryspan.llm.representative import judged, latent_quality  # noqa: E402


def test_an_ending_needs_a_share_of_its_occurrences(spark):
    rows = [(i, "a", f"The valve {i} holds the drive shaft in place at night.") for i in range(40)]
    rows += [(100 + i, "a", f"The sensor {i} is near the drive shaft.") for i in range(3)]
    rows += [(200 + i, "a", f"The pump {i} runs under full load.") for i in range(3)]
    # an ending inside only, delivered twice
    rows += [(300, "a", "The frame is of cold steel and iron."), (300, "a", "The frame is of cold steel and iron.")]
    rows += [(401, "a", "The lock sits at the drive shaft"), (402, "a", "The lock works under full load"), (403, "a", "The lock is made of cold steel")]
    schema = "id long, provider string, summary string"
    got = {tuple(r) for r in truncation.cut_texts(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(401, "a", "ending"), (403, "a", "ending")}
    # the same corpus ten times: no verdict changes with its size
    many = [(k * 1000 + i, f"a{k}", t) for k in range(10) for i, s, t in rows]
    again = truncation.cut_texts(spark.createDataFrame(many, schema)).collect()
    assert {(r["id"] % 1000, r["rule"]) for r in again} == {(401, "ending"), (403, "ending")} and len(again) == 20


def test_left_out_texts_and_repeated_rows(spark):
    rows = [(1, "a", "It stops in the mid", None), (1, "a", "It stops in the mid", None), (2, "a", "It ends he…", "t"), (3, None, None, "t"), (4, "a", "Done.", "t")]
    df = spark.createDataFrame(rows, "id long, provider string, summary string, title string")
    assert sorted(tuple(r) for r in truncation.cut_texts(df).collect()) == [(1, "a", "ending"), (2, "a", "mark")]
    out = truncation.cut_texts(df, title="title", left_out=lambda texts, titles: np.array([t is not None for t in titles]))
    assert [tuple(r) for r in out.collect()] == [(1, "a", "ending")]


def test_endings_inside():
    assert truncation.inside_endings("The pump, at 20 bar, stops. It (then) rests.") == ["the pump", "pump, at", "at #", "# bar", "stops. it", "it then"]
    assert truncation.inside_endings("one") == truncation.inside_endings("") == []


def test_every_dealt_field_is_fused(spark, tmp_path):
    at = datetime.datetime(2025, 1, 1)
    schema = "id long, session_id string, source_type string, canonical_id string, title string, url string, provider string, evidence_level string, verified_url int, evidence_quality_score double, created_at timestamp"
    rows = [(i, "s", "web", c, "T", "u", f"p{i}", "unverified", v, q, at) for i, (c, v, q) in enumerate([("a/1", 1, 4.5), ("a/1", 1, 4.5), ("A/1", 0, float("nan")), ("a/1", None, 4.5)])]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "raw_evidence_items.parquet"))
    (r,) = p2_fused(spark, str(tmp_path)).collect()
    assert (r["canonical_id_values"][0], r["verified_url_values"][0], r["evidence_quality_score_values"]) == ("a/1", "1", ["4.5"])
    assert r["title_values"] == ["T"] and r["evidence_level_values"] == ["unverified"]


def _facts(spark, rows):
    """rows: (i, true, [(witness, says)..]) as facts of one field."""
    coded = [(i, true, "\x1f".join(["f", "\x1e".join(w for w, _ in c), "\x1e".join(w for w, says in c if says)])) for i, true, c in rows]
    return spark.createDataFrame(coded, "i int, true boolean, pattern string")


def test_latent_model_converges_on_a_rare_truth(spark):
    rng = random.Random(8)
    rows = []
    for i in range(2000):
        true = rng.random() < 0.1
        rows.append((i, true, sorted((w, rng.random() < (0.8 if true else 0.1)) for w in "abcde")))
    facts = _facts(spark, rows)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        out = judged(facts, latent_quality(facts)).collect()
    exact = {r["i"]: r["truth"] for r in judged(facts, latent_quality(facts, tolerance=1e-8)).collect()}
    assert max(abs(r["truth"] - exact[r["i"]]) for r in out) < 0.02
    assert abs(sum(r["truth"] for r in out) / len(out) - 0.1) < 0.02


def test_planted_rates_and_truth_are_found(spark):
    """Sources of known sensitivity and specificity: the model finds their rates and, by them, the truth, better than votes."""
    rng = random.Random(3)
    planted = {"a": (0.95, 0.02), "b": (0.9, 0.05), "c": (0.6, 0.4), "d": (0.6, 0.4), "e": (0.6, 0.4)}
    rows = []
    for i in range(6000):
        true = rng.random() < 0.4
        rows.append((i, true, sorted((w, rng.random() < p[0 if true else 1]) for w, p in planted.items())))
    facts = _facts(spark, rows)
    quality = latent_quality(facts)
    for w, (sens, fpr) in planted.items():
        assert abs(quality.rates["f", w][0] - sens) < 0.05 and abs(quality.rates["f", w][1] - fpr) < 0.05
    right = sum((r["truth"] > 0.5) == r["true"] for r in judged(facts, quality).collect())
    votes = sum((sum(says for _, says in c) > 2) == true for _, true, c in rows)
    assert right > 0.96 * len(rows) > votes
