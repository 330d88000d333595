"""Operators that give the whole of their rows, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata

from pyspark.sql import functions as F

from quarryspan.functions import structured as X
from quarryspan.operators.ranking import hit_order
from quarryspan.operators.scoring import tiered
from quarryspan.plans import identity, more, ranking
from quarryspan.tables import load


def form(query: str | None) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", query or "").strip()).lower()


def test_query_form_of_odd_texts(spark):
    texts = [None, "", "  A\t b ", "ﬁne  Ｗide", "a B　c", "x²", "İstanbul ΟΔΟΣ", "Café", "a\x1cb", "\x1f a", "‍ Ω", "ﷺ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, q string").select("i", X.query_form(F.col("q")).alias("f")).collect()
    assert {r["i"]: r["f"] for r in rows} == {i: form(t) for i, t in enumerate(texts)}


def test_every_session_has_a_form_and_hashes(spark, folder):
    queries = {r[0]: r[1] for r in load(spark, folder, "research_sessions", "session_id", "original_query").collect()}
    assert any(not q.isascii() for q in queries.values() if q)
    assert {r["session_id"]: r["normalized"] for r in identity.q02_normalized(spark, folder).collect()} == {s: form(q) for s, q in queries.items()}
    for r in identity.q03_query_hash(spark, folder).collect():
        digest = hashlib.sha256(form(queries.pop(r["session_id"])).encode()).hexdigest()
        assert (r["query_hash"], r["fingerprint"], r["input_hash"]) == (digest[:24], digest[:32], digest)
    assert not queries


def test_hit_order_numbers_every_row(spark):
    rng = random.Random(3)
    ranks = {"focused": 3, "direct": 3, "exact": 3, "adjacent": 2, "loose": 2, "generic": 1}
    labels = [*ranks, " Focused ", "", None, "unheard"]
    hits = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.choice(labels), rng.choice([None, 0.0, 1.0, 2.5, -1.0, float("nan")])) for i in range(3000)]
    want = set()
    for g in {h[0] for h in hits}:
        own = sorted((h for h in hits if h[0] == g), key=lambda h: h[1])
        own.sort(key=lambda h: (ranks.get((h[2] or "").strip().lower(), 0), 0.0 if h[3] is None or h[3] != h[3] else h[3]), reverse=True)
        want |= {(g, k, h[1]) for k, h in enumerate(own, 1)}
    df = spark.createDataFrame(hits, "g string, id long, label string, score double").repartition(7)
    got = [tuple(r) for r in hit_order(df, ["g"], F.col("label"), F.col("score"), "id").collect()]
    assert len(got) == len(hits) and set(got) == want
    assert hit_order(df.limit(0), ["g"], F.col("label"), F.col("score"), "id").count() == 0


def test_no_item_is_left_out_of_the_order(spark, tmp_path):
    rows = spark.range(60).selectExpr("id", "'s' AS session_id", "'web' AS source_type", "cast(id % 9 AS double) AS relevance_score")
    rows.unionByName(rows.limit(5)).write.parquet(str(tmp_path / "raw_evidence_items.parquet"))
    got = {r["rank_no"]: r["id"] for r in ranking.w05_hit_order(spark, str(tmp_path)).collect()}
    assert [got[k] for k in range(1, 61)] == sorted(range(60), key=lambda i: (-(i % 9), i))


def test_tiers(spark):
    pools = {"first": [2.8, 3.0, 4.0, 2.5], "second": [2.9, 2.3, 2.2, 2.1], "same": [2.9, 2.0], "third": [1.5, 2.1, 1.4], "none": [1.0]}
    df = spark.createDataFrame([(g, x) for g, v in pools.items() for x in v], "g string, score double")
    got = {(r["g"], r["score"], r["threshold"]) for r in tiered(df, ["g"], floor=True).collect()}
    assert got == {("first", 2.8, 2.8), ("first", 3.0, 2.8), ("first", 4.0, 2.8), ("second", 2.9, 2.2), ("second", 2.3, 2.2), ("second", 2.2, 2.2), ("same", 2.9, 2.8), ("third", 1.5, 1.5), ("third", 2.1, 1.5)}
    assert {r["g"] for r in tiered(df, ["g"], floor=False).collect()} == {"first", "second", "same"}


def test_patents_past_the_eightieth_are_kept(spark, tmp_path):
    letters = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    rows = [(i, "s", "patent", f"US{5000000 + i}B1", f"Garden {letters(i)} soil {letters(i)} study", "On paint.", "p", "claim_verified", f"https://p.example/{i}") for i in range(120)]
    rows.append((200, "s", "patent", "US9000000B1", "Biometric door lock with vibration sensor", "A biometric door lock with a vibration sensor and alarm.", "q", "claim_verified", "https://q.example/1"))
    rows.append((201, "s", "patent", "US9000000B1", "Another", "Again.", "q", "claim_verified", "https://q.example/2"))
    schema = "id long, session_id string, source_type string, canonical_id string, title string, summary string, provider string, evidence_level string, url string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "raw_evidence_items.parquet"))
    spark.createDataFrame([("s", "biometric door lock vibration sensor alarm")], "session_id string, original_query string").write.parquet(str(tmp_path / "research_sessions.parquet"))
    assert {r["id"] for r in ranking.d01_greedy_dedupe(spark, str(tmp_path)).collect()} == {*range(120), 200}
    assert [(r["rank_no"], r["id"]) for r in more.d08_patent_search(spark, str(tmp_path)).collect()] == [(1, 200)]
