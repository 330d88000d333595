from __future__ import annotations

import datetime
import random

import pytest

pytest.importorskip("quarryspan.llm")

from pyspark.sql import functions as F  # noqa: E402

from oracle import compare  # noqa: E402
from quarryspan.llm import registry  # noqa: E402
from quarryspan.llm.lookalike import rules, same_looking_classes, same_looking_pairs, transducer  # noqa: E402
from quarryspan.llm.representative import best_representative, document_key  # noqa: E402
from quarryspan.llm.topn import top_n  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(name, spark, folder):
    compare(registry.queries()[name], registry.oracle_sql()[name], spark, folder)


def test_top_n_against_brute_force_with_hot_group_ties_and_odd_scores(spark):
    rng = random.Random(1)
    nan, inf = float("nan"), float("inf")
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), i, rng.choice([1.0, 1.0, 2.5, rng.random(), None, nan, inf, -inf, -3.0])) for i in range(900)]
    rows += rows[:80]
    df = spark.createDataFrame(rows, "g string, id long, s double").selectExpr("*", "1 AS bin", "2 AS tie", "3 AS rank_no")
    best: dict = {}
    for g, i, s in set((g, i, s) for g, i, s in rows if s is not None and s == s):
        best.setdefault(g, set()).add((-s, i))
    want = {(g, k, i) for g, v in best.items() for k, (_, i) in enumerate(sorted(v)[:4], 1)}
    for hot in (3, 1000):
        assert {tuple(r) for r in top_n(df, ["g"], "s", "id", 4, hot=hot).collect()} == want
    assert top_n(df.limit(0), ["g"], "s", "id", 4).count() == 0


@pytest.mark.parametrize("same", [
    ["10.1/ab.5", " doi:10.1/AB.5 ", "DOI: 10.1/ab.5", "http://dx.doi.example/10.1/ab.5", "https://doi.org/10.1/ab.5"],
    ["us123456b1", "US 123,456 B1", "US-123456-B1", "patent:us123456b1", "US123456.B1"],
    ["https://www.p.example/a/1", "p.example/A/1/", "HTTP://P.EXAMPLE/a/1#x", "https://p.example/a/1?utm_source=f&gclid=2"],
])
def test_document_key_same(spark, same):
    assert spark.createDataFrame([(x,) for x in same], "c string").select(document_key(F.col("c"))).distinct().count() == 1


def test_document_key_different_and_none(spark):
    rows = ["us123456b1", "us123456b2", "p.example/a?page=1", "p.example/a?page=2", None, " ", "--"]
    keys = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "c string").select(document_key(F.col("c"))).collect()]
    assert len(set(keys[:4])) == 4 and keys[4:] == [None] * 3


def test_representative_with_nulls_ties_and_repeats(spark):
    at = datetime.datetime(2025, 1, 1)
    schema = "id long, session_id string, source_type string, canonical_id string, title string, url string, provider string, evidence_level string, verified_url int, evidence_quality_score double, created_at timestamp, doc_key string"
    row = lambda i, c, p=None, v=None, q=None: (i, "s", "web", c, None, None, p, "unverified", v, q, at, "x")
    rows = [row(1, "a/1", " "), row(2, "A/1", "P1", 0, 5.0), row(3, "a/1#f", "p2 ", 1, None), row(3, "a/1#f", "p2 ", 1, None), row(4, "b/1", "p"), row(4, "b/1", "p"), row(5, None), row(6, None), row(7, "c/1", q=float("nan")), row(8, "c/1", q=1.0)]
    got = {(r["id"], r["provider_from_id"]) for r in best_representative(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(3, 3), (8, 8)}
    assert best_representative(spark.createDataFrame([], schema)).count() == 0


def test_representative_with_null_times_and_null_keys(spark):
    """A null time comes last, as in the SQL; groups with a null session or source type get values by the model, too."""
    at = datetime.datetime(2025, 1, 1)
    schema = "id long, session_id string, source_type string, canonical_id string, title string, url string, provider string, evidence_level string, verified_url int, evidence_quality_score double, created_at timestamp"
    row = lambda i, s, k, c, p, t: (i, s, k, c, "T", None, p, "unverified", 1, 2.0, t)
    rows = [row(1, "s", "web", "a/1", "p", None), row(2, "s", "web", "A/1", None, at), row(3, "s", "web", "b/1", "p", None), row(4, "s", "web", "B/1", "q", None)]
    rows += [row(5, None, "web", "a/1", "p", at), row(6, None, "web", "A/1", "p", at), row(7, "s", None, "a/1", "p", at), row(8, "s", None, "A/1", "p", at)]
    out = best_representative(spark.createDataFrame(rows, schema)).collect()
    assert {(r["id"], r["provider_from_id"]) for r in out} == {(2, 1), (3, 3), (5, 5), (7, 7)}
    assert all(r["fused"] and r["fused"]["title"] == ["T"] and r["fused"]["provider"] for r in out)


def test_forms_are_final_and_idempotent():
    table = rules()
    assert all(c not in table for to in table.values() for c in to)
    form = transducer()
    for text in ("ｗｉｄｅ", "a​b", "Café", "раураl", "ﬁx", "ガ", "x²", None, "", " ", "e‍́" * 10_000):
        assert form(form(text)) == form(text)
    assert form("ｗｉｄｅ a‑b​") == "wide a-b" and form("Café") == "Café" and form("x²") == "x²" and form("Cafe") != form("Café")


def test_pairs_against_brute_force(spark):
    texts = ["a b", "a b", "a b", "A b", "ａ b", "", None, " ", "Café", "Café", "Cafe"]
    rows = [(f"s{i % 2}", i, t) for i, t in enumerate(texts * 3)]
    form = transducer()
    want = {(s, i, j) for s, i, t in rows for r, j, u in rows if s == r and i < j and t and u and t.strip() and t != u and form(t) == form(u)}
    df = spark.createDataFrame(rows + rows[:5], "s string, id int, t string").selectExpr("*", "1 AS form", "2 AS k")
    got = [tuple(r) for r in same_looking_pairs(df, ["s"], "id", "t").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert same_looking_pairs(df.limit(0), ["s"], "id", "t").count() == 0


def test_one_variant_among_many_equal_texts(spark):
    many = spark.range(100_000).selectExpr("'s' AS s", "id AS i", "'a b' AS t").unionByName(spark.createDataFrame([("s", -1, "ａ b")], "s string, i long, t string"))
    pairs = same_looking_pairs(many, ["s"], "i", "t")
    assert pairs.count() == 100_000 and pairs.where("a <> -1 OR b < 0").count() == 0
    got = same_looking_classes(many, ["s"], "i", "t").agg(F.count("*"), F.min("first_key"), F.max("texts")).first()
    assert tuple(got) == (100_001, -1, 2)
