from __future__ import annotations

import random

from pyspark.sql import functions as F

from quarryspan.operators.quality import hit_quality, relevance_label
from quarryspan.operators.ranking import greedy_first
from quarryspan.operators.scoring import evaluate_gold
from quarryspan.sources import snapshots


def test_greedy_is_not_two_distincts(spark):
    rows = [("q", 1, "d1", "t1"), ("q", 2, "d2", "t1"), ("q", 3, "d2", "t3"), ("q", 4, "", "t1"), ("q", 5, None, ""), ("r", 1, "d1", "t1")]
    df = spark.createDataFrame(rows, "g string, n int, doi string, title string")
    got = {(x["g"], x["n"]) for x in greedy_first(df, ["g"], "n", ["doi", "title"]).collect()}
    assert got == {("q", 1), ("q", 3), ("q", 5), ("r", 1)}
    assert greedy_first(df.limit(0), ["g"], "n", ["doi", "title"]).count() == 0
    assert greedy_first(df, ["g"], "n", ["doi", "title"], cap=1).count() == 2


def test_hit_quality(spark):
    rows = [(None, "claim_verified", 1), (0.0, "search_snippet_only", 0), (float("nan"), "nonsense", None), (9.9, "unverified", 1), (5.0, None, 0)]
    df = spark.createDataFrame(rows, "s double, l string, v int")
    out = [r[0] for r in df.select(hit_quality(F.col("s"), F.col("l"), relevance_label(F.col("s")), F.col("v"))).collect()]
    assert out == [4.4, 1.23, 0.7, 10.0, 5.0]


def test_gold_metrics(spark):
    texts = [(1, "smart door lock with remote unlock and sensor alarm"), (0, "garden soil study"), (1, "door lock alarm sensor for smart homes"), (0, "review of paint")]
    rows = [("q1", "smart door lock with alarm sensor", "publication", i, y, t) for i, (y, t) in enumerate(texts)]
    gold = spark.createDataFrame(rows, "query_id string, query string, source_type string, pos int, label int, text string")
    r = evaluate_gold(gold).first()
    assert (r["n"], r["relevant"], r["precision"], r["recall"], r["ap"], r["rr"]) == (4, 2, 1.0, 1.0, 1.0, 1.0)


def test_snapshot_seal(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, x string")
    path = str(tmp_path / "snap")
    snapshots.write_once(df, path)
    seal = snapshots.digest(df.repartition(3))
    assert snapshots.read_snapshot(spark, path, seal, ["x", "id"]).count() == 2
    for wrong in ((seal + "0", ["x", "id"]), (seal, ["id"])):
        try:
            snapshots.read_snapshot(spark, path, *wrong)
        except ValueError:
            continue
        raise AssertionError("no error")


def test_main_text():
    page = "<html><nav>Menu one two three four five six</nav><main><p>This is the main text of the page.</p><p>short</p></main></html>"
    assert snapshots.main_text(page) == "This is the main text of the page."
    assert snapshots.main_text(None) == ""


def test_inverted_index(spark):
    df = spark.createDataFrame([(1, {"b": [1], "a": [0, 2]}), (2, {})], "id int, inverted map<string,array<int>>")
    assert [r["text"] for r in snapshots.inverted_abstracts(df).orderBy("id").collect()] == ["a b a", ""]


def test_greedy_against_brute_force_with_chains_and_ties(spark):
    from quarryspan.operators.ranking import greedy_first

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice(["", None, *map(str, range(12))]), rng.choice(["", *map(str, range(12))])) for i in range(150)]
    rows += [("chain", 1000 + i, f"x{i // 2}", f"y{(i + 1) // 2}") for i in range(12)] + rows[:20]
    want = set()
    for g in {r[0] for r in rows}:
        seen: set = set()
        for r in sorted({r for r in rows if r[0] == g}, key=lambda r: r[1]):
            own = {(k, v) for k, v in enumerate(r[2:]) if v}
            if not own & seen:
                seen |= own
                want.add((g, r[1]))
    df = spark.createDataFrame(rows, "g string, n int, k string, l string")
    got = [(r["g"], r["n"]) for r in greedy_first(df, ["g"], "n", ["k", "l"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_cache_against_the_definition(spark):
    from collections import OrderedDict

    from quarryspan.operators.ranking import cache_hits

    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.choice("klmnopq"), i, rng.randint(0, 4000)) for i in range(600)]
    df = spark.createDataFrame(rows, "c string, k string, i int, s int").withColumn("at", F.timestamp_seconds("s")).withColumnRenamed("s", "cached_at").repartition(5)
    for entries in (None, 3):
        want, held = {}, {}
        for c, k, i, s in sorted(rows, key=lambda r: (r[3], r[2])):
            own = held.setdefault(c, OrderedDict())
            hit = k in own and s - own[k] <= 300
            if not hit:
                own[k] = s
            own.move_to_end(k)
            while entries and len(own) > entries:
                own.popitem(last=False)
            want[i] = hit
        got = {r["i"]: r["cached"] for r in cache_hits(df, ["c"], "k", "at", "i", 300, entries).collect()}
        assert got == want
    # used again and again, an entry still ends 300 seconds after it was stored
    often = spark.createDataFrame([("a", "k", i, 100 * i) for i in range(8)], "c string, k string, i int, s int").withColumn("at", F.timestamp_seconds("s"))
    assert [r["cached"] for r in cache_hits(often, ["c"], "k", "at", "i", 300).orderBy("i").collect()] == [False, True, True, True, False, True, True, True]


def test_keyed_hash_against_published_vectors(spark):
    """Test cases 1, 2 and 6 of RFC 4231."""
    from quarryspan.operators.ranking import keyed_hash

    cases = [(b"\x0b" * 20, "Hi There", "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"), (b"Jefe", "what do ya want for nothing?", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"), (b"\xaa" * 131, "Test Using Larger Than Block-Size Key - Hash Key First", "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54")]
    for key, message, want in cases:
        assert spark.range(1).select(keyed_hash(key, F.lit(message))).first()[0] == want


def test_running_sums_and_metrics_of_one_large_group(spark):
    from quarryspan.operators.ranking import average_precision

    rng = random.Random(2)
    rows = [("g" if i % 9 else None, i, rng.choice([0.5, 1.0, 2.0, rng.random()]), int(rng.random() < 0.3)) for i in range(2000)] + [("none", 9999, 1.0, 0)]
    df = spark.createDataFrame(rows, "g string, i int, s double, r int").repartition(6)
    got = {r["g"]: r for r in average_precision(df, ["g"], F.col("s"), F.col("r") == 1, F.col("s") >= 1, "i").collect()}
    for g in ("g", None, "none"):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        k = sum(r[3] for r in own)
        hits = [i for i, r in enumerate(own, 1) if r[3]]
        ap = sum((j + 1) / i for j, i in enumerate(hits)) / k if k else 0.0
        assert (got[g]["n"], got[g]["relevant"]) == (len(own), k) and abs(got[g]["ap"] - ap) < 1e-9
        assert abs(got[g]["p_at_k"] - (sum(r[3] for r in own[:k]) / k if k else 0)) < 1e-12 and abs(got[g]["rr"] - (1 / hits[0] if hits else 0)) < 1e-12


def test_text_cut_by_lines_and_tails(spark):
    from quarryspan.functions import text as T

    def one(c):
        return spark.range(1).select(c).first()[0]

    assert one(T.trim_lines(F.lit("a b\n\nc d, e\nf"), 4)) == "a b\n\nc d..."
    assert one(T.trim_lines(F.lit("a b\nc  \n"), 9)) == "a b\nc" and one(T.trim_lines(F.lit(None).cast("string"), 3)) == ""
    assert one(T.trim_lines(F.lit("a b\nc"), 2)) == "a b"
    assert one(T.without_json_tail(F.lit('The  valve ",\n      "verified_url": true, "title": "x"'))) == 'The valve ",'
    assert one(T.without_json_tail(F.lit('"title": stays {here}'))) == 'title": stays {here'
