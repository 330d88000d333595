from __future__ import annotations

import random

from quarryspan.operators.references import Reference, orphan_references, orphan_report

PARENT = "key string, created_at timestamp"
REF = "id long, key string, created_at string"


def _frames(spark, parents, refs, deleted):
    import datetime

    day = lambda n: datetime.datetime(2025, 1, 1) + datetime.timedelta(days=n)
    p = spark.createDataFrame([(k, day(n)) for k, n in parents], PARENT)
    r = spark.createDataFrame([(i, k, None if n is None else day(n).isoformat() + "Z") for i, k, n in refs], REF)
    d = spark.createDataFrame(deleted, "key_table string, key_value string")
    return p, r, d


def _expected(parents, refs, deleted):
    first, gone = {}, {k for t, k in deleted if t == "p"}
    for k, n in parents:
        if k:
            first[k] = min(n, first.get(k, n))
    out = set()
    for i, k, n in refs:
        if not k:
            continue
        if k not in first:
            out.add((i, "deleted" if k in gone else "missing"))
        elif n is not None and first[k] > n:
            out.add((i, "late"))
    return out


def test_against_brute_force_with_hot_key_and_repeats(spark):
    rng = random.Random(3)
    parents = [(f"k{rng.randrange(40)}", rng.randrange(30)) for _ in range(60)] + [("", 1), (None, 1), ("hot", 5)]
    refs = [(i, "hot" if i % 3 == 0 else rng.choice([f"k{rng.randrange(60)}", "", None, " k1"]), rng.choice([None, *range(30)])) for i in range(600)]
    refs += refs[:50]
    deleted = [("p", "k55"), ("p", "k55"), ("q", "k56"), ("p", "k1"), ("p", None)]
    p, r, d = _frames(spark, parents, refs, deleted)
    got = orphan_references([Reference("t", r, "key", "p")], {"p": (p, "key", "created_at")}, d, part_rows=20, range_parents=4)
    rows = [(x["id"], x["kind"]) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == _expected(parents, refs, deleted)
    assert sum(x["orphans"] for x in orphan_report(got).collect()) == len(rows)


def test_empty_tables_and_extra_columns(spark):
    p, r, d = _frames(spark, [], [(1, "a", 1)], [])
    clash = r.withColumnRenamed("key", "key").selectExpr("*", "1 AS parent", "2 AS h", "3 AS kind", "4 AS part")
    got = orphan_references([Reference("t", clash, "key", "p")], {"p": (p, "key", "created_at")})
    assert [tuple(x)[:3] for x in got.collect()] == [("t", 1, "missing")]
    none = orphan_references([Reference("t", r.where("id < 0"), "key", "p")], {"p": (p, "key", "created_at")}, d)
    assert none.count() == 0
