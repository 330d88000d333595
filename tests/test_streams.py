"""Streams in several micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryspan.streaming import events as E


def _files(spark, tmp_path, name, schema, batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"{name}.parquet"))


def test_attempts_over_batches_with_repeats_across_them(spark, tmp_path):
    schema = "id long, session_id string, source_type string, attempt int, status string"
    first = [(1, "a", "web", 1, "failed"), (2, "a", "patent", 1, "ok"), (3, "b", "web", 1, "ok")]
    second = [(1, "a", "web", 1, "failed"), (4, "a", "web", 2, "ok"), (5, "c", "web", 1, "failed")]
    third = [(4, "a", "web", 2, "ok"), (6, "a", "web", 2, "partial"), (2, "a", "patent", 1, "ok")]
    _files(spark, tmp_path, "evidence_results", schema, [first, second, third])
    stream = E.stream_of(spark, str(tmp_path), "evidence_results", files=1)
    out = E.run_to_table(E.attempt_states(stream), "update", ["session_id", "source_type"]).collect()
    assert sorted(tuple(r) for r in out) == [("a", "patent", 1, 1, "ok"), ("a", "web", 3, 2, "partial"), ("b", "web", 1, 1, "ok"), ("c", "web", 1, 1, "failed")]


def test_counts_over_batches(spark, tmp_path):
    rows = [spark.sql(f"SELECT TIMESTAMP '2025-01-0{d} 10:00:00' AS ts, 'x' AS event_type") for d in (1, 1, 2)]
    for r in rows:
        r.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = E.stream_of(spark, str(tmp_path), "events", files=1)
    out = E.run_to_table(E.windowed_counts(stream, "ts", "event_type"), "complete")
    assert sorted(r["n"] for r in out.select(F.col("n")).collect()) == [1, 2]
    assert E.run_to_table(E.without_repeats(E.stream_of(spark, str(tmp_path), "events", files=1), ["ts"], "ts", "3 days")).count() == 2
