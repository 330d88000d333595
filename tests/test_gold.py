"""The published gold set (three queries, twenty labelled candidates) and the published figures for it."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarryspan import dims
from quarryspan.operators.scoring import evaluate_gold
from quarryspan.sources.snapshots import read_gold

GOLD = str(Path(__file__).parent / "fixtures" / "gold.json")


@pytest.fixture(scope="module")
def gold(spark):
    return read_gold(spark, GOLD)


def test_published_macro_figures(gold):
    r = evaluate_gold(gold).agg(*[F.round(F.avg(c), 3).alias(c) for c in ("precision", "recall", "f1", "p_at_k", "ap", "rr")]).first()
    assert tuple(r) == (0.611, 0.833, 0.683, 0.667, 0.759, 0.778)


def test_published_sweep(gold):
    rows = evaluate_gold(gold, dims.SWEEP).groupBy("threshold").agg(*[F.round(F.avg(c), 3).alias(c) for c in ("precision", "recall", "f1")]).collect()
    want = {2.5: (0.651, 1.0, 0.748), 2.8: (0.611, 0.833, 0.683), 3.0: (0.611, 0.833, 0.683), 3.2: (0.611, 0.833, 0.683), 3.5: (0.667, 0.833, 0.733), 4.0: (0.556, 0.667, 0.6), 4.5: (0.556, 0.5, 0.489)}
    assert {r["threshold"]: (r["precision"], r["recall"], r["f1"]) for r in rows} == want
