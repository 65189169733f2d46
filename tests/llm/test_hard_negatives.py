import math
import random

import pytest
from pyspark.sql import functions as F

from saltmarsh.llm import hard_negatives
from saltmarsh.llm.hard_negatives import mine_hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, every=10, k=5):
    """The contract, vector by vector; rows without an id come last in ties."""
    fit = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
           if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, y) in enumerate(fit):
        if i is None or i % every:
            continue
        score = [(-sum(p * q for p, q in zip(v, w, strict=False)), math.inf if j is None else j, z) for j, w, z in fit]
        pos = sorted((s, j) for b, (s, j, z) in enumerate(score) if z == y and b != a)[:k]
        for s, j in pos:
            neg = sorted((t, h) for t, h, z in score if z != y and 80 * -s <= 100 * -t <= 100 * -s)[:k]
            out += [(i, j, n + 1, h, -s, -t) for n, (t, h) in enumerate(neg)]
    none = lambda x: None if x == math.inf else x
    return sorted(((a, none(j), n, none(h), s, t) for a, j, n, h, s, t in out), key=str)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = mine_hard_negatives(df, F.col("vec_id") % 10 == 0, **more)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got.columns == columns
    return sorted((tuple(r) for r in got.collect()), key=str)


def vectors(seed, n, width, around=0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(around)]
    rows = []
    for i in range(n):
        base, spread = (rng.choice(centres), 0.2) if around else ([0] * width, 1)
        rows.append((i, [b + rng.gauss(0, spread) for b in base], rng.randrange(4)))
    return rows


@pytest.mark.parametrize("rows", [
    vectors(1, 400, 8), vectors(2, 400, 16, around=6),
    # many equal vectors, and scores of zero
    [(i, [1.0, 0.5] if i % 3 == 0 else [0.0, 0.0] if i % 3 == 1 else [i / 50, -0.5], i % 2) for i in range(200)],
    # negative scores only
    [(i, [1.0 if i % 2 else -1.0], i % 2) for i in range(40)] + [(100, [3.0], 7), (110, [-2.0], 7)],
], ids=["anywhere", "clustered", "ties", "opposed"])
def test_equals_the_plain_search(spark, rows, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST_BLOCK", 60)
    assert mined(spark, rows, clusters=5) == plain(rows)


def test_small_steps_end_early_and_change_nothing(spark, monkeypatch):
    rows = vectors(3, 300, 6, around=5)
    monkeypatch.setattr(hard_negatives, "LEAST_BLOCK", 100)
    monkeypatch.setattr(hard_negatives, "BLOCK_COMPONENTS", 6 * 80)
    assert mined(spark, rows, clusters=3) == plain(rows)


def test_walks_end_before_the_list_does():
    import numpy as np

    rng = np.random.default_rng(0)
    centres = np.eye(8)
    x = np.round(1000 * (centres[np.repeat(np.arange(8), 4000)] + rng.normal(0, 0.02, (32_000, 8))))
    labels = np.tile([0, 1], 16_000)
    anchors = x[:50]
    widest = np.array([hard_negatives.angles(anchors, c).max() for c in centres])
    block = hard_negatives.Block(np.arange(32_000), np.arange(32_000), labels, x, centres, widest)
    seen = []
    block.sort_for(0)
    real = hard_negatives.products
    hard_negatives.products = lambda a, b: seen.append(len(b)) or real(a, b)
    try:
        best = hard_negatives.first_positives(block, np.arange(50), labels[:50], anchors, 5)
    finally:
        hard_negatives.products = real
    assert sum(seen) < 16_000
    everything = anchors @ x.T
    everything[np.arange(50), np.arange(50)] = -np.inf
    everything[labels[:50, None] != labels[None]] = -np.inf
    assert np.array_equal(np.sort(best.score.reshape(50, 5)), np.sort(np.sort(everything)[:, -5:]))


def test_rows_that_take_no_part_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(4, 60, 4) + [
        (60, None, 1), (70, [nan, 1.0, 1.0, 1.0], 1), (80, [inf, 0.0, 0.0, 0.0], 1), (90, [None, 1.0, 1.0, 1.0], 2), (100, [1.0, 1.0, 1.0, 1.0], None),
        (None, [1.0, 1.0, 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0, 1.0], 2), (110, [], 1), (120, [2.0, 1.0], 2), (0, [1.0, 2.0, 3.0, 4.0], 1),
        (10, [1.0, 0.0, 1.0, 0.0], 3), (10, [1.0, 0.0, 1.0, 0.0], 3), (130, [0.5, 0.5, 0.5, 0.5], 99)]
    assert mined(spark, rows) == plain(rows)


def test_large_components_stay_exact(spark):
    rng = random.Random(9)
    rows = [(i, [float(rng.randrange(1 << 20)) for _ in range(4)], i % 3) for i in range(60)]
    assert mined(spark, rows) == plain(rows)
    rows = [(i, [3e30, -1.0], i % 2) for i in range(20)]
    assert len(mined(spark, rows)) == 2 * 5 * 5


def test_empty_tables_and_clashing_columns(spark):
    assert mined(spark, [(None, None, None)]) == [] and mined(spark, [(0, [1.0], 1)]) == []
    rows = vectors(5, 50, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("row", "x", "block", "cluster", "score", "rank", "anchor_id", "is_anchor", "nth", "other"):
        df = df.withColumn(name, F.lit("own"))
    got = mine_hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)
    assert mine_hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
