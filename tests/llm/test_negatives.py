"""Operator 13 against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ecospark.llm import negatives as N


def brute(rows, every, k=5, m=5, low=80, high=100, of=100, scale=256):
    one = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [max(-(1 << 62), min(1 << 62, math.floor(max(-2.0**62, min(2.0**62, scale * float(np.float32(x))))))) for x in v]
        one[i] = min(one.get(i, (label, whole)), (label, whole))
    dot = lambda a, b: max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b))))
    out = set()
    for a, (label, v) in one.items():
        if a % every:
            continue
        scored = [(-dot(v, w), i, other) for i, (other, w) in one.items() if i != a]
        for p, i, _ in sorted(x for x in scored if x[2] == label)[:k]:
            near = sorted(x for x in scored if x[2] != label and low * -p <= of * -x[0] <= high * -p)[:m]
            out |= {(a, i, r, j, -p, -s) for r, (s, j, _) in enumerate(near, 1)}
    return out


def mined(spark, rows, every, **more):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<float>, label int, id string, length int").repartition(4)
    got = [tuple(r) for r in N.hard_negatives(df, anchor=F.col("id") % every == 0, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


def sample(n, dims, seed, near=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims))
    rows = []
    for i in range(n):
        v = centres[i % 4] + near * rng.normal(size=dims)
        v *= rng.choice([0.1, 1.0, 1.0, 3.0]) / np.linalg.norm(v)
        rows.append((i, v.astype(np.float32).tolist(), int(rng.integers(0, 3)) if i % 5 else 0))
    return rows


@pytest.mark.parametrize("dims, near", [(8, 0.1), (3, 1.0), (1, 1.0)])
def test_equals_brute_force(spark, dims, near, monkeypatch):
    monkeypatch.setattr(N, "BUCKET_ROWS", 16)
    monkeypatch.setattr(N, "ANCHOR_BYTES", 8 * 8 * 20)  # several chunks
    rows = sample(400, dims, dims, near)
    assert mined(spark, rows, 7) == brute(rows, 7)


def test_awkward_rows(spark):
    rows = sample(60, 4, 9)
    rows += [(100 + i, rows[0][1], i % 2) for i in range(40)]  # copies of one vector, ties by id
    rows += [(200, [0.0] * 4, 0), (210, [], 1), (220, [0.5], 0), (221, [0.25, 0.0, 0.5, 0.0, 1.0], 1), (230, [-1.0] * 4, 2)]
    rows += [(None, [1.0] * 4, 0), (300, None, 0), (310, [1.0] * 4, None), (320, [1.0, None, 0.0, 0.0], 0), (330, [float("nan")] * 4, 0), (340, [float("inf")] * 4, 0)]
    rows += [(0, rows[0][1], 0), (0, rows[0][1], 2), (20, [0.5] * 4, 1), (20, [0.4] * 4, 1)]  # repeated ids
    assert mined(spark, rows, 10) == brute(rows, 10)
    assert mined(spark, rows, 10, n_positives=2, n_negatives=3, low=10, high=90) == brute(rows, 10, 2, 3, 10, 90)


@pytest.mark.parametrize("size, huge", [(1e5, None), (3e6, None), (1e12, None), (1e12, 1e30)])
def test_large_components_are_exact(spark, size, huge):
    """Products in doubles, in longs and in Python's integers, there with scores limited to a long."""
    rows = [(i, [float(np.float32(x * size)) for x in v], label) for i, v, label in sample(50, 2, 3)]
    if huge:
        rows[10] = (10, [huge, 1.0], 0)
    assert mined(spark, rows, 7) == brute(rows, 7)


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(2)
    vectors = np.floor(64 * (rng.normal(size=(8, 16))[np.arange(500) % 8] + 0.2 * rng.normal(size=(500, 16))))
    bucket = N.Bucket(np.arange(500), vectors)
    anchors = N.Anchors.of(list(range(50)), [0] * 50, vectors[:50])
    scores = vectors[:50] @ vectors.T
    theta = np.sort(scores, axis=1)[:, -3]  # the anchor itself and its two next
    found = dict(bucket.candidates(anchors, np.arange(50), theta))
    assert all(set(np.flatnonzero(scores[a] >= theta[a])) <= set(found.get(a, [])) for a in range(50))
    assert sum(map(len, found.values())) < 0.5 * 50 * 500
    assert not dict(bucket.candidates(anchors, np.arange(50), np.full(50, 2 * scores.max())))


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    out = N.hard_negatives(df, anchor=F.col("id") % 100 == 0)
    assert out.count() == 0 and out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
