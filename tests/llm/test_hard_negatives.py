"""Hard negatives against brute force: ties, repeated rows, nulls, vectors of several lengths, a hot label, several blocks."""

import math

import numpy as np
import pytest

from parlance.llm import hard_negatives


def brute(rows):
    """rows of (vec_id, label, vector); rows are told apart by their place."""
    kept = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(x)) for x in v]) for i, v, label in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for r, (anchor, label, x) in enumerate(kept):
        if anchor % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i, k == label) for q, (i, k, v) in enumerate(kept) if q != r and len(v) == len(x))
        for p, pid, _ in [s for s in scored if s[2]][:5]:
            hard = [(n, s) for s, n, same in scored if not same and 30 * -p <= 100 * -s <= 90 * -p][:10]
            out += [(anchor, pid, k, n, -p, -s) for k, (n, s) in enumerate(hard, 1)]
    return sorted(out)


def made(seed, n, labels, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, 12))
    rows = []
    for i in range(n):
        label = 0 if rng.random() < 0.4 else int(rng.integers(labels))
        v = centres[int(rng.integers(labels)) if rng.random() < 0.3 else label] + spread * rng.normal(size=12)
        rows.append((i, [float(np.float32(x)) for x in v], label))
    return rows


EDGE = [
    (100, [0.5] * 12, 1), (100, [0.5] * 12, 1), (5000, None, 1), (None, [1.0] * 12, 1), (5001, [1.0] * 12, None), (5002, [1.0, None] * 6, 1), (5100, [float("nan")] * 12, 1), (5200, [0.0] * 12, 2),
    (5300, [1.0, 2.0, 3.0], 1), (5301, [1.0, 2.0, 3.0], 1), (5302, [1.0, 1.0, 2.0], 2), (5303, [0.9, 1.8, 2.7], 3), (5400, [], 1), (5401, [], 1), (5402, [], 2), (5500, [-0.0005] * 12, 3),
]


@pytest.mark.parametrize("rows", [made(1, 1500, 6, 0.05) + EDGE, made(2, 700, 3, 1.0)], ids=["clusters", "spread"])
def test_hard_negatives(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "vec_id long, embedding array<float>, label int, id string, row int").repartition(5)
    got = hard_negatives.hard_negatives(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_groups_are_bounded():
    """With narrow clusters most candidates are sent to few groups."""
    rows = made(3, 3000, 8, 0.02)
    x = np.floor(256 * np.array([v for _, v, _ in rows]))
    labels = np.array([k for *_, k in rows])
    space = hard_negatives.Space(x, np.arange(len(x)), labels, float((x * x).sum(1).max()), len(x))
    least = hard_negatives._least_positive(space, x[:100], np.arange(100), labels[:100], None)
    cell, d = space.groups(x[:100])
    far = space.reach(x[:100], least)
    apart = space.distances(space.lifted(x))
    served = np.mean([((d[cell == g] - far[cell == g][:, None]).min(0) <= apart).__and__(apart <= (d[cell == g] + far[cell == g][:, None]).max(0)).all(1).mean() for g in np.unique(cell)])
    assert served < 0.6


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(none).count() == 0
