"""Counting operators against plain loops."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import compute, hypothesis, paired, personas, reliability, resample
from parlance.plans import sessions


def test_pairs_that_agree_are_counted_without_pairing(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([None, 0.0, 1.0, 2.5, 7.0]), rng.choice([None, *range(9)])) for g in ("a", "b", "c") for _ in range(40)] + [("d", 1.0, 1), ("e", None, None)]
    want = {}
    for g in "abcde":
        known = [(x, y) for k, x, y in rows if k == g and x is not None and y is not None]
        pairs = [(p, q) for p, q in itertools.combinations(known, 2) if p[0] != q[0] and p[1] != q[1]]
        if pairs:
            want[g] = (len(pairs), sum((p[0] < q[0]) == (p[1] < q[1]) for p, q in pairs))
    frame = spark.createDataFrame(rows, "g string, x double, y int")
    assert {r.g: (r.n_pairs, r.n_same) for r in reliability.pair_counts(frame, ["g"], "x", "y").collect()} == want


def test_draws_follow_from_the_hash_alone(spark):
    units = list(range(50))
    frame = spark.createDataFrame([("g", u, float(u)) for u in units], "g string, u long, v double")
    draws = {r.b: r.v for r in resample.replicates(frame.repartition(7), ["g"], "u", ["v"], n=20).collect()}
    assert sorted(draws) == list(range(20))
    for b, mean in draws.items():
        weight = []
        for u in units:
            digest = hashlib.md5(f"12345|{b // 8}|{u}".encode()).hexdigest()
            x = int(digest[4 * (b % 8) : 4 * (b % 8) + 4], 16)
            weight.append(sum(x >= t for t in resample.POISSON))
        assert abs(sum(w * u for w, u in zip(weight, units, strict=True)) / sum(weight) - mean) < 1e-9
    ends = resample.bootstrap_mean(frame, ["g"], "u", "v").first()
    assert ends.n == 50 and ends.lo < 24.5 < ends.hi and 6 < ends.hi - ends.lo < 10


def test_draws_of_names_of_any_length_are_those_of_the_hash():
    units = [None, "", "7", "x" * 44, "x" * 46, "x" * 47, "y" * 300, "\u00e9" * 20]
    got = resample.drawn(9, units, 3, 850)
    for u, row in zip(units, got, strict=True):
        for b in (3, 79, 80, 807, 849):
            digest = hashlib.md5((f"9|{b // 8}" + ("" if u is None else f"|{u}")).encode()).hexdigest()
            x = int(digest[4 * (b % 8) : 4 * (b % 8) + 4], 16)
            assert row[b - 3] == sum(x >= t for t in resample.POISSON)
    assert len(resample._digests(np.zeros((3, 64), "uint8"))) == 3


def test_contrast_conventions(spark):
    rows = [("all_zero", i, 1.0, 1.0) for i in range(4)] + [("few", i, 1.0, 0.0) for i in range(2)] + [("some", i, float(d), 0.0) for i, d in enumerate((1, -2, 3, 0, 3))]
    pairs = spark.createDataFrame(rows, "g string, persona_id int, a double, b double").withColumn("d", F.col("a") - F.col("b"))
    got = {r.g: r for r in paired.of_pairs(pairs, ["g"]).collect()}
    assert (got["all_zero"].n_nonzero, got["all_zero"].p, got["all_zero"].w, got["all_zero"].dz) == (0, 1.0, None, None)
    assert (got["few"].n, got["few"].p, got["few"].mean_delta) == (2, None, None)
    assert (got["some"].n, got["some"].n_nonzero, got["some"].t_plus, got["some"].t_minus, got["some"].w, got["some"].median_delta) == (5, 4, 8.0, 2.0, 2.0, 1.0)


def test_small_operators(spark):
    t = spark.createDataFrame([("abcd", "abxd"), ("", "a"), ("same", "same"), ("a", "ab")], "a string, b string")
    assert [r.n for r in t.select(compute.shared_prefix(F.col("a"), F.col("b")).alias("n")).collect()] == [2, 0, 4, 1]
    grid = sessions.persona_grid(spark).orderBy("persona_id").collect()
    names = list(sessions.PERSONA)
    assert [tuple(r[n] for n in names) for r in grid] == list(itertools.product(*sessions.PERSONA.values()))
    order = {(r.iteration, r.file_index): r.persona_id for r in personas.persona_order(spark, 7, 2, 10).collect()}
    want = list(range(10))
    random.Random(9).shuffle(want)
    assert [order[1, i] for i in range(10)] == want
    normal = spark.createDataFrame([("g", float(x)) for x in (-2, -1, -1, 0, 0, 0, 1, 1, 2)], "g string, score double")
    r = hypothesis.jarque_bera(normal, ["g"]).first()
    assert abs(r.skew) < 1e-12 and 0.5 < r.p <= 1


def test_replicates_are_weighed_before_they_are_dealt(spark, monkeypatch):
    """Keys of two kinds with nulls, null and infinite values, no unit; groups sent two at a time; no row is multiplied by the replicates."""
    monkeypatch.setattr(resample, "HELD", 2)
    rows = [(None if i % 5 == 0 else f"k{i % 3}", i % 2 or None, None if i % 7 == 0 else i % 11, None if i % 4 == 0 else i / 3, float("inf") if i == 9 else i * 1.5) for i in range(90)]
    df = spark.createDataFrame(rows, "a string, b2 int, u int, x double, y double")
    out = resample.replicates(df, ["a", "b2"], "u", ["x", "y"], n=20, seed=3)
    got = {(r.a, r.b2, r.b): (r.x, r.y) for r in out.collect()}
    units = sorted({None if r[2] is None else str(r[2]) for r in rows}, key=str)
    w = dict(zip(units, resample.drawn(3, units, 0, 20).astype(int), strict=True))
    want = {}
    for key in {r[:2] for r in rows}:
        for b in range(20):
            own = [(r, w[None if r[2] is None else str(r[2])][b]) for r in rows if r[:2] == key]
            if any(n for _, n in own):
                mean = lambda at: (lambda k: sum(n * r[at] for r, n in k) / sum(n for _, n in k) if k else None)([(r, n) for r, n in own if n and r[at] is not None])  # noqa: B023, E731
                want[(*key, b)] = (mean(3), mean(4))
    assert got.keys() == want.keys()
    for k, pair in want.items():
        assert got[k] == tuple(v if v is None else pytest.approx(v) for v in pair), k
    assert "_w" not in out._jdf.queryExecution().optimizedPlan().toString()
