"""Ranks, quantiles, exact signed ranks and resampled pair counts against plain Python."""

import itertools
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import paired, ranking, reliability, resample


def frame(spark, groups):
    return spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(3)


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(1)
    return {
        "even": [rng.random() for _ in range(701)], "ties": [float(rng.randrange(5)) for _ in range(300)], "one": [3.5], "two": [2.0, -1.0],
        "hot": [7.0] * 500 + [rng.gauss(0, 1) for _ in range(40)], "wide": [10.0 ** rng.randrange(-12, 12) for _ in range(200)],
    }


def test_ranks(spark, groups):
    for row in ranking.with_rank(frame(spark, groups), ["g"], "v", "rank", "ties", parts=7).collect():
        same, less = groups[row.g].count(row.v), sum(v < row.v for v in groups[row.g])
        assert (row["rank"], row.ties) == (less + (same + 1) / 2, same)


@pytest.mark.parametrize("parts", [2, 64])
def test_quantiles(spark, groups, parts):
    rows = {r.g: r for r in ranking.quantiles(frame(spark, groups).union(spark.createDataFrame([("none", None)], "g string, v double")), ["g"], "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}, parts).collect()}
    assert set(rows) == set(groups)
    for g, vs in groups.items():
        assert np.allclose(rows[g][1:], np.percentile(vs, [0, 25, 50, 90, 100]), rtol=1e-12)


def test_quantile_of_all_rows(spark, groups):
    every = [v for vs in groups.values() for v in vs]
    assert ranking.quantiles(frame(spark, groups), [], "v", {"m": 0.5}).first().m == pytest.approx(statistics.median(every))


def test_values_whose_last_bit_differs_each_time_they_are_computed(spark, groups):
    """As means do whose parts arrive in another order: no row is lost, no rank or quantile moves."""
    shaken = F.udf(lambda v: v * (1 + random.SystemRandom().randrange(3) * 2.3e-16), "double").asNondeterministic()
    rows = frame(spark, {g: sorted(set(groups[g])) for g in ("even", "wide")}).withColumn("u", F.col("v")).withColumn("v", shaken("v"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = ranking.with_rank(ranking.with_rank(rows, ["g"], "v", "rank"), ["g"], "v", "again").collect()
        counts = ranking.ranked_counts(ranking.counted(rows, ["g"], "v"), ["g"]).collect()
        middle = {r.g: r.m for r in ranking.quantiles(rows, ["g"], "v", {"m": 0.5}).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    for g in ("even", "wide"):
        vs = sorted(set(groups[g]))
        assert sorted((r.u, r["rank"], r.again) for r in got if r.g == g) == [(v, i, i) for i, v in enumerate(vs, 1)]
        assert sorted(r._rank for r in counts if r.g == g) == list(range(1, len(vs) + 1))
        assert middle[g] == pytest.approx(statistics.median(vs), rel=1e-12)


def ranks(sizes):
    return [sum(y < x for y in sizes) + (sizes.count(x) + 1) / 2 for x in sizes]


def enumerated(d):
    kept = [x for x in d if x]
    r = ranks([abs(x) for x in kept])
    w = min(sum(a for a, x in zip(r, kept, strict=True) if x > 0), sum(a for a, x in zip(r, kept, strict=True) if x < 0))
    below = sum(sum(a for a, s in zip(r, signs, strict=True) if s) <= w for signs in itertools.product((0, 1), repeat=len(r)))
    return min(1.0, 2 * below / 2 ** len(r))


def test_signed_ranks_are_exact_for_few(spark):
    rng = random.Random(3)
    cases = {f"{n}{kind}": [rng.choice([-1, 1]) * (i + 1.5) if kind == "plain" else float(rng.randrange(-3, 5)) for i in range(n)] for n in range(1, 13) for kind in ("plain", "ties")}
    cases["zeros"] = [0.0, 0.0, 0.0]
    df = spark.createDataFrame([(k, x) for k, d in cases.items() for x in d], "g string, d double")
    for row in paired.signed_ranks(df, ["g"]).collect():
        assert row.p == pytest.approx(enumerated(cases[row.g]) if any(cases[row.g]) else 1.0), row.g


def test_signed_ranks_switch(spark):
    """Up to 50 without ties by the recurrence; 51, and ties beyond 13, by the normal."""
    of = lambda n: [(-1) ** (i % 3 == 0) * (i + 1.0) for i in range(n)]
    cases = {"50": of(50), "51": of(51), "14 and a zero": [*of(14), 0.0], "14 and a tie": [*of(13), 13.0]}
    got = {r.g: r for r in paired.signed_ranks(spark.createDataFrame([(k, x) for k, d in cases.items() for x in d], "g string, d double"), ["g"]).collect()}
    odds = np.ones(1)
    for r in range(1, 51):
        odds = np.append(odds, np.zeros(r)) / 2 + np.append(np.zeros(r), odds) / 2
    assert got["50"].p == pytest.approx(2 * odds[: int(got["50"].w) + 1].sum())
    for k in ("51", "14 and a zero", "14 and a tie"):
        assert got[k].p == pytest.approx(2 * statistics.NormalDist().cdf(-abs(got[k].z)), abs=1e-6)


def test_resampled_pairs(spark):
    rng = random.Random(5)
    rows = [("a" if i % 3 else "b", i // 2, float(rng.randrange(6)), float(rng.randrange(9))) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, u int, x double, y double")
    drawn = spark.createDataFrame([(u,) for u in range(30)], "u int").select("u", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("j"))
    drawn = drawn.select("u", "j", F.array(*resample.counts(9, F.col("j"), F.col("u"))).alias("w")).collect()
    weight = {(r.u, 8 * r.j + i): w for r in drawn for i, w in enumerate(r.w)}
    got = {(r.g, r.b): (r.n_pairs, r.n_same) for r in reliability.pair_replicates(df, ["g"], "x", "y", F.col("u"), n=16, seed=9).collect()}
    for g in "ab":
        for b in range(16):
            pairs = [(weight[p[1], b] * weight[q[1], b], (p[2] - q[2]) * (p[3] - q[3]) > 0) for p, q in itertools.combinations([r for r in rows if r[0] == g], 2) if p[2] != q[2] and p[3] != q[3]]
            assert got.get((g, b), (0, 0)) == (sum(w for w, _ in pairs), sum(w for w, same in pairs if same))


def test_resampled_pairs_are_weighed_by_parts(spark):
    """Parts of four rows, a value that most rows have, and a plan whose rows do not grow with the number of replicates before the parts are weighed."""
    rng = random.Random(6)
    rows = [(g, i, float(rng.choice([3, 3, 3, rng.randrange(40)])), float(rng.choice([5, rng.randrange(50)]))) for g, size in (("a", 150), ("b", 9), ("c", 1)) for i in range(size)]
    df = spark.createDataFrame(rows, "g string, u int, x double, y double").repartition(3)
    whole, cut = (reliability.pair_replicates(df, ["g"], "x", "y", F.col("u"), n=300, seed=9, **k) for k in ({}, {"part": 4}))
    got = {(r.g, r.b): (r.n_pairs, r.n_same) for r in cut.collect()}
    assert {k: v for k, v in got.items() if v[0]} == {(r.g, r.b): (r.n_pairs, r.n_same) for r in whole.collect() if r.n_pairs}
    for g in "abc":
        own = [r for r in rows if r[0] == g]
        w = resample.drawn(9, [str(r[1]) for r in own], 0, 300).astype(int)
        for b in (0, 8, 255, 299):
            pairs = [(w[i, b] * w[j, b], (p[2] - q[2]) * (p[3] - q[3]) > 0) for (i, p), (j, q) in itertools.combinations(enumerate(own), 2) if p[2] != q[2] and p[3] != q[3]]
            assert got.get((g, b), (0, 0)) == (sum(v for v, _ in pairs), sum(v for v, same in pairs if same))
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("md5") == 0
