"""Shapiro-Wilk, normal quantile and studentised range against published values and numeric integration."""

import statistics

import pytest
from pyspark.sql import functions as F

from parlance.functions import distributions
from parlance.operators import hypothesis

#: Weights of men (Shapiro and Wilk 1965): W 0.79, and the p that Royston's approximation gives.
WEIGHTS = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
#: Upper 5 % points of the studentised range: means, degrees of freedom, q.
POINTS = [(2, 5, 3.635), (3, 2, 8.331), (3, 10, 3.877), (4, 20, 3.958), (5, 60, 3.977), (6, 120, 4.096), (10, 10, 5.599)]


def test_normal_quantile(spark):
    ps = [1e-9, 1e-4, 0.02, 0.025, 0.3, 0.5, 0.77, 0.98, 0.999999]
    for r in spark.createDataFrame([(p,) for p in ps], "p double").select("p", F.expr(distributions.normal_quantile("p")).alias("z")).collect():
        assert r.z == pytest.approx(statistics.NormalDist().inv_cdf(r.p), rel=1e-8, abs=1e-8)


def test_shapiro_wilk(spark):
    groups = {"weights": WEIGHTS, "far": [x + 1e6 for x in WEIGHTS], "flat": [2.0] * 9, "two": [1.0, 2.0], "line": [1.0, 2.0, 3.0], "hot": [0.0] * 400 + [1.0, 2.0, 3.0]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("weights", None)]
    got = {r.g: r for r in hypothesis.shapiro_wilk(spark.createDataFrame(rows, "g string, score double"), ["g"], chunk=7).collect()}
    assert set(got) == set(groups) - {"two"}
    for g in ("weights", "far"):
        assert got[g].w == pytest.approx(0.7888146, abs=2e-6) and got[g].p == pytest.approx(0.0067038, abs=2e-5)
    assert got["flat"].w is None and got["flat"].p is None
    assert got["line"].w == pytest.approx(1.0) and got["line"].p == pytest.approx(1.0)
    assert got["hot"].p < 1e-6


def test_studentised_range(spark):
    df = spark.createDataFrame([(k, float(n), q) for k, n, q in POINTS] + [(1, 5.0, 1.0), (3, 0.0, 1.0), (3, 5.0, 0.0)], "k int, df double, q double")
    got = df.select("k", "df", "q", distributions.studentised_range_p(F.col("q"), F.col("k"), F.col("df")).alias("p")).collect()
    for r in got[: len(POINTS)]:
        assert r.p == pytest.approx(0.05, abs=6e-5), r
    assert [r.p for r in got[len(POINTS) : -1]] == [None, None] and got[-1].p == pytest.approx(1.0)
