"""Means that are compared for equality: the order in which rows lie must not make or break a tie."""

from datetime import datetime
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from parlance.operators import paired
from parlance.plans.catalogue import QUERIES

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Eight conversations of one length. The first two have the same scores in the same order of events, which the second's rows do not lie in."""
    rows = []

    def add(unit, event, value):
        rows.append((event, datetime(2024, 1, 1), unit, "click", value, '{"k": 0}'))

    for i, unit in enumerate(range(1, 48, 6)):
        given = (0.1, 0.2, 0.3) if i < 2 else (1.0 + i,)
        for at, v in (reversed if i == 1 else list)(list(enumerate(given))):
            add(unit, 100 * i + 2 * at, v)
        add(unit, 100 * i + 1, 1.0 + i)
    out = tmp_path_factory.mktemp("order")
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{out}/events.parquet")
    return str(out)


def test_same_scores_tie_wherever_their_rows_lie(spark, folder):
    assert [tuple(r) for r in QUERIES["agreement_cells"](spark, folder).collect()] == [("A_K0", 0, 2, 27, 27)]
    assert [(r.n_pairs, r.agreement) for r in QUERIES["by_cooperation"](spark, folder).collect()] == [(27, 1.0)]
    assert [(r.n_pairs, r.agreement) for r in QUERIES["faithfulness_by_iter"](spark, folder).collect()] == [(27, 1.0)]
    assert {(r.bin, r.n_pairs) for r in QUERIES["faithfulness_curve"](spark, folder).collect()} == {("1-2", 27), ("all", 27)}


def test_means_follow_the_given_order(spark):
    values = [0.1, 0.2, 0.3, 1e16, None, -1e16, 0.7]
    rows = spark.createDataFrame([(u, i, v, 2.0 if u else None) for u in range(3) for i, v in enumerate(values)], "u int, i int, v double, w double")
    total = 0.0
    for v in values:
        total += v or 0.0
    for dealt in (rows.repartition(5, "i"), rows.orderBy(F.desc("i")), rows.coalesce(1)):
        got = {r.u: (r.v, r.w, r.i) for r in paired.means_in_order(dealt, ["u"], "i", "v", "w").collect()}
        assert got == {0: (total / 6, None, 0), 1: (total / 6, 2.0, 0), 2: (total / 6, 2.0, 0)}


def test_rubrics_are_added_up_in_the_order_of_their_first_events(spark, tmp_path):
    """The same three scores whatever the order of the rubrics' names: six conversations tie, and the last is above them."""
    rows = []
    for i, names in enumerate([*permutations("abc"), "bca"]):
        unit = 6 * i + 1
        for at, (name, v) in enumerate(zip(names, (0.1, 0.2, 0.3 + (i > 5)), strict=True)):
            rows += [(10 * i + 2 * at, datetime(2024, 1, 1), unit, name, v, '{"k": 0}'), (10 * i + 2 * at + 1, datetime(2024, 1, 1), unit, name, float(i), '{"k": 0}')]
    spark.createDataFrame(rows[::-1], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in QUERIES["agreement_cells"](spark, str(tmp_path)).collect()] == [("A_K0", 0, 2, 6, 6)]


def test_signs_of_differences_follow_the_order_of_events(spark, tmp_path):
    """0.1 + 0.2 + 0.3 over three is more than 0.2, 0.3 + 0.2 + 0.1 over three is less; the latest iteration has the first event."""
    day = lambda i: datetime(2024, 1, 1 + 6 * i)
    rows = []
    for unit in range(40):
        given = [(i, v) for i, v in enumerate((0.1, 0.2, 0.3))]
        rows += [(100 * unit + 2 - i, day(i), unit, "click", v, '{"k": 0}') for i, v in (given, given[::-1])[unit % 2]]
        rows.append((100 * unit + 50, day(0), unit, "click", 0.2, '{"k": 1}'))
    for dealt in (rows, rows[::-1]):
        spark.createDataFrame(dealt, EVENTS).repartition(3, "ts").write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        assert [(r.n, r.n_up, r.n_down) for r in QUERIES["paired_models"](spark, str(tmp_path)).collect()] == [(40, 0, 40)]


def test_rank_agreement_leaves_out_the_same_tie(spark, folder):
    assert [(r.n_pairs, r.agreement) for r in QUERIES["rank_agreement"](spark, folder).collect()] == [(27, 1.0)]


def test_gains_that_cancel_have_no_retention(spark, tmp_path):
    """0.3 - 0.1 and 0.0 - 0.2 add up to nothing but rounding; without the third unit a resample has no gain to divide by."""
    rows = []
    for unit, (before, after, judge) in enumerate([(0.1, 0.3, 1.0), (0.2, 0.0, 2.0), (0.0, 5.0, 5.0)]):
        given = [(before, 1), (0.0, 1), (after, 7), (judge, 7)]
        rows += [(10 * unit + at, datetime(2024, 1, day), unit, "click", v, '{"k": 0}') for at, (v, day) in enumerate(given)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    (r,) = QUERIES["retention_ci_hash"](spark, str(tmp_path)).collect()
    assert r.n == 3 and max(abs(r.lo), abs(r.hi)) < 1000
