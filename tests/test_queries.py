import glob
import json
import math
import os
import random

import duckdb
import numpy as np
import pytest

from parlance.plans.catalogue import ORACLE_SQL, QUERIES
from parlance.plans.views import S

SF = "/root/testdata/sf0.001"
#: Queries whose rows SQL does not give; each has a test of its own.
BY_TEST = {"rubric_factor_space", "sessions_with_personas"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6) + 0.0:.6f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - BY_TEST))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    done = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in done.fetchall())


def test_every_query_is_compared():
    assert set(QUERIES) - set(ORACLE_SQL) == BY_TEST


def test_factor_space_is_an_eigenbasis(spark, con):
    names = ["click", "view", "purchase", "error"]
    wide = con.execute(S + "SELECT " + ", ".join(f"max(m) FILTER (questionnaire='{n}') AS {n}" for n in names) + " FROM (SELECT arm, iteration, questionnaire, avg(m0) AS m FROM (SELECT arm, iteration, persona_id, questionnaire, avg(score) AS m0 FROM c GROUP BY ALL) GROUP BY ALL) GROUP BY arm, iteration").fetchdf().dropna()
    r = wide.corr().to_numpy()
    rows = sorted(QUERIES["rubric_factor_space"](spark, SF).collect())
    for row, value in zip(rows, sorted(np.linalg.eigvalsh(r))[::-1], strict=False):
        v = np.array([row.loadings[n] for n in names])
        assert np.allclose(r @ v, value * v, atol=1e-8) and np.isclose(v @ v, 1) and v[np.abs(v).argmax()] > 0
        assert np.isclose(row.explained, value / 4)
    assert [row.component for row in rows] == [1, 2]


def test_sessions_meet_personas_in_the_recorded_order(spark):
    for r in QUERIES["sessions_with_personas"](spark, SF).collect():
        order = list(range(96))
        random.Random(42 + r.iteration + 1).shuffle(order)
        assert r.persona_id == (order[r.file_index] if 0 <= r.file_index < 96 and r.iteration < 5 else -1)


def test_set_queries_keep_every_persona(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").where("value IS NOT NULL").select("user_id", "ts", "props").collect()
    arm = lambda r: json.loads(r.props)["k"] % 4
    a, b = ({((r.ts.day - 1) // 6, r.user_id) for r in rows if arm(r) == k} for k in (0, 1))
    for name, want in {"common_units": a & b, "all_units": a | b, "one_sided_units": a - b}.items():
        assert sorted(map(tuple, QUERIES[name](spark, SF).collect())) == sorted(want)


def test_every_total_is_a_budget(spark):
    totals = QUERIES["cost_cumsum"](spark, SF).where("arm = '1-URGENT'").collect()
    assert {r.budget for r in QUERIES["budget_sweep_whole"](spark, SF).collect()} == {r.cum_cost for r in totals}
    assert len({r.iteration % 6 for r in totals}) == 6
