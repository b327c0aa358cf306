import json
import re

import pytest

from parlance.operators import training
from parlance.plans.catalogue import QUERIES
from parlance.plans.signals import branches

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["branch_reliability", "tail_audit_by_iter", "tail_within_group", "flatten_candidates"])
def test_three_numbers_a_candidate_are_shuffled(spark, name):
    collected = re.findall(r"collect_list\(struct\((.*?)\), 0, 0\)", plan(QUERIES[name](spark, SF)))
    assert collected and all("map(" not in c and "completion" not in c for c in collected)


@pytest.mark.parametrize("name", ["branch_reliability", "tail_audit_by_iter", "tail_within_group"])
def test_only_the_fields_of_a_query_are_parsed(spark, name):
    assert "StructField(role," not in plan(QUERIES[name](spark, SF))


def test_tails_within_groups_take_no_second_shuffle(spark):
    assert "Window" not in plan(QUERIES["tail_within_group"](spark, SF))


@pytest.mark.parametrize("fields", ["BRANCH_SCORES", "BRANCH_TAILS"])
def test_fewer_fields_leave_the_records_as_they_are(spark, fields):
    def part(value, like):
        if isinstance(like, dict):
            return {k: part(value[k], v) for k, v in like.items()}
        return [part(v, w) for v, w in zip(value, like, strict=True)] if isinstance(like, list) else value

    rows = lambda df: {(r.method, r.iteration, r.branch_id): r.asDict(recursive=True) for r in df.collect()}
    whole, some = rows(branches(spark, SF)), rows(branches(spark, SF, getattr(training, fields)))
    assert whole.keys() == some.keys()
    order = lambda r: {**r, "candidates": sorted(r["candidates"], key=json.dumps)}
    for key, like in some.items():
        cut = {k: v for k, v in whole[key].items() if k in like}
        cut["candidates"] = [part(c, like["candidates"][0]) for c in cut["candidates"]]
        assert order(cut) == order(like)
