"""Session logs folded run by run, and the order of personas against what was recorded."""

import json
import random

import pytest

from parlance import streaming
from parlance.operators import personas


def put(folder, name, *records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("record_id", "unit", "iteration", "phase", "seconds", "finished"), r, strict=True))) if isinstance(r, tuple) else r for r in records) + "\n")


FIRST = [("a", "u1", 1, "gen", 1.5, False), ("b", "u1", 1, "train", 2.0, True), ("c", "u2", 1, "gen", 4.0, None), "{not json"]
SECOND = [("c", "u2", 1, "gen", 4.0, None), ("d", "u2", 1, "train", 0.5, True), ("e", "u3", 2, "gen", None, False), (None, "u3", 2, "gen", 1.0, False), (None, "u3", 2, "gen", 1.0, False)]
WANT = [("u1", 1, 2, 3.5, True), ("u2", 1, 2, 4.5, True), ("u3", 2, 3, 2.0, False)]


@pytest.mark.parametrize("batches", [(FIRST, SECOND), (FIRST + SECOND,)], ids=["two runs", "one run"])
def test_runs_add_up(spark, tmp_path, batches):
    log, out = tmp_path / "log", str(tmp_path / "out")
    for i, records in enumerate(batches):
        put(log, f"{i}.json", *records)
        streaming.run_once(spark, str(log), str(tmp_path / "state"), out, files=1)
    streaming.run_once(spark, str(log), str(tmp_path / "state"), out)  # nothing new
    totals = streaming.latest(spark, out)
    assert sorted(map(tuple, totals.collect())) == WANT
    every = spark.read.schema(streaming.RECORD).json(str(log)).where("unit IS NOT NULL")
    assert sorted(map(tuple, streaming.session_totals(every).collect())) == WANT
    plan = spark.createDataFrame([("u1", 1, "x"), ("u2", 1, "x"), ("u3", 2, "x"), ("u4", 2, "x")], "unit string, iteration int, more string")
    assert sorted(r.unit for r in streaming.unfinished(plan, totals).collect()) == ["u3", "u4"]


def order(seed, n):
    out = list(range(n))
    random.Random(seed).shuffle(out)
    return out


def test_persona_order(spark):
    got = personas.persona_order(spark, 42, 3, n=20)
    assert sorted(map(tuple, got.collect())) == sorted((k, i, p) for k in range(3) for i, p in enumerate(order(43 + k, 20)))
    recorded = spark.createDataFrame([(0, 0, order(43, 20)[0]), (0, 1, order(43, 20)[0]), (9, 0, 1)], "iteration int, file_index long, persona_id int")
    assert sorted(map(tuple, personas.misplaced(recorded, got).collect())) == [(0, 1, order(43, 20)[0]), (9, 0, 1)]


def test_stated_ages(spark):
    texts = {"I am 61 and tired": 61, "a 45-year-old man": 45, "I'm 33.": 33, "Im 34": 34, "70 years of age": 70, "5 years ago": None, "": None, None: None, "52 years old, I am 9": 52}
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", personas.stated_age("text").alias("age"))
    assert {r.text: r.age for r in df.collect()} == texts


@pytest.mark.parametrize(("true_offset", "same_age", "verdict"), [(1, False, "confirmed"), (2, False, "rejected"), (1, True, "inconclusive")])
def test_verify_seeds(spark, true_offset, same_age, verdict):
    age = lambda p: 40 if same_age else 20 + 3 * p
    ages = spark.createDataFrame([(p, age(p)) for p in range(24)], "persona_id int, age int")
    rows = [(k, i, f"Hello, I am {age(p)}." if i % 3 else "Hello.") for k in range(2) for i, p in enumerate(order(7 + k + true_offset, 24))] + [(0, 99, "I am 40.")]
    scores = personas.seed_scores(spark.createDataFrame(rows, "iteration int, file_index long, text string"), ages, 7, 2, n=24)
    by = {(r.offset, r.iteration): r for r in scores.collect()}
    assert by[true_offset, 0].wrong == 0 and by[true_offset, 0].correct == 16 and by[true_offset, 0].unresolved == 8
    assert personas.verify_seeds(scores).first().verdict == verdict
