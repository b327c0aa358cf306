"""The lake and its fold, nested records, manifests, caches, ledgers and tables on small folders."""

import json
import os

import pytest
from pyspark.sql import functions as F

from parlance import sinks, sources
from parlance.operators import training
from parlance.sinks import ledger


def put(path, text):
    os.makedirs(path.parent, exist_ok=True)
    path.write_text(text)


@pytest.fixture
def lake(tmp_path):
    root = tmp_path / "lake"
    for judge in ("a", "b"):
        for metric in ("q1", "q2"):
            for model in ("m_Base", "m_I1"):
                for i in range(3):
                    put(root / f"judge={judge}/rep=0/metric={metric}/model={model}/{i}.csv", f"mean,total,n_items\n{i}.5,{i * 12},12\n9,9,9\n")
                put(root / f"judge={judge}/rep=0/metric={metric}/model={model}/notes.csv", "mean,total,n_items\n7,7,7\n")
    return root


def test_fold_equals_lake_and_serves_only_what_is_current(spark, lake, tmp_path):
    root, out = f"file:{lake}", f"file:{tmp_path}/fold"
    rows = sources.read_scores(spark, root)
    assert rows.count() == 24 and rows.where("mean = 9 OR mean = 7").count() == 0
    assert {(r.judge, tuple(r.reps)) for r in sources.judges(rows).collect()} == {("a", (0,)), ("b", (0,))}
    sources.fold(spark, root, out)
    assert sources.verify_fold(spark, root, out).count() == 0
    assert sources.fold_status(spark, root, out).first() == (4, 0)
    report = sources.fold_report(spark, root, out).first()
    assert report.lake_files == 32 and report.fold_files < 32
    put(lake / "judge=a/rep=0/metric=q1/model=m_I1/0.csv", "mean,total,n_items\n4.25,51,12\n")
    assert sources.fold_status(spark, root, out).first() == (3, 1)
    assert sorted(map(tuple, sources.served(spark, root, out).collect())) == sorted(map(tuple, sources.read_scores(spark, root).select("judge", "rep", "metric", "model", "file_index", "mean", "total", "n_items").collect()))
    assert {r.side for r in sources.verify_fold(spark, root, out).collect()} == {"lake", "fold"}


def test_nested_records_and_pairs(spark, tmp_path):
    good = {"method": "PTO", "iteration": 2, "phase": "train", "branch_id": 5, "chosen_idx": 1, "candidates": [{"idx": 0, "completion": "x", "score": 1.0, "sub_scores": {"Q1": 1.0}, "lookahead": {"k": 5, "realized_turns": 3}}, {"idx": 1, "completion": " ", "score": None}]}
    put(tmp_path / "gen/a.jsonl", json.dumps(good) + "\nnot json\n")
    records, bad = sources.read_generations(spark, f"file:{tmp_path}/gen")
    flat = training.flatten(records).orderBy("cand_idx").collect()
    assert [(r.train_iter, r.eval_iter, r.cand_idx, r.score, r.q1, r.realized_turns, r.is_chosen, r["empty"]) for r in flat] == [(2, 1, 0, 1.0, 1.0, 3, False, False), (2, 1, 1, None, None, None, True, True)]
    assert [r.value for r in bad.collect()] == ["not json"]
    for i in (1, 2):
        put(tmp_path / f"run/iteration_{i}/pairs.csv", f"conversation_id,chosen_score,rejected_score\n{i},0.9,0.{i}\n")
    assert sorted((r.iteration, round(r.margin, 6)) for r in sources.read_pairs(spark, f"file:{tmp_path}/run").collect()) == [(1, 0.8), (2, 0.7)]


def test_arms_and_cache(spark, tmp_path):
    for name, n in (("PTO_LA5_MCL40_full_gpt", 2), ("odd", 1)):
        for i in range(n):
            put(tmp_path / f"runs/{name}/iteration_{i}/0.csv", "role,text\n")
    put(tmp_path / "runs/odd/run_metadata.json", '{"steps": 7}\n')
    arms = sources.discover_arms(spark, f"file:{tmp_path}/runs")
    assert {(r.experiment, r.iteration, r.method, r.k, r.steps) for r in arms.collect()} == {("PTO_LA5_MCL40_full_gpt", 0, "PTO", 5, None), ("PTO_LA5_MCL40_full_gpt", 1, "PTO", 5, None), ("odd", 0, None, None, 7)}
    assert sources.filter_arms(arms, method=["PTO"], k=None, iteration=[1]).count() == 1
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    get = lambda **p: sources.cached(spark, f"file:{tmp_path}/cache", "frame", [f"file:{tmp_path}/runs"], p, build).count()
    assert (get(a=1), get(a=1), len(built)) == (3, 3, 1)
    put(tmp_path / "runs/odd/iteration_0/1.csv", "role,text\n")
    assert (get(a=1), len(built)) == (3, 2)
    assert (sources.reset_cache(spark, f"file:{tmp_path}/cache"), sources.reset_cache(spark, f"file:{tmp_path}/cache"), sources.reset_cache(spark, f"file:{tmp_path}/none")) == (2, 0, 0)
    assert (get(a=1), len(built)) == (3, 3)


def test_scores_of_a_grader(spark):
    rows = [("j", 0, "Q1", "m", 1, 2.0, 4.0, 2), ("j", 1, "Q1", "m", 1, 3.0, 8.0, 2), ("h", 0, "Q1", "m", 1, 9.0, 9.0, 2)]
    df = spark.createDataFrame(rows, "judge string, rep int, metric string, model string, file_index int, mean double, total double, n_items int")
    assert [tuple(r) for r in sources.judge_scores(df, "j").collect()] == [("j", "Q1", "m", 1, 2.5, 6.0, 2)]
    assert [r.mean for r in sources.judge_scores(df, "j", 1).collect()] == [3.0]


def test_ledger_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 2, float("nan"))], "arm string, it int, x double")
    new = ledger.entries(df, ["arm", "it"], ["x"], "main", digits=3)
    sinks.save_numbers(f"file:{tmp_path}/one", new)
    sinks.save_numbers(f"file:{tmp_path}/two", ledger.entries(df.where("arm = 'a'").withColumn("x", F.lit(5.1236)), ["arm", "it"], ["x"], "again"), old=f"file:{tmp_path}/one")
    assert {r.key: (r.value, r.source) for r in sinks.read_ledger(spark, f"file:{tmp_path}/two").collect()} == {"a.1.x": ("5.124", "again"), "b.2.x": ("null", "main")}
    sinks.save_table(df, f"file:{tmp_path}/tab/main", caption="c", order=["arm"])
    sinks.save_table(df.limit(0), f"file:{tmp_path}/tab/none", ("md",))
    back = sinks.read_markdown(spark, f"file:{tmp_path}/tab/main/md")
    assert back.dtypes == [("arm", "string"), ("it", "double"), ("x", "string")] or back.dtypes == [("arm", "string"), ("it", "double"), ("x", "double")]
    assert [r.arm for r in back.orderBy("arm").collect()] == ["a", "b"]
    assert spark.read.text(f"file:{tmp_path}/tab/none/md").first()[0] == "(no rows)"
    put(tmp_path / "tab/lost/caption/part-0.txt", "x")
    assert [r.name for r in sinks.orphan_captions(spark, f"file:{tmp_path}/tab").collect()] == ["lost"]
    for s in (1.0, 2.5):
        sinks.log_session(spark, f"file:{tmp_path}/log", 3, generation=s, training=1)
    assert {(r.phase, r.seconds) for r in sinks.cumulative_seconds(spark, f"file:{tmp_path}/log").collect()} == {("generation", 3.5), ("training", 2.0)}
    turns = spark.createDataFrame([(1, 0, "user", 'say "x"\nand'), (1, 1, "assistant", "y")], "conv_id int, turn int, role string, text string")
    sinks.save_conversations(turns, f"file:{tmp_path}/conv")
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"file:{tmp_path}/conv").where("role = 'user'").first().text == 'say "x"\nand'
