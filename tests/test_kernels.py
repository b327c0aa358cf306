"""Hand-computed values and edge cases."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from parlance.functions import expr
from parlance.operators import compute, hypothesis, paired, reliability, reshape, training, transcripts


def one(df):
    return df.collect()[0].asDict()


def test_holm_and_bh(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "i int, p double")
    assert [r.p_holm for r in paired.holm(df, []).orderBy("i").collect()] == [pytest.approx(0.03), pytest.approx(0.06), pytest.approx(0.06), None]
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.2)], "i int, p double")
    assert [round(r.q, 6) for r in paired.benjamini_hochberg(df, []).orderBy("i").collect()] == [0.04, 0.053333, 0.053333, 0.2]


def test_wilcoxon_and_dz(spark):
    df = spark.createDataFrame([("g", float(d), 0.0, float(d)) for d in (1, -0.5, 2, 0.5, -1.5, 3, 0)], "g string, a double, b double, d double")
    w = one(paired.wilcoxon(df, ["g"]))
    assert (w["n_nonzero"], w["t_plus"], w["t_minus"], w["w"]) == (6, 15.5, 5.5, 5.5)
    assert w["z"] == pytest.approx(1.051177, abs=1e-6) and w["p_normal"] == pytest.approx(0.293177, abs=1e-5)
    assert w["p"] == pytest.approx(22 / 64)  # 11 of the 64 choices of signs give a sum of ranks of 5.5 at most
    assert one(paired.summary(df, ["g"]))["dz"] == pytest.approx(0.423013, abs=1e-6)
    zero = df.where("d = 0")
    assert one(paired.wilcoxon(zero, ["g"]))["p"] == 1.0 and one(paired.summary(zero, ["g"]))["dz"] is None


def test_icc(spark):
    m = ((9, 2, 5, 8), (6, 1, 3, 2), (8, 4, 6, 8), (7, 1, 2, 6), (10, 5, 6, 9), (6, 2, 4, 7))
    df = spark.createDataFrame([("g", i, j, float(v)) for i, r in enumerate(m) for j, v in enumerate(r)], "g string, t int, r int, score double")
    assert one(reliability.icc_2_1(df, ["g"], "t", "r"))["icc"] == pytest.approx(0.289764, abs=1e-6)
    c = one(reliability.variance_components(df, ["g"], "t", "r"))
    assert [round(c[k], 6) for k in ("var_target", "var_rater", "var_resid")] == [2.555556, 5.244444, 1.019444]


def test_friedman(spark):
    df = spark.createDataFrame([("g", i, j, float(v)) for i, r in enumerate(((1, 2, 3), (2, 3, 1), (1, 3, 2), (1, 2, 3))) for j, v in enumerate(r)], "g string, u int, t int, score double")
    f = one(hypothesis.friedman(df, ["g"], "u", "t"))
    assert (f["chi2"], f["kendall_w"]) == (pytest.approx(3.5), pytest.approx(0.4375))


def test_group(spark):
    df = spark.createDataFrame([("a", 1, 1, i, s) for i, s in enumerate((4.0, 3.5, 3.5, 2.0))], "arm string, train_iter int, group_id int, cand_idx int, score double")
    g = one(training.group_frame(df))
    assert [round(g[k], 6) for k in ("sd0", "margin", "winner_z", "sd1")] == [0.75, 2.0, 1.0, 0.866025]
    assert [round(r.weight, 6) for r in training.standardised_weights(df).orderBy("cand_idx").collect()] == [0.6, 0.2, 0.2, -1.0]
    assert one(training.best_and_worst(df))["chosen_idx"] == 0
    assert [r.weight for r in training.pair_weights(df).orderBy("cand_idx").collect()] == [1.0, 0.0, 0.0, -1.0]
    assert training.standardised_weights(df.withColumn("score", F.lit(1.0))).count() == 0


def test_span(spark):
    df = spark.createDataFrame([(1, float(t)) for t in (0, 10, 20, 5000, 5010)], "k int, at double")
    got = one(compute.imputed_span(df, ["k"]))
    assert (got["span"], got["n_imputed"]) == (40.0, 1)


def test_labels(spark):
    df = spark.createDataFrame([(None, ""), (5, "x"), (0, ""), (3, "x "), (3, "x"), (2, "x")], "rt int, tail string")
    want = ["not_simulated", "full", "no_tail", "patient_closed", "therapist_stalled", "after_therapist"]
    assert [r[0] for r in df.select(expr.end_reason("rt", "tail", 5)).collect()] == want
    texts = spark.createDataFrame([(" hi<|im_end|>x",), (None,), ("bye SESSION ended now",)], "t string")
    assert [r[0] for r in texts.select(expr.clean_completion("t")).collect()] == ["hi", "", "bye SESSION ended now"]
    end = [r[0] for r in texts.select(expr.session_end("t", "SESSION ENDED")).collect()][2]
    assert (end.said, end.explanation, end.ended) == ("bye", "now", True)
    names = spark.createDataFrame([("PTO_LA5_MCL40_full_gpt",), ("other",), ("PTOExp3_LA5_I7",)], "n string")
    parts = [r[0] for r in names.select(expr.experiment_parts("n")).collect()]
    assert (parts[0].method, parts[0].k, parts[0].mcl, parts[0].oracle, parts[1].method) == ("PTO", 5, 40, "gpt", None)
    assert [r[0] for r in names.select(expr.model_iteration("n")).collect()] == [-1, -1, 7]


def test_flatten(spark):
    row = {"method": "GRPO", "iteration": 2, "phase": "train", "conversation_id": 1, "branch_id": 3, "chosen_idx": 1, "candidates": [{"idx": 0, "completion": " ", "score": None}, {"idx": 1, "completion": "a", "score": 2.0, "sub_scores": {"Q1": 4.0}}]}
    got = training.flatten(spark.createDataFrame([row], training.BRANCH)).orderBy("cand_idx").collect()
    assert [(r.eval_iter, r.epoch, r.is_chosen, r.empty, r.q1) for r in got] == [(1, -1.0, False, True, None), (1, -1.0, True, False, 4.0)]


def test_split_by_group(spark):
    df = spark.createDataFrame([(i // 5, i) for i in range(50)], "g int, i int")
    s = training.grouped_split(df, "g", 0.2, 1)
    assert s.where("split = 'eval'").select("g").distinct().count() == 2 and s.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert training.grouped_split(df.where("g = 1"), "g", 0.2, 1).where("split = 'eval'").count() == 0


def test_transcript_round_trip(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b\n\nc"), (1, 2, "system", "z"), (1, 3, "user", " ")], "conv_id int, turn int, role string, text string")
    t = transcripts.transcript(turns, {"user": "PATIENT", "assistant": "THERAPIST"})
    assert one(t)["transcript"] == "[PATIENT] a\n\n[THERAPIST] b\n\nc"
    back = transcripts.messages_of(t, "transcript", {"PATIENT": "user", "THERAPIST": "assistant"}, "conv_id").orderBy("pos").collect()
    assert [(r.role, r.content) for r in back] == [("user", "a"), ("assistant", "b\n\nc")]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "arm string, questionnaire string, iteration int, persona_id int, score double")
    assert paired.main_results(e).count() == 0 and reshape.coverage(e, ["arm"], "persona_id", 5, 2).count() == 0


def test_grouped_split_orders_few_ids(spark):
    """Every id is hashed and counted, only those that share the first digits of the last chosen one are put in order."""
    df = spark.range(5000).select(F.when(F.col("id") % 1000 > 0, F.col("id")).alias("g"))
    out = training.grouped_split(df, "g", 0.1, 7)
    ids = [r.g for r in df.distinct().collect()]
    order = sorted(ids, key=lambda g: (hashlib.md5(("7" if g is None else f"7|{g}").encode()).hexdigest(), g or -1))
    assert {r.g for r in out.where("split = 'eval'").collect()} == set(order[: int(len(ids) * 0.1)]) - {None}
    limits = re.findall(r"(?:GlobalLimit|LocalLimit) (\d+)", out._jdf.queryExecution().optimizedPlan().toString())
    assert all(int(n) < 50 for n in limits)
