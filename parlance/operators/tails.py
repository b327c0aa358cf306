"""Simulated tails of candidates: their turns, their structure and simple cues in them, next to the candidate itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import end_reason, ratio

MARKER, LEAK = r"\[(THERAPIST|PATIENT)\]: ", "<|im_start|>"
#: Patterns of cues; parameters, as what counts as a cue depends on the language.
CUES = {"affirm": r"(?i)\b(?:good|great|glad|strong|brave|appreciat\w*)\b", "effusive": r"(?i)\b(?:amazing|incredible|wonderful|fantastic)\b", "wrapup": r"(?i)wrap|for now|next time|thank"}
FEATURES = (
    "tail_chars", "tail_patient_turns", "tail_therapist_turns", "tail_patient_chars", "tail_th_chars", "tail_th_turn_len", "tail_th_q_per_turn", "tail_th_affirm_rate", "tail_th_effusive_rate",
    "tail_loop", "tail_leak", "tail_ws_end", "last_patient_wrapup_cue", "cand_q", "cand_affirm", "cand_effusive", "end_reason",
)


def tail_turns(tail: Column | str) -> Column:
    """Array of (role, text) of a tail in order; what stands before the first marker belongs to none, null gives an empty array."""
    text = F.coalesce(F.col(tail) if isinstance(tail, str) else tail, F.lit(""))
    roles, texts = F.regexp_extract_all(text, F.lit(MARKER), F.lit(1)), F.split(text, MARKER, -1)
    return F.arrays_zip(roles.alias("role"), F.slice(texts, 2, F.size(texts)).alias("text"))


def tail_features(candidates: DataFrame, k: int, cues: dict[str, str] = CUES) -> DataFrame:
    """candidates (tail, completion, realized_turns and more) with the seventeen features; shares are null without a therapist turn.

    tail_loop: a therapist turn repeats the candidate or another one, blanks around it aside. last_patient_wrapup_cue: the tail ends on a
    patient's turn that has the cue. Null tails and completions are empty.
    """
    tail, said = F.coalesce("tail", F.lit("")), F.coalesce("completion", F.lit(""))
    rows = candidates.withColumns({"_turns": tail_turns("tail"), "_said": F.regexp_replace(said, r"^\s+|\s+$", "")})
    of = lambda role: F.transform(F.filter("_turns", lambda t: t["role"] == role), lambda t: t["text"])
    rows = rows.withColumns({"_th": of("THERAPIST"), "_pat": of("PATIENT"), "_last": F.element_at(F.when(F.size("_turns") > 0, F.col("_turns")), -1)})
    total = lambda texts, size: F.aggregate(texts, F.lit(0).cast("long"), lambda s, t: s + size(t).cast("long"))
    marks, has = lambda t: F.length(t) - F.length(F.replace(t, F.lit("?"), F.lit(""))), lambda c: lambda t: t.rlike(cues[c]).cast("int")
    n = F.size("_th")
    share = lambda x: ratio(x, n)
    pool = F.filter(F.concat(F.array("_said"), F.transform("_th", lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))), lambda t: t != "")
    out = {
        "tail_chars": F.length(tail), "tail_patient_turns": F.size("_pat"), "tail_therapist_turns": n, "tail_patient_chars": total("_pat", F.length), "tail_th_chars": total("_th", F.length),
        "tail_th_turn_len": share(total("_th", F.length)), "tail_th_q_per_turn": share(total("_th", marks)), "tail_th_affirm_rate": share(total("_th", has("affirm"))), "tail_th_effusive_rate": share(total("_th", has("effusive"))),
        "tail_loop": F.size(F.array_distinct(pool)) < F.size(pool), "tail_leak": F.contains(tail, F.lit(LEAK)), "tail_ws_end": tail.rlike(r"\s$"),
        "last_patient_wrapup_cue": F.coalesce((F.col("_last")["role"] == "PATIENT") & F.col("_last")["text"].rlike(cues["wrapup"]), F.lit(False)),
        "cand_q": marks(said), "cand_affirm": said.rlike(cues["affirm"]), "cand_effusive": said.rlike(cues["effusive"]), "end_reason": end_reason("realized_turns", "tail", k),
    }
    return rows.withColumns(out).drop("_turns", "_said", "_th", "_pat", "_last")


def cue_means(featured: DataFrame, by: list[str], iteration: str) -> DataFrame:
    """by, iteration (null: pooled over rows, not over iterations): mean cues of the tails beside those of the candidates."""
    g = featured.groupingSets([[*by, iteration], by], *by, iteration).agg(
        F.count(F.lit(1)).alias("n"), F.avg("tail_th_turn_len").alias("th_turn_len"), F.avg("tail_th_q_per_turn").alias("th_q"), F.avg("cand_q").alias("cand_q"), F.avg("tail_th_affirm_rate").alias("th_affirm"),
        F.avg(F.col("cand_affirm").cast("int")).alias("cand_affirm"), F.avg("tail_th_effusive_rate").alias("th_effusive"), F.avg(F.col("cand_effusive").cast("int")).alias("cand_effusive"),
        F.avg(F.col("tail_loop").cast("int")).alias("loop_rate"), ratio(F.sum("tail_patient_chars"), F.sum("tail_patient_turns")).alias("patient_turn_len"),
    )
    return g


def record_summary(branches: DataFrame, by: list[str]) -> DataFrame:
    """by: the figures of an iteration's log from its nested records: candidates, rewards, graders' success, tails, pairs and flat groups.

    A pair was emitted where a candidate is marked rejected; tau_filter_rate is the share of records without one.
    """
    score = F.filter(F.transform("candidates", lambda c: c["score"]), lambda s: s.isNotNull())
    tails = F.filter("candidates", lambda c: F.coalesce(c["lookahead"]["k"], F.lit(0)) > 0)
    add = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x))
    each = branches.select(
        *by, F.size("candidates").alias("n"), F.size(score).alias("ns"), add(score, lambda s: s).alias("s1"), add(score, lambda s: s * s).alias("s2"),
        add("candidates", lambda c: F.coalesce(c["oracle"]["success"], F.lit(False)).cast("double")).alias("ok"), F.size(tails).alias("nt"), add(tails, lambda c: F.coalesce(c["lookahead"]["realized_turns"], F.lit(0)).cast("double")).alias("turns"),
        add(tails, lambda c: F.coalesce(c["lookahead"]["ended_early"], F.lit(False)).cast("double")).alias("early"), F.exists("candidates", lambda c: F.coalesce(c["role"] == "rejected", F.lit(False))).alias("pair"), "group_std",
    )
    g = each.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_branches"), F.sum("n").alias("n_candidates"), F.sum("ns").alias("_ns"), ratio(F.sum("s1"), F.sum("ns")).alias("mean_reward"), ratio(F.sum("s2"), F.sum("ns")).alias("_sq"), ratio(F.sum("ok"), F.sum("n")).alias("success_rate"),
        ratio(F.sum("turns"), F.sum("nt")).alias("realized_turns_mean"), ratio(F.sum("early"), F.sum("nt")).alias("ended_early_share"), F.count_if("pair").alias("n_pairs"), F.avg("group_std").alias("group_std_mean"), F.avg((F.col("group_std") == 0).cast("int")).alias("flat_share"),
    )
    std = F.sqrt(F.greatest(F.col("_sq") - F.col("mean_reward") * F.col("mean_reward"), F.lit(0.0)))
    return g.withColumns({"reward_std": std, "tau_filter_rate": 1 - F.col("n_pairs") / F.col("n_branches")}).drop("_ns", "_sq")
