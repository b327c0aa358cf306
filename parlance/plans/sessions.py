"""Queries on conversations as sessions of an arm: coded behaviour, text metrics, cross-checks, rubric rows and trainer steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import clean_completion, label_count, ratio, session_end
from ..operators import behavior, paired, reshape, training, transcripts
from .scores import _P6, _R6, _contrast_sql, _holm_sql, _k, _pairs_sql
from .views import ARMS, ITEMS, S, items_long, query, r6, scores_long, sql6, table

KEYS = ["arm", "iteration", "persona_id"]


def coded(spark, sf_dir) -> DataFrame:
    """Counts of six behaviours and four global ratings of a session (arm, iteration, persona_id)."""
    s = scores_long(spark, sf_dir)
    n = lambda q: F.count_if(F.col("questionnaire") == q)
    mean = lambda q: F.avg(F.when(F.col("questionnaire") == q, F.col("score"))) / 10
    return s.groupBy(*KEYS, "method", "k").agg(
        n("click").alias("sr"), n("view").alias("cr"), n("purchase").alias("q"), n("signup").alias("af"), n("error").alias("persuade"), F.count_if(F.col("judge") == 1).alias("seek"),
        mean("click").alias("g1"), mean("view").alias("g2"), mean("purchase").alias("g3"), mean("signup").alias("g4"),
    )


_CODE = S + """, cd AS (SELECT arm, iteration, persona_id, method, k, count(*) FILTER (questionnaire='click') AS sr, count(*) FILTER (questionnaire='view') AS cr, count(*) FILTER (questionnaire='purchase') AS q,
 count(*) FILTER (questionnaire='signup') AS af, count(*) FILTER (questionnaire='error') AS persuade, count(*) FILTER (judge=1) AS seek, avg(score) FILTER (questionnaire='click')/10 AS g1, avg(score) FILTER (questionnaire='view')/10 AS g2,
 avg(score) FILTER (questionnaire='purchase')/10 AS g3, avg(score) FILTER (questionnaire='signup')/10 AS g4 FROM s GROUP BY ALL),
mi AS (SELECT *, (sr+cr)::DOUBLE/nullif(q,0) AS r_to_q, cr::DOUBLE/nullif(sr+cr,0) AS pct_cr, (sr+cr+af+seek)::DOUBLE/nullif(sr+cr+af+seek+persuade,0) AS pct_mico, (g1+g2)/2 AS technical, (g3+g4)/2 AS relational FROM cd)
"""
_MI = ("r_to_q", "pct_cr", "pct_mico", "technical", "relational")


def shapes(spark, sf_dir) -> DataFrame:
    """Text metrics of the therapist's turns of a session; conversations are dealt over arms, iterations and personas."""
    t = transcripts.turn_metrics(table(spark, sf_dir, "conversations"), "assistant", ",")
    arm = F.element_at(F.array(*map(F.lit, ARMS)), (F.col("conv_id") % 4 + 1).cast("int"))
    return t.select(
        "conv_id", arm.alias("arm"), (F.floor(F.col("conv_id") / 4) % 5).cast("int").alias("iteration"), F.floor(F.col("conv_id") / 20).cast("long").alias("persona_id"),
        F.substring(arm, 1, 1).alias("method"), F.substring(arm, 4, 1).cast("int").alias("k"), "n_turns", "mean_chars", "max_repeat", "loop", "marks_per_turn",
    )


_SHAPE = """, o AS (SELECT conv_id, trim(text, ' ') AS said, count(*) AS times, sum(length(text)) AS chars, sum(length(text)-length(replace(text, ',', ''))) AS marks FROM conversations WHERE role='assistant' AND text IS NOT NULL GROUP BY ALL),
og AS (SELECT conv_id, sum(times)::BIGINT AS n, sum(chars) AS ch, max(times) AS mr, sum(marks) AS mk FROM o GROUP BY ALL),
sh AS (SELECT conv_id, (['A_K0','A_K5','B_K0','B_K5'])[1+conv_id%4] AS arm, ((conv_id//4)%5)::INT AS iteration, (conv_id//20)::BIGINT AS persona_id, coalesce(n,0) AS n_turns, coalesce(ch/nullif(n,0)::DOUBLE,0) AS mean_chars, coalesce(mr,0)::BIGINT AS max_repeat, coalesce(mk/nullif(n,0)::DOUBLE,0) AS marks_per_turn FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN og USING (conv_id)),
sm AS (SELECT *, arm[1:1] AS method, arm[4:4]::INT AS k FROM sh)
"""
_SHAPE0 = "WITH RECURSIVE z AS (SELECT 1)" + _SHAPE
_TM = ("n_turns", "mean_chars", "max_repeat", "marks_per_turn")


# --- coded behaviour ---------------------------------------------------------------------------------------------------


@query(_CODE + "SELECT arm, iteration, persona_id, sr, cr, q, af, persuade, seek, " + sql6(*_MI) + " FROM mi")
def miti_behavior(spark, sf_dir):
    return behavior.summary_scores(coded(spark, sf_dir)).select(*KEYS, "sr", "cr", "q", "af", "persuade", "seek", *r6(*_MI))


@query(_CODE + "SELECT arm, iteration, count(*) AS n, " + sql6(*(f"avg({m}) AS {m}" for m in _MI)) + " FROM mi GROUP BY ALL")
def miti_proficiency_by_iter(spark, sf_dir):
    return behavior.means_by(behavior.summary_scores(coded(spark, sf_dir)), ["arm", "iteration"], list(_MI)).select("arm", "iteration", "n", *r6(*_MI))


@query(_CODE + "SELECT arm, iteration, persona_id, q+persuade AS n_bad, " + sql6("g1 AS severity", "persuade::DOUBLE/nullif(sr+cr+q+af+persuade,0) AS persuade_rate", "q::DOUBLE/nullif(sr+cr+q+af+persuade,0) AS q_rate") + " FROM cd")
def mici_behavior(spark, sf_dir):
    """Severity, counts and rates of what a therapist should not do."""
    c = coded(spark, sf_dir).withColumn("all_codes", F.expr("sr + cr + q + af + persuade"))
    r = behavior.rates(c, ["persuade", "q"], "all_codes")
    return r.select(*KEYS, (F.col("q") + F.col("persuade")).alias("n_bad"), *r6("persuade_rate", "q_rate", severity=F.col("g1")))


@query(_CODE + "SELECT arm, iteration, persona_id, sr AS ct, cr AS st, " + sql6("g1", "g2", "sr::DOUBLE/nullif(sr+cr,0) AS change_prop") + " FROM cd")
def pct_behavior(spark, sf_dir):
    """What the patient says: counts of change and sustain talk and the share of the first."""
    return coded(spark, sf_dir).select(*KEYS, F.col("sr").alias("ct"), F.col("cr").alias("st"), *r6("g1", "g2", change_prop=ratio("sr", F.col("sr") + F.col("cr"))))


@query(_CODE + _SHAPE + ", x AS (SELECT sm.arm, sm.iteration, marks_per_turn AS lexical, persuade::DOUBLE/nullif(n_turns,0) AS coded FROM sm JOIN cd ON sm.arm=cd.arm AND sm.iteration=cd.iteration AND sm.persona_id=cd.persona_id) SELECT arm, iteration, count(*) AS n, " + sql6("avg(lexical) AS lexical", "avg(coded) AS coded") + " FROM x GROUP BY ALL")
def overpraise_crosscheck(spark, sf_dir):
    """A rate read off the words against the coded one, over sessions that have both."""
    x = shapes(spark, sf_dir).join(coded(spark, sf_dir).drop("method", "k"), KEYS).withColumn("coded", ratio("persuade", "n_turns"))
    return behavior.means_by(x.withColumn("lexical", F.col("marks_per_turn")), ["arm", "iteration"], ["lexical", "coded"]).select("arm", "iteration", "n", *r6("lexical", "coded"))


@query(_CODE + _SHAPE + ", x AS (SELECT sm.arm, sm.iteration, marks_per_turn AS by_text, q::DOUBLE/n_turns AS by_code FROM sm JOIN cd ON sm.arm=cd.arm AND sm.iteration=cd.iteration AND sm.persona_id=cd.persona_id WHERE n_turns>0), t AS (SELECT count(*) AS n_text FROM sm WHERE n_turns>0) SELECT arm, count(*) AS n, " + sql6("avg(by_text) AS by_text", "avg(by_code) AS by_code") + ", count(*) OVER () > 0 AND sum(count(*)) OVER () >= 0.9*max(n_text) AS covered FROM x, t GROUP BY arm")
def question_rate_crosscheck(spark, sf_dir):
    """The same for questions, without sessions that have no turn; covered tells whether nine tenths of them were joined."""
    text = shapes(spark, sf_dir).where("n_turns > 0")
    x = text.join(coded(spark, sf_dir).drop("method", "k"), KEYS).select("arm", F.col("marks_per_turn").alias("by_text"), ratio("q", "n_turns").alias("by_code"))
    total = text.agg(F.count(F.lit(1)).alias("n_text"))
    g = x.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg("by_text").alias("by_text"), F.avg("by_code").alias("by_code"))
    joined = g.agg(F.sum("n").alias("n_joined"))
    return g.join(total).join(joined).select("arm", "n", *r6("by_text", "by_code"), (F.col("n_joined") >= 0.9 * F.col("n_text")).alias("covered"))


@query(_CODE + _SHAPE + ", x AS (SELECT coalesce(sm.arm,cd.arm) AS arm, coalesce(sm.iteration,cd.iteration) AS iteration, sr::DOUBLE/nullif(n_turns,0) AS sr_rate, q::DOUBLE/nullif(n_turns,0) AS q_rate, mean_chars, CASE WHEN sm.arm IS NULL THEN 'right' WHEN cd.arm IS NULL THEN 'left' ELSE 'both' END AS side FROM sm FULL JOIN cd ON sm.arm=cd.arm AND sm.iteration=cd.iteration AND sm.persona_id=cd.persona_id) SELECT arm, iteration, count(*) AS n, count(*) FILTER (side='left') AS only_text, count(*) FILTER (side='right') AS only_code, " + sql6("avg(sr_rate) AS sr_rate", "avg(q_rate) AS q_rate", "avg(mean_chars) AS mean_chars") + " FROM x GROUP BY ALL")
def behavior_by_iter(spark, sf_dir):
    """Text and code joined whole; sessions that only one side has are counted."""
    both = behavior.rates(behavior.outer(shapes(spark, sf_dir).drop("method", "k"), coded(spark, sf_dir), KEYS), ["sr", "q"], "n_turns")
    g = both.groupBy("arm", "iteration").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("side") == "left").alias("only_text"), F.count_if(F.col("side") == "right").alias("only_code"), *(F.avg(c).alias(c) for c in ("sr_rate", "q_rate", "mean_chars")))
    return g.select("arm", "iteration", "n", "only_text", "only_code", *r6("sr_rate", "q_rate", "mean_chars"))


_DETAIL = _CODE + _SHAPE + ", x AS (SELECT cd.*, n_turns FROM cd LEFT JOIN sm ON sm.arm=cd.arm AND sm.iteration=cd.iteration AND sm.persona_id=cd.persona_id)"
_RATES = ("sr", "cr", "q", "af", "persuade", "seek")


def _detail(spark, sf_dir) -> DataFrame:
    turns = shapes(spark, sf_dir).select(*KEYS, "n_turns")
    return behavior.rates(coded(spark, sf_dir).join(turns, KEYS, "left"), list(_RATES), "n_turns")


@query(_DETAIL + " SELECT arm, iteration, persona_id, " + sql6(*(f"{c}::DOUBLE/nullif(n_turns,0) AS {c}_rate" for c in _RATES)) + " FROM x")
def miti_detail_per_conv(spark, sf_dir):
    return _detail(spark, sf_dir).select(*KEYS, *r6(*(f"{c}_rate" for c in _RATES)))


@query(_DETAIL + " SELECT arm, iteration, count(*) AS n, " + sql6(*(f"avg({c}::DOUBLE/nullif(n_turns,0)) AS {c}_rate" for c in _RATES)) + " FROM x GROUP BY ALL")
def miti_detail_by_iter(spark, sf_dir):
    names = [f"{c}_rate" for c in _RATES]
    return behavior.means_by(_detail(spark, sf_dir), ["arm", "iteration"], names).select("arm", "iteration", "n", *r6(*names))


@query(_DETAIL + " SELECT arm, iteration, count(*) AS n, " + sql6("avg(persuade::DOUBLE/nullif(n_turns,0)) AS persuade_rate", "avg((persuade+q)::DOUBLE/nullif(n_turns,0)) AS bad_rate") + " FROM x GROUP BY ALL")
def mici_behavior_by_iter(spark, sf_dir):
    d = _detail(spark, sf_dir).withColumn("bad_rate", ratio(F.col("persuade") + F.col("q"), "n_turns"))
    return behavior.means_by(d, ["arm", "iteration"], ["persuade_rate", "bad_rate"]).select("arm", "iteration", "n", *r6("persuade_rate", "bad_rate"))


@query(_CODE + "SELECT arm, iteration, count(*) AS n, " + sql6("avg(sr::DOUBLE/nullif(sr+cr+q,0)) AS ct_share", "avg(cr::DOUBLE/nullif(sr+cr+q,0)) AS st_share", "avg(q::DOUBLE/nullif(sr+cr+q,0)) AS neutral_share") + " FROM cd GROUP BY ALL")
def pct_behavior_by_iter(spark, sf_dir):
    """Shares of a session's utterances, then means."""
    c = coded(spark, sf_dir).withColumn("said", F.expr("sr + cr + q"))
    c = c.withColumns({n: ratio(x, "said") for n, x in (("ct_share", "sr"), ("st_share", "cr"), ("neutral_share", "q"))})
    return behavior.means_by(c, ["arm", "iteration"], ["ct_share", "st_share", "neutral_share"]).select("arm", "iteration", "n", *r6("ct_share", "st_share", "neutral_share"))


_CHAN = _CODE + _SHAPE + ", ch AS (SELECT coalesce(sm.arm,mi.arm) AS arm, coalesce(sm.iteration,mi.iteration) AS iteration, coalesce(sm.persona_id,mi.persona_id) AS persona_id, r_to_q, pct_cr, technical, mean_chars, marks_per_turn FROM sm FULL JOIN mi ON sm.arm=mi.arm AND sm.iteration=mi.iteration AND sm.persona_id=mi.persona_id)"
_CH = ("r_to_q", "pct_cr", "technical", "mean_chars", "marks_per_turn")


def _channels(spark, sf_dir) -> DataFrame:
    return behavior.outer(shapes(spark, sf_dir).drop("method", "k"), behavior.summary_scores(coded(spark, sf_dir)), KEYS).select(*KEYS, *_CH)


@query(_CHAN + " SELECT ch.arm, ch.iteration, ch.persona_id, coalesce(u.c_mktsegment,'none') AS stratum, " + sql6(*(f"ch.{c} AS {c}" for c in _CH)) + " FROM ch LEFT JOIN customer u ON u.c_custkey=ch.persona_id")
def channels_per_conv(spark, sf_dir):
    """Graded and text channels of a session in one row, with the persona's stratum."""
    traits = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("persona_id"), F.col("c_mktsegment").alias("stratum"))
    return reshape.attach(_channels(spark, sf_dir), traits, ["persona_id"], {"stratum": "none"}).select(*KEYS, "stratum", *r6(*_CH))


@query(_CHAN + ", l AS (SELECT arm, iteration, persona_id, unnest(" + repr(list(_CH)) + ") AS channel, unnest([" + ", ".join(_CH) + "]) AS v FROM ch) SELECT arm, iteration, persona_id, channel, " + sql6("v AS score") + " FROM l WHERE v IS NOT NULL")
def channel_scores_long(spark, sf_dir):
    return reshape.to_long(_channels(spark, sf_dir), KEYS, list(_CH), "channel", "score").select(*KEYS, "channel", *r6("score"))


@query(_CODE + ", g AS (SELECT arm, iteration, avg(r_to_q) AS r_to_q, avg(pct_cr) AS pct_cr, avg(technical) AS technical, avg(relational) AS relational FROM mi GROUP BY ALL), e AS (SELECT arm, min(iteration) AS lo, max(iteration) AS hi FROM g GROUP BY ALL), l AS (SELECT arm, iteration, unnest(['r_to_q','pct_cr','technical','relational']) AS score_name, unnest([r_to_q,pct_cr,technical,relational]) AS v, unnest([1.0,0.4,3.0,3.5]) AS fair, unnest([2.0,0.5,4.0,4.0]) AS good FROM g) SELECT arm, CASE WHEN iteration=lo THEN 'base' ELSE 'final' END AS state, score_name, " + sql6("v AS value") + ", CASE WHEN v IS NULL THEN 'none' WHEN v>=good THEN 'good' WHEN v>=fair THEN 'fair' ELSE 'below' END AS verdict FROM l JOIN e USING (arm) WHERE (iteration=lo OR iteration=hi) AND v IS NOT NULL")
def miti_threshold_table(spark, sf_dir):
    """Summary scores of base and final iteration against their thresholds."""
    names = list(behavior.THRESHOLDS)
    g = behavior.means_by(behavior.summary_scores(coded(spark, sf_dir)), ["arm", "iteration"], names)
    ends = g.groupBy("arm").agg(F.min("iteration").alias("lo"), F.max("iteration").alias("hi"))
    at = g.join(ends, "arm").where("iteration = lo OR iteration = hi").withColumn("state", F.when(F.col("iteration") == F.col("lo"), "base").otherwise("final"))
    long = reshape.to_long(at, ["arm", "state"], names, "score_name", "value")
    return behavior.with_verdicts(long).select("arm", "state", "score_name", *r6("value"), "verdict")


@query(S + ", la AS (SELECT arm, max(iteration) AS la FROM c GROUP BY ALL) SELECT c.arm, " + ", ".join(sql6(f"avg(score) FILTER (questionnaire='{q}') AS {q}") for q in ("click", "view", "purchase")) + " FROM c JOIN la ON la.arm=c.arm AND la=iteration GROUP BY ALL")
def leaderboard_scorecard(spark, sf_dir):
    """Mean of every rubric at the selected iteration of each arm."""
    from .views import cells

    c = cells(spark, sf_dir)
    last = c.join(paired.final_iteration(c, ["arm"]), ["arm", "iteration"], "left_semi")
    return reshape.to_wide(last, ["arm"], "questionnaire", ["click", "view", "purchase"], "score").select("arm", *r6("click", "view", "purchase"))


# --- session shape -----------------------------------------------------------------------------------------------------


@query(_SHAPE0 + "SELECT arm, iteration, persona_id, conv_id, n_turns, max_repeat, " + sql6("mean_chars", "marks_per_turn") + ", count(*) OVER (PARTITION BY arm, iteration)=5 AS full_cell FROM sm")
def shape_text_metrics(spark, sf_dir):
    """Text metrics by session, and whether its cell has as many sessions as it should."""
    s = shapes(spark, sf_dir)
    size = s.groupBy("arm", "iteration").agg(F.count(F.lit(1)).alias("_n"))
    return s.join(size, ["arm", "iteration"]).select("arm", "iteration", "persona_id", "conv_id", "n_turns", "max_repeat", *r6("mean_chars", "marks_per_turn"), (F.col("_n") == 5).alias("full_cell"))


@query(_SHAPE0 + "SELECT arm, iteration, count(*) AS n, " + sql6(*(f"avg({m}) AS {m}" for m in _TM), *(f"stddev_samp({m})/sqrt(count(*)) AS {m}_se" for m in _TM)) + " FROM sm GROUP BY ALL")
def session_shape_levels(spark, sf_dir):
    g = shapes(spark, sf_dir).groupBy("arm", "iteration").agg(F.count(F.lit(1)).alias("n"), *(F.avg(m).alias(m) for m in _TM), *((F.stddev_samp(m) / F.sqrt(F.count(F.lit(1)).cast("double"))).alias(f"{m}_se") for m in _TM))
    return g.select("arm", "iteration", "n", *r6(*_TM, *(f"{m}_se" for m in _TM)))


_SHL = _SHAPE0 + ", sl AS (SELECT method, k, iteration, persona_id, unnest(['n_turns','mean_chars','marks_per_turn']) AS metric, unnest([n_turns::DOUBLE, mean_chars, marks_per_turn]) AS score FROM sm)"
_SHK = _SHL + _contrast_sql("metric, method, iteration", _pairs_sql("metric, method, iteration", "k=0", "k=5", "sl")) + _holm_sql("ct", "metric, method", "iteration")


def _shape_contrast(spark, sf_dir) -> DataFrame:
    s = shapes(spark, sf_dir).withColumn("n_turns", F.col("n_turns").cast("double"))
    long = reshape.to_long(s, ["method", "k", "iteration", "persona_id"], ["n_turns", "mean_chars", "marks_per_turn"], "metric", "score")
    by = ["metric", "method", "iteration"]
    return paired.holm(paired.contrast(long, by, _k(0), _k(5)), by[:2], tiebreak=["iteration"])


@query(_SHK + f"SELECT metric, method, iteration, n, n_nonzero, {_P6} FROM hm")
def session_shape_paired(spark, sf_dir):
    return _shape_contrast(spark, sf_dir).select("metric", "method", "iteration", "n", "n_nonzero", *r6(*_R6))


@query(_SHK + ", la AS (SELECT method, max(iteration) AS la FROM hm GROUP BY ALL) SELECT metric, hm.method, iteration, n, " + sql6("mean_a", "mean_b", "mean_delta") + " FROM hm JOIN la ON la.method=hm.method AND iteration=la")
def length_kcontrast(spark, sf_dir):
    """The contrast at the last iteration that both look-aheads have."""
    out = _shape_contrast(spark, sf_dir)
    return out.join(paired.final_iteration(out, ["method"]), ["method", "iteration"], "left_semi").select("metric", "method", "iteration", "n", *r6("mean_a", "mean_b", "mean_delta"))


@query(_SHAPE0 + ", e AS (SELECT arm, min(iteration) AS lo, max(iteration) AS hi FROM sm GROUP BY ALL) SELECT sm.arm, " + sql6("avg(mean_chars) FILTER (iteration=lo) AS base", "avg(mean_chars) FILTER (iteration=hi) AS final", "avg(mean_chars) FILTER (iteration=hi)-avg(mean_chars) FILTER (iteration=lo) AS change") + " FROM sm JOIN e USING (arm) GROUP BY ALL")
def length_endpoints(spark, sf_dir):
    s = shapes(spark, sf_dir)
    s = s.join(s.groupBy("arm").agg(F.min("iteration").alias("lo"), F.max("iteration").alias("hi")), "arm")
    at = lambda c: F.avg(F.when(F.col("iteration") == F.col(c), F.col("mean_chars")))
    g = s.groupBy("arm").agg(at("lo").alias("base"), at("hi").alias("final"))
    return g.select("arm", *r6("base", "final", change=F.col("final") - F.col("base")))


# --- rubric rows and responses ------------------------------------------------------------------------------------------

_ROW = ITEMS + ", rw AS (SELECT judge, arm, iteration, persona_id, avg(score) AS mean, sum(score) AS total, avg(score) FILTER (item IN (1,4,7,10)) AS goal, avg(score) FILTER (item IN (2,5,8,11)) AS task, avg(score) FILTER (item IN (3,6,9,12)) AS bond, count(*) AS n_items FROM it GROUP BY ALL)"


def _item_lists(spark, sf_dir) -> DataFrame:
    """judge, arm, iteration, persona_id, scores: twelve item scores in order, null where an item was not rated."""
    keys = ["judge", "arm", "iteration", "persona_id"]
    g = items_long(spark, sf_dir).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("item", "score"))).alias("m"))
    return g.select(*keys, F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.try_element_at("m", i)).alias("scores"))


@query(_ROW + " SELECT judge, arm, iteration, persona_id, n_items, " + sql6("mean", "total", "goal", "task", "bond") + " FROM rw")
def rubric_rows(spark, sf_dir):
    """A graded item list as a row: mean, total and the means of its parts, items without a score left out."""
    s = _item_lists(spark, sf_dir)
    parts = {n: behavior.part_mean("scores", [i for i in range(1, 13) if i % 3 == m]) for n, m in (("goal", 1), ("task", 2), ("bond", 0))}
    n = F.size(F.filter("scores", lambda x: x.isNotNull())).cast("long").alias("n_items")
    return s.select("judge", "arm", "iteration", "persona_id", n, *behavior.simple_row("scores"), *(c.alias(k) for k, c in parts.items())).select("judge", "arm", "iteration", "persona_id", "n_items", *r6("mean", "total", "goal", "task", "bond"))


@query(_DETAIL + " SELECT arm, iteration, persona_id, persuade+q+seek AS total, " + sql6("(persuade+q+seek)/3.0 AS mean", "(persuade+q+seek)::DOUBLE/nullif(n_turns,0) AS per_turn", "sr::DOUBLE/nullif(sr+cr,0) AS change_prop") + " FROM x")
def behavior_rows(spark, sf_dir):
    """Counts as a row: mean, total, rate per therapist turn, and a share that is null where both counts are zero."""
    x = _detail(spark, sf_dir).withColumn("counts", F.array(*(F.col(c).cast("double") for c in ("persuade", "q", "seek"))))
    mean, total = behavior.simple_row("counts")
    return x.select(*KEYS, total.cast("long").alias("total"), *r6(mean=mean, per_turn=ratio(total, "n_turns"), change_prop=ratio("sr", F.col("sr") + F.col("cr"))))


def eval_schema(n_questions: int, low: float, high: float) -> tuple[T.StructType, str]:
    """Schema of a grader's response and the condition that its scores meet: as many as there are questions, all within bounds."""
    schema = T.StructType([T.StructField("questionnaire_id", T.StringType()), T.StructField("scores", T.ArrayType(T.DoubleType()))])
    return schema, f"size(scores) = {n_questions} AND forall(scores, x -> x IS NOT NULL AND x BETWEEN {low} AND {high})"


def nested_schema(globals_: list[str], behaviors: list[str]) -> T.StructType:
    """Schema of a coder's response: global ratings and behaviour counts under names of their own."""
    part = lambda names, kind: T.StructType([T.StructField(n, kind) for n in names])
    return T.StructType([T.StructField("questionnaire_id", T.StringType()), T.StructField("globals", part(globals_, T.DoubleType())), T.StructField("behaviors", part(behaviors, T.LongType()))])


@query("WITH r AS (SELECT event_id, event_type AS qid, value AS a, value/2 AS b, event_id%7 AS v FROM events) SELECT event_id, CASE WHEN v=0 THEN 'not_json' WHEN v=1 THEN 'wrong_id' WHEN v=2 THEN 'wrong_count' WHEN a>60 OR b>60 THEN 'out_of_bounds' END AS reject, CASE WHEN v<3 OR a>60 OR b>60 THEN NULL ELSE qid END AS questionnaire_id, " + sql6("CASE WHEN v<3 OR a>60 OR b>60 THEN NULL ELSE (a+b)/2 END AS mean", "CASE WHEN v<3 OR a>60 OR b>60 THEN NULL ELSE a+b END AS total") + " FROM r")
def parse_responses(spark, sf_dir):
    """Responses as JSON text: parsed with a schema, checked for id, number of scores and bounds, the reason of a reject kept."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("value").alias("a"), (F.col("value") / 2).alias("b"), (F.col("event_id") % 7).alias("v"))
    scores = F.when(F.col("v") == 2, F.array("a")).otherwise(F.array("a", "b"))
    text = F.when(F.col("v") == 0, F.lit("not json {")).otherwise(F.to_json(F.struct(F.when(F.col("v") == 1, "other").otherwise(F.col("event_type")).alias("questionnaire_id"), scores.alias("scores"))))
    schema, _ = eval_schema(2, 0, 60)
    p = e.select("event_id", "event_type", F.from_json(text, schema).alias("r"))
    low = F.exists("r.scores", lambda x: x.isNull() | (x < 0) | (x > 60))
    reject = F.when(F.col("r.questionnaire_id").isNull(), "not_json").when(F.col("r.questionnaire_id") != F.col("event_type"), "wrong_id").when(F.size("r.scores") != 2, "wrong_count").when(low, "out_of_bounds")
    p = p.withColumn("reject", reject)
    good = lambda c: F.when(F.col("reject").isNull(), c)
    mean, total = behavior.simple_row("r.scores")
    return p.select("event_id", "reject", good(F.col("r.questionnaire_id")).alias("questionnaire_id"), *r6(mean=good(mean), total=good(total)))


@query("SELECT event_id, " + sql6("value AS first", "value/2 AS second") + ", 2::INT AS n_keys FROM events")
def scores_to_dict(spark, sf_dir):
    """Labels and scores zipped to a map."""
    m = F.map_from_arrays(F.array(F.lit("first"), F.lit("second")), F.array("value", F.col("value") / 2))
    e = table(spark, sf_dir, "events").select("event_id", m.alias("m"))
    return e.select("event_id", *r6(first=F.col("m")["first"], second=F.col("m")["second"]), F.size("m").alias("n_keys"))


_TEXT = "WITH t AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '[PATIENT] ' ELSE '[THERAPIST] ' END || text, chr(10)||chr(10) ORDER BY turn) AS tx, count(*) FILTER (role='assistant') AS th, count(*) FILTER (role='user') AS pa FROM conversations WHERE role IN ('user','assistant') AND trim(text, ' ')<>'' GROUP BY ALL)"
_LABELS = {"user": "PATIENT", "assistant": "THERAPIST"}


@query(_TEXT + " SELECT conv_id, th AS n_therapist, pa AS n_patient FROM t")
def utterance_counts(spark, sf_dir):
    """Labelled lines of a transcript by speaker."""
    t = transcripts.transcript(table(spark, sf_dir, "conversations"), _LABELS)
    return t.select("conv_id", *(label_count("transcript", x).cast("long").alias(n) for n, x in (("n_therapist", "THERAPIST"), ("n_patient", "PATIENT"))))


# --- steps of the trainers ------------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, trim(regexp_replace(regexp_replace(coalesce(text,''), '(?s)(a of|the an).*$', ''), '^\\s+|\\s+$', '', 'g'), ' ') AS cleaned FROM conversations")
def clean_completions(spark, sf_dir):
    """Text before the first of two markers, trimmed."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", clean_completion("text", ("a of", "the an")).alias("cleaned"))


@query("WITH x AS (SELECT conv_id, turn, text, instr(upper(text), 'ON THE') AS p FROM conversations) SELECT conv_id, turn, CASE WHEN p>0 THEN trim(text[1:p-1], ' ') ELSE text END AS said, CASE WHEN p>0 THEN trim(text[p+6:], ' ') END AS explanation, p>0 AS ended FROM x")
def session_ends(spark, sf_dir):
    """Text before and after a marker, whatever its case."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", session_end("text", "on the").alias("x"))
    return t.select("conv_id", "turn", "x.said", "x.explanation", "x.ended")


@query("WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations WHERE role IN ('user','assistant') AND text IS NOT NULL), r AS (SELECT conv_id, i, role, text FROM m UNION ALL SELECT DISTINCT conv_id, 0, 'system', 'You listen.' FROM m) SELECT conv_id, i::INT AS pos, role, CASE role WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'user' ELSE role END AS mirrored, text AS content FROM r")
def turns_to_messages(spark, sf_dir):
    """Turns as messages after a system prompt, and the roles from the other side."""
    m = transcripts.message_lists(table(spark, sf_dir, "conversations"), "You listen.")
    z = m.select("conv_id", F.posexplode(F.arrays_zip(F.col("messages").alias("a"), F.col("mirrored").alias("b"))).alias("pos", "x"))
    return z.select("conv_id", "pos", F.col("x.a.role").alias("role"), F.col("x.b.role").alias("mirrored"), F.col("x.a.content").alias("content"))


@query(_TEXT + ", p AS (SELECT conv_id, unnest(string_split(tx, chr(10)||chr(10))) AS part, generate_subscripts(string_split(tx, chr(10)||chr(10)),1) AS i FROM t), o AS (SELECT *, regexp_extract(part, '^\\[(PATIENT|THERAPIST)\\]\\s*', 1) AS lb FROM p), q AS (SELECT *, sum((lb<>'')::INT) OVER (PARTITION BY conv_id ORDER BY i) AS pos FROM o) SELECT conv_id, pos::BIGINT AS pos, CASE max(lb) WHEN 'PATIENT' THEN 'user' ELSE 'assistant' END AS role, string_agg(CASE WHEN lb<>'' THEN regexp_replace(part, '^\\[[A-Z]+\\]\\s*', '') ELSE part END, chr(10)||chr(10) ORDER BY i) AS content FROM q WHERE pos>0 GROUP BY ALL")
def transcript_messages(spark, sf_dir):
    """A labelled transcript back to turns; unlabelled segments continue the turn before."""
    t = transcripts.transcript(table(spark, sf_dir, "conversations"), _LABELS)
    return transcripts.messages_of(t, "transcript", {"PATIENT": "user", "THERAPIST": "assistant"}, "conv_id")


@query("WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\\s]+') AS w FROM documents) SELECT doc_id, least(len(w),50)::INT AS n, array_to_string(w[greatest(len(w)-49,1):], ' ') AS tail FROM w")
def token_tails(spark, sf_dir):
    """The last fifty words of a text."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\t\n\f\r ]+"), F.lit(0)).alias("w"), transcripts.token_tail("text", 50, r"[^\t\n\f\r ]+").alias("tail"))
    return t.select("doc_id", F.least(F.size("w"), F.lit(50)).alias("n"), "tail")


@query("SELECT conv_id, turn, (SELECT string_agg('['||upper(role)||'] '||coalesce(text,''), chr(10)||chr(10) ORDER BY turn) FROM conversations p WHERE p.conv_id=t.conv_id AND p.turn<=t.turn) AS prefix FROM conversations t WHERE role='user' AND (SELECT count(*) FROM conversations p WHERE p.conv_id=t.conv_id AND p.turn<=t.turn)>=3")
def prompt_prefixes(spark, sf_dir):
    """For each patient turn from the third place on the labelled text up to it."""
    return transcripts.prefixes(table(spark, sf_dir, "conversations"), "user", 3)


@query("WITH w AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, count(*)::INT AS n_turns, sum(length(text))::BIGINT AS chars FROM w WHERE n>3 AND i<=3 AND conv_id IN (SELECT conv_id FROM w WHERE i=3 AND role='user') GROUP BY ALL")
def prefix_seeds(spark, sf_dir):
    """The first three turns of longer conversations whose third turn is the patient's."""
    s = transcripts.prefix_seeds(table(spark, sf_dir, "conversations"), 3, "user")
    return s.select("conv_id", F.size("seed").alias("n_turns"), F.aggregate("seed", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.length(x["text"]), F.lit(0))).alias("chars"))


@query("SELECT conv_id, turn, coalesce(CASE WHEN turn%3=0 THEN role END, CASE WHEN turn%2=0 THEN 'assistant' ELSE 'user' END) AS role FROM conversations")
def roles_by_parity(spark, sf_dir):
    """Turns whose role is missing take it from their place."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("role")).alias("role"))
    return transcripts.with_parity_roles(t)


@query("WITH i AS (SELECT DISTINCT l_orderkey AS g FROM lineitem), n AS (SELECT *, row_number() OVER (ORDER BY md5('17|'||g), g) AS r, count(*) OVER () AS n FROM i), s AS (SELECT g, r <= CASE WHEN n<2 THEN 0 ELSE least(greatest(1, floor(n*0.1)::BIGINT), n-1) END AS ev FROM n) SELECT l_returnflag AS arm, CASE WHEN ev THEN 'eval' ELSE 'train' END AS split, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_groups FROM lineitem JOIN s ON s.g=l_orderkey GROUP BY ALL")
def grouped_split(spark, sf_dir):
    """A split by whole groups: none is on both sides."""
    out = training.grouped_split(table(spark, sf_dir, "lineitem"), "l_orderkey", 0.1, 17)
    return out.groupBy(F.col("l_returnflag").alias("arm"), "split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("l_orderkey").alias("n_groups"))


#: The enumerations of the patients, in the order in which their product is numbered.
PERSONA = {
    "gender": ("Male", "Female"), "cooperation": ("Low", "High", "StartLowAndChangesToHigh"), "problem": ("Smoking", "Obesity"),
    "problem_time": ("FewMonths", "ManyYears"), "tried": ("Never", "ManyTimes"), "age": ("Young", "Old"),
}


def persona_grid(spark) -> DataFrame:
    """persona_id and six traits: all combinations, numbered in nested order, the last trait fastest."""
    size = 1
    for values in PERSONA.values():
        size *= len(values)
    traits, step = [], size
    for name, values in PERSONA.items():
        step //= len(values)
        traits.append(F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("id") / step) % len(values) + 1).cast("int")).alias(name))
    return spark.range(0, size, 1, 1).select(F.col("id").cast("int").alias("persona_id"), *traits)


_GRID = "WITH g AS (SELECT row_number() OVER (ORDER BY a,b,c,d,e,f)::INT-1 AS persona_id, " + ", ".join(f"({list(v)!r})[{x}] AS {k}" for (k, v), x in zip(PERSONA.items(), "abcdef", strict=True)) + " FROM " + ", ".join(f"(SELECT unnest(range(1,{len(v) + 1})) AS {x})" for v, x in zip(PERSONA.values(), "abcdef", strict=True)) + ")"


@query(_GRID + " SELECT * FROM g")
def canonical_personas(spark, sf_dir):
    return persona_grid(spark)


@query(_GRID + ", p AS (SELECT DISTINCT user_id FROM events) SELECT p.user_id, coalesce(g.persona_id,-1)::INT AS persona_id, g.cooperation, CASE g.cooperation WHEN 'High' THEN 'Cooperative' WHEN 'StartLowAndChangesToHigh' THEN 'Warms up' WHEN 'Low' THEN 'Resistant' END AS stratum FROM p LEFT JOIN g ON g.persona_id=p.user_id")
def persona_characteristics(spark, sf_dir):
    """Traits by index; an index outside the grid is -1."""
    ids = table(spark, sf_dir, "events").select("user_id").distinct()
    grid = persona_grid(spark).select("persona_id", "cooperation")
    label = F.when(F.col("cooperation") == "High", "Cooperative").when(F.col("cooperation") == "StartLowAndChangesToHigh", "Warms up").when(F.col("cooperation") == "Low", "Resistant")
    return ids.join(grid, ids["user_id"] == grid["persona_id"], "left").select("user_id", F.coalesce("persona_id", F.lit(-1)).alias("persona_id"), "cooperation", label.alias("stratum"))
