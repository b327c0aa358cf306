"""Queries on tails and logs in detail, channels at selected budgets, rules of weighting against data, graders' repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import cosine, ratio, spearman_brown
from ..operators import compute as cost
from ..operators import paired, reliability, reshape, tails, training, vectors
from .costs import _PICK, _selected
from .scores import _P6, _R6, _contrast_sql, _holm_sql
from .sessions import _CH, _CHAN, _channels
from .signals import branches
from .views import ARMS, G, ITEMS, JP, S, cells, items_long, judge_pairs, query, r6, sql6, table

# --- tails -------------------------------------------------------------------------------------------------------------


def candidates(spark, sf_dir) -> DataFrame:
    """A candidate per conversation: its last therapist turn, and all turns as the tail; conversations are dealt over arms and iterations."""
    t = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL")
    text, role = F.coalesce("text", F.lit("")), F.when(F.col("role") == "assistant", "THERAPIST").otherwise("PATIENT")
    g = t.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("["), role, F.lit("]: "), text).alias("line")))).alias("lines"), F.max_by(F.when(F.col("role") == "assistant", text), F.when(F.col("role") == "assistant", F.col("turn"))).alias("completion"))
    arm = F.element_at(F.array(*map(F.lit, ARMS)), (F.col("conv_id") % 4 + 1).cast("int"))
    return g.select("conv_id", arm.alias("arm"), (F.floor(F.col("conv_id") / 4) % 5).cast("int").alias("iteration"), "completion", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("tail"), F.size("lines").alias("realized_turns"))


_CUE = {n: p.removeprefix("(?i)") for n, p in tails.CUES.items()}
_RX = lambda text, cue: f"regexp_matches({text}, '{_CUE[cue]}', 'i')"
_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_TF = r"""WITH t0 AS (SELECT conv_id, turn, coalesce(role='assistant', false) AS th, coalesce(text,'') AS text, count(*) OVER (PARTITION BY conv_id) AS nt, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, text || CASE WHEN i<nt THEN chr(10)||chr(10) ELSE '' END AS tt FROM t0), lc AS (SELECT conv_id, arg_max(text, i) AS completion FROM t WHERE th GROUP BY ALL),
po AS (SELECT conv_id, """ + _TRIM.format("tt") + """ AS s FROM t WHERE th UNION ALL SELECT conv_id, """ + _TRIM.format("completion") + """ FROM lc), lo AS (SELECT conv_id, count(DISTINCT s)<count(*) AS tail_loop FROM po WHERE s<>'' GROUP BY ALL),
tg AS (SELECT conv_id, sum(length(tt)+CASE WHEN th THEN 13 ELSE 11 END)::INT AS tail_chars, count(*) FILTER (NOT th)::INT AS tail_patient_turns, count(*) FILTER (th)::INT AS tail_therapist_turns, coalesce(sum(length(tt)) FILTER (NOT th),0)::BIGINT AS tail_patient_chars, coalesce(sum(length(tt)) FILTER (th),0)::BIGINT AS tail_th_chars,
 sum(length(tt)-length(replace(tt,'?',''))) FILTER (th) AS q, sum((""" + _RX("tt", "affirm") + """)::INT) FILTER (th) AS af, sum((""" + _RX("tt", "effusive") + """)::INT) FILTER (th) AS ef, max(nt)::INT AS realized, bool_or(contains(text,'<|im_start|>')) AS tail_leak,
 arg_max(regexp_matches(tt, '\\s$') OR tt='', i) AS tail_ws_end, arg_max(NOT th AND """ + _RX("tt", "wrapup") + """, i) AS last_patient_wrapup_cue FROM t GROUP BY ALL),
tf AS (SELECT conv_id, (['A_K0','A_K5','B_K0','B_K5'])[1+conv_id%4] AS arm, ((conv_id//4)%5)::INT AS iteration, tg.* EXCLUDE (conv_id), tail_th_chars/nullif(tail_therapist_turns,0)::DOUBLE AS tail_th_turn_len, q/nullif(tail_therapist_turns,0)::DOUBLE AS tail_th_q_per_turn, af/nullif(tail_therapist_turns,0)::DOUBLE AS tail_th_affirm_rate, ef/nullif(tail_therapist_turns,0)::DOUBLE AS tail_th_effusive_rate,
 coalesce(tail_loop,false) AS tail_loop, length(coalesce(completion,''))-length(replace(coalesce(completion,''),'?','')) AS cand_q, """ + _RX("coalesce(completion,'')", "affirm") + """ AS cand_affirm, """ + _RX("coalesce(completion,'')", "effusive") + """ AS cand_effusive,
 CASE WHEN realized>=5 THEN 'full' WHEN realized%2=1 AND tail_ws_end THEN 'patient_closed' WHEN realized%2=1 THEN 'therapist_stalled' ELSE 'after_therapist' END AS end_reason FROM tg LEFT JOIN lo USING (conv_id) LEFT JOIN lc USING (conv_id))
"""
_SHARES = ("tail_th_turn_len", "tail_th_q_per_turn", "tail_th_affirm_rate", "tail_th_effusive_rate")
_PLAIN = tuple(f for f in tails.FEATURES if f not in _SHARES)


@query(_TF + "SELECT conv_id, " + ", ".join(_PLAIN) + ", " + sql6(*_SHARES) + " FROM tf")
def tail_features(spark, sf_dir):
    """Seventeen features of a candidate's tail."""
    return tails.tail_features(candidates(spark, sf_dir), 5).select("conv_id", *_PLAIN, *r6(*_SHARES))


_CUES6 = ("th_turn_len", "th_q", "cand_q", "th_affirm", "cand_affirm", "th_effusive", "cand_effusive", "loop_rate", "patient_turn_len")


@query(_TF + "SELECT arm, coalesce(iteration::VARCHAR,'pooled') AS iteration, count(*) AS n, " + sql6("avg(tail_th_turn_len) AS th_turn_len", "avg(tail_th_q_per_turn) AS th_q", "avg(cand_q) AS cand_q", "avg(tail_th_affirm_rate) AS th_affirm", "avg(cand_affirm::INT) AS cand_affirm", "avg(tail_th_effusive_rate) AS th_effusive", "avg(cand_effusive::INT) AS cand_effusive", "avg(tail_loop::INT) AS loop_rate", "sum(tail_patient_chars)::DOUBLE/nullif(sum(tail_patient_turns),0) AS patient_turn_len") + " FROM tf GROUP BY GROUPING SETS ((arm, iteration), (arm))")
def tail_cues_by_iter(spark, sf_dir):
    """Cues in the tails beside those in the candidates, by iteration and pooled."""
    g = tails.cue_means(tails.tail_features(candidates(spark, sf_dir), 5), ["arm"], "iteration")
    return g.select("arm", F.coalesce(F.col("iteration").cast("string"), F.lit("pooled")).alias("iteration"), "n", *r6(*_CUES6))


@query(G + ", b AS (SELECT arm AS method, train_iter AS iteration, group_id, count(*) AS n, count(score) AS ns, sum(score) AS s1, sum(score*score) AS s2, count(*) AS nt, sum(coalesce(realized_turns,0)) AS tu, count(*) FILTER (realized_turns<5) AS ea FROM g GROUP BY ALL) SELECT method, iteration, count(*) AS n_branches, sum(n)::BIGINT AS n_candidates, 0::BIGINT AS n_pairs, " + sql6("sum(s1)/sum(ns) AS mean_reward", "sqrt(greatest(sum(s2)/sum(ns)-power(sum(s1)/sum(ns),2),0)) AS reward_std", "0.0 AS success_rate", "sum(tu)::DOUBLE/sum(nt) AS realized_turns_mean", "sum(ea)::DOUBLE/sum(nt) AS ended_early_share", "1.0 AS tau_filter_rate") + " FROM b GROUP BY ALL")
def record_summary(spark, sf_dir):
    """What a trainer reports of an iteration, from its nested records; no candidate of these records is marked rejected."""
    g = tails.record_summary(branches(spark, sf_dir), ["method", "iteration"])
    return g.select("method", "iteration", "n_branches", "n_candidates", "n_pairs", *r6("mean_reward", "reward_std", "success_rate", "realized_turns_mean", "ended_early_share", "tau_filter_rate"))


# --- channels at the budgets that a selection takes ------------------------------------------------------------------------

_SELCH = _PICK + _CHAN[len(S) :] + ", sel AS (SELECT * FROM (SELECT a.judge AS select_judge, a.budget, a.iteration AS ia, b.iteration AS ib, row_number() OVER (PARTITION BY a.judge ORDER BY a.budget DESC) AS top FROM pk a JOIN pk b ON a.judge=b.judge AND a.budget=b.budget WHERE a.arm='A_K0' AND b.arm='A_K5') WHERE top=1), cl AS (SELECT arm, iteration, persona_id, unnest(" + repr(list(_CH)) + ") AS channel, unnest([" + ", ".join(_CH) + "]) AS score FROM ch), pr0 AS (SELECT select_judge, ia, ib, x.channel, x.persona_id, x.score AS a, y.score AS b, x.score-y.score AS d FROM sel JOIN cl x ON x.arm='A_K0' AND x.iteration=ia JOIN cl y ON y.arm='A_K5' AND y.iteration=ib AND y.channel=x.channel AND y.persona_id=x.persona_id WHERE x.score IS NOT NULL AND y.score IS NOT NULL)" + _contrast_sql("select_judge, ia, ib, channel", "SELECT * FROM pr0") + _holm_sql("ct", "select_judge", "channel")


@query(_SELCH + f" SELECT select_judge, ia AS iter_a, ib AS iter_b, channel, n, n_nonzero, {_P6} FROM hm")
def iso_channels_selected(spark, sf_dir):
    """Channels of the states that each grader's selection takes at the largest budget, Holm over the channels."""
    newest = Window.partitionBy("select_judge").orderBy(F.desc("budget"))  # a row a budget
    top = _selected(spark, sf_dir).withColumn("_r", F.row_number().over(newest)).where("_r = 1").select("select_judge", "iter_a", "iter_b")
    long = reshape.to_long(_channels(spark, sf_dir), ["arm", "iteration", "persona_id"], list(_CH), "channel", "score")
    pairs = cost.pairs_at(long, top, "A_K0", "A_K5", ["channel"], keep=["select_judge", "iter_b"])
    by = ["select_judge", "iter_a", "iter_b", "channel"]
    return paired.holm(paired.of_pairs(pairs, by), ["select_judge"], tiebreak=["channel"]).select(*by, "n", "n_nonzero", *r6(*_R6))


# --- rules of weighting and data --------------------------------------------------------------------------------------------

#: Comparisons: name, rule and arm of either side; arm 0 was trained on best against worst, arm 1 on standardised scores.
PLAN = (
    ("as trained", "native", 0, "native", 1), ("same data of 0, rule swapped", "native", 0, "grpo", 0), ("same data of 1, rule swapped", "native", 1, "dpo", 1),
    ("same rule grpo, data differ", "grpo", 0, "native", 1), ("same rule dpo, data differ", "native", 0, "dpo", 1),
)
_CAND = "WITH k AS (SELECT vec_id, label, label%2 AS arm, vec_id//8 AS grp, round(embedding[1]::DOUBLE*20)/2 AS score, embedding FROM embeddings), z AS (SELECT *, row_number() OVER (PARTITION BY arm, grp ORDER BY score DESC, vec_id) AS top, row_number() OVER (PARTITION BY arm, grp ORDER BY score, vec_id) AS low, max(score) OVER (PARTITION BY arm, grp) AS hi, min(score) OVER (PARTITION BY arm, grp) AS lo, (score-avg(score) OVER (PARTITION BY arm, grp))/nullif(stddev_samp(score) OVER (PARTITION BY arm, grp),0) AS st FROM k), w0 AS (SELECT vec_id, label, arm, grp, 'dpo' AS rule, CASE WHEN top=1 THEN 1.0 WHEN low=1 THEN -1.0 ELSE 0.0 END AS raw FROM z WHERE hi<>lo UNION ALL SELECT vec_id, label, arm, grp, 'grpo', coalesce(st,0.0) FROM z), w1 AS (SELECT *, 2*raw/nullif(sum(abs(raw)) OVER (PARTITION BY rule, arm, grp),0) AS weight FROM w0), w AS (SELECT * FROM w1 WHERE weight IS NOT NULL UNION ALL SELECT vec_id, label, arm, grp, 'native', raw, weight FROM w1 WHERE weight IS NOT NULL AND rule=CASE arm WHEN 0 THEN 'dpo' ELSE 'grpo' END), e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding,1) AS dim FROM embeddings)"


def weighted(spark, sf_dir) -> DataFrame:
    """vec_id, label, arm, grp, embedding, rule, weight: candidates of groups of eight under either rule, and under the one of their arm."""
    k = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("label") % 2).alias("arm"), F.floor(F.col("vec_id") / 8).alias("grp"), (F.round(F.col("embedding")[0].cast("double") * 20) / 2).alias("score"), "embedding", F.col("vec_id").alias("cand_idx"))
    by = ["arm", "grp"]
    both = training.pair_weights(k, by).withColumn("rule", F.lit("dpo")).unionByName(training.standardised_weights(k, by).withColumn("rule", F.lit("grpo")))
    own = F.when(F.col("arm") == 0, "dpo").otherwise("grpo")
    native = F.when(F.col("rule") == own, F.array(F.col("rule"), F.lit("native"))).otherwise(F.array("rule"))
    return both.withColumn("rule", F.explode(native)).where("weight <> 0")


@query(_CAND + ", dr AS (SELECT rule, arm, dim, sum(weight*v) AS s FROM w JOIN e USING (vec_id) WHERE weight<>0 GROUP BY ALL), du AS (SELECT *, s/nullif(sqrt(sum(s*s) OVER (PARTITION BY rule, arm)),0) AS u FROM dr), hr AS (SELECT rule, arm, grp%2 AS half, dim, sum(weight*v) AS s FROM w JOIN e USING (vec_id) WHERE weight<>0 GROUP BY ALL), hu AS (SELECT *, s/nullif(sqrt(sum(s*s) OVER (PARTITION BY rule, arm, half)),0) AS u FROM hr), rl AS (SELECT a.rule, a.arm, sum(a.u*b.u) AS c FROM hu a JOIN hu b ON a.rule=b.rule AND a.arm=b.arm AND a.dim=b.dim AND a.half=0 AND b.half=1 GROUP BY ALL), pl AS (SELECT unnest([" + ", ".join(f"{{'c': '{c}', 'ra': '{ra}', 'aa': {aa}, 'rb': '{rb}', 'ab': {ab}}}" for c, ra, aa, rb, ab in PLAN) + "], recursive := true)), cs AS (SELECT c, any_value(aa) AS aa, any_value(ab) AS ab, ra, rb, sum(x.u*y.u) AS cs FROM pl JOIN du x ON x.rule=ra AND x.arm=aa JOIN du y ON y.rule=rb AND y.arm=ab AND y.dim=x.dim GROUP BY c, ra, rb), ce AS (SELECT cs.*, sqrt(greatest(2*p.c/(1+p.c)*(2*q.c/(1+q.c)),0)) AS ceiling FROM cs JOIN rl p ON p.rule=ra AND p.arm=aa JOIN rl q ON q.rule=rb AND q.arm=ab) SELECT c AS comparison, CASE WHEN aa=ab THEN 'cosine' ELSE 'corrected' END AS read, " + sql6("cs AS cosine", "ceiling", "cs/nullif(ceiling,0) AS corrected") + " FROM ce")
def weighting_decomposition(spark, sf_dir):
    """Do two arms differ by their rule or by their data: cosines of directions with the rule or the data held fixed.

    Rows of one arm's own groups share their noise, so their plain cosine is to be read; the others are corrected by the reliabilities.
    """
    w = weighted(spark, sf_dir)
    d = vectors.direction(w, ["rule", "arm"], F.col("weight")).select("rule", "arm", "direction")
    halves = vectors.direction(w.withColumn("half", F.col("grp") % 2), ["rule", "arm", "half"], F.col("weight"))
    side = lambda h: F.max(F.when(F.col("half") == h, F.col("direction")))
    r = halves.groupBy("rule", "arm").agg(cosine(side(0), side(1)).alias("c")).select("rule", "arm", spearman_brown("c").alias("r"))
    known = d.join(r, ["rule", "arm"])
    plan = spark.createDataFrame(list(PLAN), "comparison string, rule_a string, arm_a int, rule_b string, arm_b int")
    of = lambda x: known.select(*(F.col(c).alias(f"{c}_{x}") for c in ("rule", "arm", "direction", "r")))
    both = plan.join(of("a"), ["rule_a", "arm_a"]).join(of("b"), ["rule_b", "arm_b"])
    c, ceiling = cosine("direction_a", "direction_b"), F.sqrt(F.greatest(F.col("r_a") * F.col("r_b"), F.lit(0.0)))
    out = both.select("comparison", F.when(F.col("arm_a") == F.col("arm_b"), "cosine").otherwise("corrected").alias("read"), c.alias("cosine"), ceiling.alias("ceiling"))
    return out.select("comparison", "read", *r6("cosine", "ceiling", corrected=ratio("cosine", "ceiling")))


@query(_CAND + ", dr AS (SELECT label, dim, sum(weight*v) AS s FROM w JOIN e USING (vec_id) WHERE rule='dpo' AND weight<>0 GROUP BY ALL), pa AS (SELECT arm, grp, arg_max(vec_id, (score, vec_id)) AS hi, arg_min(vec_id, (score, vec_id)) AS lo FROM k GROUP BY ALL HAVING max(score)-min(score)>0.1), pl AS (SELECT hi AS vec_id, 1.0 AS sg FROM pa UNION ALL SELECT lo, -1.0 FROM pa), pd AS (SELECT label, dim, sum(sg*v) AS s FROM pl JOIN k USING (vec_id) JOIN e USING (vec_id) GROUP BY ALL), n AS (SELECT label, count(*) AS n FROM pl JOIN k USING (vec_id) GROUP BY ALL) SELECT label, n, " + sql6("sum(dr.s*pd.s)/nullif(sqrt(sum(dr.s*dr.s))*sqrt(sum(pd.s*pd.s)),0) AS cosine") + " FROM dr JOIN pd USING (label, dim) JOIN n USING (label) GROUP BY ALL")
def direction_agreement_with_pairs(spark, sf_dir):
    """The direction of the weighted candidates against that of the emitted pairs, which another rule for ties chose."""
    own = vectors.direction(weighted(spark, sf_dir).where("rule = 'dpo'"), ["label"], F.col("weight")).select("label", F.col("direction").alias("own"))
    e = table(spark, sf_dir, "embeddings")
    k = e.select((F.col("label") % 2).alias("arm"), F.floor(F.col("vec_id") / 8).alias("grp"), (F.round(F.col("embedding")[0].cast("double") * 20) / 2).alias("score"), F.col("vec_id").alias("cand_idx"))
    p = training.best_and_worst(k, ["arm", "grp"])
    sides = p.select(F.explode(F.array(F.struct(F.col("chosen_idx").alias("vec_id"), F.lit(1.0).alias("sign")), F.struct(F.col("rejected_idx").alias("vec_id"), F.lit(-1.0).alias("sign")))).alias("s")).select("s.*")
    pairs = vectors.direction(sides.join(e, "vec_id"), ["label"], F.col("sign"))
    return own.join(pairs, "label").select("label", "n", *r6(cosine=cosine("own", "direction")))


# --- graders -------------------------------------------------------------------------------------------------------------

_FRAMES = ITEMS + ", fr AS (SELECT judge, 'item' AS instrument, arm, iteration, persona_id, 'item_'||item AS name, score FROM it UNION ALL SELECT judge, 'subscale', arm, iteration, persona_id, CASE WHEN item<=6 THEN 'first' ELSE 'second' END, avg(score) FROM it GROUP BY ALL UNION ALL SELECT judge, 'rubric', arm, iteration, persona_id, questionnaire, score FROM j)"


@query(_FRAMES + " SELECT judge, instrument, arm, iteration, persona_id, name, coalesce(c_mktsegment,'none') AS stratum, " + sql6("score") + " FROM fr LEFT JOIN customer ON c_custkey=persona_id")
def instrument_frames_by_judge(spark, sf_dir):
    """Items, subscales and rubrics of every grader in one read, with the persona's trait."""
    keys = ["judge", "instrument", "arm", "iteration", "persona_id", "name"]
    it = items_long(spark, sf_dir)
    items = it.select("judge", F.lit("item").alias("instrument"), "arm", "iteration", "persona_id", F.concat(F.lit("item_"), F.col("item").cast("string")).alias("name"), "score")
    half = it.groupBy("judge", "arm", "iteration", "persona_id", F.when(F.col("item") <= 6, "first").otherwise("second").alias("name")).agg(F.avg("score").alias("score")).withColumn("instrument", F.lit("subscale"))
    rubric = cells(spark, sf_dir, "judge").select("judge", F.lit("rubric").alias("instrument"), "arm", "iteration", "persona_id", F.col("questionnaire").alias("name"), "score")
    every = items.unionByName(half.select(*keys, "score")).unionByName(rubric)
    traits = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("persona_id"), F.col("c_mktsegment").alias("stratum"))
    return reshape.attach(every, traits, ["persona_id"], {"stratum": "none"}).select(*keys, "stratum", *r6("score"))


@query(JP + ", rm AS (SELECT questionnaire, count(*) AS n, avg(abs(p-h)) AS mean_abs_diff, max(abs(p-h)) AS largest, avg((p+h)/2) AS g, avg(p) AS mp, avg(h) AS mh FROM jp GROUP BY ALL), rs AS (SELECT jp.questionnaire, 2*sum(power((p+h)/2-g,2))/nullif(max(n)-1,0) AS msr, max(n)*(power(max(mp)-max(g),2)+power(max(mh)-max(g),2)) AS msc, sum(power(p-(p+h)/2-mp+g,2)+power(h-(p+h)/2-mh+g,2))/nullif(max(n)-1,0) AS mse FROM jp JOIN rm USING (questionnaire) GROUP BY ALL) SELECT questionnaire, n, " + sql6("mean_abs_diff", "largest", "CASE WHEN n>=3 THEN (msr-mse)/nullif(msr+mse+2*(msc-mse)/n,0) END AS icc") + " FROM rm JOIN rs USING (questionnaire)")
def repeatability(spark, sf_dir):
    """How far two gradings of one conversation are apart, and the intraclass correlation beside it."""
    jp = judge_pairs(spark, sf_dir)
    d = F.abs(F.col("p") - F.col("h"))
    g = jp.groupBy("questionnaire").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_abs_diff"), F.max(d).alias("largest"))
    j = cells(spark, sf_dir, "judge").withColumn("target", F.concat_ws("|", "arm", "iteration", "persona_id"))
    return g.join(reliability.icc_2_1(j, ["questionnaire"], "target", "judge").select("questionnaire", "icc"), "questionnaire").select("questionnaire", "n", *r6("mean_abs_diff", "largest", "icc"))


# --- coders' responses ------------------------------------------------------------------------------------------------------

#: Instruments of coders: global ratings with their bounds, and behaviours that are counted.
CODERS = {
    "miti": (("cultivate", "soften", "partner", "empathy"), (1, 5), ("sr", "cr", "q", "af", "persuade", "seek")), "pct": (("warmth",), (0, 10), ("open", "closed")), "mici": (("tone", "pace"), (-3, 3), ("advise", "confront", "direct")),
}
_CODED = "WITH r AS (SELECT event_id, ['miti','pct','mici'][1+event_id%3] AS coder, event_id%11 AS v, (floor(value)::INT % 5 + 1)::DOUBLE AS g, event_id%4 AS n FROM events WHERE value IS NOT NULL), k AS (SELECT *, CASE coder WHEN 'miti' THEN 4 WHEN 'pct' THEN 1 ELSE 2 END AS ng, CASE coder WHEN 'miti' THEN 6 WHEN 'pct' THEN 2 ELSE 3 END AS nb, CASE WHEN coder='mici' THEN 3.0 WHEN coder='pct' THEN 10.0 ELSE 5.0 END AS top FROM r), j AS (SELECT *, CASE WHEN v=0 THEN 'not_json' WHEN v=1 THEN 'wrong_id' WHEN v=2 THEN 'missing' WHEN v=3 THEN 'negative' WHEN g>top THEN 'out_of_bounds' END AS reject FROM k)"


@query(_CODED + " SELECT event_id, coder, reject, CASE WHEN reject IS NULL THEN nb*n END AS n_behaviours, " + sql6("CASE WHEN reject IS NULL THEN g END AS mean_global") + " FROM j")
def parse_coder_responses(spark, sf_dir):
    """Responses of three coding instruments as JSON text: each parsed with its own nested schema and checked field by field, the reason of a reject kept."""
    from .sessions import nested_schema

    e = table(spark, sf_dir, "events").where("value IS NOT NULL").select(
        "event_id", F.element_at(F.array(*map(F.lit, CODERS)), (F.col("event_id") % 3 + 1).cast("int")).alias("coder"), (F.col("event_id") % 11).alias("v"), (F.floor("value").cast("int") % 5 + 1).cast("double").alias("g"), (F.col("event_id") % 4).alias("n"))
    out = None
    for coder, (ratings, (low, high), behaviours) in CODERS.items():
        given = [F.when((F.col("v") == 2) & F.lit(i == 0), None).otherwise(F.col("g")).alias(x) for i, x in enumerate(ratings)]
        seen = [F.when((F.col("v") == 3) & F.lit(i == 0), -1).otherwise(F.col("n")).alias(x) for i, x in enumerate(behaviours)]
        name = F.when(F.col("v") == 1, "other").otherwise(F.lit(coder)).alias("questionnaire_id")
        text = F.when(F.col("v") == 0, "{not json").otherwise(F.to_json(F.struct(name, F.struct(*given).alias("globals"), F.struct(*seen).alias("behaviors"))))
        p = e.where(F.col("coder") == coder).select("event_id", "coder", F.from_json(text, nested_schema(list(ratings), list(behaviours))).alias("r"))
        of = lambda part, names: F.array(*(F.col(f"r.{part}.{x}").cast("double") for x in names))
        p = p.select("event_id", "coder", "r", of("globals", ratings).alias("gs"), of("behaviors", behaviours).alias("bs"))
        any_of = lambda c, test: F.exists(c, test)
        reject = (
            F.when(F.col("r.questionnaire_id").isNull(), "not_json").when(F.col("r.questionnaire_id") != coder, "wrong_id").when(any_of("gs", F.isnull) | any_of("bs", F.isnull), "missing")
            .when(any_of("bs", lambda x: x < 0), "negative").when(any_of("gs", lambda x: (x < low) | (x > high)), "out_of_bounds")
        )
        total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
        good = lambda c, r=reject: F.when(r.isNull(), c)
        one = p.select("event_id", "coder", reject.alias("reject"), good(total("bs")).cast("long").alias("n_behaviours"), *r6(mean_global=good(total("gs") / len(ratings))))
        out = one if out is None else out.unionByName(one)
    return out
