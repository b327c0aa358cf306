"""Queries on graders, candidate groups, transcripts, vectors, cost and resampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import end_reason, ratio
from ..operators import compute as cost
from ..operators import paired, reliability, resample, training, transcripts, vectors
from .views import C, G, JP, S, cells, compute, generations, judge_pairs, query, r6, scores_long, sql6, table

# --- graders ---------------------------------------------------------------------------------------------------------

_MS = """, kt AS (SELECT questionnaire, count(DISTINCT judge) AS k FROM q GROUP BY ALL), pt AS (SELECT questionnaire, t, count(*) AS own, sum(v) AS tt, sum(v*v) AS t2 FROM q GROUP BY ALL), wt AS (SELECT pt.*, k FROM pt JOIN kt USING (questionnaire) WHERE own=k),
cc AS (SELECT questionnaire, sum(c*c) AS cc FROM (SELECT questionnaire, judge, sum(v) AS c FROM q SEMI JOIN wt USING (questionnaire, t) GROUP BY ALL) GROUP BY ALL),
g AS (SELECT questionnaire, k, count(*) AS n, sum(tt) AS s, sum(t2) AS ss, sum(tt*tt) AS tt FROM wt GROUP BY ALL), ms0 AS (SELECT *, s*s/(n*k) AS ba, tt/k - s*s/(n*k) AS ssr, cc/n - s*s/(n*k) AS ssc FROM g JOIN cc USING (questionnaire)),
ms AS (SELECT questionnaire, n, k, ssr/(n-1) AS msr, ssc/nullif(k-1,0) AS msc, (ss-ba-ssr-ssc)/nullif((n-1)*(k-1),0) AS mse FROM ms0)
"""
_Q = S + ", q AS (SELECT questionnaire, arm||'|'||iteration||'|'||persona_id AS t, judge, avg(score) AS v FROM s GROUP BY ALL)" + _MS


def _rated(spark, sf_dir):
    return scores_long(spark, sf_dir).withColumn("target", F.concat_ws("|", "arm", "iteration", "persona_id"))


@query(_Q + "SELECT questionnaire, n, k, " + sql6("(msr-mse)/(msr+(k-1)*mse+k*(msc-mse)/n) AS icc") + " FROM ms")
def icc_2_1(spark, sf_dir):
    return reliability.icc_2_1(_rated(spark, sf_dir), ["questionnaire"], "target", "judge").select("questionnaire", "n", "k", *r6("icc"))


@query(_Q + "SELECT questionnaire, n, k, " + sql6("greatest((msr-mse)/k,0) AS var_target", "greatest((msc-mse)/n,0) AS var_rater", "greatest(mse,0) AS var_resid") + " FROM ms")
def variance_components_conv(spark, sf_dir):
    return reliability.variance_components(_rated(spark, sf_dir), ["questionnaire"], "target", "judge").select("questionnaire", "n", "k", *r6("var_target", "var_rater", "var_resid"))


@query(S + ", q AS (SELECT questionnaire, arm||'|'||iteration AS t, judge, avg(score) AS v FROM j GROUP BY ALL)" + _MS + "SELECT questionnaire, n, k, " + sql6("greatest((msr-mse)/k,0) AS var_target", "greatest((msc-mse)/n,0) AS var_rater", "greatest(mse,0) AS var_resid") + " FROM ms")
def variance_components_arm(spark, sf_dir):
    j = cells(spark, sf_dir, "judge").withColumn("target", F.concat_ws("|", "arm", "iteration"))
    return reliability.variance_components(j, ["questionnaire"], "target", "judge").select("questionnaire", "n", "k", *r6("var_target", "var_rater", "var_resid"))


@query(JP + ", r AS (SELECT *, rank() OVER (PARTITION BY questionnaire ORDER BY p)+(count(*) OVER (PARTITION BY questionnaire,p)-1)/2.0 AS x, rank() OVER (PARTITION BY questionnaire ORDER BY h)+(count(*) OVER (PARTITION BY questionnaire,h)-1)/2.0 AS y FROM jp) SELECT questionnaire, count(*) AS n, " + sql6("corr(p,h) AS pearson", "corr(x,y) AS spearman", "avg(h-p) AS bias", "avg(abs(h-p)) AS mean_abs_diff") + " FROM r GROUP BY ALL")
def agreement(spark, sf_dir):
    return reliability.agreement(judge_pairs(spark, sf_dir), ["questionnaire"]).select("questionnaire", "n", *r6("pearson", "spearman", "bias", "mean_abs_diff"))


@query(JP + """, b AS (SELECT arm, questionnaire, persona_id, p AS p0, h AS h0 FROM jp WHERE iteration=0), g AS (SELECT jp.arm, jp.questionnaire, iteration, count(*) AS n, avg(p-p0) AS dp, avg(h-h0) AS dh FROM jp JOIN b USING (arm, questionnaire, persona_id) WHERE iteration>0 GROUP BY ALL)
SELECT arm, questionnaire, iteration, n, """ + sql6("dp AS d_primary", "dh AS d_judge", "CASE WHEN abs(dp)>=0.15 THEN dh/dp END AS retention") + " FROM g")
def gain_retention(spark, sf_dir):
    return reliability.gain_retention(judge_pairs(spark, sf_dir), ["arm", "questionnaire"], 0.15).select("arm", "questionnaire", "iteration", "n", *r6("d_primary", "d_judge", "retention"))


_STATES = JP + ", m AS (SELECT questionnaire, arm||'|'||iteration AS st, avg(p) AS p, avg(h) AS h FROM jp GROUP BY ALL), ct AS (SELECT x.questionnaire, x.st AS a, y.st AS b, x.p-y.p AS dp, x.h-y.h AS dh FROM m x JOIN m y ON x.questionnaire=y.questionnaire AND x.st<y.st) "


def _states(spark, sf_dir):
    m = judge_pairs(spark, sf_dir).groupBy("questionnaire", F.concat_ws("|", "arm", "iteration").alias("state")).agg(F.avg("p").alias("p"), F.avg("h").alias("h"))
    return reliability.state_contrasts(m, ["questionnaire"])


@query(_STATES + "SELECT questionnaire, a, b, " + sql6("dp", "dh") + ", sign(dp)=sign(dh) AS same_sign FROM ct")
def all_pairs_contrasts(spark, sf_dir):
    return _states(spark, sf_dir).select("questionnaire", "a", "b", *r6("dp", "dh"), (F.signum("dp") == F.signum("dh")).alias("same_sign"))


@query(_STATES + "SELECT questionnaire, rung, count(*) AS n, count(*) FILTER (sign(dp)=sign(dh)) AS n_same, " + sql6("100.0*avg((sign(dp)=sign(dh))::INT) AS pct") + " FROM ct, (SELECT unnest([0.0,0.5,1.0,2.0])::DOUBLE AS rung) WHERE dp<>0 AND dh<>0 AND abs(dp)>=rung GROUP BY ALL")
def sign_ladder(spark, sf_dir):
    return reliability.sign_ladder(_states(spark, sf_dir), [0, 0.5, 1, 2], ["questionnaire"]).select("questionnaire", "rung", "n", "n_same", *r6("pct"))


@query(_STATES + "SELECT questionnaire, bin, count(*) AS n, " + sql6("avg((sign(dp)=sign(dh))::INT) AS agreement") + " FROM (SELECT *, CASE WHEN abs(dp)<0.1 THEN 0.0 WHEN abs(dp)<0.25 THEN 0.1 WHEN abs(dp)<0.5 THEN 0.25 WHEN abs(dp)<1 THEN 0.5 WHEN abs(dp)<2 THEN 1.0 WHEN abs(dp)<99 THEN 2.0 END::DOUBLE AS bin FROM ct WHERE dp<>0) WHERE bin IS NOT NULL GROUP BY ALL")
def concordance_bins(spark, sf_dir):
    return reliability.concordance_bins(_states(spark, sf_dir), [0, 0.1, 0.25, 0.5, 1, 2, 99], ["questionnaire"]).select("questionnaire", "bin", "n", *r6("agreement"))


@query(JP + ", q AS (SELECT arm, iteration, persona_id, avg(p) AS p, avg(h) AS h FROM jp GROUP BY ALL) SELECT arm, iteration, count(*) AS n_pairs, " + sql6("avg((sign(pa-pb)=sign(ha-hb))::INT) AS agreement") + " FROM (SELECT x.arm, x.iteration, x.p AS pa, y.p AS pb, x.h AS ha, y.h AS hb FROM q x JOIN q y ON x.arm=y.arm AND x.iteration=y.iteration AND x.persona_id<y.persona_id WHERE x.p<>y.p AND x.h<>y.h) GROUP BY ALL HAVING count(*)>=20")
def rank_agreement(spark, sf_dir):
    q = paired.means_in_order(judge_pairs(spark, sf_dir), ["arm", "iteration", "persona_id"], "event_id", "p", "h")
    return reliability.rank_agreement(q, ["arm", "iteration"], "p", "h", "persona_id", 20).select("arm", "iteration", "n_pairs", *r6("agreement"))


# --- candidate groups ------------------------------------------------------------------------------------------------

_GF = G + """, t AS (SELECT * FROM g WHERE phase<>'eval'), gf AS (SELECT arm, train_iter, group_id, count(*) AS n, count(score) AS n_scored, stddev_pop(score) AS sd0, stddev_samp(score) AS sd1, min(score) AS lo, max(score) AS hi, avg(score) AS mean, max(score)-min(score) AS margin, (max(score)-avg(score))/nullif(stddev_pop(score),0) AS winner_z FROM t GROUP BY ALL)
"""


def _trained(spark, sf_dir):
    return training.trained(generations(spark, sf_dir))


@query(_GF + "SELECT arm, train_iter, group_id, n, n_scored, " + sql6("sd0", "sd1", "lo", "hi", "mean", "margin", "winner_z") + " FROM gf")
def group_frame(spark, sf_dir):
    return training.group_frame(_trained(spark, sf_dir)).select("arm", "train_iter", "group_id", "n", "n_scored", *r6("sd0", "sd1", "lo", "hi", "mean", "margin", "winner_z"))


@query(_GF + "SELECT arm, train_iter, count(*) AS n_groups, " + sql6("avg(sd0) AS sd_mean", "quantile_cont(sd0,0.5) AS sd_median", "avg(margin) AS margin_mean", "quantile_cont(margin,0.5) AS margin_median", "avg(winner_z) AS winner_z", "avg((sd0<1e-6)::INT) AS frac_sd_zero", "avg((n_scored<n)::INT) AS frac_unscored", "quantile_cont(mean,0.75)-quantile_cont(mean,0.25) AS reward_iqr") + " FROM gf WHERE n_scored>=2 GROUP BY ALL")
def dispersion_by_iter(spark, sf_dir):
    out = training.dispersion(training.group_frame(_trained(spark, sf_dir)), ["arm", "train_iter"])
    return out.select("arm", "train_iter", "n_groups", *r6("sd_mean", "sd_median", "margin_mean", "margin_median", "winner_z", "frac_sd_zero", "frac_unscored", "reward_iqr"))


@query(_GF + "SELECT arm, tau, count(*) AS n_groups, " + sql6("avg((margin>tau)::INT) AS share") + " FROM gf, (SELECT unnest([0.05,0.15,0.25,0.35])::DOUBLE AS tau) WHERE n_scored>=2 GROUP BY ALL")
def tau_yield(spark, sf_dir):
    return training.tau_yield(training.group_frame(_trained(spark, sf_dir)), ["arm"], [0.05, 0.15, 0.25, 0.35]).select("arm", "tau", "n_groups", *r6("share"))


@query(_GF + ", x AS (SELECT arm, coalesce(train_iter::VARCHAR,'pooled') AS it, avg(margin) AS m, avg(sd0) AS s FROM gf WHERE n_scored>=2 GROUP BY GROUPING SETS ((arm, train_iter), (arm))) SELECT a.it AS train_iter, " + sql6("a.m/b.m AS margin_ratio", "a.s/b.s AS sd_ratio") + " FROM x a JOIN x b USING (it) WHERE a.arm='AF' AND b.arm='RF'")
def dispersion_ratio(spark, sf_dir):
    g = training.group_frame(_trained(spark, sf_dir)).where("n_scored >= 2").groupingSets([["arm", "train_iter"], ["arm"]], "arm", "train_iter").agg(F.avg("margin").alias("m"), F.avg("sd0").alias("s"))
    g = g.select("arm", F.coalesce(F.col("train_iter").cast("string"), F.lit("pooled")).alias("train_iter"), "m", "s")
    side = lambda a, c: F.max(F.when(F.col("arm") == a, F.col(c)))
    both = g.groupBy("train_iter").agg(ratio(side("AF", "m"), side("RF", "m")).alias("margin_ratio"), ratio(side("AF", "s"), side("RF", "s")).alias("sd_ratio"))
    return both.where("margin_ratio IS NOT NULL").select("train_iter", *r6("margin_ratio", "sd_ratio"))


@query(G + "SELECT arm, train_iter, phase, count(*) AS n, count(*) FILTER (score IS NULL) AS n_failed, " + sql6("100.0*avg((score IS NULL)::INT) AS pct_failed") + " FROM g GROUP BY ALL")
def degeneracy_scan(spark, sf_dir):
    g = generations(spark, sf_dir).groupBy("arm", "train_iter", "phase").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score").isNull()).alias("n_failed"))
    return g.select("arm", "train_iter", "phase", "n", "n_failed", *r6(pct_failed=100.0 * F.col("n_failed") / F.col("n")))


_WT = G + ", t AS (SELECT * FROM g WHERE phase<>'eval' AND score IS NOT NULL), z AS (SELECT *, coalesce((score-avg(score) OVER w)/nullif(stddev_samp(score) OVER w,0),0) AS raw FROM t WINDOW w AS (PARTITION BY arm, train_iter, group_id)), wt AS (SELECT * FROM (SELECT *, 2*raw/nullif(sum(abs(raw)) OVER (PARTITION BY arm, train_iter, group_id),0) AS weight FROM z) WHERE weight IS NOT NULL) "


@query(_WT + "SELECT arm, train_iter, group_id, cand_idx, " + sql6("weight") + " FROM wt")
def weights_grpo(spark, sf_dir):
    return training.standardised_weights(_trained(spark, sf_dir)).select("arm", "train_iter", "group_id", "cand_idx", *r6("weight"))


@query(_WT + "SELECT arm, train_iter, count(*) AS n_groups, " + sql6("avg(v) AS push", "stddev_samp(v)/sqrt(count(*)) AS push_se") + " FROM (SELECT arm, train_iter, group_id, sum(weight*length) AS v FROM wt GROUP BY ALL) GROUP BY ALL")
def lexical_push(spark, sf_dir):
    out = training.feature_push(training.standardised_weights(_trained(spark, sf_dir)), F.col("length"), ["arm", "train_iter"])
    return out.select("arm", "train_iter", "n_groups", *r6("push", "push_se"))


@query(G + ", p AS (SELECT arm, train_iter, group_id, count(*) AS n, max((score, cand_idx)) AS b, min((score, cand_idx)) AS w FROM g WHERE phase<>'eval' AND score IS NOT NULL GROUP BY ALL) SELECT arm, train_iter, group_id, n, b[2] AS chosen_idx, w[2] AS rejected_idx, " + sql6("b[1]-w[1] AS margin") + " FROM p WHERE n>=2 AND b[1]-w[1]>0.15")
def pair_yield(spark, sf_dir):
    return training.best_and_worst(_trained(spark, sf_dir), tau=0.15).select("arm", "train_iter", "group_id", "n", "chosen_idx", "rejected_idx", *r6("margin"))


@query(G + "SELECT arm, train_iter, count(score) AS n, " + sql6("avg(score) AS mean", "stddev_samp(score)/sqrt(count(score)) AS se") + " FROM g GROUP BY ALL")
def pool_mean(spark, sf_dir):
    g = generations(spark, sf_dir).groupBy("arm", "train_iter").agg(F.count("score").alias("n"), F.avg("score").alias("mean"), (F.stddev_samp("score") / F.sqrt(F.count("score").cast("double"))).alias("se"))
    return g.select("arm", "train_iter", "n", *r6("mean", "se"))


@query(G + "SELECT arm, CASE WHEN realized_turns IS NULL THEN 'not_simulated' WHEN realized_turns>=5 THEN 'full' WHEN realized_turns=0 THEN 'no_tail' WHEN realized_turns%2=1 THEN 'therapist_stalled' ELSE 'after_therapist' END AS reason, count(*) AS n, " + sql6("avg(score) AS mean_score") + " FROM g GROUP BY ALL")
def end_reason_counts(spark, sf_dir):
    g = generations(spark, sf_dir).groupBy("arm", end_reason("realized_turns", F.lit(""), 5).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))
    return g.select("arm", "reason", "n", *r6("mean_score"))


@query(G + "SELECT arm, train_iter, count(*) AS n_candidates, count(score) AS scored, sum(ceil(coalesce(realized_turns,0)/2.0))::BIGINT AS tail_calls FROM g GROUP BY ALL")
def api_calls(spark, sf_dir):
    return training.call_counts(generations(spark, sf_dir), ["arm", "train_iter"])


@query(G + ", d AS (SELECT arm, realized_turns, score - avg(score) OVER (PARTITION BY arm, train_iter, group_id) AS dev FROM g WHERE score IS NOT NULL) SELECT arm, realized_turns, count(*) AS n, " + sql6("avg(dev) AS dev_mean") + " FROM d WHERE realized_turns IS NOT NULL GROUP BY ALL HAVING count(*)>=5")
def score_by_realized_turns(spark, sf_dir):
    d = generations(spark, sf_dir).where("score IS NOT NULL").withColumn("dev", F.col("score") - F.avg("score").over(Window.partitionBy(*training.GROUP)))
    g = d.where("realized_turns IS NOT NULL").groupBy("arm", "realized_turns").agg(F.count(F.lit(1)).alias("n"), F.avg("dev").alias("dev_mean")).where("n >= 5")
    return g.select("arm", "realized_turns", "n", *r6("dev_mean"))


# --- transcripts -----------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT conv_id, trim(text, ' ') AS said, count(*) AS times, sum(length(text)) AS chars, sum(length(text)-length(replace(text, ',', ''))) AS marks FROM conversations WHERE role='assistant' AND text IS NOT NULL GROUP BY ALL),
g AS (SELECT conv_id, sum(times) AS n, sum(chars) AS ch, max(times) AS mr, sum(marks) AS mk FROM o GROUP BY ALL) SELECT conv_id, coalesce(n,0)::BIGINT AS n_turns, """ + sql6("coalesce(ch/nullif(n,0)::DOUBLE,0) AS mean_chars") + ", coalesce(mr,0)::BIGINT AS max_repeat, coalesce(mr,0)>=2 AS loop, " + sql6("coalesce(mk/nullif(n,0)::DOUBLE,0) AS marks_per_turn") + " FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN g USING (conv_id)")
def turn_metrics(spark, sf_dir):
    return transcripts.turn_metrics(table(spark, sf_dir, "conversations"), "assistant", ",").select("conv_id", "n_turns", *r6("mean_chars"), "max_repeat", "loop", *r6("marks_per_turn"))


@query("SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '[PATIENT] ' ELSE '[THERAPIST] ' END || text, chr(10)||chr(10) ORDER BY turn) AS transcript FROM conversations WHERE role IN ('user','assistant') AND trim(text, ' ')<>'' GROUP BY ALL")
def transcript_text(spark, sf_dir):
    return transcripts.transcript(table(spark, sf_dir, "conversations"), {"user": "PATIENT", "assistant": "THERAPIST"})


@query("WITH w AS (SELECT *, count(*) OVER o AS n_turns, sum(coalesce(length(text),0)) OVER o AS n_chars FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) SELECT conv_id, turn, n_turns, n_chars::BIGINT AS n_chars FROM w WHERE role='user' AND n_turns>=2")
def prompts_after_user_turn(spark, sf_dir):
    return transcripts.prompts(table(spark, sf_dir, "conversations"), "user", 2)


@query("WITH w AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS spent FROM conversations) SELECT conv_id, count(*) AS n_turns, max(spent)::BIGINT AS spent FROM w WHERE spent<=600 GROUP BY ALL")
def truncate_to_budget(spark, sf_dir):
    kept = transcripts.last_within(table(spark, sf_dir, "conversations"), 600, F.length("text"))
    return kept.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.max("spent").alias("spent"))


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS n_convs, " + sql6("avg(length(text)) AS mean_chars") + " FROM conversations GROUP BY ALL")
def role_counts(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("n_convs"), F.avg(F.length("text")).alias("mean_chars"))
    return g.select("role", "n", "n_convs", *r6("mean_chars"))


@query("WITH w AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) SELECT conv_id, count(*) AS n, count(*) FILTER (p<>role) AS n_switches FROM w GROUP BY ALL")
def role_alternation(spark, sf_dir):
    return transcripts.alternation(table(spark, sf_dir, "conversations"))


@query("WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY ALL ORDER BY n DESC, word LIMIT 100")
def vocab_top_n(spark, sf_dir):
    return transcripts.vocabulary(table(spark, sf_dir, "documents"), "text", 100)


@query("SELECT lang, source, count(*) AS n, " + sql6("avg(regexp_matches(text, '(?i)license|copyright')::INT) AS marker_rate", "avg(length(text)) AS mean_chars") + " FROM documents GROUP BY ALL")
def marker_rate(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("text").rlike("(?i)license|copyright").cast("int")).alias("marker_rate"), F.avg(F.length("text")).alias("mean_chars"))
    return g.select("lang", "source", "n", *r6("marker_rate", "mean_chars"))


@query("WITH x AS (SELECT d.lang, l.quality, l.toxic, length(d.text) AS len FROM documents d JOIN labels l USING (doc_id)) SELECT lang, count(*) FILTER (quality=1) AS n_chosen, count(*) FILTER (quality=0) AS n_rejected, " + sql6("avg(len) FILTER (quality=1) - avg(len) FILTER (quality=0) AS delta_len", "avg(toxic) FILTER (quality=1) - avg(toxic) FILTER (quality=0) AS delta_toxic") + " FROM x GROUP BY ALL")
def pair_text_features(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("len")).join(table(spark, sf_dir, "labels"), "doc_id")
    side = lambda q, c: F.avg(F.when(F.col("quality") == q, F.col(c)))
    g = x.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("n_chosen"), F.count_if(F.col("quality") == 0).alias("n_rejected"), (side(1, "len") - side(0, "len")).alias("delta_len"), (side(1, "toxic") - side(0, "toxic")).alias("delta_toxic"))
    return g.select("lang", "n_chosen", "n_rejected", *r6("delta_len", "delta_toxic"))


# --- vectors ---------------------------------------------------------------------------------------------------------

_DIR = """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding,1) AS dim FROM embeddings), d0 AS (SELECT label, dim, sum(CASE WHEN vec_id%2=0 THEN v ELSE -v END) AS s, count(*) AS n FROM e GROUP BY ALL),
d AS (SELECT label, dim, n, s/sqrt(sum(s*s) OVER (PARTITION BY label)) AS u FROM d0) """
def _directions(spark, sf_dir):
    return vectors.direction(table(spark, sf_dir, "embeddings"), ["label"], F.when(F.col("vec_id") % 2 == 0, 1.0).otherwise(-1.0))


@query(_DIR + "SELECT label, dim-1 AS dim, max(n) AS n, " + sql6("max(u) AS value") + " FROM d GROUP BY ALL")
def direction_by_label(spark, sf_dir):
    return _directions(spark, sf_dir).select("label", "n", F.posexplode("direction").alias("dim", "value")).select("label", F.col("dim").cast("long").alias("dim"), "n", *r6("value"))


@query(_DIR + "SELECT x.label AS a, y.label AS b, " + sql6("sum(x.u*y.u) AS cosine") + " FROM d x JOIN d y ON x.dim=y.dim AND x.label<y.label GROUP BY ALL")
def direction_cosines(spark, sf_dir):
    return vectors.cosines(_directions(spark, sf_dir), "label").select("a", "b", *r6("cosine"))


@query(_DIR + ", p AS (SELECT e.label, vec_id, sum(v*u) AS pr FROM e JOIN d USING (label, dim) GROUP BY ALL) SELECT label, " + sql6("avg(pr) FILTER (vec_id%2=0) AS mean_plus", "avg(pr) FILTER (vec_id%2=1) AS mean_minus", "avg((pr>0)::INT) FILTER (vec_id%2=0) AS wins") + " FROM p GROUP BY ALL")
def projection_wins(spark, sf_dir):
    p = vectors.projections(table(spark, sf_dir, "embeddings"), _directions(spark, sf_dir), ["label"])
    even = F.col("vec_id") % 2 == 0
    g = p.groupBy("label").agg(F.avg(F.when(even, F.col("projection"))).alias("mean_plus"), F.avg(F.when(~even, F.col("projection"))).alias("mean_minus"), F.avg(F.when(even, (F.col("projection") > 0).cast("int"))).alias("wins"))
    return g.select("label", *r6("mean_plus", "mean_minus", "wins"))


@query("""WITH e AS (SELECT label, (vec_id//100)::BIGINT AS step, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding,1) AS dim FROM embeddings), s AS (SELECT label, step, dim, sum(v) AS s FROM e GROUP BY ALL), d AS (SELECT label, step, dim, s/sqrt(sum(s*s) OVER (PARTITION BY label, step)) AS u FROM s),
st AS (SELECT *, lag(step) OVER (PARTITION BY label ORDER BY step) AS prev FROM (SELECT DISTINCT label, step FROM d)) SELECT st.label, st.step, """ + sql6("sum(x.u*y.u) AS cosine") + " FROM st JOIN d x ON x.label=st.label AND x.step=st.step JOIN d y ON y.label=st.label AND y.step=st.prev AND y.dim=x.dim GROUP BY ALL")
def centroid_drift(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("step", F.floor(F.col("vec_id") / 100))
    return vectors.drift(vectors.direction(e, ["label", "step"], F.lit(1.0)), ["label"], "step").select("label", "step", *r6("cosine"))


# --- cost ------------------------------------------------------------------------------------------------------------


@query(C + "SELECT arm, iteration, n_steps, " + sql6("cost", "cum_cost", "median_step") + " FROM comp")
def cost_cumsum(spark, sf_dir):
    return compute(spark, sf_dir).select("arm", "iteration", "n_steps", *r6("cost", "cum_cost", "median_step"))


@query(C + ", g AS (SELECT arm, count(*) AS n_iterations, sum(cost) AS total, quantile_cont(median_step,0.5) AS median_step FROM comp GROUP BY ALL) SELECT arm, n_iterations, " + sql6("total", "median_step", "total/n_iterations AS per_iteration", "total/sum(total) OVER () AS share") + " FROM g")
def cost_summary(spark, sf_dir):
    return cost.cost_summary(compute(spark, sf_dir)).select("arm", "n_iterations", *r6("total", "median_step", "per_iteration", "share"))


@query(C + ", n AS (SELECT a.iteration AS iter_a, b.iteration AS iter_b, abs(a.cum_cost-b.cum_cost) AS gap, row_number() OVER (PARTITION BY a.iteration ORDER BY abs(a.cum_cost-b.cum_cost), b.iteration) AS r FROM comp a, comp b WHERE a.arm='1-URGENT' AND b.arm='5-LOW') SELECT iter_a, iter_b, " + sql6("gap") + " FROM n WHERE r=1")
def iso_budget_pairs(spark, sf_dir):
    return cost.nearest_budget(compute(spark, sf_dir), "1-URGENT", "5-LOW").select("iter_a", "iter_b", *r6("gap"))


_BUDGET = C + ", b AS (SELECT DISTINCT cum_cost AS budget FROM comp WHERE arm='1-URGENT'), x AS (SELECT arm, budget, iteration, median_step, comp.cum_cost, row_number() OVER (PARTITION BY arm, budget ORDER BY median_step DESC, iteration) AS r FROM comp JOIN b ON cum_cost<=budget+1e-9) "


@query(_BUDGET + "SELECT arm, iteration AS best_iter, " + sql6("budget", "median_step AS level", "cum_cost") + " FROM x WHERE r=1")
def budget_sweep(spark, sf_dir):
    comp = compute(spark, sf_dir)
    budgets = comp.where("arm = '1-URGENT'").select(F.col("cum_cost").alias("budget")).distinct()
    best = cost.best_within(comp.withColumnRenamed("median_step", "level"), budgets, ["arm"], value="level")
    return best.select("arm", "best_iter", *r6("budget", "level", "cum_cost"))


@query(_BUDGET + "SELECT arm, iteration AS best_iter, " + sql6("budget", "median_step AS level", "cum_cost") + " FROM x WHERE r=1")
def budget_sweep_whole(spark, sf_dir):
    return budget_sweep(spark, sf_dir)


@query(C + ", p AS (SELECT iteration, max(median_step) FILTER (arm='1-URGENT') AS a, max(median_step) FILTER (arm='5-LOW') AS b FROM comp GROUP BY ALL) SELECT iteration, " + sql6("a AS step_a", "b AS step_b", "b/a AS ratio") + " FROM p")
def step_multiplier(spark, sf_dir):
    side = lambda a: F.max(F.when(F.col("arm") == a, F.col("median_step")))
    p = compute(spark, sf_dir).groupBy("iteration").agg(side("1-URGENT").alias("step_a"), side("5-LOW").alias("step_b"))
    return p.select("iteration", *r6("step_a", "step_b", ratio=ratio("step_b", "step_a")))


@query("""WITH t AS (SELECT user_id, epoch(ts)::DOUBLE AS tm FROM events), g AS (SELECT user_id, tm - lag(tm) OVER (PARTITION BY user_id ORDER BY tm) AS gap FROM t), s AS (SELECT user_id, count(*) AS n, coalesce(sum(gap) FILTER (gap>0 AND gap<86400),0) AS sm, count(*) FILTER (gap IS NOT NULL AND NOT (gap>0 AND gap<86400)) AS n_imputed, coalesce(quantile_cont(gap,0.5) FILTER (gap>0 AND gap<86400),0) AS md FROM g GROUP BY ALL)
SELECT user_id, n, n_imputed, """ + sql6("sm+n_imputed*md AS span") + " FROM s")
def span_imputed(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return cost.imputed_span(table(spark, sf_dir, "events").select("user_id", at.alias("at")), ["user_id"], cutoff=86400.0).select("user_id", "n", "n_imputed", *r6("span"))


# --- resampling ------------------------------------------------------------------------------------------------------

_BOOT = S + """, x AS (SELECT method, questionnaire, persona_id, avg(score) FILTER (k=0)-avg(score) FILTER (k=5) AS d FROM c GROUP BY ALL),
h AS (SELECT method, questionnaire, d, j, md5('12345|'||j||'|'||persona_id) AS h FROM x, (SELECT unnest(range(250)) AS j) WHERE d IS NOT NULL),
u AS (SELECT method, questionnaire, d, j*8+i AS b, ('0x'||h[i*4+1:i*4+4])::INT AS u FROM h, (SELECT unnest(range(8)) AS i)),
w AS (SELECT method, questionnaire, b, d, (u>=24109)::INT+(u>=48218)::INT+(u>=60273)::INT+(u>=64291)::INT+(u>=65296)::INT+(u>=65497)::INT+(u>=65530)::INT+(u>=65535)::INT AS w FROM u),
m AS (SELECT method, questionnaire, b, sum(w*d)/nullif(sum(w),0) AS m FROM w GROUP BY ALL), n AS (SELECT method, questionnaire, count(d) AS n FROM x GROUP BY ALL) """


@query(_BOOT + "SELECT method, questionnaire, max(n) AS n, " + sql6("quantile_cont(m,0.025) AS lo", "quantile_cont(m,0.975) AS hi") + " FROM m JOIN n USING (method, questionnaire) GROUP BY ALL")
def bootstrap_ci_hash(spark, sf_dir):
    by = ["method", "questionnaire"]
    d = paired.deltas(cells(spark, sf_dir), by, F.col("k") == 0, F.col("k") == 5)
    return resample.bootstrap_mean(d, by, "persona_id", "d").select(*by, "n", *r6("lo", "hi"))
