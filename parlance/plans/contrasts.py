"""Families of contrasts: states, graders, items and strata, each from rows, with intervals where they are quoted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import favours, model_name, ratio, stars
from ..operators import hypothesis, paired, ranking, reliability, reshape, resample
from .scores import _EFFECT, _P6, _R6, _contrast_sql, _holm_sql, _k, _pairs_sql
from .views import ITEMS, JP, S, cells, items_long, judge_pairs, ordered_cells, query, r6, scores_long, sql6, table

#: Draws of operators.resample as SQL, for rows `src` (keys, unit, value columns).
_W = "(u>=24109)::INT+(u>=48218)::INT+(u>=60273)::INT+(u>=64291)::INT+(u>=65296)::INT+(u>=65497)::INT+(u>=65530)::INT+(u>=65535)::INT"


def draws_sql(name: str, source: str, by: str, unit: str, values: list[str], blocks: int = 250) -> str:
    """CTE `name` (by, b, the mean of each value in replicate b)."""
    means = ", ".join(f"sum(w*{v}) FILTER ({v} IS NOT NULL)/nullif(sum(w) FILTER ({v} IS NOT NULL),0) AS {v}" for v in values)
    return f""", {name}_h AS (SELECT {by}, {', '.join(values)}, j, md5('12345|'||j||'|'||{unit}) AS h FROM {source}, (SELECT unnest(range({blocks})) AS j)),
{name}_u AS (SELECT {by}, {', '.join(values)}, j*8+i AS b, ('0x'||h[i*4+1:i*4+4])::INT AS u FROM {name}_h, (SELECT unnest(range(8)) AS i)),
{name} AS (SELECT {by}, b, {means} FROM (SELECT *, {_W} AS w FROM {name}_u) GROUP BY {by}, b)
"""


# --- states ----------------------------------------------------------------------------------------------------------

_TWO = S + _contrast_sql("questionnaire", _pairs_sql("questionnaire", "arm='A_K0' AND iteration=2", "arm='A_K5' AND iteration=2")) + _holm_sql("ct", "1", "questionnaire")


@query(_TWO + f"SELECT questionnaire, n, n_nonzero, {_P6} FROM hm")
def compare_two_models(spark, sf_dir):
    """Two states on every rubric, Holm over the rubrics."""
    side = lambda arm: (F.col("arm") == arm) & (F.col("iteration") == 2)
    out = paired.contrast(cells(spark, sf_dir), ["questionnaire"], side("A_K0"), side("A_K5")).withColumn("family", F.lit(1))
    return paired.holm(out, ["family"], tiebreak=["questionnaire"]).select("questionnaire", "n", "n_nonzero", *r6(*_R6))


_MD = "pr AS ({pairs}), md AS (SELECT {by}, count(*) AS n, quantile_cont(d,0.5) AS median_delta, count(*) FILTER (d>0) AS n_up, count(*) FILTER (d<0) AS n_down, avg(d)/nullif(stddev_samp(d)/sqrt(count(*)),0) AS t FROM pr GROUP BY {by})"


@query(S + ", " + _MD.format(by="method, questionnaire", pairs=_pairs_sql("method, questionnaire", "k=0", "k=5")) + " SELECT method, questionnaire, n, n_up, n_down, " + sql6("median_delta", "t") + " FROM md")
def paired_models(spark, sf_dir):
    """Paired t statistic, median difference and how many units go either way."""
    by = ["method", "questionnaire"]
    d = paired.deltas(ordered_cells(spark, sf_dir), by, _k(0), _k(5), order="event_id")
    g = d.groupBy(*by).agg(
        F.count("d").alias("n"), F.count_if(F.col("d") > 0).alias("n_up"), F.count_if(F.col("d") < 0).alias("n_down"), F.percentile("d", 0.5).alias("median_delta"),
        ratio(F.avg("d"), F.stddev_samp("d") / F.sqrt(F.count("d").cast("double"))).alias("t"),
    )
    return g.select(*by, "n", "n_up", "n_down", *r6("median_delta", "t"))


_CI = S + ", src AS (" + _pairs_sql("method, questionnaire, iteration", "k=0", "k=5") + ")" + draws_sql("dr", "src", "method, questionnaire, iteration", "persona_id", ["d"])


@query(_CI + ", n AS (SELECT method, questionnaire, iteration, count(*) AS n FROM src GROUP BY ALL) SELECT method, questionnaire, iteration, n, " + sql6("CASE WHEN n>=3 THEN quantile_cont(d,0.025) END AS lo", "CASE WHEN n>=3 THEN quantile_cont(d,0.975) END AS hi") + " FROM dr JOIN n USING (method, questionnaire, iteration) GROUP BY method, questionnaire, iteration, n")
def paired_k_contrast_ci(spark, sf_dir):
    by = ["method", "questionnaire", "iteration"]
    return paired.with_interval(paired.deltas(cells(spark, sf_dir), by, _k(0), _k(5)), by).select(*by, "n", *r6("lo", "hi"))


_KJ = "judge, method, questionnaire, iteration"
_JSQL = S + _contrast_sql(_KJ, _pairs_sql(_KJ, "k=0", "k=5", "j"))
_KLEV = "lv AS (SELECT judge, method, questionnaire, iteration, avg(score) FILTER (k=0) AS level_k0, avg(score) FILTER (k=5) AS level_k5, stddev_samp(score) FILTER (k=0)/sqrt(count(*) FILTER (k=0)) AS se_k0, stddev_samp(score) FILTER (k=5)/sqrt(count(*) FILTER (k=5)) AS se_k5 FROM j GROUP BY ALL)"


def _k_frames(spark, sf_dir, family: list[str], tie: list[str]) -> DataFrame:
    by = ["judge", "method", "questionnaire", "iteration"]
    return paired.holm(paired.contrast(cells(spark, sf_dir, "judge"), by, _k(0), _k(5)), family, tiebreak=tie)


@query(_JSQL + _holm_sql("ct", "judge, method, questionnaire", "iteration") + f", {_KLEV} SELECT {_KJ}, n, n_nonzero, {_P6}, {sql6('level_k0', 'level_k5', 'se_k0', 'se_k5')} FROM hm JOIN lv USING (judge, method, questionnaire, iteration)")
def paired_k_frames(spark, sf_dir):
    """The contrast under either grader with the levels of both sides; Holm over the iterations of a rubric."""
    by = ["judge", "method", "questionnaire", "iteration"]
    k = lambda n: F.when(F.col("k") == n, F.col("score"))
    levels = cells(spark, sf_dir, "judge").groupBy(*by).agg(*(F.avg(k(n)).alias(f"level_k{n}") for n in (0, 5)), *((F.stddev_samp(k(n)) / F.sqrt(F.count(k(n)).cast("double"))).alias(f"se_k{n}") for n in (0, 5)))
    out = _k_frames(spark, sf_dir, ["judge", "method", "questionnaire"], ["iteration"]).join(levels, by)
    return out.select(*by, "n", "n_nonzero", *r6(*_R6, "level_k0", "level_k5", "se_k0", "se_k5"))


@query(_JSQL + _holm_sql("ct", "judge, method, iteration", "questionnaire") + f"SELECT {_KJ}, {sql6('p', 'p_holm')} FROM hm")
def paired_k_frames_by_rubric(spark, sf_dir):
    """The same p with Holm over the rubrics of an iteration."""
    return _k_frames(spark, sf_dir, ["judge", "method", "iteration"], ["questionnaire"]).select("judge", "method", "questionnaire", "iteration", *r6("p", "p_holm"))


@query(S + "SELECT judge, arm, questionnaire, iteration, count(*) AS n, " + sql6("avg(score) AS mean", "stddev_samp(score) AS sd", "stddev_samp(score)/sqrt(count(*)) AS se") + " FROM j GROUP BY ALL")
def k_levels(spark, sf_dir):
    g = cells(spark, sf_dir, "judge").groupBy("judge", "arm", "questionnaire", "iteration").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"))
    return g.select("judge", "arm", "questionnaire", "iteration", "n", *r6("mean", "sd", se=F.col("sd") / F.sqrt(F.col("n").cast("double"))))


_CELL = "coalesce(round(round(avg(score) FILTER ({0}),10),2)::DECIMAL(18,2)::VARCHAR, '—')"


@query(S + f"SELECT questionnaire, iteration, {_CELL.format('arm=' + chr(39) + 'A_K0' + chr(39) + ' AND judge=0')} AS a_k0_j0, {_CELL.format('arm=' + chr(39) + 'A_K5' + chr(39) + ' AND judge=0')} AS a_k5_j0, {_CELL.format('arm=' + chr(39) + 'A_K0' + chr(39) + ' AND judge=1')} AS a_k0_j1, {_CELL.format('arm=' + chr(39) + 'A_K5' + chr(39) + ' AND judge=1')} AS a_k5_j1 FROM j GROUP BY ALL")
def k_table1(spark, sf_dir):
    """Cells of a printed table, a dash where there is nothing."""
    cell = lambda arm, judge: F.coalesce(F.round(F.round(F.avg(F.when((F.col("arm") == arm) & (F.col("judge") == judge), F.col("score"))), 10), 2).cast("decimal(18,2)").cast("string"), F.lit("—"))
    return cells(spark, sf_dir, "judge").groupBy("questionnaire", "iteration").agg(*(cell(a, j).alias(f"{a.lower()}_j{j}") for j in (0, 1) for a in ("A_K0", "A_K5")))


@query(S + "SELECT persona_id, " + ", ".join(sql6(f"avg(score) FILTER (arm='{a}' AND iteration={i}) AS {a.lower()}_{i}") for a in ("A_K0", "A_K5") for i in (0, 4)) + " FROM c WHERE questionnaire='click' GROUP BY ALL HAVING count(*) FILTER (arm IN ('A_K0','A_K5') AND iteration IN (0,4)) > 0")
def wide_by_persona(spark, sf_dir):
    """A row per persona, a column per state, for one rubric."""
    states = [(a, i) for a in ("A_K0", "A_K5") for i in (0, 4)]
    named = cells(spark, sf_dir).where("questionnaire = 'click' AND arm IN ('A_K0', 'A_K5') AND iteration IN (0, 4)").withColumn("state", F.concat_ws("_", F.lower("arm"), "iteration"))
    names = [f"{a.lower()}_{i}" for a, i in states]
    return reshape.to_wide(named, ["persona_id"], "state", names, "score").select("persona_id", *r6(*names))


@query(S + "SELECT DISTINCT arm, iteration, arm[1:1]||'Exp3_LA'||arm[4:4]||'_'||CASE WHEN iteration=0 THEN 'Base' ELSE 'I'||iteration END AS model FROM c")
def model_names(spark, sf_dir):
    keys = cells(spark, sf_dir).select("arm", "method", "k", "iteration").distinct()
    return keys.select("arm", "iteration", model_name("method", "k", "iteration").alias("model"))


@query(S + ", sc AS (SELECT arm, iteration, persona_id, questionnaire AS channel, score, 'graded' AS kind FROM c UNION ALL SELECT arm, iteration, persona_id, 'share_click', count(*) FILTER (questionnaire='click')::DOUBLE/count(*), 'text' FROM s GROUP BY ALL)"
       + ", sk AS (SELECT *, arm[1:1] AS method, arm[4:4]::INT AS k FROM sc)" + _contrast_sql("kind, channel, method, iteration", _pairs_sql("kind, channel, method, iteration", "k=0", "k=5", "sk")) + _holm_sql("ct", "kind, channel, method", "iteration") + f"SELECT kind, channel, method, iteration, n, n_nonzero, {_P6} FROM hm")
def channel_k_frames(spark, sf_dir):
    """Graded channels and one that is counted from the rows, in one contrast."""
    keys = ["arm", "method", "k", "iteration", "persona_id"]
    graded = cells(spark, sf_dir).select(*keys, F.col("questionnaire").alias("channel"), "score", F.lit("graded").alias("kind"))
    share = scores_long(spark, sf_dir).groupBy(*keys).agg(ratio(F.count_if(F.col("questionnaire") == "click"), F.count(F.lit(1))).alias("score"))
    every = graded.unionByName(share.withColumns({"channel": F.lit("share_click"), "kind": F.lit("text")}))
    by = ["kind", "channel", "method", "iteration"]
    return paired.holm(paired.contrast(every, by, _k(0), _k(5)), by[:3], tiebreak=["iteration"]).select(*by, "n", "n_nonzero", *r6(*_R6))


@query(_JSQL + _holm_sql("ct", "judge, method, questionnaire", "iteration") + """SELECT method, questionnaire, iteration, max(n) FILTER (judge=0) AS n_primary, max(n) FILTER (judge=1) AS n_judge, """ + sql6("max(mean_delta) FILTER (judge=0) AS d_primary", "max(mean_delta) FILTER (judge=1) AS d_judge", "max(p_holm) FILTER (judge=0) AS p_primary", "max(p_holm) FILTER (judge=1) AS p_judge") + " FROM hm GROUP BY ALL HAVING max(mean_delta) FILTER (judge=0) IS NOT NULL AND max(mean_delta) FILTER (judge=1) IS NOT NULL")
def cross_k_pairs(spark, sf_dir):
    """The contrast of matched iterations side by side under both graders, Holm within each."""
    out = _k_frames(spark, sf_dir, ["judge", "method", "questionnaire"], ["iteration"])
    side = lambda j, c: F.max(F.when(F.col("judge") == j, F.col(c)))
    names = (("primary", 0), ("judge", 1))
    g = out.groupBy("method", "questionnaire", "iteration").agg(*(side(j, "n").alias(f"n_{m}") for m, j in names), *(side(j, "mean_delta").alias(f"d_{m}") for m, j in names), *(side(j, "p_holm").alias(f"p_{m}") for m, j in names))
    return g.where("d_primary IS NOT NULL AND d_judge IS NOT NULL").select("method", "questionnaire", "iteration", "n_primary", "n_judge", *r6("d_primary", "d_judge", "p_primary", "p_judge"))


@query(JP + """, b AS (SELECT arm, questionnaire, persona_id, avg(p) AS p0, avg(h) AS h0 FROM jp WHERE iteration=0 GROUP BY ALL), pb AS (SELECT questionnaire, persona_id, avg(p) AS p0, avg(h) AS h0 FROM jp WHERE iteration=0 GROUP BY ALL),
rf AS (SELECT 'own' AS reference, jp.*, p0, h0 FROM jp JOIN b USING (arm, questionnaire, persona_id) WHERE iteration>0 UNION ALL SELECT 'pooled', jp.*, p0, h0 FROM jp JOIN pb USING (questionnaire, persona_id) WHERE iteration>0),
g AS (SELECT reference, arm, questionnaire, iteration, count(*) AS n, avg(p-p0) AS dp, avg(h-h0) AS dh FROM rf GROUP BY ALL), r AS (SELECT *, CASE WHEN abs(dp)>=0.15 THEN dh/dp END AS retention FROM g)
SELECT reference, questionnaire, arm[4:4]::INT AS k, count(*) AS n_cells, count(retention) AS n_kept, """ + sql6("avg(retention) AS mean_retention", "quantile_cont(retention,0.5) AS median_retention") + " FROM r GROUP BY ALL")
def retention_by_k(spark, sf_dir):
    """Retention against an arm's own base and the base of all arms, summed up by the look-ahead of the arm."""
    jp = judge_pairs(spark, sf_dir)
    base = jp.where("iteration = 0")
    own = base.groupBy("arm", "questionnaire", "persona_id").agg(F.avg("p").alias("p0"), F.avg("h").alias("h0"))
    pooled = base.groupBy("questionnaire", "persona_id").agg(F.avg("p").alias("p0"), F.avg("h").alias("h0"))
    later = jp.where("iteration > 0")
    rf = later.join(own, ["arm", "questionnaire", "persona_id"]).withColumn("reference", F.lit("own")).unionByName(later.join(pooled, ["questionnaire", "persona_id"]).withColumn("reference", F.lit("pooled")))
    g = rf.groupBy("reference", "arm", "k", "questionnaire", "iteration").agg(F.avg(F.col("p") - F.col("p0")).alias("dp"), F.avg(F.col("h") - F.col("h0")).alias("dh"))
    g = g.withColumn("retention", F.when(F.abs("dp") >= 0.15, ratio("dh", "dp")))
    out = g.groupBy("reference", "questionnaire", "k").agg(F.count(F.lit(1)).alias("n_cells"), F.count("retention").alias("n_kept"), F.avg("retention").alias("mean_retention"), F.percentile("retention", 0.5).alias("median_retention"))
    return out.select("reference", "questionnaire", "k", "n_cells", "n_kept", *r6("mean_retention", "median_retention"))


_RET = JP + ", b AS (SELECT arm, questionnaire, persona_id, avg(p) AS p0, avg(h) AS h0 FROM jp WHERE iteration=0 GROUP BY ALL), src AS (SELECT jp.arm, jp.questionnaire, iteration, persona_id, p-p0 AS dp, h-h0 AS dh FROM jp JOIN b USING (arm, questionnaire, persona_id) WHERE iteration>0)" + draws_sql("dr", "src", "arm, questionnaire, iteration", "persona_id", ["dp", "dh"], 250)

#: Gains of a resample that cancel leave up to some 1e-14 of a float sum, of either sign; below this there is no gain, and retention is null.
NO_GAIN = 5e-11


@query(_RET + ", m AS (SELECT arm, questionnaire, iteration, count(*) AS n, avg(dp) AS ma, avg(dh) AS mb FROM src GROUP BY ALL) SELECT arm, questionnaire, iteration, n, " + sql6("mb/nullif(ma,0) AS retention", "quantile_cont(dh/nullif(dp,0),0.025) AS lo", "quantile_cont(dh/nullif(dp,0),0.975) AS hi") + " FROM m JOIN dr USING (arm, questionnaire, iteration) WHERE abs(ma)>=0.15 GROUP BY arm, questionnaire, iteration, n, ma, mb")
def retention_ci_hash(spark, sf_dir):
    """Retention with an interval from 2,000 joint resamples of both graders' gains."""
    by = ["arm", "questionnaire", "iteration"]
    jp = judge_pairs(spark, sf_dir)
    base = jp.where("iteration = 0").groupBy("arm", "questionnaire", "persona_id").agg(F.avg("p").alias("p0"), F.avg("h").alias("h0"))
    rows = jp.where("iteration > 0").join(base, ["arm", "questionnaire", "persona_id"]).select(*by, "persona_id", (F.col("p") - F.col("p0")).alias("dp"), (F.col("h") - F.col("h0")).alias("dh"))
    whole = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("dp").alias("a"), F.avg("dh").alias("b")).where("abs(a) >= 0.15")
    gain = F.when(F.abs("dp") >= NO_GAIN, F.col("dp"))
    ends = resample.interval(resample.replicates(rows, by, "persona_id", ["dp", "dh"]), by, ratio("dh", gain))
    return whole.join(ends, by).select(*by, "n", *r6("lo", "hi", retention=ratio("b", "a")))


# --- endpoints -------------------------------------------------------------------------------------------------------


@query(S + ", e AS (SELECT arm, method, k, max(iteration) AS last FROM c GROUP BY ALL) SELECT method, min(last) AS matched, max(last) FILTER (k=0) AS last_k0, max(last) FILTER (k=5) AS last_k5 FROM e GROUP BY ALL")
def matched_endpoints(spark, sf_dir):
    """The last iteration of either look-ahead, and the last that both have."""
    last = paired.final_iteration(cells(spark, sf_dir), ["method", "k"])
    return last.groupBy("method").agg(F.min("iteration").alias("matched"), *(F.max(F.when(F.col("k") == n, F.col("iteration"))).alias(f"last_k{n}") for n in (0, 5)))


_ITEM = ITEMS + ", lx AS (SELECT arm, max(iteration) AS la FROM it GROUP BY ALL), ig AS (SELECT it.arm, item, avg(score) FILTER (iteration=0) AS base, avg(score) FILTER (iteration=la) AS target, max(la) AS target_iter FROM it JOIN lx USING (arm) GROUP BY ALL)"


@query(_ITEM + " SELECT arm, item, target_iter, " + sql6("base", "target", "target-base AS delta") + " FROM ig WHERE base IS NOT NULL AND target IS NOT NULL")
def item_endpoint_deltas(spark, sf_dir):
    """Base and final mean of every item of an arm."""
    it = items_long(spark, sf_dir)
    return paired.endpoint_deltas(it, ["arm", "item"]).select("arm", "item", "target_iter", *r6("base", "target", "delta"))


@query(_ITEM + ", lb AS (SELECT unnest(range(1,13)) AS item, unnest(['goal','task','bond','goal','task','bond','goal','task','bond','goal','task','bond']) AS grp) SELECT arm, grp, count(*) AS n_items, " + sql6("avg(target-base) AS delta", "max(target-base) AS largest") + " FROM ig JOIN lb USING (item) WHERE base IS NOT NULL AND target IS NOT NULL GROUP BY ALL")
def item_deltas_by_group(spark, sf_dir):
    """The same with the items' labels and groups joined on."""
    labels = spark.createDataFrame([(i, ("bond", "goal", "task")[i % 3]) for i in range(1, 13)], "item int, grp string")
    g = paired.endpoint_deltas(items_long(spark, sf_dir), ["arm", "item"]).join(labels, "item")
    return g.groupBy("arm", "grp").agg(F.count(F.lit(1)).alias("n_items"), F.avg("delta").alias("delta"), F.max("delta").alias("largest")).select("arm", "grp", "n_items", *r6("delta", "largest"))


_SUB = ITEMS + ", w AS (SELECT judge, arm, method, k, iteration, persona_id, avg(score) FILTER (item%3=1) AS goal, avg(score) FILTER (item%3=2) AS task, avg(score) FILTER (item%3=0) AS bond, avg(score) AS total FROM it GROUP BY ALL)"


def _subscales(spark, sf_dir) -> DataFrame:
    part = lambda m: F.avg(F.when(F.col("item") % 3 == m, F.col("score")))
    return items_long(spark, sf_dir).groupBy("judge", "arm", "method", "k", "iteration", "persona_id").agg(part(1).alias("goal"), part(2).alias("task"), part(0).alias("bond"), F.avg("score").alias("total"))


@query(_SUB + " SELECT judge, arm, iteration, persona_id, " + sql6("goal", "task", "bond", "total", "bond-(goal+task)/2 AS bond_excess") + " FROM w")
def wai_conversation_frame(spark, sf_dir):
    """Items to subscale means by conversation; an excess over the mean of the two others."""
    w = _subscales(spark, sf_dir)
    return w.select("judge", "arm", "iteration", "persona_id", *r6("goal", "task", "bond", "total", bond_excess=F.col("bond") - (F.col("goal") + F.col("task")) / 2))


@query(_SUB + ", st AS (SELECT judge, arm, iteration, persona_id, sum(score) FILTER (item%3=1)/nullif(count(*) FILTER (item%3=1),0) AS stored FROM it GROUP BY ALL) SELECT count(*) AS n, " + sql6("max(abs(goal-stored)) AS largest_gap") + ", max(abs(goal-stored))<=1e-9 AS equal FROM w JOIN st USING (judge, arm, iteration, persona_id)")
def wai_subscale_parity(spark, sf_dir):
    """The subscale from its items against one that is stored."""
    keys = ["judge", "arm", "iteration", "persona_id"]
    first = F.when(F.col("item") % 3 == 1, F.col("score"))
    kept = items_long(spark, sf_dir).groupBy(*keys).agg(ratio(F.sum(first), F.count(first)).alias("stored"))
    return reshape.largest_gap(_subscales(spark, sf_dir).select(*keys, F.col("goal").alias("x")), kept.select(*keys, F.col("stored").alias("y")), keys, 1e-9).select("n", *r6("largest_gap"), "equal")


_SUBL = _SUB + ", u AS (SELECT judge, arm, method, k, iteration, persona_id, unnest(['goal','task','bond']) AS scale, unnest([goal,task,bond]) AS score FROM w), l AS (SELECT * FROM u WHERE score IS NOT NULL)"


def _scales(spark, sf_dir) -> DataFrame:
    keys = ["judge", "arm", "method", "k", "iteration", "persona_id"]
    return reshape.to_long(_subscales(spark, sf_dir).select(*keys, "goal", "task", "bond"), keys, ["goal", "task", "bond"], "scale", "score")


@query(_SUBL + ", g AS (SELECT judge, arm, scale, iteration, count(*) AS n, avg(score) AS mean FROM l GROUP BY ALL), b AS (SELECT judge, arm, scale, mean AS base FROM g WHERE iteration=0) SELECT judge, arm, scale, iteration, n, " + sql6("mean", "mean-base AS gain") + " FROM g LEFT JOIN b USING (judge, arm, scale)")
def wai_subscales(spark, sf_dir):
    """Levels of the subscales and what they gained over base."""
    g = _scales(spark, sf_dir).groupBy("judge", "arm", "scale", "iteration").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))
    base = g.where("iteration = 0").select("judge", "arm", "scale", F.col("mean").alias("base"))
    return g.join(base, ["judge", "arm", "scale"], "left").select("judge", "arm", "scale", "iteration", "n", *r6("mean", gain=F.col("mean") - F.col("base")))


_WK = "judge, scale, method, iteration"


@query(_SUBL + _contrast_sql(_WK, _pairs_sql(_WK, "k=0", "k=5", "l")) + _holm_sql("ct", "judge, scale, method", "iteration") + f"SELECT {_WK}, n, n_nonzero, {_P6} FROM hm")
def wai_kcontrast(spark, sf_dir):
    by = ["judge", "scale", "method", "iteration"]
    return paired.holm(paired.contrast(_scales(spark, sf_dir), by, _k(0), _k(5)), by[:3], tiebreak=["iteration"]).select(*by, "n", "n_nonzero", *r6(*_R6))


@query(_SUBL + ", la AS (SELECT arm, max(iteration) AS la FROM l GROUP BY ALL), src AS (SELECT arm, scale, persona_id, avg(score) FILTER (iteration=la) - avg(score) FILTER (iteration=0) AS d FROM l JOIN la USING (arm) WHERE judge=0 GROUP BY ALL), s2 AS (SELECT * FROM src WHERE d IS NOT NULL)" + draws_sql("dr", "s2", "arm, scale", "persona_id", ["d"], 250) + ", m AS (SELECT arm, scale, count(*) AS n, avg(d) AS gain FROM s2 GROUP BY ALL) SELECT arm, scale, n, " + sql6("gain", "CASE WHEN n>=3 THEN quantile_cont(d,0.025) END AS lo", "CASE WHEN n>=3 THEN quantile_cont(d,0.975) END AS hi") + " FROM m JOIN dr USING (arm, scale) GROUP BY arm, scale, n, gain")
def wai_fig_data(spark, sf_dir):
    """Gains of the subscales at the last iteration with an interval of 200 draws, one grader."""
    rows = _scales(spark, sf_dir).where("judge = 0")
    rows = rows.join(paired.final_iteration(_scales(spark, sf_dir), ["arm"]).withColumnRenamed("iteration", "la"), "arm")
    by = ["arm", "scale"]
    d = paired.deltas(rows, by, F.col("iteration") == F.col("la"), F.col("iteration") == 0)
    g = d.groupBy(*by).agg(F.count("d").alias("n"), F.avg("d").alias("gain"))
    ends = resample.interval(resample.replicates(d, by, "persona_id", ["d"]), by, F.col("d"))
    return g.join(ends, by).select(*by, "n", *r6("gain", lo=F.when(F.col("n") >= 3, F.col("lo")), hi=F.when(F.col("n") >= 3, F.col("hi"))))


_PCT = S + ", pc AS (SELECT method, k, iteration, persona_id, count(*) FILTER (questionnaire='click') AS ct, count(*) FILTER (questionnaire='view') AS st FROM s GROUP BY ALL), pp AS (SELECT method, k, iteration, persona_id, unnest(['ct','st','prop']) AS part, unnest([ct::DOUBLE, st::DOUBLE, ct::DOUBLE/nullif(ct+st,0)]) AS score FROM pc), pl AS (SELECT * FROM pp WHERE score IS NOT NULL)"


@query(_PCT + _contrast_sql("part, method, iteration", _pairs_sql("part, method, iteration", "k=0", "k=5", "pl")) + _holm_sql("ct", "part, method", "iteration") + f"SELECT part, method, iteration, n, n_nonzero, {_P6} FROM hm")
def pct_kcontrast(spark, sf_dir):
    """Counts of two kinds of talk and the share of the first, null where there is neither."""
    keys = ["method", "k", "iteration", "persona_id"]
    n = lambda q: F.count_if(F.col("questionnaire") == q).cast("double")
    w = scores_long(spark, sf_dir).groupBy(*keys).agg(n("click").alias("ct"), n("view").alias("st")).withColumn("prop", ratio("ct", F.col("ct") + F.col("st")))
    long = reshape.to_long(w, keys, ["ct", "st", "prop"], "part", "score")
    by = ["part", "method", "iteration"]
    return paired.holm(paired.contrast(long, by, _k(0), _k(5)), by[:2], tiebreak=["iteration"]).select(*by, "n", "n_nonzero", *r6(*_R6))


@query(ITEMS + _contrast_sql("method, item, judge", _pairs_sql("method, item, judge", "k=0", "k=5", "it")) + _holm_sql("ct", "method, judge", "item") + f"SELECT method, item, judge, n, n_nonzero, {_P6} FROM hm")
def q2_items(spark, sf_dir):
    """The contrast item by item, Holm over the items."""
    by = ["method", "item", "judge"]
    return paired.holm(paired.contrast(items_long(spark, sf_dir), by, _k(0), _k(5)), ["method", "judge"], tiebreak=["item"]).select(*by, "n", "n_nonzero", *r6(*_R6))


# --- spread ----------------------------------------------------------------------------------------------------------

_SD = S + ", bt AS (SELECT method, questionnaire, iteration, stddev_samp(score) FILTER (k=0) AS sd0, stddev_samp(score) FILTER (k=5) AS sd5, quantile_cont(score,0.75) FILTER (k=0)-quantile_cont(score,0.25) FILTER (k=0) AS iqr0, quantile_cont(score,0.75) FILTER (k=5)-quantile_cont(score,0.25) FILTER (k=5) AS iqr5 FROM c GROUP BY ALL), pm AS (SELECT method, questionnaire, iteration, count(*) AS n, CASE WHEN count(*)>=3 THEN corr(a+b,a-b) END AS r FROM (" + _pairs_sql("method, questionnaire, iteration", "k=0", "k=5") + ") GROUP BY ALL), md AS (SELECT method, questionnaire, iteration, k, quantile_cont(score,0.5) AS ce FROM c GROUP BY ALL), dv AS (SELECT c.method, c.questionnaire, c.iteration, c.k, abs(score-ce) AS dd FROM c JOIN md USING (method, questionnaire, iteration, k)), g AS (SELECT method, questionnaire, iteration, k, count(*) AS n, avg(dd) AS m, var_pop(dd) AS v FROM dv GROUP BY ALL), tt AS (SELECT method, questionnaire, iteration, sum(n) AS n, count(*) AS k, sum(n*v) AS w, sum(n*m)/sum(n) AS gm FROM g GROUP BY ALL), f AS (SELECT g.method, g.questionnaire, g.iteration, (sum(g.n*(m-gm)*(m-gm))/nullif(max(tt.k)-1,0))/nullif(max(w)/(max(tt.n)-max(tt.k)),0) AS f FROM g JOIN tt USING (method, questionnaire, iteration) GROUP BY ALL), sd AS (SELECT * FROM bt JOIN pm USING (method, questionnaire, iteration) JOIN f USING (method, questionnaire, iteration))"
_SDK = ["method", "questionnaire", "iteration"]


def _sd_tests(spark, sf_dir) -> DataFrame:
    c = cells(spark, sf_dir)
    k = lambda n: F.when(F.col("k") == n, F.col("score"))
    q = ranking.quantiles(c, [*_SDK, "k"], "score", {"q1": 0.25, "q3": 0.75})
    width = q.groupBy(*_SDK).agg(*(F.max(F.when(F.col("k") == n, F.col("q3") - F.col("q1"))).alias(f"iqr{n}") for n in (0, 5)))
    spread = c.groupBy(*_SDK).agg(*(F.stddev_samp(k(n)).alias(f"sd{n}") for n in (0, 5))).join(width, _SDK)
    both = hypothesis.pitman_morgan(paired.deltas(c, _SDK, _k(0), _k(5)), _SDK).select(*_SDK, "n", F.when(F.col("n") >= 3, F.col("r")).alias("r"))
    return spread.join(both, _SDK).join(hypothesis.levene(c.withColumnRenamed("k", "side"), _SDK, "side").select(*_SDK, "f"), _SDK)


@query(_SD + " SELECT method, questionnaire, iteration, n, " + sql6("sd5/nullif(sd0,0) AS sd_ratio", "iqr0", "iqr5", "f", "r", "CASE WHEN 1-r*r>1e-6 THEN r*sqrt((n-2)/(1-r*r)) END AS t") + " FROM sd")
def sd_tests(spark, sf_dir):
    """Spread of both sides, Brown-Forsythe F and the Pitman-Morgan correlation with its t: null under three pairs, t also next to |r| = 1."""
    s = _sd_tests(spark, sf_dir)
    rest = 1 - F.col("r") * F.col("r")
    t = F.when(rest > 1e-6, F.col("r") * F.sqrt((F.col("n") - 2) / rest))
    return s.select(*_SDK, "n", *r6("iqr0", "iqr5", "f", "r", sd_ratio=ratio("sd5", "sd0"), t=t))


@query(_SD + " SELECT method, questionnaire, count(*) AS n_iters, count(*) FILTER (sd5<sd0) AS n_k5_lower, count(*) FILTER (sd5>sd0) AS n_k5_higher, " + sql6("quantile_cont(sd5/nullif(sd0,0),0.5) AS median_ratio") + " FROM sd GROUP BY ALL")
def sd_tally(spark, sf_dir):
    g = _sd_tests(spark, sf_dir).groupBy("method", "questionnaire").agg(F.count(F.lit(1)).alias("n_iters"), F.count_if(F.col("sd5") < F.col("sd0")).alias("n_k5_lower"), F.count_if(F.col("sd5") > F.col("sd0")).alias("n_k5_higher"), F.percentile(ratio("sd5", "sd0"), 0.5).alias("median_ratio"))
    return g.select("method", "questionnaire", "n_iters", "n_k5_lower", "n_k5_higher", *r6("median_ratio"))


@query(S + ", g AS (SELECT arm, questionnaire, iteration, avg(score) AS m, stddev_samp(score) AS sd FROM c GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY arm, questionnaire ORDER BY m) AS rm, rank() OVER (PARTITION BY arm, questionnaire ORDER BY sd) AS rs, row_number() OVER (PARTITION BY arm, questionnaire ORDER BY sd, iteration) AS i1, row_number() OVER (PARTITION BY arm, questionnaire ORDER BY m DESC, iteration) AS i2 FROM g) SELECT arm, questionnaire, max(iteration) FILTER (i1=1) AS least_sd_iter, max(iteration) FILTER (i2=1) AS best_iter, " + sql6("min(sd) AS least_sd", "CASE WHEN stddev_pop(rm)*stddev_pop(rs)>0 THEN corr(rm,rs) END AS rho") + " FROM r GROUP BY ALL")
def sd_summary(spark, sf_dir):
    """Where spread is least and the mean best, and how the two go together over the iterations."""
    by = ["arm", "questionnaire"]
    g = cells(spark, sf_dir).groupBy(*by, "iteration").agg(F.avg("score").alias("m"), F.stddev_samp("score").alias("sd"))
    at = g.groupBy(*by).agg(F.min_by("iteration", F.struct("sd", "iteration")).alias("least_sd_iter"), F.min_by("iteration", F.struct((-F.col("m")).alias("m"), F.col("iteration"))).alias("best_iter"), F.min("sd").alias("least_sd"))
    return at.join(hypothesis.spearman(g, by, "m", "sd").select(*by, "rho"), by).select(*by, "least_sd_iter", "best_iter", *r6("least_sd", "rho"))


@query(S + ", lx AS (SELECT *, max(iteration) OVER (PARTITION BY arm) AS la FROM c), x AS (SELECT lx.*, u.c_mktsegment AS stratum FROM lx JOIN customer u ON u.c_custkey=lx.persona_id) SELECT arm, stratum, count(*) FILTER (iteration=0) AS n_base, count(*) FILTER (iteration=la) AS n_end, " + sql6("avg(score) FILTER (iteration=0) AS base", "avg(score) FILTER (iteration=la) AS final", "stddev_samp(score) FILTER (iteration=la) AS sd_end", "avg((score>=45)::INT) FILTER (iteration=la) AS high_end") + " FROM x GROUP BY ALL")
def ceiling_endpoints(spark, sf_dir):
    """Base and end of an arm by stratum, with the share near the top of the scale."""
    c = cells(spark, sf_dir)
    c = c.join(paired.final_iteration(c, ["arm"]).withColumnRenamed("iteration", "la"), "arm").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("persona_id"), F.col("c_mktsegment").alias("stratum")), "persona_id")
    at = lambda cond, v: F.when(cond, v)
    base, end = F.col("iteration") == 0, F.col("iteration") == F.col("la")
    g = c.groupBy("arm", "stratum").agg(
        F.count_if(base).alias("n_base"), F.count_if(end).alias("n_end"), F.avg(at(base, F.col("score"))).alias("base"), F.avg(at(end, F.col("score"))).alias("final"),
        F.stddev_samp(at(end, F.col("score"))).alias("sd_end"), F.avg(at(end, (F.col("score") >= 45).cast("int"))).alias("high_end"))
    return g.select("arm", "stratum", "n_base", "n_end", *r6("base", "final", "sd_end", "high_end"))


# --- two generations of graders ---------------------------------------------------------------------------------------

_XL = S + ", x AS (SELECT judge, method, k, iteration, persona_id, avg(score) AS score FROM j GROUP BY ALL)"


def _final(spark, sf_dir) -> DataFrame:
    """judge, method, k, iteration, persona_id: the mean of a conversation's rubrics."""
    return paired.means(cells(spark, sf_dir, "judge"), ["judge", "method", "k", "iteration", "persona_id"])


@query(_XL + _contrast_sql("judge, method, iteration", _pairs_sql("judge, method, iteration", "k=0", "k=5", "x")) + _holm_sql("ct", "judge, method", "iteration") + f", wl AS (SELECT judge, method, iteration, avg(score) FILTER (k=0)-avg(score) FILTER (k=5) AS delta, var_samp(score) FILTER (k=0)/count(*) FILTER (k=0)+var_samp(score) FILTER (k=5)/count(*) FILTER (k=5) AS v FROM x GROUP BY ALL) SELECT judge, method, iteration, n, n_nonzero, {_P6}, " + sql6("delta/nullif(sqrt(v),0) AS welch_t") + " FROM hm JOIN wl USING (judge, method, iteration)")
def k_contrast_table(spark, sf_dir):
    """Paired and unpaired contrast by iteration under either grader."""
    x, by = _final(spark, sf_dir), ["judge", "method", "iteration"]
    out = paired.holm(paired.contrast(x, by, _k(0), _k(5)), by[:2], tiebreak=["iteration"]).join(hypothesis.welch(x, by, _k(0)).select(*by, "t"), by)
    return out.select(*by, "n", "n_nonzero", *r6(*_R6, welch_t=F.col("t")))


@query(_XL + ", y AS (SELECT *, method||k AS arm FROM x), b AS (SELECT judge, arm, persona_id, score AS base FROM y WHERE iteration=0), d AS (SELECT y.judge, y.arm, y.iteration, y.persona_id, y.score AS a, base AS b, y.score-base AS d FROM y JOIN b USING (judge, arm, persona_id) WHERE y.iteration>0)" + _contrast_sql("judge, arm, iteration", "SELECT * FROM d") + _holm_sql("ct", "judge, arm", "iteration") + f"SELECT judge, arm, iteration, n, n_nonzero, {_P6} FROM hm")
def vs_base_table(spark, sf_dir):
    x = _final(spark, sf_dir).withColumn("arm", F.concat("method", "k"))
    return paired.holm(paired.vs_base(x, ["judge", "arm"]), ["judge", "arm"], tiebreak=["iteration"]).select("judge", "arm", "iteration", "n", "n_nonzero", *r6(*_R6))


@query(_XL + ", pl AS (SELECT judge, method, k, persona_id, avg(score) AS score FROM x WHERE iteration>0 GROUP BY ALL)" + _contrast_sql("judge, method", _pairs_sql("judge, method", "k=0", "k=5", "pl")) + f"SELECT judge, method, n, n_nonzero, {sql6('mean_a', 'mean_b', 'mean_delta', 'dz', 'w', 'z', 'p')} FROM ct")
def pooled_arm_contrast(spark, sf_dir):
    """The mean of a persona over all trained iterations, then the pair."""
    pooled = paired.means(_final(spark, sf_dir).where("iteration > 0"), ["judge", "method", "k", "persona_id"])
    return paired.contrast(pooled, ["judge", "method"], _k(0), _k(5)).select("judge", "method", "n", "n_nonzero", *r6("mean_a", "mean_b", "mean_delta", "dz", "w", "z", "p"))


@query(_XL + ", l AS (SELECT judge, method, k, iteration, count(*) AS n, avg(score) AS m, stddev_samp(score) AS sd FROM x GROUP BY ALL), a AS (SELECT * FROM l WHERE judge=0), b AS (SELECT * FROM l WHERE judge=1) SELECT coalesce(a.method,b.method) AS method, coalesce(a.k,b.k) AS k, coalesce(a.iteration,b.iteration) AS iteration, a.n AS n_old, b.n AS n_new, " + sql6("a.m AS mean_old", "b.m AS mean_new", "a.sd AS sd_old", "b.sd AS sd_new") + " FROM a FULL JOIN b ON a.method=b.method AND a.k=b.k AND a.iteration=b.iteration")
def grader_levels(spark, sf_dir):
    """Levels of a state under both graders, whichever has it."""
    l = _final(spark, sf_dir).groupBy("judge", "method", "k", "iteration").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"))
    keys = ["method", "k", "iteration"]
    side = lambda j, name: l.where(F.col("judge") == j).select(*keys, *(F.col(c).alias(f"{c}_{name}") for c in ("n", "mean", "sd")))
    both = side(0, "old").join(side(1, "new"), keys, "full_outer")
    return both.select(*keys, "n_old", "n_new", *r6("mean_old", "mean_new", "sd_old", "sd_new"))


@query(_XL + """, l AS (SELECT judge, method, k, iteration, avg(score) AS m FROM x GROUP BY ALL), a AS (SELECT * FROM l WHERE k=0 AND iteration>0), b AS (SELECT * FROM l WHERE k=5 AND iteration>0),
cr AS (SELECT a.judge, a.method, count(*) AS n_pairs, count(*) FILTER (b.m>a.m) AS n_k5_higher, count(*) FILTER (a.iteration=b.iteration) AS n_matched, count(*) FILTER (a.iteration=b.iteration AND b.m>a.m) AS n_matched_k5_higher, min(b.m)>max(a.m) AS separated FROM a JOIN b USING (judge, method) GROUP BY ALL),
bs AS (SELECT judge, method, avg(m) AS base FROM l WHERE iteration=0 GROUP BY ALL), vb AS (SELECT l.judge, l.method, count(*) AS n_trained, count(*) FILTER (m>base) AS n_above_base FROM l JOIN bs USING (judge, method) WHERE iteration>0 GROUP BY ALL) SELECT * FROM cr JOIN vb USING (judge, method)""")
def ordering_claims(spark, sf_dir):
    """How often states of one look-ahead lie above those of the other, and above base."""
    l = _final(spark, sf_dir).groupBy("judge", "method", "k", "iteration").agg(F.avg("score").alias("m"))
    by = ["judge", "method"]
    trained = l.where("iteration > 0")
    a = trained.where("k = 0").select(*by, F.col("iteration").alias("ia"), F.col("m").alias("ma"))
    b = trained.where("k = 5").select(*by, F.col("iteration").alias("ib"), F.col("m").alias("mb"))
    up, same = F.col("mb") > F.col("ma"), F.col("ia") == F.col("ib")
    crossed = a.join(b, by).groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(up).alias("n_k5_higher"), F.count_if(same).alias("n_matched"), F.count_if(same & up).alias("n_matched_k5_higher"), (F.min("mb") > F.max("ma")).alias("separated"))
    base = l.where("iteration = 0").groupBy(*by).agg(F.avg("m").alias("base"))
    above = trained.join(base, by).groupBy(*by).agg(F.count(F.lit(1)).alias("n_trained"), F.count_if(F.col("m") > F.col("base")).alias("n_above_base"))
    return crossed.join(above, by)


@query(_XL + ", y AS (SELECT method, k, iteration, persona_id, max(score) FILTER (judge=0) AS p, max(score) FILTER (judge=1) AS h FROM x GROUP BY ALL), ok AS (SELECT * FROM y WHERE p IS NOT NULL AND h IS NOT NULL), lv AS (SELECT method, k, iteration, avg(p) AS p, avg(h) AS h FROM ok GROUP BY ALL), rr AS (SELECT 'level' AS basis, p, h FROM lv UNION ALL SELECT 'conversation', p, h FROM ok), rk AS (SELECT *, rank() OVER (PARTITION BY basis ORDER BY p)+(count(*) OVER (PARTITION BY basis,p)-1)/2.0 AS a, rank() OVER (PARTITION BY basis ORDER BY h)+(count(*) OVER (PARTITION BY basis,h)-1)/2.0 AS b FROM rr) SELECT basis, count(*) AS n, " + sql6("corr(p,h) AS pearson", "corr(a,b) AS spearman", "avg(h-p) AS bias") + " FROM rk GROUP BY ALL")
def grader_agreement(spark, sf_dir):
    """Agreement of the graders on states and on conversations."""
    x = _final(spark, sf_dir)
    side = lambda j: F.max(F.when(F.col("judge") == j, F.col("score")))
    both = x.groupBy("method", "k", "iteration", "persona_id").agg(side(0).alias("p"), side(1).alias("h")).where("p IS NOT NULL AND h IS NOT NULL")
    levels = both.groupBy("method", "k", "iteration").agg(F.avg("p").alias("p"), F.avg("h").alias("h"))
    rows = levels.select(F.lit("level").alias("basis"), "p", "h").unionByName(both.select(F.lit("conversation").alias("basis"), "p", "h"))
    return reliability.agreement(rows, ["basis"]).select("basis", "n", *r6("pearson", "spearman", "bias"))


@query(_XL + ", t1 AS (SELECT method, k, iteration, avg(score) AS published FROM x WHERE judge=0 GROUP BY ALL), re AS (SELECT method, k, iteration, sum(score)/count(*) AS again FROM x WHERE judge=0 GROUP BY ALL) SELECT count(*) AS n, " + sql6("max(abs(published-again)) AS largest_gap") + ", max(abs(published-again))<=0.005 AS equal FROM t1 JOIN re USING (method, k, iteration)")
def table1_crosscheck(spark, sf_dir):
    """A printed table against the same numbers from rows."""
    keys = ["method", "k", "iteration"]
    x = _final(spark, sf_dir).where("judge = 0")
    return reshape.largest_gap(x.groupBy(*keys).agg(F.avg("score").alias("x")), x.groupBy(*keys).agg(ratio(F.sum("score"), F.count("score")).alias("y")), keys, 0.005).select("n", *r6("largest_gap"), "equal")


@query("WITH e AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS a, count(DISTINCT o_orderpriority) AS b FROM orders GROUP BY ALL) SELECT count(*) AS n_personas, count(*) FILTER (a<=1 AND b<=1) AS n_aligned FROM e")
def persona_alignment_check(spark, sf_dir):
    """Personas whose stated traits have at most one value."""
    return reshape.aligned(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"])


@query("SELECT count(DISTINCT conv_id) AS n_convs, sum(length(text)+14)::BIGINT AS chars, " + sql6("(2*sum(length(text)+14)/4.0 + 2*count(DISTINCT conv_id)*1500)/1e6*0.5 + 2*count(DISTINCT conv_id)*180/1e6*1.5 AS usd") + " FROM conversations WHERE role IN ('user','assistant') AND text IS NOT NULL")
def regrade_cost_estimate(spark, sf_dir):
    """What two rubrics on every transcript would cost: labelled characters over four, a fixed prefix, 180 tokens back."""
    t = table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant') AND text IS NOT NULL")
    g = t.agg(F.count_distinct("conv_id").alias("n_convs"), F.sum(F.length("text") + 14).alias("chars"))
    usd = (2 * F.col("chars") / 4.0 + 2 * F.col("n_convs") * 1500) / 1e6 * 0.5 + 2 * F.col("n_convs") * 180 / 1e6 * 1.5
    return g.select("n_convs", "chars", *r6(usd=usd))


@query(S + "SELECT method, k, questionnaire, " + sql6("avg(score) AS mean") + ", count(*) AS n FROM c WHERE iteration=3 GROUP BY ALL")
def sweep_means(spark, sf_dir):
    g = cells(spark, sf_dir).where("iteration = 3").groupBy("method", "k", "questionnaire").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))
    return g.select("method", "k", "questionnaire", *r6("mean"), "n")


_SIGN = S + _contrast_sql("questionnaire, iteration", _pairs_sql("questionnaire, iteration", "k=0", "k=5"))


@query(_SIGN + f"SELECT questionnaire, iteration, {sql6('mean_delta', 'dz')}, {_EFFECT} AS effect, CASE WHEN p<0.001 THEN '***' WHEN p<0.01 THEN '**' WHEN p<0.05 THEN '*' ELSE '' END AS sig, CASE WHEN mean_delta IS NULL THEN NULL WHEN mean_delta=0 THEN 'tie' WHEN (mean_delta>0) = (questionnaire<>'error') THEN 'K0' ELSE 'K5' END AS winner FROM ct")
def favoured_sides(spark, sf_dir):
    """Labels of a contrast: size, stars, and which side it speaks for; lower is better on one rubric."""
    from ..functions.expr import effect_label

    out = paired.contrast(cells(spark, sf_dir), ["questionnaire", "iteration"], _k(0), _k(5))
    return out.select("questionnaire", "iteration", *r6("mean_delta", "dz"), effect_label("dz").alias("effect"), stars("p").alias("sig"), favours("mean_delta", F.col("questionnaire") == "error", "K0", "K5").alias("winner"))
