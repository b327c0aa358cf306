"""Queries on the cost axis with outcomes: contrasts at equal budget, sweeps with intervals, graders and channels, plans and prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ratio
from ..operators import compute as cost
from ..operators import paired, ranking, resample, reshape
from .contrasts import draws_sql
from .scores import _P6, _R6, _contrast_sql, _holm_sql
from .views import C, S, cells, compute, query, r6, sql6, table

#: Cost of an arm's iteration for arms with scores: an order priority each, its months dealt to five iterations. The months of orders
#: without a priority are dealt to all four arms in turn.
ARM_COST = {"A_K0": "1-URGENT", "A_K5": "2-HIGH", "B_K0": "3-MEDIUM", "B_K5": "5-LOW"}


def costs(spark, sf_dir) -> DataFrame:
    """arm, iteration, n_steps, cost, cum_cost of the arms that have scores."""
    shared = F.get(F.array(*map(F.lit, ARM_COST)), F.col("iteration") % 4)
    name = F.coalesce(*(F.when(F.col("arm") == p, F.lit(a)) for a, p in ARM_COST.items()), shared)
    c = compute(spark, sf_dir).withColumns({"arm": name, "iteration": F.col("iteration") % 5})
    g = c.groupBy("arm", "iteration").agg(F.sum("n_steps").alias("n_steps"), F.round(F.sum("cost"), 2).alias("cost"))
    return cost.running_total(g, ["arm"], "iteration", "cost", "cum_cost")


_CO = S + ", " + C.replace("WITH m AS", "m AS", 1) + ", co0 AS (SELECT CASE arm WHEN '1-URGENT' THEN 'A_K0' WHEN '2-HIGH' THEN 'A_K5' WHEN '3-MEDIUM' THEN 'B_K0' WHEN '5-LOW' THEN 'B_K5' ELSE (['A_K0','A_K5','B_K0','B_K5'])[1+iteration%4] END AS arm, iteration%5 AS iteration, round(sum(cost),2) AS cost FROM comp GROUP BY ALL), co AS (SELECT *, sum(cost) OVER (PARTITION BY arm ORDER BY iteration) AS cum_cost FROM co0)"
_NEAR = _CO + ", nb AS (SELECT ia, ib, gap FROM (SELECT a.iteration AS ia, b.iteration AS ib, abs(a.cum_cost-b.cum_cost) AS gap, row_number() OVER (PARTITION BY a.iteration ORDER BY abs(a.cum_cost-b.cum_cost), b.iteration) AS r FROM co a, co b WHERE a.arm='A_K0' AND b.arm='A_K5') WHERE r=1)"


@query(_NEAR + ", x AS (SELECT ia, questionnaire, persona_id, score AS a FROM c JOIN nb ON ia=iteration WHERE arm='A_K0'), y AS (SELECT ia, questionnaire, persona_id, score AS b FROM c JOIN nb ON ib=iteration WHERE arm='A_K5'), pr0 AS (SELECT ia, questionnaire, persona_id, a, b, a-b AS d FROM x JOIN y USING (ia, questionnaire, persona_id))" + _contrast_sql("ia, questionnaire", "SELECT * FROM pr0") + _holm_sql("ct", "ia", "questionnaire") + f" SELECT ia AS iter_a, questionnaire, n, n_nonzero, {_P6} FROM hm")
def iso_compute_contrast(spark, sf_dir):
    """The contrast of states whose budgets are nearest, Holm over the rubrics."""
    near = cost.nearest_budget(costs(spark, sf_dir), "A_K0", "A_K5").select("iter_a", "iter_b")
    pairs = cost.pairs_at(cells(spark, sf_dir), near, "A_K0", "A_K5", ["questionnaire"])
    by = ["iter_a", "questionnaire"]
    return paired.holm(paired.of_pairs(pairs, by), ["iter_a"], tiebreak=["questionnaire"]).select(*by, "n", "n_nonzero", *r6(*_R6))


@query(_CO + ", l AS (SELECT arm, iteration, count(*) AS n, avg(score) AS mean, stddev_samp(score)/sqrt(count(*)) AS sem FROM c WHERE questionnaire='click' GROUP BY ALL) SELECT l.arm, l.iteration, n, " + sql6("mean", "sem", "cum_cost") + " FROM l LEFT JOIN co ON co.arm=l.arm AND co.iteration=l.iteration")
def score_by_cost(spark, sf_dir):
    """Levels of a rubric beside what has been spent."""
    g = cells(spark, sf_dir).where("questionnaire = 'click'").groupBy("arm", "iteration").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), (F.stddev_samp("score") / F.sqrt(F.count("score").cast("double"))).alias("sem"))
    return g.join(costs(spark, sf_dir).select("arm", "iteration", "cum_cost"), ["arm", "iteration"], "left").select("arm", "iteration", "n", *r6("mean", "sem", "cum_cost"))


_FLOOR = _CO + ", rc AS (SELECT *, CASE WHEN iteration%2=0 THEN cost*1.25 END AS recorded FROM co), fl AS (SELECT arm, iteration, cost, greatest(cost, coalesce(recorded,cost)) AS cost_floor FROM rc), fc AS (SELECT *, sum(cost_floor) OVER (PARTITION BY arm ORDER BY iteration) AS cum_floor FROM fl)"


def _floored(spark, sf_dir) -> DataFrame:
    c = costs(spark, sf_dir)
    recorded = c.where("iteration % 2 = 0").select("arm", "iteration", (F.col("cost") * 1.25).alias("recorded"))
    return cost.with_floor(c, recorded, ["arm", "iteration"])


@query(_FLOOR + " SELECT arm, iteration, " + sql6("cost", "cost_floor", "cum_floor") + " FROM fc")
def compute_with_floor(spark, sf_dir):
    """The larger of measured and recorded cost, with its own running total."""
    return _floored(spark, sf_dir).select("arm", "iteration", *r6("cost", "cost_floor", cum_floor=F.col("cum_cost_floor")))


_SUMM = _FLOOR + ", sm AS (SELECT arm, sum(cost_floor) AS total, count(*) AS n FROM fc GROUP BY ALL)"


def _floor_summary(spark, sf_dir) -> DataFrame:
    return _floored(spark, sf_dir).groupBy("arm").agg(F.sum("cost_floor").alias("total"), F.count(F.lit(1)).alias("n_iterations"))


@query(_SUMM + " SELECT arm, n AS n_iterations, " + sql6("total", "total/n AS per_iteration", "total/sum(total) OVER () AS share") + " FROM sm")
def compute_by_arm_with_floor(spark, sf_dir):
    s = _floor_summary(spark, sf_dir)
    whole = s.agg(F.sum("total").alias("whole"))
    return s.join(whole).select("arm", "n_iterations", *r6("total", per_iteration=ratio("total", "n_iterations"), share=ratio("total", "whole")))


@query(_SUMM + ", pr AS (SELECT unnest(['a_k','b_k','k0']) AS name, unnest(['A_K5','B_K5','B_K0']) AS num, unnest(['A_K0','B_K0','A_K0']) AS den) SELECT name, num, den, " + sql6("x.total AS num_total", "y.total AS den_total", "x.total/y.total AS ratio") + ", round(x.total)::BIGINT::VARCHAR || ' / ' || round(y.total)::BIGINT::VARCHAR AS arithmetic FROM pr JOIN sm x ON x.arm=num JOIN sm y ON y.arm=den")
def cost_ratios(spark, sf_dir):
    """Named ratios of totals with their arithmetic as text."""
    pairs = spark.createDataFrame([("a_k", "A_K5", "A_K0"), ("b_k", "B_K5", "B_K0"), ("k0", "B_K0", "A_K0")], "name string, num string, den string")
    return cost.cost_ratios(_floor_summary(spark, sf_dir), pairs).select("name", "num", "den", *r6("num_total", "den_total", "ratio"), "arithmetic")


# --- sweeps ------------------------------------------------------------------------------------------------------------

_JL = ", jl AS (SELECT judge, arm, questionnaire, iteration, avg(score) AS mean FROM j GROUP BY ALL), bu AS (SELECT DISTINCT cum_cost AS budget FROM co WHERE arm IN ('A_K0','A_K5'))"
_PICK = _CO + _JL + ", pk AS (SELECT judge, arm, budget, iteration, mean FROM (SELECT jl.judge, jl.arm, budget, jl.iteration, round(mean,9) AS mean, row_number() OVER (PARTITION BY jl.judge, jl.arm, budget ORDER BY round(mean,9) DESC, jl.iteration) AS r FROM jl JOIN co ON co.arm=jl.arm AND co.iteration=jl.iteration JOIN bu ON cum_cost<=budget+1e-9 WHERE questionnaire='click' AND jl.arm IN ('A_K0','A_K5')) WHERE r=1)"
_SW = _PICK + ", sel AS (SELECT a.judge AS select_judge, a.budget, a.iteration AS ia, b.iteration AS ib FROM pk a JOIN pk b ON a.judge=b.judge AND a.budget=b.budget WHERE a.arm='A_K0' AND b.arm='A_K5'), un AS (SELECT DISTINCT ia, ib FROM sel), ev AS (SELECT x.judge AS eval_judge, ia, ib, x.persona_id, x.score AS a, y.score AS b, x.score-y.score AS d FROM un JOIN j x ON x.arm='A_K0' AND x.iteration=ia AND x.questionnaire='view' JOIN j y ON y.arm='A_K5' AND y.iteration=ib AND y.questionnaire='view' AND y.persona_id=x.persona_id AND y.judge=x.judge)" + _contrast_sql("eval_judge, ia, ib", "SELECT * FROM ev") + _holm_sql("ct", "eval_judge", "ia, ib")


def _selected(spark, sf_dir) -> DataFrame:
    """select_judge, budget, iter_a, iter_b: the best iteration of either arm within each budget by one rubric and grader."""
    c = costs(spark, sf_dir)
    levels = cells(spark, sf_dir, "judge").where("questionnaire = 'click' AND arm IN ('A_K0', 'A_K5')").groupBy("judge", "arm", "iteration").agg(F.round(F.avg("score"), 9).alias("mean"))
    spent = levels.join(c.select("arm", "iteration", "cum_cost"), ["arm", "iteration"])
    budgets = c.where("arm IN ('A_K0', 'A_K5')").select(F.col("cum_cost").alias("budget")).distinct()
    best = cost.best_within(spent, budgets, ["judge", "arm"])
    side = lambda a, n: best.where(F.col("arm") == a).select(F.col("judge").alias("select_judge"), "budget", F.col("best_iter").alias(n))
    return side("A_K0", "iter_a").join(side("A_K5", "iter_b"), ["select_judge", "budget"])


def _sweep(spark, sf_dir, how: str = "inner") -> DataFrame:
    """Each selection under each grader on another rubric; Holm over the distinct pairs of iterations, not over budgets.

    With how="left" selections that a grader has no pairs for stay, without statistics.
    """
    sel = _selected(spark, sf_dir)
    unique = sel.select("iter_a", "iter_b").distinct()
    j = cells(spark, sf_dir, "judge").where("questionnaire = 'view'")
    pairs = cost.pairs_at(j, unique, "A_K0", "A_K5", ["judge"], keep=["iter_b"])
    by = ["judge", "iter_a", "iter_b"]
    out = paired.holm(paired.of_pairs(pairs, by), ["judge"], tiebreak=["iter_a", "iter_b"])
    judged = sel.withColumn("eval_judge", F.explode(F.array(F.lit(0), F.lit(1))))
    return judged.join(out.withColumnRenamed("judge", "eval_judge"), ["iter_a", "iter_b", "eval_judge"], how)


@query(_SW + f" SELECT select_judge, eval_judge, budget_ AS budget, sel.ia AS iter_a, sel.ib AS iter_b, n, n_nonzero, {_P6} FROM (SELECT select_judge, round(budget,2) AS budget_, ia, ib FROM sel) sel JOIN hm ON hm.ia=sel.ia AND hm.ib=sel.ib")
def crossjudge_sweep(spark, sf_dir):
    """Selected by one grader, judged by another, at every budget."""
    return _sweep(spark, sf_dir).select("select_judge", "eval_judge", F.round("budget", 2).alias("budget"), "iter_a", "iter_b", "n", "n_nonzero", *r6(*_R6))


@query(_SW + ", tp AS (SELECT *, row_number() OVER (PARTITION BY select_judge ORDER BY budget DESC) AS r FROM sel), lo AS (SELECT *, row_number() OVER (PARTITION BY select_judge ORDER BY budget) AS r FROM sel), t AS (SELECT select_judge, e.eval_judge, mean_delta, p_holm FROM tp CROSS JOIN (SELECT unnest([0,1]) AS eval_judge) e LEFT JOIN hm ON hm.ia=tp.ia AND hm.ib=tp.ib AND hm.eval_judge=e.eval_judge WHERE r=1), f AS (SELECT select_judge, e.eval_judge, mean_delta AS first_delta FROM lo CROSS JOIN (SELECT unnest([0,1]) AS eval_judge) e LEFT JOIN hm ON hm.ia=lo.ia AND hm.ib=lo.ib AND hm.eval_judge=e.eval_judge WHERE r=1) SELECT t.select_judge, t.eval_judge, " + sql6("mean_delta", "first_delta", "p_holm") + ", sign(mean_delta)<>sign(first_delta) AS flipped, CASE WHEN p_holm IS NULL THEN 'no test' WHEN p_holm>=0.05 THEN 'open' WHEN mean_delta>0 THEN 'A_K0' ELSE 'A_K5' END AS verdict FROM t JOIN f USING (select_judge, eval_judge)")
def crossjudge_verdicts(spark, sf_dir):
    """The largest budget of every sweep, with or without pairs to test: its verdict, and whether the sign differs from the smallest."""
    s = _sweep(spark, sf_dir, "left")
    g = s.groupBy("select_judge", "eval_judge").agg(F.max_by(F.struct("mean_delta", "p_holm"), "budget").alias("t"), F.min_by(F.struct("mean_delta"), "budget").alias("f"))
    d, p = F.col("t.mean_delta"), F.col("t.p_holm")
    verdict = F.when(p.isNull(), "no test").when(p >= 0.05, "open").when(d > 0, "A_K0").otherwise("A_K5")
    return g.select("select_judge", "eval_judge", *r6(mean_delta=d, first_delta=F.col("f.mean_delta"), p_holm=p), (F.signum(d) != F.signum("f.mean_delta")).alias("flipped"), verdict.alias("verdict"))


@query(_SW + draws_sql("dr", "ev", "eval_judge, ia, ib", "persona_id", ["d"], 250) + ", ci AS (SELECT eval_judge, ia, ib, quantile_cont(d,0.025) AS lo, quantile_cont(d,0.975) AS hi FROM dr GROUP BY ALL) SELECT select_judge, hm.eval_judge, round(budget,2) AS budget, " + sql6("-mean_delta AS k_delta", "-hi AS k_lo", "-lo AS k_hi") + " FROM sel JOIN hm ON hm.ia=sel.ia AND hm.ib=sel.ib JOIN ci ON ci.ia=sel.ia AND ci.ib=sel.ib AND ci.eval_judge=hm.eval_judge WHERE n>=3")
def budget_sweep_ci(spark, sf_dir):
    """The sweep with an interval of 2,000 draws, in the sign convention of the longer look-ahead."""
    sel = _selected(spark, sf_dir)
    j = cells(spark, sf_dir, "judge").where("questionnaire = 'view'")
    pairs = cost.pairs_at(j, sel.select("iter_a", "iter_b").distinct(), "A_K0", "A_K5", ["judge"], keep=["iter_b"])
    by = ["judge", "iter_a", "iter_b"]
    ends = resample.interval(resample.replicates(pairs, by, "persona_id", ["d"]), by, F.col("d"))
    out = sel.join(paired.of_pairs(pairs, by).join(ends, by), ["iter_a", "iter_b"]).where("n >= 3")
    return out.select("select_judge", F.col("judge").alias("eval_judge"), F.round("budget", 2).alias("budget"), *r6(k_delta=-F.col("mean_delta"), k_lo=-F.col("hi"), k_hi=-F.col("lo")))


# --- plans and prices ----------------------------------------------------------------------------------------------------

_PLAN = S + ", w AS (SELECT * FROM (SELECT DISTINCT arm, iteration FROM c), (SELECT DISTINCT questionnaire FROM c), (SELECT unnest([0,1]) AS judge), (SELECT DISTINCT persona_id FROM c)), ms AS (SELECT arm, iteration, questionnaire, judge, persona_id FROM w ANTI JOIN j USING (arm, iteration, questionnaire, judge, persona_id))"


@query(_PLAN + " SELECT judge, questionnaire, count(*) AS n_missing, count(DISTINCT persona_id) AS n_personas FROM ms GROUP BY ALL")
def plan_sweep(spark, sf_dir):
    """Cells that are wanted and not there, by grader and rubric."""
    j = cells(spark, sf_dir, "judge")
    states = j.select("arm", "iteration").distinct()
    grid = states.crossJoin(j.select("questionnaire").distinct()).crossJoin(j.select("judge").distinct())  # settings only
    left = reshape.missing(j, ["arm", "iteration", "questionnaire", "judge", "persona_id"], "persona_id", grid)
    return left.groupBy("judge", "questionnaire").agg(F.count(F.lit(1)).alias("n_missing"), F.count_distinct("persona_id").alias("n_personas"))


_USE = "WITH u AS (SELECT conv_id, sum(length(text))::BIGINT AS chars, count(*) AS calls FROM conversations WHERE text IS NOT NULL GROUP BY ALL), p AS (SELECT count(*) AS convs, sum(chars) AS chars, sum(calls) AS calls, avg(chars)/3.9 AS tokens_each FROM u), e AS (SELECT *, chars/3.9 AS tokens_in, calls*180.0 AS tokens_out, (chars/3.9*0.4+calls*180.0*1.6)/1e6 AS list_cost FROM p)"


def _usage(spark, sf_dir) -> DataFrame:
    u = table(spark, sf_dir, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("calls"))
    return u.agg(F.count(F.lit(1)).alias("convs"), F.sum("chars").alias("chars"), F.sum("calls").alias("calls"), (F.avg("chars") / 3.9).alias("tokens_each"))


@query(_USE + " SELECT convs, calls::BIGINT AS calls, " + sql6("tokens_each", "tokens_in", "tokens_out", "list_cost", "list_cost*0.5 AS batch_cost") + " FROM e")
def estimate_cost(spark, sf_dir):
    """Tokens from characters, and their price at list and batch rates."""
    p = cost.priced(_usage(spark, sf_dir), "chars", "calls", 3.9, 0.4, 1.6, 180.0)
    return p.select("convs", "calls", *r6("tokens_each", "tokens_in", "tokens_out", list_cost=F.col("cost"), batch_cost=F.col("cost") * 0.5))


@query(_USE + ", r AS (SELECT *, list_cost*0.37 AS observed, calls*0.4 AS observed_calls FROM e) SELECT 'estimate' AS basis, " + sql6("list_cost AS cost") + " FROM r UNION ALL SELECT 'receipt', " + sql6("observed/observed_calls*calls AS cost") + " FROM r")
def sweep_report(spark, sf_dir):
    """The estimate beside one scaled from a receipt for part of the calls."""
    p = cost.priced(_usage(spark, sf_dir), "chars", "calls", 3.9, 0.4, 1.6, 180.0)
    return cost.with_receipt(p, F.col("cost") * 0.37, F.col("calls") * 0.4).select("basis", *r6("cost"))


@query("WITH t AS (SELECT item_id, text, lead(text) OVER (ORDER BY item_id) AS nxt FROM benchmark), p AS (SELECT item_id, text, nxt, (SELECT max(n) FROM (SELECT unnest(range(0, least(length(text),length(nxt))+1)) AS n) WHERE text[1:n]=nxt[1:n]) AS shared FROM t WHERE nxt IS NOT NULL) SELECT item_id, shared::INT AS shared, " + sql6("shared/4.0 AS tokens") + " FROM p")
def prefix_report(spark, sf_dir):
    """How many characters a prompt shares with the next one by number: what a cache would save. Numbers are unique."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    placed = ranking.with_rank(items, [], "item_id", "place").withColumn("place", F.col("place").cast("long"))
    t = placed.join(placed.select((F.col("place") - 1).alias("place"), F.col("text").alias("next")), "place").where("text IS NOT NULL AND next IS NOT NULL")
    n = cost.shared_prefix(F.col("text"), F.col("next"))
    return t.select("item_id", n.alias("shared")).select("item_id", "shared", *r6(tokens=F.col("shared") / 4.0))
