"""Queries of independent groups: selection by own metric, normality, posts-hoc, comparisons with a baseline and of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio
from ..functions.distributions import normal_quantile, shapiro_p, shapiro_w, studentised_range_p, upper_tail
from ..operators import hypothesis, paired, reshape
from .scores import _k
from .views import S, cells, p_sql, query, r6, sql6

_MOD = S + ", md AS (SELECT *, arm||'_I'||iteration AS model FROM c)"


def _models(spark, sf_dir) -> DataFrame:
    return cells(spark, sf_dir).withColumn("model", F.concat("arm", F.lit("_I"), "iteration"))


@query(_MOD + ", g AS (SELECT arm, model, iteration, avg(score) AS m, stddev_samp(score) AS sd FROM md WHERE questionnaire='click' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY round(m,9) DESC, round(sd,9), iteration) AS rk FROM g) SELECT arm, model, iteration, " + sql6("m AS mean", "sd") + " FROM r WHERE rk=1")
def best_models_per_experiment(spark, sf_dir):
    """The best model of an arm by mean, then the smaller spread, then the earlier iteration."""
    g = _models(spark, sf_dir).where("questionnaire = 'click'").groupBy("arm", "model", "iteration").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"))
    top = reshape.top_per_group(g, ["arm"], [F.round("mean", 9).desc(), F.round("sd", 9), F.col("iteration")], 1)
    return top.select("arm", "model", "iteration", *r6("mean", "sd"))


_OWN = _MOD + ", ow AS (SELECT unnest(['A_K0','A_K5','B_K0','B_K5']) AS arm, unnest(['click','view','purchase','error']) AS questionnaire), og AS (SELECT arm, questionnaire, model, iteration, avg(score) AS m FROM md SEMI JOIN ow USING (arm, questionnaire) GROUP BY ALL), ob AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY round(m,9) DESC, iteration) AS rk FROM og) WHERE rk=1)"


def _own_best(spark, sf_dir) -> DataFrame:
    own = spark.createDataFrame([("A_K0", "click"), ("A_K5", "view"), ("B_K0", "purchase"), ("B_K5", "error")], "arm string, questionnaire string")
    g = _models(spark, sf_dir).join(F.broadcast(own), ["arm", "questionnaire"], "left_semi").groupBy("arm", "questionnaire", "model", "iteration").agg(F.avg("score").alias("mean"))
    return reshape.top_per_group(g, ["arm"], [F.round("mean", 9).desc(), F.col("iteration")], 1)


@query(_OWN + " SELECT arm, questionnaire, model, " + sql6("m AS mean") + " FROM ob")
def best_models_by_own_metric(spark, sf_dir):
    return _own_best(spark, sf_dir).select("arm", "questionnaire", "model", *r6("mean"))


@query(_OWN + " SELECT model, questionnaire, count(*) AS n, " + sql6("avg(score) AS mean") + " FROM md WHERE iteration=0 OR model IN (SELECT model FROM ob) GROUP BY ALL")
def filter_to_models(spark, sf_dir):
    """Rows of the chosen models and of the baseline."""
    kept = reshape.keep_base_and(_models(spark, sf_dir), _own_best(spark, sf_dir), ["model"])
    return kept.groupBy("model", "questionnaire").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean")).select("model", "questionnaire", "n", *r6("mean"))


@query(_OWN + " SELECT md.model, md.questionnaire, count(*) AS n FROM md LEFT JOIN ob ON ob.model=md.model AND ob.questionnaire=md.questionnaire WHERE md.iteration=0 OR ob.model IS NOT NULL GROUP BY ALL")
def filter_to_best_per_metric(spark, sf_dir):
    """A set of models of its own for each metric."""
    kept = reshape.keep_base_and(_models(spark, sf_dir), _own_best(spark, sf_dir), ["model", "questionnaire"])
    return kept.groupBy("model", "questionnaire").agg(F.count(F.lit(1)).alias("n"))


_MOM = "count(*) AS n, avg(score) AS m, var_pop(score) AS v"


@query(S + ", g AS (SELECT questionnaire, arm, avg(score) AS m, count(*) AS n FROM c GROUP BY ALL), x AS (SELECT c.questionnaire, c.arm, g.n, avg(power(score-m,2)) AS m2, avg(power(score-m,3)) AS m3, avg(power(score-m,4)) AS m4 FROM c JOIN g USING (questionnaire, arm) GROUP BY ALL), y AS (SELECT *, m3/nullif(power(m2,1.5),0) AS skew, m4/nullif(m2*m2,0)-3 AS kurt FROM x) SELECT questionnaire, arm, n, " + sql6("skew", "kurt", "n/6.0*(skew*skew+kurt*kurt/4) AS jb", "exp(-n/12.0*(skew*skew+kurt*kurt/4)) AS p") + ", exp(-n/12.0*(skew*skew+kurt*kurt/4))>0.05 AS normal FROM y")
def normality(spark, sf_dir):
    """Jarque-Bera by group: skewness and excess of a normal sample are near zero; its chi-square of two degrees has a closed p."""
    return hypothesis.jarque_bera(cells(spark, sf_dir), ["questionnaire", "arm"]).select("questionnaire", "arm", "n", *r6("skew", "kurt", "jb", "p"), (F.col("p") > 0.05).alias("normal"))


_AN = ", g AS (SELECT questionnaire, arm, " + _MOM + " FROM c GROUP BY ALL), e AS (SELECT questionnaire, sum(n) AS nn, count(*) AS k, sum(n*v) AS w FROM g GROUP BY ALL)"


@query(S + _AN + " SELECT a.questionnaire, a.arm AS arm_a, b.arm AS arm_b, " + sql6("a.m-b.m AS diff", "abs(a.m-b.m)/sqrt(w/(nn-k)/2*(1.0/a.n+1.0/b.n)) AS q") + " FROM g a JOIN g b ON a.questionnaire=b.questionnaire AND a.arm<b.arm JOIN e ON e.questionnaire=a.questionnaire")
def anova_posthoc(spark, sf_dir):
    """Tukey-Kramer studentised range of every pair of groups; the statistic, as its p has no closed form."""
    return hypothesis.tukey_kramer(cells(spark, sf_dir), ["questionnaire"], "arm").select("questionnaire", F.col("a").alias("arm_a"), F.col("b").alias("arm_b"), *r6("diff", "q"))


_TK = S + _AN + ", pr AS (SELECT a.questionnaire, a.arm AS arm_a, b.arm AS arm_b, k, (nn-k)::DOUBLE AS df, a.m-b.m AS diff, abs(a.m-b.m)/sqrt(w/(nn-k)/2*(1.0/a.n+1.0/b.n)) AS q FROM g a JOIN g b ON a.questionnaire=b.questionnaire AND a.arm<b.arm JOIN e ON e.questionnaire=a.questionnaire), sc AS (SELECT *, exp((-20.0+0.25*j)/sqrt(2*df)) AS s, (-20.0+0.25*j)/sqrt(2*df) AS l FROM pr, (SELECT unnest(range(113)) AS j)), zn AS (SELECT *, -8.0+0.25*i AS z, -8.0+0.25*i-q*s AS y FROM sc, (SELECT unnest(range(65)) AS i)), rg AS (SELECT questionnaire, arm_a, arm_b, j, any_value(exp(df*(l-s*s/2+0.5))) AS wt, any_value(k)*0.25/sqrt(2*pi())*sum(exp(-z*z/2)*power(greatest((" + upper_tail("y") + ")-(" + upper_tail("z") + "),0.0),k-1)) AS pr FROM zn GROUP BY ALL), tp AS (SELECT questionnaire, arm_a, arm_b, greatest(0.0,least(1.0,1-sum(wt*pr)/sum(wt))) AS p FROM rg GROUP BY ALL)"


@query(_TK + " SELECT questionnaire, arm_a, arm_b, k, df::BIGINT AS df, " + sql6("diff", "q", "p") + ", p<0.05 AS differs FROM pr JOIN tp USING (questionnaire, arm_a, arm_b)")
def tukey_hsd(spark, sf_dir):
    """Every pair of groups with the p of its studentised range."""
    t = hypothesis.tukey_kramer(cells(spark, sf_dir), ["questionnaire"], "arm")
    t = t.withColumn("p", studentised_range_p(F.col("q"), F.col("k"), F.col("df").cast("double")))
    return t.select("questionnaire", F.col("a").alias("arm_a"), F.col("b").alias("arm_b"), "k", "df", *r6("diff", "q", "p"), (F.col("p") < 0.05).alias("differs"))


_SWT = shapiro_w()
_SW = S + ", sz AS (SELECT questionnaire, arm, count(*)::DOUBLE AS n, avg(score) AS m, var_pop(score)*count(*) AS ss FROM c GROUP BY ALL), od AS (SELECT c.questionnaire, c.arm, n, ss, score-m AS x, row_number() OVER (PARTITION BY c.questionnaire, c.arm ORDER BY score)::DOUBLE AS i FROM c JOIN sz USING (questionnaire, arm)), ps AS (SELECT *, " + normal_quantile("((i-0.375)/(n+0.25))") + " AS s FROM od), sm AS (SELECT questionnaire, arm, n, ss, sum(s*s) AS mm, coalesce(sum(s*x) FILTER (NOT (i=1 OR i=n OR (n>5 AND (i=2 OR i=n-1)))),0) AS mid, max(s) FILTER (i=1) AS m1, max(s) FILTER (i=2) AS m2, max(x) FILTER (i=1) AS x1, max(x) FILTER (i=2) AS x2, max(x) FILTER (i=n) AS y1, max(x) FILTER (i=n-1) AS y2 FROM ps WHERE n>=3 GROUP BY ALL)"
for _i, (_name, _text) in enumerate(_SWT.items()):
    _SW += f", sw{_i} AS (SELECT *, {_text} AS {_name} FROM {f'sw{_i - 1}' if _i else 'sm'})"
_SW += f", sp AS (SELECT questionnaire, arm, n::BIGINT AS n, w, {shapiro_p()} AS p FROM sw{len(_SWT) - 1})"


@query(_SW + " SELECT questionnaire, arm, n, " + sql6("w", "p") + ", p>0.05 AS normal FROM sp")
def shapiro_wilk(spark, sf_dir):
    """Shapiro-Wilk by group."""
    g = hypothesis.shapiro_wilk(cells(spark, sf_dir), ["questionnaire", "arm"])
    return g.select("questionnaire", "arm", "n", *r6("w", "p"), (F.col("p") > 0.05).alias("normal"))


def _mw_sql(by: str, source: str) -> str:
    """CTEs to mw (by, n1, n2, u, z, p) of rows (by, side, score) of `source`; side 1 against side 0."""
    return f""", mr AS (SELECT {by}, side, rank() OVER (PARTITION BY {by} ORDER BY score)+(count(*) OVER (PARTITION BY {by}, score)-1)/2.0 AS rk, count(*) OVER (PARTITION BY {by}, score)::DOUBLE AS t FROM {source}),
mm AS (SELECT {by}, count(*) FILTER (side=1)::DOUBLE AS n1, count(*) FILTER (side=0)::DOUBLE AS n2, sum(CASE WHEN side=1 THEN rk ELSE 0 END) AS r1, sum(t*t-1) AS ti FROM mr GROUP BY {by}),
mu AS (SELECT *, r1-n1*(n1+1)/2 AS u, n1*n2/12*((n1+n2+1)-ti/nullif((n1+n2)*(n1+n2-1),0)) AS va FROM mm),
mz AS (SELECT *, (u-n1*n2/2)/nullif(sqrt(va),0) AS z FROM mu), mw AS (SELECT *, {p_sql('z')} AS p FROM mz)"""


_PAIRROWS = S + ", ar AS (SELECT DISTINCT arm FROM c), pa AS (SELECT a.arm AS arm_a, b.arm AS arm_b FROM ar a JOIN ar b ON a.arm<b.arm), pr AS (SELECT questionnaire, arm_a, arm_b, (c.arm=arm_a)::INT AS side, score FROM c JOIN pa ON c.arm=arm_a OR c.arm=arm_b)" + _mw_sql("questionnaire, arm_a, arm_b", "pr")


def _pair_rows(spark, sf_dir) -> DataFrame:
    """Every row once for each pair of arms that it belongs to; arms are a short list."""
    return hypothesis.pair_rows(cells(spark, sf_dir), "arm")


@query(_PAIRROWS + " SELECT questionnaire, arm_a, arm_b, n1::BIGINT AS n1, n2::BIGINT AS n2, " + sql6("u", "z", "p", "least(1.0, p*6) AS p_bonferroni") + " FROM mw")
def kruskal_posthoc(spark, sf_dir):
    """Mann-Whitney of every pair of groups, Bonferroni over the pairs."""
    by = ["questionnaire", "arm_a", "arm_b"]
    out = hypothesis.mann_whitney(_pair_rows(spark, sf_dir), by, F.col("side") == 1)
    n = F.count("p").over(Window.partitionBy("questionnaire"))
    return out.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col("p") * n)).select(*by, "n1", "n2", *r6("u", "z", "p", "p_bonferroni"))


_BH = ", {n}0 AS (SELECT *, count(p) OVER (PARTITION BY {f}) AS m, row_number() OVER (PARTITION BY {f}, p IS NULL ORDER BY p, {t}) AS rn FROM {s}), {n} AS (SELECT *, CASE WHEN p IS NOT NULL THEN min(least(1.0,p*m/rn)) OVER (PARTITION BY {f}, p IS NULL ORDER BY p, {t} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS q FROM {n}0)"


@query(_PAIRROWS + _BH.format(n="bh", f="questionnaire", t="arm_a, arm_b", s="mw") + " SELECT questionnaire, arm_a, arm_b, " + sql6("z", "p", "q") + " FROM bh WHERE q<0.5")
def compare_all_pairwise(spark, sf_dir):
    """All pairs, those below a false-discovery rate kept."""
    out = hypothesis.mann_whitney(_pair_rows(spark, sf_dir), ["questionnaire", "arm_a", "arm_b"], F.col("side") == 1)
    return paired.benjamini_hochberg(out, ["questionnaire"], tiebreak=["arm_a", "arm_b"]).where("q < 0.5").select("questionnaire", "arm_a", "arm_b", *r6("z", "p", "q"))


_BASE = S + ", pr AS (SELECT questionnaire, arm, iteration, 1 AS side, score FROM c WHERE iteration>0 UNION ALL SELECT b.questionnaire, b.arm, i.iteration, 0, score FROM c b JOIN (SELECT DISTINCT arm, iteration FROM c WHERE iteration>0) i ON i.arm=b.arm WHERE b.iteration=0)" + _mw_sql("questionnaire, arm, iteration", "pr")


@query(_BASE + ", ef AS (SELECT questionnaire, arm, iteration, (avg(score) FILTER (side=1)-avg(score) FILTER (side=0))/nullif(sqrt(((count(*) FILTER (side=1)-1)*var_pop(score) FILTER (side=1)+(count(*) FILTER (side=0)-1)*var_pop(score) FILTER (side=0))/(count(*)-2)),0) AS d FROM pr GROUP BY ALL)" + _BH.format(n="bh", f="questionnaire", t="arm, iteration", s="mw") + " SELECT questionnaire, arm, iteration, " + sql6("u", "z", "p", "q", "d") + " FROM bh JOIN ef USING (questionnaire, arm, iteration)")
def compare_all_vs_baseline(spark, sf_dir):
    """Every trained iteration against the base of its arm: Mann-Whitney, false-discovery q and Cohen's d."""
    c = cells(spark, sf_dir)
    trained = c.where("iteration > 0")
    base = c.where("iteration = 0").drop("iteration").join(trained.select("arm", "iteration").distinct(), "arm")
    rows = trained.withColumn("side", F.lit(1)).unionByName(base.withColumn("side", F.lit(0)))
    by = ["questionnaire", "arm", "iteration"]
    first = F.col("side") == 1
    out = hypothesis.mann_whitney(rows, by, first).join(hypothesis.cohens_d(rows, by, first).select(*by, "d"), by)
    return paired.benjamini_hochberg(out, ["questionnaire"], tiebreak=["arm", "iteration"]).select(*by, *r6("u", "z", "p", "q", "d"))


@query(S + ", pr AS (SELECT questionnaire, method AS grp, (k=0)::INT AS side, score FROM c UNION ALL SELECT questionnaire, 'all', (k=0)::INT, score FROM c)" + _mw_sql("questionnaire, grp", "pr") + " SELECT questionnaire, grp, n1::BIGINT AS n1, n2::BIGINT AS n2, " + sql6("u", "z", "p") + " FROM mw")
def compare_lookahead(spark, sf_dir):
    """Both look-aheads overall and within each method."""
    rows = cells(spark, sf_dir).withColumn("grp", F.explode(F.array("method", F.lit("all"))))
    return hypothesis.mann_whitney(rows, ["questionnaire", "grp"], _k(0)).select("questionnaire", "grp", "n1", "n2", *r6("u", "z", "p"))


@query(S + _AN + ", f AS (SELECT g.questionnaire, max(nn) AS n, max(e.k) AS k, max(w) AS w, sum(n*(m-gm)*(m-gm)) AS b FROM g JOIN e USING (questionnaire) JOIN (SELECT questionnaire, sum(n*m)/sum(n) AS gm FROM g GROUP BY ALL) USING (questionnaire) GROUP BY ALL), d AS (SELECT questionnaire, min(score) AS lo, max(score) AS hi, quantile_cont(score,0.5) AS med FROM c GROUP BY ALL) SELECT questionnaire, n::BIGINT AS n, " + sql6("lo", "med", "hi", "(b/(k-1))/(w/(n-k)) AS f", "b/(b+w) AS eta2") + " FROM f JOIN d USING (questionnaire)")
def stats_battery(spark, sf_dir):
    """Descriptions and the one-way test of every metric."""
    c = cells(spark, sf_dir)
    d = c.groupBy("questionnaire").agg(F.min("score").alias("lo"), F.percentile("score", 0.5).alias("med"), F.max("score").alias("hi"))
    return hypothesis.anova(c, ["questionnaire"], "arm").join(d, "questionnaire").select("questionnaire", "n", *r6("lo", "med", "hi", "f", "eta2"))


@query(S + ", w AS (SELECT arm, iteration, persona_id, avg(score) FILTER (questionnaire='click') AS q1, avg(score) FILTER (questionnaire='view') AS q2 FROM c GROUP BY ALL) SELECT arm, iteration, persona_id, " + sql6("q1", "q2", "(q1+q2)/2 AS final", "q1+q2 AS total") + " FROM w WHERE q1 IS NOT NULL AND q2 IS NOT NULL")
def merge_q1_q2(spark, sf_dir):
    """Two rubrics of a conversation joined, with the mean and total of both."""
    c = cells(spark, sf_dir)
    keys = ["arm", "iteration", "persona_id"]
    side = lambda q, n: c.where(F.col("questionnaire") == q).select(*keys, F.col("score").alias(n))
    both = side("click", "q1").join(side("view", "q2"), keys)
    return both.select(*keys, *r6("q1", "q2", final=(F.col("q1") + F.col("q2")) / 2, total=F.col("q1") + F.col("q2")))


@query(S + ", w AS (SELECT arm, iteration, persona_id, avg(score) FILTER (questionnaire='click') AS a, avg(score) FILTER (questionnaire='view') AS b, avg(score) FILTER (questionnaire='error') AS d FROM c GROUP BY ALL) SELECT arm, iteration, count(*) AS n, " + sql6("avg(a) AS click", "avg(b) AS view", "avg(d) AS error") + " FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND d IS NOT NULL GROUP BY ALL")
def merged_metrics(spark, sf_dir):
    """Several metrics of one conversation in a row, by a chain of inner joins."""
    c = cells(spark, sf_dir)
    keys, out = ["arm", "iteration", "persona_id"], None
    for q in ("click", "view", "error"):
        one = c.where(F.col("questionnaire") == q).select(*keys, F.col("score").alias(q))
        out = one if out is None else out.join(one, keys)
    g = out.groupBy("arm", "iteration").agg(F.count(F.lit(1)).alias("n"), *(F.avg(q).alias(q) for q in ("click", "view", "error")))
    return g.select("arm", "iteration", "n", *r6("click", "view", "error"))


@query(S + ", o AS (SELECT unnest(['B_K5','A_K0','B_K0','A_K5']) AS arm, unnest([1,2,3,4]) AS place) SELECT place::INT AS place, arm, count(*) AS n FROM c JOIN o USING (arm) GROUP BY ALL")
def model_order(spark, sf_dir):
    """Arms in a stated order."""
    order = spark.createDataFrame([(a, i) for i, a in enumerate(("B_K5", "A_K0", "B_K0", "A_K5"), 1)], "arm string, place int")
    return cells(spark, sf_dir).join(F.broadcast(order), "arm").groupBy("place", "arm").agg(F.count(F.lit(1)).alias("n"))
