"""Queries on scores: reshaping, selection, key sets, paired contrasts, tests and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import effect_label, favours, ratio, stars
from ..operators import hypothesis, paired, ranking, reshape
from .views import S, cells, p_sql, query, r6, scores_long, sql6, table

# --- shape -----------------------------------------------------------------------------------------------------------


@query(S + "SELECT arm, iteration, persona_id, questionnaire, " + sql6("score") + " FROM c")
def scores_cells(spark, sf_dir):
    return cells(spark, sf_dir).select("arm", "iteration", "persona_id", "questionnaire", *r6("score"))


@query(S + "SELECT arm, iteration, persona_id, " + sql6("avg(score) FILTER (questionnaire='click') AS click", "avg(score) FILTER (questionnaire='view') AS view", "avg(score) FILTER (questionnaire='purchase') AS purchase") + " FROM c GROUP BY ALL")
def scores_wide(spark, sf_dir):
    wide = reshape.to_wide(cells(spark, sf_dir), ["arm", "iteration", "persona_id"], "questionnaire", ["click", "view", "purchase"], "score")
    return wide.select("arm", "iteration", "persona_id", *r6("click", "view", "purchase"))


@query(S + """, w AS (SELECT arm, iteration, persona_id, avg(score) FILTER (questionnaire='click') AS click, avg(score) FILTER (questionnaire='view') AS view FROM c GROUP BY ALL)
SELECT arm, iteration, persona_id, rubric, """ + sql6("v AS score") + """ FROM (SELECT arm, iteration, persona_id, 'click' AS rubric, click AS v FROM w UNION ALL SELECT arm, iteration, persona_id, 'view', view FROM w) WHERE v IS NOT NULL""")
def scores_unpivot(spark, sf_dir):
    keys = ["arm", "iteration", "persona_id"]
    wide = reshape.to_wide(cells(spark, sf_dir), keys, "questionnaire", ["click", "view"], "score")
    return reshape.to_long(wide, keys, ["click", "view"], "rubric", "score").select(*keys, "rubric", *r6("score"))


@query(S + """, w AS (SELECT arm, iteration, persona_id, avg(score) FILTER (questionnaire='click') AS a, avg(score) FILTER (questionnaire='view') AS b FROM c GROUP BY ALL)
SELECT arm, iteration, persona_id, questionnaire, """ + sql6("score") + """ FROM c UNION ALL SELECT arm, iteration, persona_id, 'composite', """ + sql6("(a+b)/2.0 AS score") + """ FROM w WHERE a IS NOT NULL AND b IS NOT NULL""")
def q1q2_composite(spark, sf_dir):
    out = reshape.with_composite(cells(spark, sf_dir), ["arm", "iteration", "persona_id"], "questionnaire", "score", "click", "view", "composite")
    return out.select("arm", "iteration", "persona_id", "questionnaire", *r6("score"))


@query(S + """, w AS (SELECT arm, iteration, persona_id, count(*) FILTER (questionnaire='click') AS n1, count(*) FILTER (questionnaire='view') AS n2, count(*) FILTER (questionnaire='purchase') AS n3 FROM s GROUP BY ALL)
SELECT arm, iteration, """ + sql6("avg(n1::DOUBLE/nullif(n2,0)) AS ratio", "avg(n1::DOUBLE/nullif(n1+n3,0)) AS share", "avg((n1+n2)::DOUBLE/nullif(n1+n2+n3,0)) AS consistent") + " FROM w GROUP BY ALL")
def derived_ratios(spark, sf_dir):
    g = scores_long(spark, sf_dir).groupBy("arm", "iteration", "persona_id").agg(*(F.count_if(F.col("questionnaire") == q).alias(n) for q, n in (("click", "n1"), ("view", "n2"), ("purchase", "n3"))))
    n1, n2, n3 = (F.col(c) for c in ("n1", "n2", "n3"))
    return g.groupBy("arm", "iteration").agg(F.avg(ratio(n1, n2)).alias("ratio"), F.avg(ratio(n1, n1 + n3)).alias("share"), F.avg(ratio(n1 + n2, n1 + n2 + n3)).alias("consistent")).select("arm", "iteration", *r6("ratio", "share", "consistent"))


@query(S + "SELECT CASE WHEN is_base THEN 'Base' ELSE arm END AS arm, CASE WHEN is_base THEN -1 ELSE k END AS k, iteration, questionnaire, count(*) AS n, " + sql6("avg(score) AS mean") + " FROM s GROUP BY ALL")
def collapse_base(spark, sf_dir):
    s = reshape.collapse_base(scores_long(spark, sf_dir), "Base")
    return s.groupBy("arm", "k", "iteration", "questionnaire").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean")).select("arm", "k", "iteration", "questionnaire", "n", *r6("mean"))


@query(S + "SELECT c.arm, c.iteration, coalesce(u.c_mktsegment, 'none') AS stratum, count(*) AS n, " + sql6("avg(c.score) AS mean") + " FROM c LEFT JOIN customer u ON u.c_custkey = c.persona_id GROUP BY ALL")
def attach_personas(spark, sf_dir):
    traits = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("persona_id"), F.col("c_mktsegment").alias("stratum"))
    c = reshape.attach(cells(spark, sf_dir), traits, ["persona_id"], {"stratum": "none"})
    return c.groupBy("arm", "iteration", "stratum").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean")).select("arm", "iteration", "stratum", "n", *r6("mean"))


@query(S + "SELECT arm, iteration, persona_id, " + sql6("(avg(score) FILTER (questionnaire='click') + avg(score) FILTER (questionnaire='view'))/2.0 AS engage", "avg(score) AS total", "avg(score) FILTER (questionnaire IN ('purchase')) - avg(score) AS excess") + " FROM c GROUP BY ALL")
def subscale_means(spark, sf_dir):
    q = lambda n: F.avg(F.when(F.col("questionnaire") == n, F.col("score")))
    g = cells(spark, sf_dir).groupBy("arm", "iteration", "persona_id").agg(((q("click") + q("view")) / 2).alias("engage"), F.avg("score").alias("total"), (q("purchase") - F.avg("score")).alias("excess"))
    return g.select("arm", "iteration", "persona_id", *r6("engage", "total", "excess"))


# --- selection and key sets ------------------------------------------------------------------------------------------

_LEVEL = S + ", l AS (SELECT arm, iteration, questionnaire, avg(score) AS mean, count(*) AS n FROM c GROUP BY ALL)\n"


@query(_LEVEL + "SELECT arm, questionnaire, iteration, " + sql6("mean") + " FROM (SELECT *, row_number() OVER (PARTITION BY arm, questionnaire ORDER BY mean DESC, iteration) AS r FROM l) WHERE r=1")
def best_iteration_by_arm(spark, sf_dir):
    return paired.best_iteration(cells(spark, sf_dir), ["arm", "questionnaire"]).select("arm", "questionnaire", "iteration", *r6("mean"))


@query(S + "SELECT arm, max(iteration) AS iteration FROM c GROUP BY ALL")
def final_iteration_by_arm(spark, sf_dir):
    return paired.final_iteration(cells(spark, sf_dir), ["arm"])


@query(_LEVEL + """, b AS (SELECT arm, iteration FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY mean DESC, iteration) AS r FROM l WHERE questionnaire='click') WHERE r=1)
SELECT arm, iteration, questionnaire, count(*) AS n, """ + sql6("avg(score) AS mean") + " FROM c WHERE iteration=0 OR (arm, iteration) IN (SELECT (arm, iteration) FROM b) GROUP BY ALL")
def keep_base_and_best(spark, sf_dir):
    c = cells(spark, sf_dir)
    best = paired.best_iteration(c.where("questionnaire = 'click'"), ["arm"]).select("arm", "iteration")
    kept = reshape.keep_base_and(c, best, ["arm", "iteration"])
    return kept.groupBy("arm", "iteration", "questionnaire").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean")).select("arm", "iteration", "questionnaire", "n", *r6("mean"))


@query(_LEVEL + "SELECT arm, questionnaire, iteration, r AS rank, " + sql6("mean") + " FROM (SELECT *, row_number() OVER (PARTITION BY arm, questionnaire ORDER BY mean DESC, iteration) AS r FROM l) WHERE r<=2")
def top_k_groups(spark, sf_dir):
    return _ranked(spark, sf_dir, F.col("mean").desc())


@query(_LEVEL + "SELECT arm, questionnaire, iteration, r AS rank, " + sql6("mean") + " FROM (SELECT *, row_number() OVER (PARTITION BY arm, questionnaire ORDER BY mean, iteration) AS r FROM l) WHERE r<=2")
def bottom_k(spark, sf_dir):
    return _ranked(spark, sf_dir, F.col("mean").asc())


def _ranked(spark, sf_dir, order) -> DataFrame:
    level = cells(spark, sf_dir).groupBy("arm", "questionnaire", "iteration").agg(F.avg("score").alias("mean"))
    top = reshape.top_per_group(level, ["arm", "questionnaire"], [order, F.col("iteration")], 2, "rank")
    return top.select("arm", "questionnaire", "iteration", "rank", *r6("mean"))


@query(S + "SELECT arm, persona_id, count(DISTINCT iteration) AS n_iterations FROM c GROUP BY ALL HAVING count(DISTINCT iteration) < 4")
def thin_arms(spark, sf_dir):
    return reshape.thin(cells(spark, sf_dir), ["arm", "persona_id"], "iteration", 4)


@query(S + ", t AS (SELECT arm, persona_id FROM c GROUP BY ALL HAVING count(DISTINCT iteration) < 4) SELECT arm, iteration, count(*) AS n, " + sql6("avg(score) AS mean") + " FROM c WHERE (arm, persona_id) NOT IN (SELECT (arm, persona_id) FROM t) GROUP BY ALL")
def filter_thin_arms(spark, sf_dir):
    c = cells(spark, sf_dir)
    kept = c.join(reshape.thin(c, ["arm", "persona_id"], "iteration", 4), ["arm", "persona_id"], "left_anti")
    return kept.groupBy("arm", "iteration").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean")).select("arm", "iteration", "n", *r6("mean"))


@query(S + "SELECT arm, iteration, questionnaire, count(DISTINCT persona_id) AS n, " + sql6("100.0*count(DISTINCT persona_id)/150 AS pct") + ", count(DISTINCT persona_id) >= 60 AS complete FROM c GROUP BY ALL")
def coverage(spark, sf_dir):
    return reshape.coverage(cells(spark, sf_dir), ["arm", "iteration", "questionnaire"], "persona_id", 150, 60).select("arm", "iteration", "questionnaire", "n", *r6("pct"), "complete")


@query(S + ", k AS (SELECT arm, iteration, questionnaire FROM c GROUP BY ALL HAVING count(DISTINCT persona_id) >= 60) SELECT questionnaire, count(*) AS n, " + sql6("avg(score) AS mean") + " FROM c SEMI JOIN k USING (arm, iteration, questionnaire) GROUP BY ALL")
def complete_cells(spark, sf_dir):
    c = cells(spark, sf_dir)
    keys = ["arm", "iteration", "questionnaire"]
    whole = reshape.coverage(c, keys, "persona_id", 150, 60).where("complete").select(*keys)
    return c.join(whole, keys, "left_semi").groupBy("questionnaire").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean")).select("questionnaire", "n", *r6("mean"))


@query(S + ", w AS (SELECT * FROM (SELECT DISTINCT arm FROM c), (SELECT DISTINCT iteration FROM c), (SELECT DISTINCT persona_id FROM c), (SELECT DISTINCT questionnaire FROM c)) SELECT arm, iteration, count(*) AS missing FROM w ANTI JOIN c USING (arm, iteration, persona_id, questionnaire) GROUP BY ALL")
def missing_cells(spark, sf_dir):
    c = cells(spark, sf_dir)
    keys = ["arm", "iteration", "persona_id", "questionnaire"]
    return reshape.missing(c, keys, "persona_id").groupBy("arm", "iteration").agg(F.count(F.lit(1)).alias("missing"))


def _iterations(spark, sf_dir, arm) -> DataFrame:
    """(iteration, persona_id) of an arm's cells."""
    return cells(spark, sf_dir).where(F.col("arm") == arm).select("iteration", "persona_id")


_IT = S + ", a AS (SELECT iteration, persona_id FROM c WHERE arm='A_K0'), b AS (SELECT iteration, persona_id FROM c WHERE arm='A_K5') "


@query(_IT + "SELECT * FROM a INTERSECT SELECT * FROM b")
def common_iterations(spark, sf_dir):
    return _iterations(spark, sf_dir, "A_K0").intersect(_iterations(spark, sf_dir, "A_K5"))


@query(_IT + "SELECT * FROM a UNION SELECT * FROM b")
def all_iterations(spark, sf_dir):
    return _iterations(spark, sf_dir, "A_K0").union(_iterations(spark, sf_dir, "A_K5")).distinct()


@query(_IT + "SELECT * FROM a EXCEPT SELECT * FROM b")
def one_sided_iterations(spark, sf_dir):
    return _iterations(spark, sf_dir, "A_K0").subtract(_iterations(spark, sf_dir, "A_K5"))


@query(_IT + "SELECT * FROM a INTERSECT SELECT * FROM b")
def common_units(spark, sf_dir):
    return _iterations(spark, sf_dir, "A_K0").intersect(_iterations(spark, sf_dir, "A_K5"))


@query(_IT + "SELECT * FROM a UNION SELECT * FROM b")
def all_units(spark, sf_dir):
    return _iterations(spark, sf_dir, "A_K0").union(_iterations(spark, sf_dir, "A_K5")).distinct()


@query(_IT + "SELECT * FROM a EXCEPT SELECT * FROM b")
def one_sided_units(spark, sf_dir):
    return _iterations(spark, sf_dir, "A_K0").subtract(_iterations(spark, sf_dir, "A_K5"))


# --- paired contrasts ------------------------------------------------------------------------------------------------

_STAT = "count(*) AS n, CASE WHEN count(*)>=3 THEN avg(a) END AS mean_a, CASE WHEN count(*)>=3 THEN avg(b) END AS mean_b, CASE WHEN count(*)>=3 THEN avg(d) END AS mean_delta, CASE WHEN count(*)>=3 THEN avg(d)/nullif(stddev_samp(d),0) END AS dz"
_STATS = ("mean_a", "mean_b", "mean_delta", "dz")


def _pairs_sql(by: str, first: str, second: str, source: str = "c") -> str:
    return f"SELECT {by}, persona_id, a, b, a-b AS d FROM (SELECT {by}, persona_id, avg(score) FILTER ({first}) AS a, avg(score) FILTER ({second}) AS b FROM {source} GROUP BY {by}, persona_id) WHERE a IS NOT NULL AND b IS NOT NULL"


def _contrast_sql(by: str, pairs: str) -> str:
    """CTEs from `pairs`: st (summary), wx (signed ranks), ct (both with p)."""
    on = " AND ".join(f"st.{k.strip()} = wx.{k.strip()}" for k in by.split(","))
    we = " AND ".join(f"wx0.{k.strip()} = we.{k.strip()}" for k in by.split(","))
    return f""", pr AS ({pairs}), st AS (SELECT {by}, {_STAT} FROM pr GROUP BY {by}),
rk AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY round(abs(d),9)) + (count(*) OVER (PARTITION BY {by}, round(abs(d),9)) - 1)/2.0 AS r, count(*) OVER (PARTITION BY {by}, round(abs(d),9)) AS t FROM pr WHERE round(abs(d),9)<>0),
w0 AS (SELECT {by}, count(*) AS n_nonzero, sum(CASE WHEN d>0 THEN r ELSE 0 END) AS t_plus, sum(CASE WHEN d<0 THEN r ELSE 0 END) AS t_minus, count(*)*(count(*)+1)/4.0 AS mu, list(r) AS rs, max(t) AS most,
 count(*)::DOUBLE*(count(*)+1)*(2*count(*)+1)/24.0 - sum(t::DOUBLE*t-1)/48.0 AS va FROM rk GROUP BY {by}),
wd AS (SELECT 0 AS wn, [1.0::DOUBLE] || [0.0::DOUBLE for i in range(1275)] AS wf UNION ALL SELECT wn+1, [(wf[i] + CASE WHEN i>wn+1 THEN wf[i-wn-1] ELSE 0 END)/2 for i in range(1,1277)] FROM wd WHERE wn<50),
wx0 AS (SELECT *, least(t_plus,t_minus) AS w, (t_plus-mu)/nullif(sqrt(va),0) AS z FROM w0),
we AS (SELECT {by}, least(1.0, 2*avg((s<=w)::INT)) AS pe FROM (SELECT {by}, w, list_sum([CASE WHEN (m >> (i-1)) & 1 = 1 THEN rs[i] ELSE 0 END for i in range(1,n_nonzero+1)]) AS s FROM (SELECT *, unnest(range(1 << n_nonzero)) AS m FROM wx0 WHERE n_nonzero<=13)) GROUP BY {by}),
wx AS (SELECT wx0.*, pe, list_sum(wf[1:w::INT+1]) AS pt FROM wx0 LEFT JOIN we ON {we} LEFT JOIN wd ON wn=n_nonzero AND n_nonzero>13 AND most=1),
ct AS (SELECT st.*, coalesce(n_nonzero,0) AS n_nonzero, CASE WHEN n>=3 THEN w END AS w, CASE WHEN n>=3 THEN z END AS z, CASE WHEN n>=3 THEN CASE WHEN coalesce(n_nonzero,0)=0 THEN 1.0 WHEN pe IS NOT NULL THEN pe WHEN pt IS NOT NULL AND n_nonzero=n THEN least(1.0,2*pt) ELSE {p_sql('z')} END END AS p FROM st LEFT JOIN wx ON {on})
"""


def _holm_sql(source: str, family: str, tie: str, name: str = "hm") -> str:
    return f""", {name}0 AS (SELECT *, least(1.0,(count(p) OVER (PARTITION BY {family}) - row_number() OVER (PARTITION BY {family}, p IS NULL ORDER BY p, {tie}) + 1)*p) AS st FROM {source}),
{name} AS (SELECT *, CASE WHEN p IS NOT NULL THEN max(st) OVER (PARTITION BY {family}, p IS NULL ORDER BY p, {tie} ROWS UNBOUNDED PRECEDING) END AS p_holm FROM {name}0)
"""


_P6 = sql6(*_STATS, "w", "z", "p", "p_holm")
_R6 = (*_STATS, "w", "z", "p", "p_holm")
_EFFECT = "CASE WHEN dz IS NULL THEN NULL WHEN abs(dz)<0.2 THEN 'negligible' WHEN abs(dz)<0.5 THEN 'small' WHEN abs(dz)<0.8 THEN 'medium' ELSE 'large' END"
_KSQL = _contrast_sql("method, questionnaire, iteration", _pairs_sql("method, questionnaire, iteration", "k=0", "k=5"))


def _k(k: int):
    return F.col("k") == k


@query(S + """, lx AS (SELECT *, max(iteration) OVER (PARTITION BY arm) AS la FROM c), mk AS (SELECT * FROM lx WHERE iteration=0 OR iteration=la)"""
       + _contrast_sql("arm, questionnaire", _pairs_sql("arm, questionnaire", "iteration=la AND la>0", "iteration=0", "mk")) + _holm_sql("ct", "arm", "questionnaire")
       + f"SELECT arm, questionnaire, n, n_nonzero, {_P6}, {_EFFECT} AS effect FROM hm")
def main_results(spark, sf_dir):
    return paired.main_results(cells(spark, sf_dir)).select("arm", "questionnaire", "n", "n_nonzero", *r6(*_R6), "effect")


@query(S + ", b AS (SELECT arm, questionnaire, persona_id, score AS base FROM c WHERE iteration=0), x AS (SELECT c.arm, c.questionnaire, c.iteration, c.persona_id, c.score AS a, b.base AS b, c.score-b.base AS d FROM c JOIN b USING (arm, questionnaire, persona_id) WHERE c.iteration>0)"
       + _contrast_sql("arm, questionnaire, iteration", "SELECT * FROM x") + _holm_sql("ct", "arm, questionnaire", "iteration") + f"SELECT arm, questionnaire, iteration, n, n_nonzero, {_P6} FROM hm")
def paired_vs_base(spark, sf_dir):
    c = cells(spark, sf_dir)
    out = paired.vs_base(c, ["arm", "questionnaire"])
    return paired.holm(out, ["arm", "questionnaire"], tiebreak=["iteration"]).select("arm", "questionnaire", "iteration", "n", "n_nonzero", *r6(*_R6))


@query(S + _KSQL + _holm_sql("ct", "method, questionnaire", "iteration") + f"SELECT method, questionnaire, iteration, n, n_nonzero, {_P6}, CASE WHEN p_holm<0.001 THEN '***' WHEN p_holm<0.01 THEN '**' WHEN p_holm<0.05 THEN '*' ELSE '' END AS sig, CASE WHEN mean_delta IS NULL THEN NULL WHEN mean_delta=0 THEN 'tie' WHEN mean_delta>0 THEN 'K0' ELSE 'K5' END AS winner FROM hm")
def paired_k_contrast(spark, sf_dir):
    out = paired.holm(paired.contrast(cells(spark, sf_dir), ["method", "questionnaire", "iteration"], _k(0), _k(5)), ["method", "questionnaire"], tiebreak=["iteration"])
    return out.select("method", "questionnaire", "iteration", "n", "n_nonzero", *r6(*_R6), stars("p_holm").alias("sig"), favours("mean_delta", False, "K0", "K5").alias("winner"))


@query(S + _contrast_sql("k, questionnaire, iteration", _pairs_sql("k, questionnaire, iteration", "method='A'", "method='B'")) + _holm_sql("ct", "k, iteration", "questionnaire") + f"SELECT k, questionnaire, iteration, n, n_nonzero, {_P6} FROM hm")
def paired_method_contrast(spark, sf_dir):
    out = paired.contrast(cells(spark, sf_dir), ["k", "questionnaire", "iteration"], F.col("method") == "A", F.col("method") == "B")
    return paired.holm(out, ["k", "iteration"], tiebreak=["questionnaire"]).select("k", "questionnaire", "iteration", "n", "n_nonzero", *r6(*_R6))


@query(_LEVEL + ", b AS (SELECT method, k, iteration, questionnaire FROM (SELECT arm[1:1] AS method, arm[4:4]::INT AS k, *, row_number() OVER (PARTITION BY arm, questionnaire ORDER BY mean DESC, iteration) AS r FROM l) WHERE r=1), bc AS (SELECT c.* FROM c SEMI JOIN b USING (method, k, iteration, questionnaire))"
       + _contrast_sql("k, questionnaire", _pairs_sql("k, questionnaire", "method='A'", "method='B'", "bc")) + _holm_sql("ct", "k", "questionnaire") + f"SELECT k, questionnaire, n, n_nonzero, {_P6} FROM hm")
def best_vs_best(spark, sf_dir):
    c = cells(spark, sf_dir)
    keys = ["method", "k", "questionnaire", "iteration"]
    chosen = c.join(paired.best_iteration(c, ["method", "k", "questionnaire"]).select(*keys), keys, "left_semi")
    out = paired.contrast(chosen, ["k", "questionnaire"], F.col("method") == "A", F.col("method") == "B")
    return paired.holm(out, ["k"], tiebreak=["questionnaire"]).select("k", "questionnaire", "n", "n_nonzero", *r6(*_R6))


@query(S + "SELECT method, questionnaire, iteration, " + sql6("avg(score) FILTER (k=0) AS mean_k0", "avg(score) FILTER (k=5) AS mean_k5", "stddev_samp(score) FILTER (k=0)/sqrt(count(*) FILTER (k=0)) AS se_k0", "stddev_samp(score) FILTER (k=5)/sqrt(count(*) FILTER (k=5)) AS se_k5") + ", count(*) FILTER (k=0) AS n_k0, count(*) FILTER (k=5) AS n_k5 FROM c GROUP BY ALL")
def levels_by_iter(spark, sf_dir):
    k = lambda n: F.when(F.col("k") == n, F.col("score"))
    g = cells(spark, sf_dir).groupBy("method", "questionnaire", "iteration").agg(*(f(k(n)).alias(f"{m}_k{n}") for n in (0, 5) for f, m in ((F.avg, "mean"), (F.stddev_samp, "sd"), (F.count, "n"))))
    g = g.withColumns({f"se_k{n}": F.col(f"sd_k{n}") / F.sqrt(F.col(f"n_k{n}").cast("double")) for n in (0, 5)})
    return g.select("method", "questionnaire", "iteration", *r6("mean_k0", "mean_k5", "se_k0", "se_k5"), "n_k0", "n_k5")


_DID = "SELECT questionnaire, iteration, persona_id, avg(score) FILTER (arm='A_K0') AS s0, avg(score) FILTER (arm='B_K0') AS s1, avg(score) FILTER (arm='A_K5') AS s2, avg(score) FILTER (arm='B_K5') AS s3 FROM c GROUP BY ALL"


@query(S + f", d AS (SELECT *, s0-s1 AS lo, s2-s3 AS hi FROM ({_DID}) WHERE s0 IS NOT NULL AND s1 IS NOT NULL AND s2 IS NOT NULL AND s3 IS NOT NULL) SELECT questionnaire, iteration, count(*) AS n, " + sql6("avg(lo) AS gap_lo", "avg(hi) AS gap_hi", "avg(lo-hi) AS did_mean", "avg(lo-hi)/nullif(stddev_samp(lo-hi),0) AS did_dz") + " FROM d GROUP BY ALL")
def did_by_iter(spark, sf_dir):
    sides = tuple(F.col("arm") == a for a in ("A_K0", "B_K0", "A_K5", "B_K5"))
    return paired.did(cells(spark, sf_dir), ["questionnaire", "iteration"], sides).select("questionnaire", "iteration", "n", *r6("gap_lo", "gap_hi", "did_mean", "did_dz"))


@query(S + ", g AS (SELECT k, questionnaire, iteration, avg(score) FILTER (method='A') AS a, avg(score) FILTER (method='B') AS b FROM c GROUP BY ALL) SELECT k, questionnaire, iteration, " + sql6("a AS mean_a", "b AS mean_b", "a-b AS gap") + " FROM g")
def method_gap(spark, sf_dir):
    m = lambda n: F.avg(F.when(F.col("method") == n, F.col("score")))
    g = cells(spark, sf_dir).groupBy("k", "questionnaire", "iteration").agg(m("A").alias("mean_a"), m("B").alias("mean_b"))
    return g.select("k", "questionnaire", "iteration", *r6("mean_a", "mean_b", gap=F.col("mean_a") - F.col("mean_b")))


@query(S + _KSQL + _holm_sql("ct", "method, questionnaire", "iteration") + """SELECT method, questionnaire, count(*) AS n_iters, count(*) FILTER (p_holm<0.05 AND mean_delta>0) AS n_sig_k0, count(*) FILTER (p_holm<0.05 AND mean_delta<0) AS n_sig_k5,
coalesce(string_agg(iteration::VARCHAR, ',' ORDER BY iteration) FILTER (mean_delta>0),'') AS iters_k0_higher, """ + sql6("avg(mean_delta) FILTER (iteration>0) AS mean_delta_trained", "avg(dz) FILTER (iteration>0) AS mean_dz_trained", "max(mean_delta) FILTER (iteration=0) AS base_delta", "max(abs(dz)) AS max_abs_dz") + " FROM hm GROUP BY ALL")
def k_summary(spark, sf_dir):
    out = paired.holm(paired.contrast(cells(spark, sf_dir), ["method", "questionnaire", "iteration"], _k(0), _k(5)), ["method", "questionnaire"], tiebreak=["iteration"])
    trained = F.col("iteration") > 0
    higher = F.array_sort(F.collect_list(F.when(F.col("mean_delta") > 0, F.col("iteration"))))
    g = out.groupBy("method", "questionnaire").agg(
        F.count(F.lit(1)).alias("n_iters"), F.count_if(F.expr("p_holm < 0.05 AND mean_delta > 0")).alias("n_sig_k0"), F.count_if(F.expr("p_holm < 0.05 AND mean_delta < 0")).alias("n_sig_k5"),
        F.array_join(F.transform(higher, lambda x: x.cast("string")), ",").alias("iters_k0_higher"), F.avg(F.when(trained, F.col("mean_delta"))).alias("mean_delta_trained"),
        F.avg(F.when(trained, F.col("dz"))).alias("mean_dz_trained"), F.max(F.when(~trained, F.col("mean_delta"))).alias("base_delta"), F.max(F.abs("dz")).alias("max_abs_dz"),
    )
    return g.select("method", "questionnaire", "n_iters", "n_sig_k0", "n_sig_k5", "iters_k0_higher", *r6("mean_delta_trained", "mean_dz_trained", "base_delta", "max_abs_dz"))


@query(S + ", st0 AS (SELECT c.*, u.c_mktsegment AS seg FROM c JOIN customer u ON u.c_custkey=c.persona_id), sx AS (SELECT *, seg AS stratum FROM st0 UNION ALL SELECT *, 'All' FROM st0), pq AS ("
       + _pairs_sql("method, stratum, questionnaire", "k=0", "k=5", "sx") + f") SELECT method, stratum, questionnaire, n, {sql6(*_STATS)} FROM (SELECT method, stratum, questionnaire, {_STAT} FROM pq GROUP BY ALL)")
def contrast_by_stratum(spark, sf_dir):
    traits = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("persona_id"), F.col("c_mktsegment").alias("seg"))
    c = cells(spark, sf_dir).join(traits, "persona_id").withColumn("stratum", F.explode(F.array("seg", F.lit("All"))))
    by = ["method", "stratum", "questionnaire"]
    return paired.summary(paired.deltas(c, by, _k(0), _k(5)), by).select(*by, "n", *r6(*_STATS))


@query(S + ", st0 AS (SELECT c.*, u.c_mktsegment AS stratum FROM c JOIN customer u ON u.c_custkey=c.persona_id) SELECT arm, coalesce(stratum,'All') AS stratum, count(*) AS n, " + sql6("avg(score) AS mean", "stddev_samp(score) AS sd", "avg((score>=45)::INT) AS share_high") + " FROM st0 GROUP BY GROUPING SETS ((arm, stratum), (arm))")
def ceiling_by_stratum(spark, sf_dir):
    traits = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("persona_id"), F.col("c_mktsegment").alias("stratum"))
    c = cells(spark, sf_dir).join(traits, "persona_id")
    g = c.groupingSets([["arm", "stratum"], ["arm"]], "arm", "stratum").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"), F.avg((F.col("score") >= 45).cast("int")).alias("share_high"))
    return g.select("arm", F.coalesce("stratum", F.lit("All")).alias("stratum"), "n", *r6("mean", "sd", "share_high"))


@query(S + ", lx AS (SELECT *, max(iteration) OVER (PARTITION BY arm) AS la FROM c), e AS (SELECT arm, questionnaire, avg(score) FILTER (iteration=0) AS base, avg(score) FILTER (iteration=la) AS final FROM lx GROUP BY ALL) SELECT arm, questionnaire, " + sql6("base", "final", "final-base AS change") + " FROM e")
def endpoint_contrasts(spark, sf_dir):
    c = cells(spark, sf_dir)
    c = c.join(paired.final_iteration(c, ["arm"]).withColumnRenamed("iteration", "last"), "arm")
    g = c.groupBy("arm", "questionnaire").agg(F.avg(F.when(F.col("iteration") == 0, F.col("score"))).alias("base"), F.avg(F.when(F.col("iteration") == F.col("last"), F.col("score"))).alias("final"))
    return g.select("arm", "questionnaire", *r6("base", "final", change=F.col("final") - F.col("base")))


# --- tests of groups -------------------------------------------------------------------------------------------------

_RANKED = ", r AS (SELECT *, rank() OVER (PARTITION BY questionnaire ORDER BY score) + (count(*) OVER (PARTITION BY questionnaire, score)-1)/2.0 AS rk, count(*) OVER (PARTITION BY questionnaire, score)::DOUBLE AS t FROM c)\n"


@query(S + _RANKED + ", m AS (SELECT questionnaire, count(*) FILTER (k=0)::DOUBLE AS n1, count(*) FILTER (k=5)::DOUBLE AS n2, sum(CASE WHEN k=0 THEN rk ELSE 0 END) AS r1, sum(t*t-1) AS ti FROM r GROUP BY ALL), u AS (SELECT *, r1-n1*(n1+1)/2 AS u, n1*n2/12*((n1+n2+1)-ti/((n1+n2)*(n1+n2-1))) AS va FROM m) SELECT questionnaire, n1::BIGINT AS n1, n2::BIGINT AS n2, " + sql6("u", "(u-n1*n2/2)/sqrt(va) AS z", p_sql("((u-n1*n2/2)/sqrt(va))") + " AS p") + " FROM u")
def mann_whitney(spark, sf_dir):
    return hypothesis.mann_whitney(cells(spark, sf_dir), ["questionnaire"], _k(0)).select("questionnaire", "n1", "n2", *r6("u", "z", "p"))


@query(S + _RANKED + ", g AS (SELECT questionnaire, arm, count(*)::DOUBLE AS n, sum(rk) AS r, sum(t*t-1) AS ti FROM r GROUP BY ALL), h AS (SELECT questionnaire, sum(n) AS n, count(*) AS k, sum(r*r/n) AS s, sum(ti) AS ti FROM g GROUP BY ALL) SELECT questionnaire, n::BIGINT AS n, k, " + sql6("(12/(n*(n+1))*s-3*(n+1))/(1-ti/(n*n*n-n)) AS h") + " FROM h")
def kruskal(spark, sf_dir):
    return hypothesis.kruskal(cells(spark, sf_dir), ["questionnaire"], "arm").select("questionnaire", "n", "k", *r6("h"))


def _anova_sql(source: str, value: str) -> str:
    return f", g AS (SELECT questionnaire, arm, count(*) AS n, avg({value}) AS m, var_pop({value}) AS v FROM {source} GROUP BY ALL), tt AS (SELECT questionnaire, sum(n) AS n, count(*) AS k, sum(n*v) AS w, sum(n*m)/sum(n) AS gm FROM g GROUP BY ALL), f AS (SELECT questionnaire, tt.n, k, w, sum(g.n*(m-gm)*(m-gm)) AS b FROM g JOIN tt USING (questionnaire) GROUP BY ALL) SELECT questionnaire, n::BIGINT AS n, k, " + sql6("(b/(k-1))/(w/(n-k)) AS f", "b/(b+w) AS eta2") + " FROM f"


@query(S + _anova_sql("c", "score"))
def anova_eta2(spark, sf_dir):
    return hypothesis.anova(cells(spark, sf_dir), ["questionnaire"], "arm").select("questionnaire", "n", "k", *r6("f", "eta2"))


@query(S + ", md AS (SELECT questionnaire, arm, quantile_cont(score,0.5) AS ce FROM c GROUP BY ALL), dv AS (SELECT questionnaire, arm, abs(score-ce) AS dd FROM c JOIN md USING (questionnaire, arm))" + _anova_sql("dv", "dd"))
def brown_forsythe(spark, sf_dir):
    return hypothesis.levene(cells(spark, sf_dir), ["questionnaire"], "arm").select("questionnaire", "n", "k", *r6("f", "eta2"))


@query(S + ", md AS (SELECT questionnaire, arm, avg(score) AS ce FROM c GROUP BY ALL), dv AS (SELECT questionnaire, arm, abs(score-ce) AS dd FROM c JOIN md USING (questionnaire, arm))" + _anova_sql("dv", "dd"))
def levene(spark, sf_dir):
    return hypothesis.levene(cells(spark, sf_dir), ["questionnaire"], "arm", center="mean").select("questionnaire", "n", "k", *r6("f", "eta2"))


@query(S + """, q AS (SELECT arm, persona_id, iteration, avg(score) AS score FROM c GROUP BY ALL), kk AS (SELECT arm, count(DISTINCT iteration) AS k FROM q GROUP BY ALL), w AS (SELECT q.*, k, count(*) OVER (PARTITION BY arm, persona_id) AS own FROM q JOIN kk USING (arm)),
r AS (SELECT *, rank() OVER (PARTITION BY arm, persona_id ORDER BY score) + (count(*) OVER (PARTITION BY arm, persona_id, score)-1)/2.0 AS rk, count(*) OVER (PARTITION BY arm, persona_id, score)::DOUBLE AS t FROM w WHERE own=k),
g AS (SELECT arm, iteration, k, sum(rk) AS r, count(*) AS n, sum(t*t-1) AS ti FROM r GROUP BY ALL), f AS (SELECT arm, n, k, sum(r*r) AS s, sum(ti) AS ti FROM g GROUP BY ALL), x AS (SELECT *, (12/(n::DOUBLE*k*(k+1))*s-3.0*n*(k+1))/(1-ti/(n*(k::DOUBLE*k*k-k))) AS chi2 FROM f)
SELECT arm, n, k, """ + sql6("CASE WHEN n>=3 AND k>=3 THEN chi2 END AS chi2", "CASE WHEN n>=3 AND k>=3 THEN chi2/(n*(k-1)) END AS kendall_w") + " FROM x")
def friedman(spark, sf_dir):
    q = paired.means(cells(spark, sf_dir), ["arm", "persona_id", "iteration"])
    return hypothesis.friedman(q, ["arm"], "persona_id", "iteration").select("arm", "n", F.col("k").cast("long").alias("k"), *r6("chi2", "kendall_w"))


@query(S + ", m AS (SELECT questionnaire, count(*) FILTER (k=0) AS n1, count(*) FILTER (k=5) AS n2, avg(score) FILTER (k=0)-avg(score) FILTER (k=5) AS df, var_pop(score) FILTER (k=0) AS v1, var_pop(score) FILTER (k=5) AS v2 FROM c GROUP BY ALL) SELECT questionnaire, n1, n2, " + sql6("df/sqrt(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2)) AS d") + " FROM m")
def cohens_d(spark, sf_dir):
    return hypothesis.cohens_d(cells(spark, sf_dir), ["questionnaire"], _k(0)).select("questionnaire", "n1", "n2", *r6("d"))


@query(S + ", m AS (SELECT questionnaire, avg(score) FILTER (k=0)-avg(score) FILTER (k=5) AS delta, var_samp(score) FILTER (k=0)/count(*) FILTER (k=0) AS a, var_samp(score) FILTER (k=5)/count(*) FILTER (k=5) AS b, count(*) FILTER (k=0) AS n, count(*) FILTER (k=5) AS m FROM c GROUP BY ALL) SELECT questionnaire, " + sql6("delta", "delta/sqrt(a+b) AS t", "(a+b)*(a+b)/(a*a/(n-1)+b*b/(m-1)) AS df") + " FROM m")
def welch_t(spark, sf_dir):
    return hypothesis.welch(cells(spark, sf_dir), ["questionnaire"], _k(0)).select("questionnaire", *r6("delta", "t", "df"))


@query(S + ", x AS (" + _pairs_sql("method, questionnaire", "k=0", "k=5") + ") SELECT method, questionnaire, count(*) AS n, " + sql6("corr(a+b, a-b) AS r", "stddev_samp(a)/stddev_samp(b) AS sd_ratio") + " FROM x GROUP BY ALL")
def pitman_morgan(spark, sf_dir):
    by = ["method", "questionnaire"]
    return hypothesis.pitman_morgan(paired.deltas(cells(spark, sf_dir), by, _k(0), _k(5)), by).select(*by, "n", *r6("r", "sd_ratio"))


@query(S + _KSQL + ", q0 AS (SELECT *, count(p) OVER (PARTITION BY method) AS m, row_number() OVER (PARTITION BY method, p IS NULL ORDER BY p, questionnaire, iteration) AS rn FROM ct) SELECT method, questionnaire, iteration, " + sql6("p", "CASE WHEN p IS NOT NULL THEN min(least(1.0,p*m/rn)) OVER (PARTITION BY method, p IS NULL ORDER BY p, questionnaire, iteration ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS q") + " FROM q0")
def bh_fdr(spark, sf_dir):
    out = paired.contrast(cells(spark, sf_dir), ["method", "questionnaire", "iteration"], _k(0), _k(5))
    return paired.benjamini_hochberg(out, ["method"], tiebreak=["questionnaire", "iteration"]).select("method", "questionnaire", "iteration", *r6("p", "q"))


@query(S + _KSQL + f"SELECT method, effect, count(*) AS n FROM (SELECT method, {_EFFECT} AS effect FROM ct) GROUP BY ALL")
def effect_labels(spark, sf_dir):
    by = ["method", "questionnaire", "iteration"]
    out = paired.summary(paired.deltas(cells(spark, sf_dir), by, _k(0), _k(5)), by)
    return out.groupBy("method", effect_label("dz").alias("effect")).agg(F.count(F.lit(1)).alias("n"))


# --- trends ----------------------------------------------------------------------------------------------------------


@query(S + """, r AS (SELECT *, rank() OVER (PARTITION BY arm, questionnaire ORDER BY iteration) + (count(*) OVER (PARTITION BY arm, questionnaire, iteration)-1)/2.0 AS x, rank() OVER (PARTITION BY arm, questionnaire ORDER BY score) + (count(*) OVER (PARTITION BY arm, questionnaire, score)-1)/2.0 AS y FROM c),
l AS (SELECT arm, questionnaire, iteration, avg(score) AS m FROM c GROUP BY ALL), b AS (SELECT arm, questionnaire, iteration AS peak_iteration FROM (SELECT *, row_number() OVER (PARTITION BY arm, questionnaire ORDER BY m DESC, iteration) AS rn FROM l) WHERE rn=1)
SELECT arm, questionnaire, count(DISTINCT iteration) AS n_iterations, """ + sql6("corr(x,y) AS rho", "regr_slope(score, iteration::DOUBLE) AS slope") + ", max(peak_iteration) AS peak_iteration, max(iteration) AS final_iteration FROM r JOIN b USING (arm, questionnaire) GROUP BY arm, questionnaire")
def trajectory(spark, sf_dir):
    return paired.trajectory(cells(spark, sf_dir), ["arm", "questionnaire"]).select("arm", "questionnaire", "n_iterations", *r6("rho", "slope"), "peak_iteration", "final_iteration")


@query(_LEVEL + "SELECT arm, questionnaire, iteration, " + sql6("mean", "mean - lag(mean) OVER (PARTITION BY arm, questionnaire ORDER BY iteration) AS delta", "avg(mean) OVER (PARTITION BY arm, questionnaire ORDER BY iteration ROWS 2 PRECEDING) AS smoothed") + " FROM l")
def iteration_delta_and_moving_average(spark, sf_dir):
    level = cells(spark, sf_dir).groupBy("arm", "questionnaire", "iteration").agg(F.avg("score").alias("mean"))
    w = Window.partitionBy("arm", "questionnaire").orderBy("iteration")
    return level.select("arm", "questionnaire", "iteration", *r6("mean", delta=F.col("mean") - F.lag("mean").over(w), smoothed=F.avg("mean").over(w.rowsBetween(-2, 0))))


@query(S + ", x AS (SELECT a.questionnaire AS q1, b.questionnaire AS q2, a.score AS s1, b.score AS s2 FROM c a JOIN c b ON a.arm=b.arm AND a.iteration=b.iteration AND a.persona_id=b.persona_id AND a.questionnaire<b.questionnaire) SELECT q1, q2, count(*) AS n, " + sql6("corr(s1,s2) AS r") + " FROM x GROUP BY ALL")
def rubric_correlation_pearson(spark, sf_dir):
    return reshape.rubric_pairs(cells(spark, sf_dir)).groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("n"), F.corr("s1", "s2").alias("r")).select("q1", "q2", "n", *r6("r"))


@query(S + ", x AS (SELECT a.questionnaire AS q1, b.questionnaire AS q2, a.score AS s1, b.score AS s2 FROM c a JOIN c b ON a.arm=b.arm AND a.iteration=b.iteration AND a.persona_id=b.persona_id AND a.questionnaire<b.questionnaire), r AS (SELECT q1, q2, rank() OVER (PARTITION BY q1,q2 ORDER BY s1)+(count(*) OVER (PARTITION BY q1,q2,s1)-1)/2.0 AS x1, rank() OVER (PARTITION BY q1,q2 ORDER BY s2)+(count(*) OVER (PARTITION BY q1,q2,s2)-1)/2.0 AS x2 FROM x) SELECT q1, q2, count(*) AS n, " + sql6("corr(x1,x2) AS rho") + " FROM r GROUP BY ALL")
def rubric_correlation_spearman(spark, sf_dir):
    return hypothesis.spearman(reshape.rubric_pairs(cells(spark, sf_dir)), ["q1", "q2"], "s1", "s2").select("q1", "q2", "n", *r6("rho"))


@query(S + "SELECT questionnaire, arm, iteration, count(*) AS n, " + sql6("avg(score) AS mean", "quantile_cont(score,0.5) AS median", "stddev_samp(score) AS sd", "quantile_cont(score,0.75)-quantile_cont(score,0.25) AS iqr", "avg((score>=40)::INT) AS share_40", "avg((score>=45)::INT) AS share_45") + " FROM c GROUP BY ALL")
def sd_by_iter(spark, sf_dir):
    c, by = cells(spark, sf_dir), ["questionnaire", "arm", "iteration"]
    g = c.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"), *(F.avg((F.col("score") >= t).cast("int")).alias(f"share_{t}") for t in (40, 45)))
    g = g.join(ranking.quantiles(c, by, "score", {"q1": 0.25, "median": 0.5, "q3": 0.75}), by).withColumn("iqr", F.col("q3") - F.col("q1"))
    return g.select("questionnaire", "arm", "iteration", "n", *r6("mean", "median", "sd", "iqr", "share_40", "share_45"))
