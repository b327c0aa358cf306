"""Queries on reward faithfulness and the graders' reliability: pair agreement by length, iteration and stratum, ceilings, contrasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ratio
from ..operators import paired, reliability, resample, reshape
from .contrasts import _W
from .views import JP, S, cells, judge_pairs, query, r6, scores_long, sql6, table

KEYS = ["arm", "iteration", "persona_id"]
_FD = JP + ", fd AS (SELECT arm, arm[4:4]::INT AS k, arm[1:1] AS method, iteration, persona_id, (persona_id%6+1)::INT AS n_turns, (persona_id%3)::INT AS stratum, avg(p) AS p, avg(h) AS h FROM jp GROUP BY ALL)"


def proxies(spark, sf_dir) -> DataFrame:
    """arm, k, method, iteration, persona_id, n_turns, stratum, p (what training saw), h (what evaluation gave)."""
    g = paired.means_in_order(judge_pairs(spark, sf_dir), ["arm", "k", "method", "iteration", "persona_id"], "event_id", "p", "h")
    return g.withColumns({"n_turns": (F.col("persona_id") % 6 + 1).cast("int"), "stratum": (F.col("persona_id") % 3).cast("int")})


def _counts_sql(by: str, name: str = "pc", more: str = "") -> str:
    keys = [k.strip() for k in by.split(",")]
    on = " AND ".join(f"x.{k}=y.{k}" for k in keys)
    return f", {name} AS (SELECT {', '.join('x.' + k + ' AS ' + k for k in keys)}, count(*) AS n_pairs, count(*) FILTER (sign(x.p-y.p)=sign(x.h-y.h)) AS n_same FROM fd x JOIN fd y ON {on} AND x.persona_id<y.persona_id{more} WHERE x.p<>y.p AND x.h<>y.h GROUP BY ALL)"


_CELL = _FD + _counts_sql("arm, method, k, iteration, n_turns")


def _counts(spark, sf_dir, *more: str) -> DataFrame:
    return reliability.pair_counts(proxies(spark, sf_dir), ["arm", "method", "k", "iteration", "n_turns", *more], "p", "h")


def pooled(counts: DataFrame, by: list[str]) -> DataFrame:
    """by, n_pairs, agreement: counts of cells added up, then one share; shares of cells are never averaged."""
    g = counts.groupBy(*by).agg(F.sum("n_pairs").alias("n_pairs"), F.sum("n_same").alias("n_same"))
    return g.select(*by, "n_pairs", ratio("n_same", "n_pairs").alias("agreement"))


_AG = "sum(n_pairs)::BIGINT AS n_pairs, " + sql6("sum(n_same)::DOUBLE/nullif(sum(n_pairs),0) AS agreement")


@query(S + ", f AS (SELECT arm, iteration, persona_id, avg(score) AS score FROM s GROUP BY ALL) SELECT f.arm, f.iteration, f.persona_id, coalesce(u.c_mktsegment,'none') AS stratum, " + sql6("score") + " FROM f LEFT JOIN customer u ON u.c_custkey=f.persona_id")
def eval_frame(spark, sf_dir):
    """Mean score of a conversation with the persona's traits."""
    f = paired.means(scores_long(spark, sf_dir), KEYS)
    traits = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("persona_id"), F.col("c_mktsegment").alias("stratum"))
    return reshape.attach(f, traits, ["persona_id"], {"stratum": "none"}).select(*KEYS, "stratum", *r6("score"))


@query(_CELL + " SELECT arm, iteration, n_turns, n_pairs, n_same FROM pc")
def agreement_cells(spark, sf_dir):
    """Pairs of conversations of equal length, and those that both scores order alike."""
    return _counts(spark, sf_dir).select("arm", "iteration", "n_turns", F.col("n_pairs").cast("long").alias("n_pairs"), F.col("n_same").cast("long").alias("n_same"))


#: Ranges of length over which the curve is pooled; fixed values.
BINS = (("1-2", 1, 2), ("3-4", 3, 4), ("5-6", 5, 6), ("all", 1, 6))
_BIN = _CELL + ", bn AS (SELECT unnest(['1-2','3-4','5-6','all']) AS bin, unnest([1,3,5,1]) AS lo, unnest([2,4,6,6]) AS hi)"


def _binned(spark, sf_dir) -> DataFrame:
    bins = spark.createDataFrame(list(BINS), "bin string, lo int, hi int")
    return _counts(spark, sf_dir).join(F.broadcast(bins), F.col("n_turns").between(F.col("lo"), F.col("hi")))


@query(_BIN + " SELECT arm, bin, " + _AG + " FROM pc JOIN bn ON n_turns BETWEEN lo AND hi GROUP BY ALL HAVING sum(n_pairs)>=20")
def faithfulness_curve(spark, sf_dir):
    """Agreement by range of length, from a table of bins."""
    return pooled(_binned(spark, sf_dir), ["arm", "bin"]).where("n_pairs >= 20").select("arm", "bin", "n_pairs", *r6("agreement"))


@query(_BIN + ", b AS (SELECT arm, bin, sum(n_same)::DOUBLE/sum(n_pairs) AS ag FROM pc JOIN bn ON n_turns BETWEEN lo AND hi GROUP BY ALL) SELECT arm, " + sql6("max(ag) FILTER (bin='1-2') AS short", "max(ag) FILTER (bin='3-4') AS middle", "max(ag) FILTER (bin='5-6') AS long", "max(ag) FILTER (bin='all') AS whole") + " FROM b GROUP BY ALL")
def curve_wide(spark, sf_dir):
    wide = reshape.to_wide(pooled(_binned(spark, sf_dir), ["arm", "bin"]), ["arm"], "bin", [b for b, *_ in BINS], "agreement")
    return wide.select("arm", *r6(short=F.col("1-2"), middle=F.col("3-4"), long=F.col("5-6"), whole=F.col("all")))


@query(_CELL + " SELECT arm, iteration, " + _AG + " FROM pc GROUP BY ALL")
def faithfulness_by_iter(spark, sf_dir):
    return pooled(_counts(spark, sf_dir), ["arm", "iteration"]).select("arm", "iteration", "n_pairs", *r6("agreement"))


@query(_CELL + ", i AS (SELECT method, k, iteration, sum(n_same)::DOUBLE/sum(n_pairs) AS ag FROM pc GROUP BY ALL) SELECT method, iteration, " + sql6("max(ag) FILTER (k=0) AS k0", "max(ag) FILTER (k=5) AS k5", "max(ag) FILTER (k=5)-max(ag) FILTER (k=0) AS delta") + " FROM i GROUP BY ALL")
def k_faithfulness_by_iter(spark, sf_dir):
    """Both look-aheads side by side."""
    i = pooled(_counts(spark, sf_dir), ["method", "k", "iteration"])
    g = reshape.to_wide(i.withColumn("k", F.concat(F.lit("k"), "k")), ["method", "iteration"], "k", ["k0", "k5"], "agreement")
    return g.select("method", "iteration", *r6("k0", "k5", delta=F.col("k5") - F.col("k0")))


@query(_BIN + ", i AS (SELECT method, k, bin, sum(n_same)::DOUBLE/sum(n_pairs) AS ag FROM pc JOIN bn ON n_turns BETWEEN lo AND hi WHERE bin<>'all' GROUP BY ALL), d AS (SELECT method, bin, max(ag) FILTER (k=5)-max(ag) FILTER (k=0) AS d FROM i GROUP BY ALL) SELECT method, count(d) AS n_bins, count(*) FILTER (d>0) AS n_up, " + sql6("avg(d) AS mean_delta", "quantile_cont(d,0.5) AS median_delta") + " FROM d GROUP BY ALL")
def matched_policy(spark, sf_dir):
    """The difference of the look-aheads bin by bin, summed up over bins."""
    i = pooled(_binned(spark, sf_dir).where("bin <> 'all'"), ["method", "k", "bin"])
    side = lambda k: F.max(F.when(F.col("k") == k, F.col("agreement")))
    d = i.groupBy("method", "bin").agg((side(5) - side(0)).alias("d"))
    g = d.groupBy("method").agg(F.count("d").alias("n_bins"), F.count_if(F.col("d") > 0).alias("n_up"), F.avg("d").alias("mean_delta"), F.percentile("d", 0.5).alias("median_delta"))
    return g.select("method", "n_bins", "n_up", *r6("mean_delta", "median_delta"))


@query(_CELL + ", po AS (SELECT method, sum(n_same) FILTER (k=5)::DOUBLE/sum(n_pairs) FILTER (k=5) - sum(n_same) FILTER (k=0)::DOUBLE/sum(n_pairs) FILTER (k=0) AS pooled FROM pc GROUP BY ALL), i AS (SELECT method, k, iteration, sum(n_same)::DOUBLE/sum(n_pairs) AS ag FROM pc GROUP BY ALL), d AS (SELECT method, iteration, max(ag) FILTER (k=5)-max(ag) FILTER (k=0) AS d FROM i GROUP BY ALL) SELECT method, count(d) AS n_iters, " + sql6("max(pooled) AS pooled", "avg(d) AS by_iteration") + " FROM d JOIN po USING (method) GROUP BY ALL")
def k_faithfulness_summary(spark, sf_dir):
    """Pooled over pairs, and with every iteration weighing the same."""
    c = _counts(spark, sf_dir)
    part = lambda k, n: F.sum(F.when(F.col("k") == k, F.col(n)))
    whole = c.groupBy("method").agg((ratio(part(5, "n_same"), part(5, "n_pairs")) - ratio(part(0, "n_same"), part(0, "n_pairs"))).alias("pooled"))
    i = pooled(c, ["method", "k", "iteration"])
    side = lambda k: F.max(F.when(F.col("k") == k, F.col("agreement")))
    d = i.groupBy("method", "iteration").agg((side(5) - side(0)).alias("d")).groupBy("method").agg(F.count("d").alias("n_iters"), F.avg("d").alias("by_iteration"))
    return d.join(whole, "method").select("method", "n_iters", *r6("pooled", "by_iteration"))


@query(_FD + _counts_sql("arm, iteration, n_turns, stratum") + " SELECT arm, stratum, " + _AG + " FROM pc GROUP BY ALL")
def by_cooperation(spark, sf_dir):
    """Only pairs within a stratum."""
    return pooled(_counts(spark, sf_dir, "stratum"), ["arm", "stratum"]).select("arm", "stratum", "n_pairs", *r6("agreement"))


@query(_FD + ", r AS (SELECT *, rank() OVER (PARTITION BY arm ORDER BY p)+(count(*) OVER (PARTITION BY arm,p)-1)/2.0 AS x, rank() OVER (PARTITION BY arm ORDER BY h)+(count(*) OVER (PARTITION BY arm,h)-1)/2.0 AS y FROM fd) SELECT arm, count(*) AS n, " + sql6("avg(p) AS proxy", "avg(h) AS eval", "avg(h-p) AS gap", "corr(p,h) AS r", "corr(x,y) AS rho") + " FROM r GROUP BY ALL")
def proxy_levels(spark, sf_dir):
    """Levels of both scores and how they go together."""
    fd = proxies(spark, sf_dir)
    levels = fd.groupBy("arm").agg(F.avg("p").alias("proxy"), F.avg("h").alias("eval"))
    return levels.join(reliability.agreement(fd, ["arm"]), "arm").select("arm", "n", *r6("proxy", "eval", gap=F.col("bias"), r=F.col("pearson"), rho=F.col("spearman")))


@query(_FD + _counts_sql("arm, iteration") + ", q2 AS (SELECT x.arm, x.iteration, avg((sign(x.p-y.p)=sign(x.h-y.h))::INT) AS again FROM fd x JOIN fd y ON x.arm=y.arm AND x.iteration=y.iteration AND x.persona_id<y.persona_id WHERE x.p<>y.p AND x.h<>y.h GROUP BY ALL) SELECT count(*) AS n, " + sql6("max(abs(n_same::DOUBLE/n_pairs-again)) AS largest_gap") + ", max(abs(n_same::DOUBLE/n_pairs-again))<=1e-9 AS equal FROM pc JOIN q2 USING (arm, iteration)")
def check_against_rank_agreement(spark, sf_dir):
    """Pooled counts against the rank agreement computed apart."""
    fd, by = proxies(spark, sf_dir), ["arm", "iteration"]
    one = pooled(reliability.pair_counts(fd, by, "p", "h"), by).select(*by, F.col("agreement").alias("x"))
    two = reliability.rank_agreement(fd, by, "p", "h", "persona_id", 1).select(*by, F.col("agreement").alias("y"))
    return reshape.largest_gap(one, two, by, 1e-9).select("n", *r6("largest_gap"), "equal")


# --- intervals ------------------------------------------------------------------------------------------------------------

_PAIRS = ", pp AS (SELECT x.arm, x.method, x.k, x.iteration, x.n_turns{cols}, x.persona_id AS u, y.persona_id AS v, (sign(x.p-y.p)=sign(x.h-y.h))::INT AS same FROM fd x JOIN fd y ON x.arm=y.arm AND x.iteration=y.iteration AND x.n_turns=y.n_turns{on} AND x.persona_id<y.persona_id WHERE x.p<>y.p AND x.h<>y.h), us AS (SELECT DISTINCT arm, iteration, persona_id FROM fd), uh AS (SELECT *, md5('12345|'||j||'|'||arm||'|'||iteration||'|'||persona_id) AS h FROM us, (SELECT unnest(range(250)) AS j)), uu AS (SELECT arm, iteration, persona_id, j*8+i AS b, ('0x'||h[i*4+1:i*4+4])::INT AS u FROM uh, (SELECT unnest(range(8)) AS i)), uw AS (SELECT arm, iteration, persona_id, b, " + _W + " AS w FROM uu), rp AS (SELECT pp.arm, pp.method, pp.k, pp.iteration, n_turns{plain}, p.b, sum(p.w*q.w) AS n_pairs, sum(p.w*q.w*same) AS n_same FROM pp JOIN uw p ON p.arm=pp.arm AND p.iteration=pp.iteration AND p.persona_id=pp.u JOIN uw q ON q.arm=pp.arm AND q.iteration=pp.iteration AND q.persona_id=pp.v AND q.b=p.b GROUP BY ALL)"
_RP = _PAIRS.format(cols="", on="", plain="")
_ENDS = "quantile_cont(ag,0.025) AS lo", "quantile_cont(ag,0.975) AS hi"


def _draws(spark, sf_dir, *more: str) -> DataFrame:
    """Pair counts of 2,000 resamples of the conversations of an arm and iteration, joint over its lengths and strata."""
    unit = F.concat_ws("|", "arm", F.col("iteration").cast("string"), F.col("persona_id").cast("string"))
    return reliability.pair_replicates(proxies(spark, sf_dir), ["arm", "method", "k", "iteration", "n_turns", *more], "p", "h", unit)


def _in_bins(spark, counts: DataFrame) -> DataFrame:
    bins = spark.createDataFrame(list(BINS), "bin string, lo int, hi int")
    return counts.join(F.broadcast(bins), F.col("n_turns").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def _with_interval(counts: DataFrame, draws: DataFrame, by: list[str]) -> DataFrame:
    """by, n_pairs, agreement, lo, hi: the share of all pairs and the interval of the same share over resamples."""
    ends = resample.interval(pooled(draws, [*by, "b"]), by, F.col("agreement"))
    return pooled(counts, by).join(ends, by, "left")


def _k_delta(counts: DataFrame, by: list[str]) -> DataFrame:
    """by, k0, k5, delta of the pooled shares of both look-aheads."""
    part = lambda k, n: F.sum(F.when(F.col("k") == k, F.col(n)))
    g = counts.groupBy(*by).agg(*(ratio(part(k, "n_same"), part(k, "n_pairs")).alias(f"k{k}") for k in (0, 5)))
    return g.withColumn("delta", F.col("k5") - F.col("k0"))


def _delta_interval(counts: DataFrame, draws: DataFrame, by: list[str]) -> DataFrame:
    ends = resample.interval(_k_delta(draws, [*by, "b"]), by, F.col("delta"))
    return _k_delta(counts, by).join(ends, by, "left").where("delta IS NOT NULL")


def _shares_sql(by: str, source: str = "pc", draws: str = "rp", least: int = 1) -> str:
    return f", pt AS (SELECT {by}, sum(n_pairs) AS n_pairs, sum(n_same)::DOUBLE/sum(n_pairs) AS agreement FROM {source} GROUP BY ALL), dd AS (SELECT {by}, b, sum(n_same)::DOUBLE/nullif(sum(n_pairs),0) AS ag FROM {draws} GROUP BY ALL), en AS (SELECT {by}, {', '.join(_ENDS)} FROM dd GROUP BY ALL) SELECT {by}, n_pairs::BIGINT AS n_pairs, " + sql6("agreement", "lo", "hi") + f" FROM pt LEFT JOIN en USING ({by}) WHERE n_pairs>={least}"


def _deltas_sql(by: str, source: str = "pc", draws: str = "rp") -> str:
    side = lambda k: f"sum(n_same) FILTER (k={k})::DOUBLE/nullif(sum(n_pairs) FILTER (k={k}),0)"
    return f", pt AS (SELECT {by}, {side(0)} AS k0, {side(5)} AS k5 FROM {source} GROUP BY ALL), dd AS (SELECT {by}, b, {side(5)}-{side(0)} AS ag FROM {draws} GROUP BY ALL), en AS (SELECT {by}, {', '.join(_ENDS)} FROM dd GROUP BY ALL) SELECT {by}, " + sql6("k0", "k5", "k5-k0 AS delta", "lo", "hi") + f" FROM pt LEFT JOIN en USING ({by}) WHERE k5-k0 IS NOT NULL"


_BINNED = ", pcb AS (SELECT pc.*, bin FROM pc JOIN bn ON n_turns BETWEEN lo AND hi), rpb AS (SELECT rp.*, bin FROM rp JOIN bn ON n_turns BETWEEN lo AND hi)"


@query(_BIN + _RP + _BINNED + _shares_sql("arm, bin", "pcb", "rpb", 20))
def faithfulness_curve_ci(spark, sf_dir):
    """Agreement by range of length with its interval over resampled conversations."""
    out = _with_interval(_binned(spark, sf_dir), _in_bins(spark, _draws(spark, sf_dir)), ["arm", "bin"])
    return out.where("n_pairs >= 20").select("arm", "bin", "n_pairs", *r6("agreement", "lo", "hi"))


@query(_CELL + _RP + _shares_sql("arm, iteration"))
def faithfulness_by_iter_ci(spark, sf_dir):
    out = _with_interval(_counts(spark, sf_dir), _draws(spark, sf_dir), ["arm", "iteration"])
    return out.select("arm", "iteration", "n_pairs", *r6("agreement", "lo", "hi"))


@query(_CELL + _RP + _deltas_sql("method, iteration"))
def k_faithfulness_ci(spark, sf_dir):
    """Both look-aheads by iteration, and the interval of their difference; the arms are resampled apart."""
    by = ["method", "iteration"]
    return _delta_interval(_counts(spark, sf_dir), _draws(spark, sf_dir), by).select(*by, *r6("k0", "k5", "delta", "lo", "hi"))


@query(_BIN + _RP + _BINNED + _deltas_sql("method, bin", "pcb", "rpb"))
def matched_policy_ci(spark, sf_dir):
    """The difference of the look-aheads by range of length, with its interval."""
    by = ["method", "bin"]
    return _delta_interval(_binned(spark, sf_dir), _in_bins(spark, _draws(spark, sf_dir)), by).select(*by, *r6("k0", "k5", "delta", "lo", "hi"))


@query(_CELL + _RP + _deltas_sql("method"))
def k_faithfulness_summary_ci(spark, sf_dir):
    """The difference pooled over all pairs of a method, with its interval."""
    return _delta_interval(_counts(spark, sf_dir), _draws(spark, sf_dir), ["method"]).select("method", *r6("k0", "k5", "delta", "lo", "hi"))


@query(_FD + _counts_sql("arm, method, k, iteration, n_turns, stratum") + _PAIRS.format(cols=", x.stratum", on=" AND x.stratum=y.stratum", plain=", stratum") + _shares_sql("arm, stratum"))
def by_cooperation_ci(spark, sf_dir):
    out = _with_interval(_counts(spark, sf_dir, "stratum"), _draws(spark, sf_dir, "stratum"), ["arm", "stratum"])
    return out.select("arm", "stratum", "n_pairs", *r6("agreement", "lo", "hi"))


# --- graders -----------------------------------------------------------------------------------------------------------


@query(JP + ", d AS (SELECT questionnaire, arm, abs(p-h) AS d FROM jp) SELECT questionnaire, arm, count(*) AS n, " + sql6("avg(d) AS mean_abs_diff", "max(d) AS largest") + " FROM d GROUP BY ALL")
def rep_mean_abs_diff(spark, sf_dir):
    """How far two gradings of one conversation are apart."""
    d = F.abs(F.col("p") - F.col("h"))
    return judge_pairs(spark, sf_dir).groupBy("questionnaire", "arm").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_abs_diff"), F.max(d).alias("largest")).select("questionnaire", "arm", "n", *r6("mean_abs_diff", "largest"))


@query(JP + ", x AS (SELECT questionnaire, method, iteration, persona_id, avg(p) FILTER (k=0) AS a0, avg(p) FILTER (k=5) AS a5, avg(h) FILTER (k=0) AS b0, avg(h) FILTER (k=5) AS b5 FROM (SELECT *, arm[1:1] AS method, arm[4:4]::INT AS k FROM jp) GROUP BY ALL) SELECT questionnaire, method, iteration, count(*) AS n, " + sql6("avg(a0-a5) AS d_primary", "avg(b0-b5) AS d_judge") + ", sign(round(avg(a0-a5),9))=sign(round(avg(b0-b5),9)) AS same_sign FROM x WHERE a0 IS NOT NULL AND a5 IS NOT NULL GROUP BY ALL")
def contrast_preservation(spark, sf_dir):
    """One contrast under each grader on shared units, and whether its sign is kept."""
    by = ["questionnaire", "method", "iteration"]
    side = lambda c, k: F.avg(F.when(F.col("k") == k, F.col(c)))
    x = judge_pairs(spark, sf_dir).groupBy(*by, "persona_id").agg((side("p", 0) - side("p", 5)).alias("a"), (side("h", 0) - side("h", 5)).alias("b")).where("a IS NOT NULL")
    g = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("d_primary"), F.avg("b").alias("d_judge"))
    return g.select(*by, "n", *r6("d_primary", "d_judge"), (F.signum(F.round("d_primary", 9)) == F.signum(F.round("d_judge", 9))).alias("same_sign"))


@query(JP + ", m AS (SELECT arm, iteration, questionnaire, avg(p) AS p, avg(h) AS h FROM jp GROUP BY ALL) SELECT arm, iteration, " + ", ".join(sql6(f"max({c}) FILTER (questionnaire='{q}') AS {q}_{n}") for q in ("click", "view") for c, n in (("p", "primary"), ("h", "judge"))) + " FROM m GROUP BY ALL")
def arm_means_by_judge(spark, sf_dir):
    """States by rubric and grader, side by side."""
    m = judge_pairs(spark, sf_dir).groupBy("arm", "iteration", "questionnaire").agg(F.avg("p").alias("primary"), F.avg("h").alias("judge"))
    long = reshape.to_long(m, ["arm", "iteration", "questionnaire"], ["primary", "judge"], "grader", "mean")
    names = [f"{q}_{g}" for q in ("click", "view") for g in ("primary", "judge")]
    wide = reshape.to_wide(long.withColumn("name", F.concat_ws("_", "questionnaire", "grader")), ["arm", "iteration"], "name", names, "mean")
    return wide.select("arm", "iteration", *r6(*names))


@query(JP + ", r AS (SELECT questionnaire, corr(p,h) AS r FROM jp GROUP BY ALL), h AS (SELECT questionnaire, corr(p,h) FILTER (persona_id%2=0) AS r1, corr(p,h) FILTER (persona_id%2=1) AS r2 FROM jp GROUP BY ALL) SELECT questionnaire, " + sql6("r", "sqrt(greatest(r1,0)*greatest(r2,0)) AS ceiling", "r/nullif(sqrt(greatest(r1,0)*greatest(r2,0)),0) AS of_ceiling") + " FROM r JOIN h USING (questionnaire)")
def attenuation_ceiling(spark, sf_dir):
    """Agreement against the largest that two reliabilities allow."""
    jp = judge_pairs(spark, sf_dir)
    half = lambda m: F.corr(F.when(F.col("persona_id") % 2 == m, F.col("p")), F.when(F.col("persona_id") % 2 == m, F.col("h")))
    g = jp.groupBy("questionnaire").agg(F.corr("p", "h").alias("r"), half(0).alias("r1"), half(1).alias("r2")).withColumn("ceiling", reliability.attenuation_ceiling("r1", "r2"))
    return g.select("questionnaire", *r6("r", "ceiling", of_ceiling=ratio("r", "ceiling")))


@query(S + ", q AS (SELECT questionnaire, arm||'|'||iteration AS t, judge, avg(score) AS v, count(*) AS nn FROM j GROUP BY ALL), kt AS (SELECT questionnaire, count(DISTINCT judge) AS k FROM q GROUP BY ALL), pt AS (SELECT questionnaire, t, count(*) AS own, avg(v) AS tm FROM q GROUP BY ALL), wt AS (SELECT pt.*, k FROM pt JOIN kt USING (questionnaire) WHERE own=k), rw AS (SELECT q.*, tm FROM q JOIN wt USING (questionnaire, t)), cm AS (SELECT questionnaire, judge, avg(v) AS cm FROM rw GROUP BY ALL), gm AS (SELECT questionnaire, k, count(*) AS n, avg(tm) AS gm FROM wt GROUP BY ALL), ms AS (SELECT rw.questionnaire, max(gm.n) AS n, max(k) AS k, sum(power(tm-gm,2))/(max(gm.n)-1) AS msr, sum(power(v-tm-cm+gm,2))/((max(gm.n)-1)*(max(k)-1)) AS mse FROM rw JOIN cm USING (questionnaire, judge) JOIN gm ON gm.questionnaire=rw.questionnaire GROUP BY rw.questionnaire), vc AS (SELECT questionnaire, greatest((msr-mse)/k,0) AS va, greatest(mse,0) AS ve FROM ms) SELECT questionnaire, g.g AS n_graders, " + sql6("va/nullif(va+ve/g,0) AS dependability") + " FROM vc, (SELECT unnest([1,2,4]) AS g) g")
def dependability(spark, sf_dir):
    """How far a state's mean can be relied on with so many graders."""
    j = cells(spark, sf_dir, "judge").withColumn("target", F.concat_ws("|", "arm", "iteration"))
    v = reliability.variance_components(j, ["questionnaire"], "target", "judge").withColumn("n_graders", F.explode(F.array(*map(F.lit, (1, 2, 4)))))
    return v.select("questionnaire", "n_graders", *r6(dependability=ratio("var_target", F.col("var_target") + F.col("var_resid") / F.col("n_graders"))))


@query(S + ", w AS (SELECT arm, iteration, persona_id, avg(score) FILTER (questionnaire='click') AS a, avg(score) FILTER (questionnaire='view') AS b FROM c GROUP BY ALL), k AS (SELECT * FROM w WHERE a IS NOT NULL AND b IS NOT NULL), r AS (SELECT corr(a,b) AS r FROM k) SELECT component, " + sql6("CASE component WHEN 1 THEN (1+abs(r))/2 ELSE (1-abs(r))/2 END AS explained") + " FROM r, (SELECT unnest([1,2]) AS component)")
def rubric_pca(spark, sf_dir):
    """Shares of variance of two standardised rubrics' components."""
    keys = ["arm", "iteration", "persona_id"]
    wide = reshape.to_wide(cells(spark, sf_dir), keys, "questionnaire", ["click", "view"], "score").dropna(subset=["click", "view"])
    return reliability.components_of(wide, ["click", "view"]).select("component", *r6("explained"))


def rubric_factor_space(spark, sf_dir):
    """Loadings of four rubrics on their first two components; signs are set so that the largest loading is positive."""
    names = ["click", "view", "purchase", "error"]
    wide = reshape.to_wide(cells(spark, sf_dir), ["arm", "iteration"], "questionnaire", names, "score").dropna(subset=names)
    return reliability.components_of(wide, names).where("component <= 2")


query()(rubric_factor_space)
