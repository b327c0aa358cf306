"""Queries on what a training run learned from: reward spread, weights, tails, preference directions and their link to outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import cosine, end_reason, partial_correlation, ratio, spearman_brown
from ..operators import hypothesis, resample, training, vectors
from .studies import _GF, _WT, _trained
from .views import G, S, cells, generations, query, r6, scores_long, sql6, table

GROUP = training.GROUP
_T = G + ", t AS (SELECT * FROM g WHERE phase<>'eval')"


# --- rewards ---------------------------------------------------------------------------------------------------------


@query(_T + " SELECT arm, train_iter, group_id, cand_idx, " + sql6("score") + " FROM t WHERE score IS NOT NULL")
def reward_distribution(spark, sf_dir):
    return _trained(spark, sf_dir).where("score IS NOT NULL").select(*GROUP, "cand_idx", *r6("score"))


@query(_GF + "SELECT arm, train_iter, count(*) AS n_groups, " + sql6("avg(sd0) AS mean_std", "avg(margin) AS mean_range", "avg((sd0<1e-6)::INT) AS frac_flat", "quantile_cont(margin,0.5) AS median_margin") + " FROM gf WHERE n_scored>=1 GROUP BY ALL")
def advantage_signal(spark, sf_dir):
    """How much a group's scores differ: what the gradient sees."""
    g = training.group_frame(_trained(spark, sf_dir)).where("n_scored >= 1")
    out = g.groupBy("arm", "train_iter").agg(F.count(F.lit(1)).alias("n_groups"), F.avg("sd0").alias("mean_std"), F.avg("margin").alias("mean_range"), F.avg((F.col("sd0") < 1e-6).cast("int")).alias("frac_flat"), F.percentile("margin", 0.5).alias("median_margin"))
    return out.select("arm", "train_iter", "n_groups", *r6("mean_std", "mean_range", "frac_flat", "median_margin"))


@query(_T + ", k AS (SELECT arm, train_iter, score, row_number() OVER (PARTITION BY arm, train_iter ORDER BY md5('77|'||group_id||'|'||cand_idx), group_id, cand_idx, score)-1 AS r FROM t WHERE score IS NOT NULL), d AS (SELECT arm, train_iter, r//4 AS draw, count(*) AS n, max(score)-min(score) AS margin, stddev_pop(score) AS sd FROM k GROUP BY ALL) SELECT arm, train_iter, count(*) AS n_groups, " + sql6("avg(margin) AS margin", "avg(sd) AS sd") + " FROM d WHERE n=4 GROUP BY ALL")
def shuffle_null_hash(spark, sf_dir):
    """Margin and deviation when scores are dealt over groups by hash: what no group effect would give."""
    rows = _trained(spark, sf_dir).where("score IS NOT NULL")
    d = resample.shuffled_groups(rows, ["arm", "train_iter"], ["group_id", "cand_idx"], 4, 77, ties=["score"])
    g = d.groupBy("arm", "train_iter", "draw").agg(F.count(F.lit(1)).alias("n"), (F.max("score") - F.min("score")).alias("margin"), F.stddev_pop("score").alias("sd")).where("n = 4")
    out = g.groupBy("arm", "train_iter").agg(F.count(F.lit(1)).alias("n_groups"), F.avg("margin").alias("margin"), F.avg("sd").alias("sd"))
    return out.select("arm", "train_iter", "n_groups", *r6("margin", "sd"))


@query("WITH d AS (SELECT b//4 AS draw, sqrt(-2*ln((('0x'||md5('5|'||b)[1:8])::BIGINT+1)/4294967297.0::DOUBLE))*cos(2*pi()*(('0x'||md5('5|'||b)[9:16])::BIGINT/4294967296.0::DOUBLE)) AS x FROM (SELECT unnest(range(20000)) AS b)), g AS (SELECT draw, max(x)-min(x) AS margin, stddev_pop(x) AS sd FROM d GROUP BY ALL) SELECT count(*) AS n, " + sql6("avg(margin) AS margin", "avg(sd) AS sd", "avg(margin)/avg(sd) AS margin_per_sd") + " FROM g")
def iid_expectation(spark, sf_dir):
    """Mean range and deviation of groups of four independent normal draws, from hashes."""
    h = F.md5(F.concat_ws("|", F.lit("5"), F.col("id").cast("string")))
    u = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("double")
    x = F.sqrt(-2 * F.ln((u(1) + 1) / 4294967297.0)) * F.cos(2 * F.pi() * (u(9) / 4294967296.0))
    d = spark.range(20000).select(F.floor(F.col("id") / 4).alias("draw"), x.alias("x"))
    g = d.groupBy("draw").agg((F.max("x") - F.min("x")).alias("margin"), F.stddev_pop("x").alias("sd"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg("margin").alias("margin"), F.avg("sd").alias("sd")).select("n", *r6("margin", "sd", margin_per_sd=ratio("margin", "sd")))


# --- weights -----------------------------------------------------------------------------------------------------------

_PW = G + """, t AS (SELECT * FROM g WHERE phase<>'eval' AND score IS NOT NULL), z AS (SELECT *, row_number() OVER (PARTITION BY arm, train_iter, group_id ORDER BY score DESC, cand_idx) AS top, row_number() OVER (PARTITION BY arm, train_iter, group_id ORDER BY score, cand_idx) AS low, max(score) OVER (PARTITION BY arm, train_iter, group_id) AS hi, min(score) OVER (PARTITION BY arm, train_iter, group_id) AS lo FROM t),
pw AS (SELECT *, CASE WHEN top=1 THEN 1.0 WHEN low=1 THEN -1.0 ELSE 0.0 END AS weight FROM z WHERE hi<>lo) """


@query(_PW + "SELECT arm, train_iter, group_id, cand_idx, " + sql6("weight") + " FROM pw WHERE weight<>0")
def weights_dpo(spark, sf_dir):
    """Plus one for the best and minus one for the worst of a group, first occurrence on ties."""
    return training.pair_weights(_trained(spark, sf_dir)).where("weight <> 0").select(*GROUP, "cand_idx", *r6("weight"))


@query(_WT.replace("wt AS", "wg AS") + ", z2 AS (SELECT *, row_number() OVER (PARTITION BY arm, train_iter, group_id ORDER BY score DESC, cand_idx) AS top, row_number() OVER (PARTITION BY arm, train_iter, group_id ORDER BY score, cand_idx) AS low FROM t), pw AS (SELECT arm, train_iter, group_id, cand_idx, CASE WHEN top=1 THEN 1.0 WHEN low=1 THEN -1.0 ELSE 0.0 END AS w FROM z2), x AS (SELECT wg.*, w FROM wg JOIN pw USING (arm, train_iter, group_id, cand_idx)) SELECT arm, train_iter, count(*) AS n, " + sql6("avg(weight*w) AS overlap", "sum(weight*w)/nullif(sqrt(sum(weight*weight)*sum(w*w)),0) AS cosine") + " FROM x GROUP BY ALL")
def reweight_agreement(spark, sf_dir):
    """How alike the two rules weigh the same candidates."""
    t = _trained(spark, sf_dir)
    pair = training.pair_weights(t).select(*GROUP, "cand_idx", F.col("weight").alias("w"))
    x = training.standardised_weights(t).join(pair, [*GROUP, "cand_idx"])
    w, v = F.col("weight"), F.col("w")
    g = x.groupBy("arm", "train_iter").agg(F.count(F.lit(1)).alias("n"), F.avg(w * v).alias("overlap"), ratio(F.sum(w * v), F.sqrt(F.sum(w * w) * F.sum(v * v))).alias("cosine"))
    return g.select("arm", "train_iter", "n", *r6("overlap", "cosine"))


@query(_T + ", k AS (SELECT *, max(score) OVER w AS hi, min(score) OVER w AS lo, count(*) OVER w AS n FROM t WHERE score IS NOT NULL WINDOW w AS (PARTITION BY arm, train_iter, group_id)), c AS (SELECT arm, train_iter, group_id, max((score,cand_idx))[2] AS pick FROM t WHERE score IS NOT NULL GROUP BY ALL), x AS (SELECT k.*, cand_idx=pick AS chosen FROM k JOIN c USING (arm, train_iter, group_id) WHERE n>=2) SELECT arm, train_iter, count(*) FILTER (chosen) AS n_groups, " + sql6("100.0*avg((score=hi)::INT) FILTER (chosen) AS pct_at_max", "100.0*avg((hi=lo)::INT) FILTER (chosen) AS pct_tied") + " FROM x GROUP BY ALL")
def rule_reconstruction(spark, sf_dir):
    """Whether the recorded pick is a group's best, and how often all of a group tie."""
    w = Window.partitionBy(*GROUP)
    k = _trained(spark, sf_dir).where("score IS NOT NULL").withColumns({"hi": F.max("score").over(w), "lo": F.min("score").over(w), "n": F.count(F.lit(1)).over(w), "pick": F.max(F.struct("score", "cand_idx")).over(w)["cand_idx"]})
    x = k.where((F.col("n") >= 2) & (F.col("cand_idx") == F.col("pick")))
    g = x.groupBy("arm", "train_iter").agg(F.count(F.lit(1)).alias("n_groups"), (100.0 * F.avg((F.col("score") == F.col("hi")).cast("int"))).alias("pct_at_max"), (100.0 * F.avg((F.col("hi") == F.col("lo")).cast("int"))).alias("pct_tied"))
    return g.select("arm", "train_iter", "n_groups", *r6("pct_at_max", "pct_tied"))


@query(_T + ", i AS (SELECT DISTINCT arm, train_iter, group_id FROM t), k AS (SELECT *, row_number() OVER (PARTITION BY arm, train_iter ORDER BY md5('9|'||group_id), group_id) AS r FROM i) SELECT arm, train_iter, group_id FROM k WHERE r<=20")
def sample_groups(spark, sf_dir):
    """Up to twenty groups of an arm's iteration, first by hash: a sampling operator, so the number is the feature."""
    ids = _trained(spark, sf_dir).select(*GROUP).distinct()
    key = F.md5(F.concat_ws("|", F.lit("9"), F.col("group_id").cast("string")))
    return ids.withColumn("r", F.row_number().over(Window.partitionBy("arm", "train_iter").orderBy(key, "group_id"))).where("r <= 20").select(*GROUP)


@query(_T + ", gm AS (SELECT arm, train_iter, group_id, count(score) AS n, max(score)-min(score) AS margin FROM t GROUP BY ALL) SELECT arm, train_iter, count(*) AS built, count(*) FILTER (n>=2 AND margin>0.1) AS trained, " + sql6("100.0*avg((n>=2 AND coalesce(margin,0)>0.1)::INT) AS pct", "avg(margin) FILTER (n>=2 AND margin>0.1) AS mean_margin") + " FROM gm GROUP BY ALL")
def pair_yield_by_iter(spark, sf_dir):
    """Groups built and those whose best and worst are far enough apart to train on."""
    g = training.group_frame(_trained(spark, sf_dir))
    ok = F.coalesce((F.col("n_scored") >= 2) & (F.col("margin") > 0.1), F.lit(False))
    out = g.groupBy("arm", "train_iter").agg(F.count(F.lit(1)).alias("built"), F.count_if(ok).alias("trained"), (100.0 * F.avg(ok.cast("int"))).alias("pct"), F.avg(F.when(ok, F.col("margin"))).alias("mean_margin"))
    return out.select("arm", "train_iter", "built", "trained", *r6("pct", "mean_margin"))


@query(_T + ", p AS (SELECT arm, train_iter, group_id, max((score,cand_idx)) AS b, min((score,cand_idx)) AS w, max(score)-min(score) AS gap FROM t WHERE score IS NOT NULL GROUP BY ALL HAVING count(*)>=2), r AS (SELECT *, row_number() OVER (PARTITION BY arm, train_iter ORDER BY gap DESC, group_id) AS rk FROM p) SELECT arm, train_iter, rk AS rank, group_id, b[2] AS chosen_idx, w[2] AS rejected_idx, " + sql6("gap") + " FROM r WHERE rk<=3")
def pref_examples(spark, sf_dir):
    """The three groups with the largest gap of an arm's iteration."""
    p = training.best_and_worst(_trained(spark, sf_dir), tau=-1.0)
    order = Window.partitionBy("arm", "train_iter").orderBy(F.col("margin").desc(), "group_id")
    return p.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("arm", "train_iter", "rank", "group_id", "chosen_idx", "rejected_idx", *r6(gap=F.col("margin")))


@query(_T + " SELECT phase, count(*) AS n FROM g GROUP BY ALL")
def eval_phase_filter(spark, sf_dir):
    return generations(spark, sf_dir).groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


# --- nested records ----------------------------------------------------------------------------------------------------


def _candidate(c):
    """A candidate as a log holds it, from its number, score and realized turns."""
    turns = c["turns"]
    tail = F.when(turns > 0, F.concat(F.lit("[PATIENT] a"), F.when(turns % 2 == 1, F.lit(" ")).otherwise(F.lit(""))))
    return F.struct(
        c["idx"].alias("idx"), F.concat(F.lit("text "), c["idx"].cast("string")).alias("completion"), c["score"].alias("score"), F.create_map(F.lit("Q1"), c["score"], F.lit("Q2"), c["score"] / 2).alias("sub_scores"),
        F.struct(F.lit(5).alias("k"), turns.alias("realized_turns"), (turns < 5).alias("ended_early"), tail.alias("tail")).alias("lookahead"),
    )


def branches(spark, sf_dir, fields: str = training.BRANCH) -> DataFrame:
    """A record per group with its candidates nested, as a log holds them, parsed from its JSON text into the fields asked for.

    Three numbers a candidate are shuffled and the rest is written after it; the group's number leads the keys, as most groups differ in it when they are sorted.
    """
    numbers = F.struct(F.col("cand_idx").cast("int").alias("idx"), "score", F.col("realized_turns").cast("int").alias("turns"))
    rec = generations(spark, sf_dir).groupBy("group_id", "train_iter", "arm").agg(F.collect_list(numbers).alias("numbers"))
    text = F.to_json(F.struct(F.col("arm").alias("method"), F.col("train_iter").alias("iteration"), F.lit("train").alias("phase"), F.col("group_id").alias("branch_id"), F.lit("[THERAPIST] a\n\n[PATIENT] b").alias("prefix"), F.lit(1).alias("chosen_idx"), F.transform("numbers", _candidate).alias("candidates")))
    return rec.select(F.from_json(text, fields).alias("r")).select("r.*")


@query(G + "SELECT arm AS method, train_iter, train_iter-1 AS eval_iter, group_id AS branch_id, cand_idx, realized_turns, cand_idx=1 AS is_chosen, coalesce(realized_turns<5,false) AS early, " + sql6("score", "score AS q1", "score/2 AS q2") + " FROM g")
def flatten_candidates(spark, sf_dir):
    """Nested records to a row per candidate."""
    f = training.flatten(branches(spark, sf_dir))
    return f.select("method", "train_iter", "eval_iter", F.col("branch_id").cast("long").alias("branch_id"), "cand_idx", "realized_turns", "is_chosen", F.coalesce("ended_early", F.lit(False)).alias("early"), *r6("score", "q1", "q2"))


@query(G + "SELECT arm AS method, train_iter AS iteration, group_id AS branch_id, 2::INT AS n_turns, " + sql6("max(score) AS proxy_max", "avg(score) AS proxy_mean", "max(score) FILTER (cand_idx=1) AS proxy_chosen") + " FROM g GROUP BY ALL")
def branch_reliability(spark, sf_dir):
    """A record's length in turns and its proxy score: best, mean or chosen candidate."""
    b = branches(spark, sf_dir, training.BRANCH_SCORES)
    scores = F.col("candidates.score")
    known = F.filter(scores, lambda x: x.isNotNull())
    chosen = F.array_max(F.filter("candidates", lambda c: c["idx"] == F.col("chosen_idx"))["score"])
    turns = F.regexp_count("prefix", F.lit(r"(?m)^\[(?:THERAPIST|PATIENT)\]")).cast("int")
    mean = ratio(F.aggregate(known, F.lit(0.0), lambda s, x: s + x), F.size(known))
    return b.select("method", "iteration", F.col("branch_id").cast("long").alias("branch_id"), turns.alias("n_turns"), *r6(proxy_max=F.array_max(scores), proxy_mean=mean, proxy_chosen=chosen))


@query(G + "SELECT arm AS method, train_iter AS iteration, count(DISTINCT group_id) AS n_records, count(*) AS n_candidates, count(score) AS n_scored, " + sql6("avg(score) AS mean_score") + ", sum(ceil(coalesce(realized_turns,0)/2.0))::BIGINT AS tail_calls FROM g GROUP BY ALL")
def stream_record_stats(spark, sf_dir):
    """Records, candidates and calls of an arm's iteration, from the nested records."""
    f = training.flatten(branches(spark, sf_dir))
    g = f.groupBy("method", F.col("train_iter").alias("iteration")).agg(F.count_distinct("branch_id").alias("n_records"), F.count(F.lit(1)).alias("n_candidates"), F.count("score").alias("n_scored"), F.avg("score").alias("mean_score"), F.sum(F.ceil(F.coalesce("realized_turns", F.lit(0)) / 2)).cast("long").alias("tail_calls"))
    return g.select("method", "iteration", "n_records", "n_candidates", "n_scored", *r6("mean_score"), "tail_calls")


# --- tails -------------------------------------------------------------------------------------------------------------

_TAIL = G + ", tl AS (SELECT *, CASE WHEN realized_turns IS NULL THEN 'not_simulated' WHEN realized_turns>=5 THEN 'full' WHEN realized_turns=0 THEN 'no_tail' WHEN realized_turns%2=1 THEN 'patient_closed' ELSE 'after_therapist' END AS reason FROM g)"


def _tails(records: DataFrame) -> DataFrame:
    """A row per candidate: score, realized_turns and why its tail ended, beside the other columns of its record."""
    rows = records.withColumn("c", F.explode("candidates"))
    turns = F.col("c.lookahead.realized_turns")
    return rows.withColumns({"score": F.col("c.score"), "realized_turns": turns, "reason": end_reason(turns, F.col("c.lookahead.tail"), 5)}).drop("c", "candidates")


@query(_TAIL + " SELECT arm AS method, coalesce(train_iter::VARCHAR,'pooled') AS iteration, count(*) AS n, " + sql6("avg((reason='full')::INT) AS full_share", "avg((reason IN ('patient_closed','after_therapist'))::INT) AS early_share", "avg((reason='not_simulated')::INT) AS missing_share", "avg(realized_turns) AS mean_turns", "avg(score) FILTER (reason='full') AS full_score", "avg(score) FILTER (reason IN ('patient_closed','after_therapist')) AS early_score") + " FROM tl GROUP BY GROUPING SETS ((arm, train_iter), (arm))")
def tail_audit_by_iter(spark, sf_dir):
    """How simulated tails end and what they score, with a pooled row from rows."""
    t = _tails(branches(spark, sf_dir, training.BRANCH_TAILS)).withColumnRenamed("iteration", "train_iter")
    full, early = F.col("reason") == "full", F.col("reason").isin("patient_closed", "after_therapist")
    g = t.groupingSets([["method", "train_iter"], ["method"]], "method", "train_iter").agg(
        F.count(F.lit(1)).alias("n"), F.avg(full.cast("int")).alias("full_share"), F.avg(early.cast("int")).alias("early_share"), F.avg((F.col("reason") == "not_simulated").cast("int")).alias("missing_share"),
        F.avg("realized_turns").alias("mean_turns"), F.avg(F.when(full, F.col("score"))).alias("full_score"), F.avg(F.when(early, F.col("score"))).alias("early_score"))
    return g.select("method", F.coalesce(F.col("train_iter").cast("string"), F.lit("pooled")).alias("iteration"), "n", *r6("full_share", "early_share", "missing_share", "mean_turns", "full_score", "early_score"))


@query(_TAIL + ", k AS (SELECT *, score - avg(score) OVER w AS dev, realized_turns - avg(realized_turns) OVER w AS dt FROM tl WHERE score IS NOT NULL AND realized_turns IS NOT NULL WINDOW w AS (PARTITION BY arm, train_iter, group_id)) SELECT arm AS method, count(*) AS n, " + sql6("corr(dev,dt) AS within_r", "avg(dev) FILTER (reason='full') AS dev_full", "avg(dev) FILTER (reason<>'full') AS dev_other") + " FROM k GROUP BY ALL")
def tail_within_group(spark, sf_dir):
    """Score against length of tail within groups; a record holds all of its group, so its means need no second shuffle."""
    both = F.filter("candidates", lambda c: c["score"].isNotNull() & c["lookahead"]["realized_turns"].isNotNull())
    mean = lambda xs: ratio(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x), F.size(xs))
    b = branches(spark, sf_dir, training.BRANCH_TAILS).select("method", both.alias("candidates"))
    b = b.withColumns({"mean_score": mean(F.col("candidates.score")), "mean_turns": mean(F.col("candidates.lookahead.realized_turns"))})
    k = _tails(b).withColumns({"dev": F.col("score") - F.col("mean_score"), "dt": F.col("realized_turns") - F.col("mean_turns")})
    side = lambda c: F.avg(F.when(c, F.col("dev")))
    g = k.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.corr("dev", "dt").alias("within_r"), side(F.col("reason") == "full").alias("dev_full"), side(F.col("reason") != "full").alias("dev_other"))
    return g.select("method", "n", *r6("within_r", "dev_full", "dev_other"))


_API = G + ", ap AS (SELECT arm, train_iter, count(*) AS cand, count(score) AS scored, sum(ceil(coalesce(realized_turns,0)/2.0))::BIGINT AS tails FROM g GROUP BY ALL)"


@query(_API + ", w AS (SELECT unnest(['early','late','all']) AS win, unnest([1992,1996,1992]) AS lo, unnest([1995,2003,2003]) AS hi), x AS (SELECT win, arm, sum(scored+tails) AS calls FROM ap JOIN w ON train_iter BETWEEN lo AND hi GROUP BY ALL) SELECT a.win AS span, a.calls::BIGINT AS calls_a, b.calls::BIGINT AS calls_b, " + sql6("b.calls::DOUBLE/a.calls AS ratio") + " FROM x a JOIN x b USING (win) WHERE a.arm='AF' AND b.arm='NO'")
def api_ratio(spark, sf_dir):
    """Calls of two arms over spans of iterations, a short list joined by range."""
    ap = training.call_counts(generations(spark, sf_dir), ["arm", "train_iter"]).withColumn("calls", F.col("scored") + F.col("tail_calls"))
    spans = spark.createDataFrame([("early", 1992, 1995), ("late", 1996, 2003), ("all", 1992, 2003)], "span string, lo int, hi int")
    x = ap.join(F.broadcast(spans), F.col("train_iter").between(F.col("lo"), F.col("hi"))).where("arm IN ('AF', 'NO')")
    side = lambda a: F.sum(F.when(F.col("arm") == a, F.col("calls")))
    g = x.groupBy("span").agg(side("AF").alias("calls_a"), side("NO").alias("calls_b")).where("calls_a IS NOT NULL AND calls_b IS NOT NULL")
    return g.select("span", "calls_a", "calls_b", *r6(ratio=ratio("calls_b", "calls_a")))


# --- directions ----------------------------------------------------------------------------------------------------------

_E = "WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding,1) AS dim FROM embeddings)"


def _unit_sql(name: str, where: str, by: str = "label") -> str:
    return f", {name}0 AS (SELECT {by}, dim, sum(CASE WHEN vec_id%2=0 THEN v ELSE -v END) AS s FROM e WHERE {where} GROUP BY ALL), {name} AS (SELECT {by}, dim, s/nullif(sqrt(sum(s*s) OVER (PARTITION BY {by})),0) AS u FROM {name}0)"


def _sign():
    return F.when(F.col("vec_id") % 2 == 0, 1.0).otherwise(-1.0)


@query(_E + _unit_sql("a", "(vec_id//2)%2=0") + _unit_sql("b", "(vec_id//2)%2=1") + ", x AS (SELECT a.label, sum(a.u*b.u) AS c FROM a JOIN b USING (label, dim) GROUP BY ALL) SELECT label, " + sql6("c AS split_half", "2*c/nullif(1+c,0) AS reliability") + " FROM x")
def split_half_cosine(spark, sf_dir):
    """Directions of two halves, how alike they are, and the reliability of the whole."""
    e = table(spark, sf_dir, "embeddings").withColumn("half", F.floor(F.col("vec_id") / 2) % 2)
    d = vectors.direction(e, ["label", "half"], _sign())
    side = lambda h: F.max(F.when(F.col("half") == h, F.col("direction")))
    g = d.groupBy("label").agg(side(0).alias("x"), side(1).alias("y")).withColumn("c", cosine("x", "y"))
    return g.select("label", *r6(split_half=F.col("c"), reliability=spearman_brown("c")))


@query(_E + _unit_sql("a", "(vec_id//2)%2=0") + ", p AS (SELECT e.label, vec_id, sum(v*u) AS pr FROM e JOIN a USING (label, dim) WHERE (vec_id//2)%2=1 GROUP BY ALL) SELECT label, count(*) AS n, " + sql6("avg((pr>0)::INT) FILTER (vec_id%2=0) AS held_out_wins", "avg(pr) FILTER (vec_id%2=0)-avg(pr) FILTER (vec_id%2=1) AS gap") + " FROM p GROUP BY ALL")
def direction_quality(spark, sf_dir):
    """A direction from one half tried on the other."""
    e = table(spark, sf_dir, "embeddings").withColumn("half", F.floor(F.col("vec_id") / 2) % 2)
    p = vectors.projections(e.where("half = 1"), vectors.direction(e.where("half = 0"), ["label"], _sign()), ["label"])
    even = F.col("vec_id") % 2 == 0
    g = p.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(even, (F.col("projection") > 0).cast("int"))).alias("held_out_wins"), (F.avg(F.when(even, F.col("projection"))) - F.avg(F.when(~even, F.col("projection")))).alias("gap"))
    return g.select("label", "n", *r6("held_out_wins", "gap"))


@query(_E + _unit_sql("d", "label<5") + ", c0 AS (SELECT label AS concept, dim, avg(v) AS m FROM e WHERE label>=5 GROUP BY ALL) SELECT label, concept, " + sql6("sum(u*m) AS projection") + " FROM d JOIN c0 USING (dim) GROUP BY ALL")
def category_projection(spark, sf_dir):
    """Directions on the mean vectors of concepts."""
    e = table(spark, sf_dir, "embeddings")
    d = vectors.direction(e.where("label < 5"), ["label"], _sign()).select("label", F.posexplode("direction").alias("dim", "u"))
    c = e.where("label >= 5").select(F.col("label").alias("concept"), F.posexplode("embedding").alias("dim", "v")).groupBy("concept", "dim").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return d.join(c, "dim").groupBy("label", "concept").agg(F.sum(F.col("u") * F.col("m")).alias("projection")).select("label", "concept", *r6("projection"))


_WP = _E + _unit_sql("d", "label<5") + ", pr AS (SELECT d.label, e.vec_id, sum(v*u) AS p FROM e JOIN d ON d.dim=e.dim WHERE e.label>=5 GROUP BY ALL)"


def _word_projections(spark, sf_dir) -> DataFrame:
    """Every vector of the upper labels, as a word, on every direction of the lower ones: few directions against many words."""
    e = table(spark, sf_dir, "embeddings")
    d = vectors.direction(e.where("label < 5"), ["label"], _sign()).select("label", "direction")
    return vectors.on_each(e.where("label >= 5").select("vec_id", "embedding"), d)


@query(_WP + ", r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY p DESC, vec_id) AS hi, row_number() OVER (PARTITION BY label ORDER BY p, vec_id) AS lo FROM pr) SELECT label, vec_id, CASE WHEN hi<=3 THEN 'top' ELSE 'bottom' END AS side, " + sql6("p AS projection") + " FROM r WHERE hi<=3 OR lo<=3")
def top_words_by_iter(spark, sf_dir):
    """The three words furthest along each direction and against it."""
    p = _word_projections(spark, sf_dir)
    hi = F.row_number().over(Window.partitionBy("label").orderBy(F.col("projection").desc(), "vec_id"))
    lo = F.row_number().over(Window.partitionBy("label").orderBy("projection", "vec_id"))
    return p.withColumns({"hi": hi, "lo": lo}).where("hi <= 3 OR lo <= 3").select("label", "vec_id", F.when(F.col("hi") <= 3, "top").otherwise("bottom").alias("side"), *r6("projection"))


@query(_WP + ", s AS (SELECT b.label, a.vec_id, b.p-a.p AS gain FROM pr a JOIN pr b ON a.vec_id=b.vec_id AND b.label=a.label+1), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY gain DESC, vec_id) AS hi, row_number() OVER (PARTITION BY label ORDER BY gain, vec_id) AS lo FROM s) SELECT label, vec_id, CASE WHEN hi<=3 THEN 'learned' ELSE 'unlearned' END AS side, " + sql6("gain") + " FROM r WHERE hi<=3 OR lo<=3")
def learn_unlearn_words(spark, sf_dir):
    """The words that gained and lost most from one direction to the next."""
    p = _word_projections(spark, sf_dir)
    before = p.select((F.col("label") + 1).alias("label"), "vec_id", F.col("projection").alias("was"))
    s = p.join(before, ["label", "vec_id"]).withColumn("gain", F.col("projection") - F.col("was"))
    hi = F.row_number().over(Window.partitionBy("label").orderBy(F.col("gain").desc(), "vec_id"))
    lo = F.row_number().over(Window.partitionBy("label").orderBy("gain", "vec_id"))
    return s.withColumns({"hi": hi, "lo": lo}).where("hi <= 3 OR lo <= 3").select("label", "vec_id", F.when(F.col("hi") <= 3, "learned").otherwise("unlearned").alias("side"), *r6("gain"))


# --- outcomes ------------------------------------------------------------------------------------------------------------

_LINK = S + ", ft AS (SELECT arm, iteration, count(*)::DOUBLE AS n_rows, avg(score) AS level FROM s GROUP BY ALL), lv AS (SELECT arm, questionnaire, iteration, avg(score) AS m FROM c GROUP BY ALL), gn AS (SELECT *, m - lag(m) OVER (PARTITION BY arm, questionnaire ORDER BY iteration) AS gain FROM lv), lk AS (SELECT gn.arm, questionnaire, iteration, gain, n_rows, level FROM gn JOIN ft USING (arm, iteration) WHERE gain IS NOT NULL)"


def _links(spark, sf_dir) -> DataFrame:
    features = scores_long(spark, sf_dir).groupBy("arm", "iteration").agg(F.count(F.lit(1)).cast("double").alias("n_rows"), F.avg("score").alias("level"))
    level = cells(spark, sf_dir).groupBy("arm", "questionnaire", "iteration").agg(F.avg("score").alias("m"))
    gain = level.withColumn("gain", F.col("m") - F.lag("m").over(Window.partitionBy("arm", "questionnaire").orderBy("iteration"))).where("gain IS NOT NULL")
    return gain.join(features, ["arm", "iteration"])


@query(_LINK + " SELECT arm, questionnaire, iteration, " + sql6("gain", "n_rows", "level") + " FROM lk")
def link_to_outcomes(spark, sf_dir):
    """What an iteration was trained on against what it gained."""
    return _links(spark, sf_dir).select("arm", "questionnaire", "iteration", *r6("gain", "n_rows", "level"))


_RK = "rank() OVER (PARTITION BY questionnaire ORDER BY {0})+(count(*) OVER (PARTITION BY questionnaire,{0})-1)/2.0"


@query(_LINK + f", r AS (SELECT questionnaire, {_RK.format('gain')} AS x, {_RK.format('level')} AS y, {_RK.format('iteration')} AS z FROM lk), k AS (SELECT questionnaire, count(*) AS n, corr(x,y) AS xy, corr(x,z) AS xz, corr(y,z) AS yz FROM r GROUP BY ALL) SELECT questionnaire, n, " + sql6("xy AS rho", "xz AS trend", "(xy-xz*yz)/nullif(sqrt((1-xz*xz)*(1-yz*yz)),0) AS partial") + " FROM k WHERE n>=4")
def outcome_correlations(spark, sf_dir):
    """Rank correlation of gain and feature, with time, and without what time explains."""
    k = _links(spark, sf_dir)
    pair = lambda a, b, name: hypothesis.spearman(k, ["questionnaire"], a, b).select("questionnaire", "n", F.col("rho").alias(name))
    g = pair("gain", "level", "xy").join(pair("gain", "iteration", "xz").drop("n"), "questionnaire").join(pair("level", "iteration", "yz").drop("n"), "questionnaire").where("n >= 4")
    return g.select("questionnaire", "n", *r6(rho=F.col("xy"), trend=F.col("xz"), partial=partial_correlation("xy", "xz", "yz")))


@query("WITH l AS (SELECT o_orderpriority AS arm, o_orderdate::DATE AS d, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT arm, r AS rank, " + sql6("v AS score") + " FROM l WHERE r-1 IN (0, (n-1)//4, (n-1)//2, (n-1)*3//4, n-1)")
def sample_for_display(spark, sf_dir):
    """Evenly spaced rows of a sorted list."""
    o = table(spark, sf_dir, "orders").withColumn("arm", F.col("o_orderpriority"))
    w = Window.partitionBy("arm").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    k = o.withColumns({"rank": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy("arm"))})
    at = F.array(*(F.floor((F.col("n") - 1) * i / 4) for i in range(5)))
    return k.where(F.array_contains(at, (F.col("rank") - 1).cast("long"))).select("arm", "rank", *r6(score=F.col("o_totalprice")))


@query(G + ", b AS (SELECT arm, train_iter, group_id, (cand_idx-1)//2 AS block, cand_idx, score FROM g) SELECT arm, train_iter, group_id, block::BIGINT AS block, count(*) AS n, " + sql6("avg(score) AS mean", "stddev_pop(score) AS sd") + ", max((score, cand_idx)) FILTER (score IS NOT NULL)[2] AS chosen_idx FROM b GROUP BY ALL")
def generation_blocks(spark, sf_dir):
    """Flat rows cut in blocks of a fixed size: mean, deviation and the best of each, the later one on ties."""
    b = generations(spark, sf_dir).withColumn("block", F.floor((F.col("cand_idx") - 1) / 2))
    g = b.groupBy("arm", "train_iter", "group_id", "block").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"), F.max(F.when(F.col("score").isNotNull(), F.struct("score", "cand_idx")))["cand_idx"].alias("chosen_idx"))
    return g.select("arm", "train_iter", "group_id", "block", "n", *r6("mean", "sd"), "chosen_idx")


@query(_T + ", p AS (SELECT arm, train_iter, group_id, cand_idx, score, max((score,cand_idx)) OVER w AS b, min((score,cand_idx)) OVER w AS lo FROM t WHERE score IS NOT NULL WINDOW w AS (PARTITION BY arm, train_iter, group_id)) SELECT arm, train_iter, CASE WHEN b[1]-lo[1]<=0.1 THEN 'dropped' WHEN cand_idx=b[2] THEN 'chosen' WHEN cand_idx=lo[2] THEN 'rejected' ELSE 'neither' END AS role, count(*) AS n, " + sql6("avg(score) AS mean") + " FROM p GROUP BY ALL")
def branch_roles(spark, sf_dir):
    """Candidates as chosen, rejected or neither; groups too close to tell are dropped."""
    w = Window.partitionBy(*GROUP)
    k = _trained(spark, sf_dir).where("score IS NOT NULL").withColumns({"b": F.max(F.struct("score", "cand_idx")).over(w), "lo": F.min(F.struct("score", "cand_idx")).over(w)})
    role = F.when(F.col("b.score") - F.col("lo.score") <= 0.1, "dropped").when(F.col("cand_idx") == F.col("b.cand_idx"), "chosen").when(F.col("cand_idx") == F.col("lo.cand_idx"), "rejected").otherwise("neither")
    return k.groupBy("arm", "train_iter", role.alias("role")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean")).select("arm", "train_iter", "role", "n", *r6("mean"))
