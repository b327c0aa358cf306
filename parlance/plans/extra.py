"""Queries that bring several results together: selections from exports, channels at equal budget, pairs of vectors, features of training."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import cosine, ratio
from ..operators import compute as cost
from ..operators import paired, personas, vectors
from .costs import _NEAR, costs
from .scores import _P6, _R6, _contrast_sql, _holm_sql
from .sessions import _CH, _CHAN, _channels, shapes
from .signals import _E, _sign, _unit_sql
from .views import S, cells, query, r6, sql6, table


@query(S + ", a AS (SELECT arm, iteration, avg(score) AS w, stddev_samp(score)/sqrt(count(*)) AS se FROM c WHERE questionnaire='click' GROUP BY ALL), b AS (SELECT arm, iteration, avg(score) AS w, stddev_samp(score)/sqrt(count(*)) AS se FROM c WHERE questionnaire='view' GROUP BY ALL), u AS (SELECT *, 1 AS o FROM a WHERE iteration%2=0 UNION ALL SELECT *, 2 FROM b), f AS (SELECT arm, iteration, w, se, o FROM (SELECT *, row_number() OVER (PARTITION BY arm, iteration ORDER BY o) AS r FROM u) WHERE r=1), n AS (SELECT arm, iteration, count(*) AS n FROM c GROUP BY ALL) SELECT arm, iteration, iteration-1 AS policy_iteration, o AS source, n, " + sql6("w", "se", "w/nullif(se,0) AS w_over_se") + " FROM f LEFT JOIN n USING (arm, iteration)")
def selection_table(spark, sf_dir):
    """Two exports put together, the first one's rows where both have one, with the cell's size and the trained policy."""
    c = cells(spark, sf_dir)
    level = lambda q, o: c.where(F.col("questionnaire") == q).groupBy("arm", "iteration").agg(F.avg("score").alias("w"), (F.stddev_samp("score") / F.sqrt(F.count("score").cast("double"))).alias("se")).withColumn("source", F.lit(o))
    every = level("click", 1).where("iteration % 2 = 0").unionByName(level("view", 2))
    first = every.groupBy("arm", "iteration").agg(F.min_by(F.struct("w", "se", "source"), "source").alias("x")).select("arm", "iteration", "x.*")
    size = c.groupBy("arm", "iteration").agg(F.count(F.lit(1)).alias("n"))
    return first.join(size, ["arm", "iteration"], "left").select("arm", "iteration", (F.col("iteration") - 1).alias("policy_iteration"), "source", "n", *r6("w", "se", w_over_se=ratio("w", "se")))


_ISO = _NEAR + _CHAN[len(S) :] + ", cl AS (SELECT arm, iteration, persona_id, unnest(" + repr(list(_CH)) + ") AS channel, unnest([" + ", ".join(_CH) + "]) AS score FROM ch), x AS (SELECT ia, channel, persona_id, score AS a FROM cl JOIN nb ON ia=iteration WHERE arm='A_K0' AND score IS NOT NULL), y AS (SELECT ia, channel, persona_id, score AS b FROM cl JOIN nb ON ib=iteration WHERE arm='A_K5' AND score IS NOT NULL), pr0 AS (SELECT ia, channel, persona_id, a, b, a-b AS d FROM x JOIN y USING (ia, channel, persona_id))" + _contrast_sql("ia, channel", "SELECT * FROM pr0") + _holm_sql("ct", "ia", "channel")


@query(_ISO + f" SELECT ia AS iter_a, channel, n, n_nonzero, {_P6} FROM hm")
def iso_channels(spark, sf_dir):
    """Behaviour channels of states whose budgets are nearest, Holm over the channels."""
    from ..operators import reshape

    long = reshape.to_long(_channels(spark, sf_dir), ["arm", "iteration", "persona_id"], list(_CH), "channel", "score")
    near = cost.nearest_budget(costs(spark, sf_dir), "A_K0", "A_K5").select("iter_a", "iter_b")
    pairs = cost.pairs_at(long, near, "A_K0", "A_K5", ["channel"])
    by = ["iter_a", "channel"]
    return paired.holm(paired.of_pairs(pairs, by), ["iter_a"], tiebreak=["channel"]).select(*by, "n", "n_nonzero", *r6(*_R6))


@query("WITH e AS (SELECT vec_id, label, embedding FROM embeddings), p AS (SELECT a.vec_id AS chosen, b.vec_id AS rejected, a.label, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])/nullif(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))*sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])),0) AS cs FROM e a JOIN e b ON b.vec_id=a.vec_id+1 WHERE a.vec_id%2=0) SELECT chosen, rejected, label, " + sql6("cs AS cosine") + " FROM p")
def embed_pairs(spark, sf_dir):
    """Pairs with the vectors of both sides joined on and their cosine."""
    e = table(spark, sf_dir, "embeddings")
    a = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("chosen"), "label", F.col("embedding").alias("x"), (F.col("vec_id") + 1).alias("rejected"))
    b = e.select(F.col("vec_id").alias("rejected"), F.col("embedding").alias("y"))
    return a.join(b, "rejected").select("chosen", "rejected", "label", *r6(cosine=cosine("x", "y")))


@query(_E + ", e2 AS (SELECT *, label%2 AS arm FROM e)" + _unit_sql("d", "true", "arm").replace("FROM e WHERE", "FROM e2 WHERE") + ", p AS (SELECT e2.arm, vec_id, sum(v*u) AS pr FROM e2 JOIN d USING (arm, dim) GROUP BY ALL) SELECT arm, count(*) AS n, " + sql6("avg((pr>0)::INT) FILTER (vec_id%2=0) AS wins", "avg(pr) FILTER (vec_id%2=0)-avg(pr) FILTER (vec_id%2=1) AS gap") + " FROM p GROUP BY ALL")
def pooled_direction_quality(spark, sf_dir):
    """One direction for all iterations of an arm, and how well it tells the sides apart."""
    e = table(spark, sf_dir, "embeddings").withColumn("arm", F.col("label") % 2)
    p = vectors.projections(e, vectors.direction(e, ["arm"], _sign()), ["arm"])
    even = F.col("vec_id") % 2 == 0
    g = p.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(even, (F.col("projection") > 0).cast("int"))).alias("wins"), (F.avg(F.when(even, F.col("projection"))) - F.avg(F.when(~even, F.col("projection")))).alias("gap"))
    return g.select("arm", "n", *r6("wins", "gap"))


@query()
def sessions_with_personas(spark, sf_dir):
    """Sessions with the persona that stood at their place of the iteration; places outside the order get -1."""
    s = shapes(spark, sf_dir).select("conv_id", "arm", "iteration", F.col("persona_id").alias("file_index"))
    order = personas.persona_order(spark, 42, 5)
    return s.join(F.broadcast(order), ["iteration", "file_index"], "left").select("conv_id", "arm", "iteration", "file_index", F.coalesce("persona_id", F.lit(-1)).alias("persona_id"))


@query(S + ", l AS (SELECT arm, iteration, questionnaire, avg(score) AS m FROM c GROUP BY ALL), f AS (SELECT arm, iteration, count(*) AS n_rows FROM s GROUP BY ALL), d AS (SELECT arm, iteration, max(m)-min(m) AS spread FROM l GROUP BY ALL) SELECT f.arm, f.iteration, n_rows, " + sql6("spread", "spread - lag(spread) OVER (PARTITION BY f.arm ORDER BY f.iteration) AS change") + " FROM f LEFT JOIN d ON d.arm=f.arm AND d.iteration=f.iteration")
def preference_features_by_iter(spark, sf_dir):
    """Features of what an iteration was trained on, joined from several results."""
    from .views import scores_long

    n = scores_long(spark, sf_dir).groupBy("arm", "iteration").agg(F.count(F.lit(1)).alias("n_rows"))
    level = cells(spark, sf_dir).groupBy("arm", "iteration", "questionnaire").agg(F.avg("score").alias("m"))
    spread = level.groupBy("arm", "iteration").agg((F.max("m") - F.min("m")).alias("spread"))
    out = n.join(spread, ["arm", "iteration"], "left")
    return out.select("arm", "iteration", "n_rows", *r6("spread", change=F.col("spread") - F.lag("spread").over(Window.partitionBy("arm").orderBy("iteration"))))
