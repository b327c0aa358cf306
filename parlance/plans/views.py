"""The virtual tables that queries run on, from the tables of a data folder, and the same tables as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import paired

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
ARMS = ("A_K0", "A_K5", "B_K0", "B_K5")


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Results are rounded to ten digits first and moved off ties by less than their last one, so that the order of a float sum never
#: decides the sixth digit.
TIE = 3e-11


def _six(c: Column) -> Column:
    ten = F.round(c.cast("double"), 10)
    return F.round(ten + F.signum(ten) * TIE, 6) + F.lit(0.0)


def r6(*names: str, **named) -> list:
    """Columns rounded to six digits, with minus zero as zero."""
    return [_six(F.col(n)).alias(n) for n in names] + [_six(c).alias(n) for n, c in named.items()]


def sql6(*exprs: str) -> str:
    """SQL of the same: 'expr AS name' or 'name'."""
    out = []
    for e in exprs:
        body, _, name = e.rpartition(" AS ")
        ten = f"round(({body or name})::DOUBLE, 10)"
        out.append(f"round({ten} + sign({ten})*{TIE}, 6) + 0.0 AS {name}")
    return ", ".join(out)


def p_sql(z: str) -> str:
    """Two-sided normal p of a z, as SQL."""
    x = f"(abs({z})/sqrt(2.0))"
    t = f"(1.0/(1.0+0.3275911*{x}))"
    return f"least(1.0, (((((1.061405429*{t}-1.453152027)*{t}+1.421413741)*{t}-0.284496736)*{t}+0.254829592)*{t})*exp(-{x}*{x}))"


def scores_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per score: method, arm, k, iteration, is_base, judge, persona_id, questionnaire, score."""
    e = table(spark, sf_dir, "events")
    k4 = F.get_json_object("props", "$.k").cast("int") % 4
    arm = F.element_at(F.array(*map(F.lit, ARMS)), k4 + 1)
    iteration = F.floor((F.dayofmonth("ts") - 1) / 6).cast("int")
    return e.select(
        "event_id", F.col("user_id").alias("persona_id"), F.col("event_type").alias("questionnaire"), F.col("value").alias("score"), arm.alias("arm"),
        F.substring(arm, 1, 1).alias("method"), F.substring(arm, 4, 1).cast("int").alias("k"), iteration.alias("iteration"), (iteration == 0).alias("is_base"),
        (F.col("event_id") % 2).cast("int").alias("judge"),
    )


def cells(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Mean score per (more, arm, method, k, iteration, persona_id, questionnaire)."""
    keys = [*more, "arm", "method", "k", "iteration", "persona_id", "questionnaire"]
    return scores_long(spark, sf_dir).where("score IS NOT NULL").groupBy(*keys).agg(F.avg("score").alias("score"))


def ordered_cells(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """cells for queries that compare means for equality, with their first event_id: scores are added up in the order of their events."""
    keys = [*more, "arm", "method", "k", "iteration", "persona_id", "questionnaire"]
    return paired.means_in_order(scores_long(spark, sf_dir).where("score IS NOT NULL"), keys, "event_id", "score")


S = """WITH RECURSIVE s0 AS (SELECT event_id, user_id AS persona_id, event_type AS questionnaire, value AS score,
 (['A_K0','A_K5','B_K0','B_K5'])[1 + (json_extract_string(props,'$.k')::INT % 4)] AS arm, ((day(ts)-1)//6)::INT AS iteration, (event_id % 2)::INT AS judge FROM events),
s AS (SELECT *, arm[1:1] AS method, arm[4:4]::INT AS k, iteration = 0 AS is_base FROM s0),
c AS (SELECT arm, method, k, iteration, persona_id, questionnaire, avg(score) AS score FROM s GROUP BY ALL),
j AS (SELECT judge, arm, method, k, iteration, persona_id, questionnaire, avg(score) AS score FROM s GROUP BY ALL)
"""


def judge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arm, iteration, questionnaire, persona_id, p, h: what the primary and the held-out grader gave, where both did; event_id: the first of either."""
    j = ordered_cells(spark, sf_dir, "judge")
    g = j.groupBy("arm", "method", "k", "iteration", "questionnaire", "persona_id").agg(
        F.max(F.when(F.col("judge") == 0, F.col("score"))).alias("p"), F.max(F.when(F.col("judge") == 1, F.col("score"))).alias("h"), F.min("event_id").alias("event_id"))
    return g.where("p IS NOT NULL AND h IS NOT NULL")


JP = S + """, jp AS (SELECT * FROM (SELECT arm, method, k, iteration, questionnaire, persona_id, max(score) FILTER (judge=0) AS p, max(score) FILTER (judge=1) AS h
 FROM j GROUP BY ALL) WHERE p IS NOT NULL AND h IS NOT NULL)
"""


def items_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score per (judge, arm, method, k, iteration, persona_id, item): twelve items of a rubric."""
    item = ((F.get_json_object("props", "$.k").cast("int") / 4).cast("int") % 12 + 1).alias("item")
    extra = table(spark, sf_dir, "events").select("event_id", item)
    keys = ["judge", "arm", "method", "k", "iteration", "persona_id", "item"]
    return scores_long(spark, sf_dir).join(extra, "event_id").where("score IS NOT NULL").groupBy(*keys).agg(F.avg("score").alias("score"))


ITEMS = S + """, it AS (SELECT judge, arm, method, k, iteration, persona_id, (json_extract_string(props,'$.k')::INT//4)%12+1 AS item, avg(score) AS score FROM s JOIN (SELECT event_id, props FROM events) USING (event_id) GROUP BY ALL)
"""


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of groups: arm, train_iter, group_id, cand_idx, score (null where it failed), realized_turns, phase."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat("l_returnflag", "l_linestatus").alias("arm"), F.year("l_shipdate").alias("train_iter"), F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("cand_idx"),
        F.nullif(F.round(F.col("l_discount") * 10, 1), F.lit(0.0)).alias("score"), F.when(F.col("l_quantity") > 10, (F.col("l_quantity").cast("int") % 6)).alias("realized_turns"),
        F.when(F.col("l_tax") > 0.07, "eval").otherwise("train").alias("phase"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("length"),
    )


G = """WITH g AS (SELECT l_returnflag || l_linestatus AS arm, year(l_shipdate)::INT AS train_iter, l_orderkey AS group_id, l_linenumber AS cand_idx,
 nullif(round(l_discount*10,1),0.0) AS score, CASE WHEN l_quantity>10 THEN l_quantity::INT % 6 END AS realized_turns,
 CASE WHEN l_tax>0.07 THEN 'eval' ELSE 'train' END AS phase, l_extendedprice AS price, l_quantity AS length FROM lineitem)
"""


def compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arm, iteration, n_steps, cost, cum_cost: spending by month, with its running total."""
    o = table(spark, sf_dir, "orders")
    month = ((F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate") - 1).cast("int")
    g = o.groupBy(F.col("o_orderpriority").alias("arm"), month.alias("iteration")).agg(F.count(F.lit(1)).alias("n_steps"), F.round(F.sum("o_totalprice"), 2).alias("cost"), F.percentile("o_totalprice", 0.5).alias("median_step"))
    from ..operators.compute import running_total

    return running_total(g, ["arm"], "iteration", "cost", "cum_cost")


C = """WITH m AS (SELECT o_orderpriority AS arm, ((year(o_orderdate)-1992)*12 + month(o_orderdate) - 1)::INT AS iteration, count(*) AS n_steps,
 round(sum(o_totalprice),2) AS cost, quantile_cont(o_totalprice,0.5) AS median_step FROM orders GROUP BY ALL),
comp AS (SELECT *, sum(cost) OVER (PARTITION BY arm ORDER BY iteration) AS cum_cost FROM m)
"""
