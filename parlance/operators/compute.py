"""The cost axis: running totals, gap-imputed spans, nearest-budget and within-budget joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import col, ratio

#: Slack of a budget comparison.
SLACK = 1e-9


def running_total(df: DataFrame, by: list[str], order: str, value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(value).over(w))


def imputed_span(times: DataFrame, by: list[str], at: str = "at", cutoff: float = 3600.0) -> DataFrame:
    """by, n, span, n_imputed: sum of the gaps between sorted times; gaps <= 0 or >= cutoff count as the median valid gap."""
    gaps = times.withColumn("_gap", F.col(at) - F.lag(at).over(Window.partitionBy(*by).orderBy(at)))
    valid = (F.col("_gap") > 0) & (F.col("_gap") < cutoff)
    g = gaps.groupBy(*by).agg(
        F.count(at).alias("n"), F.coalesce(F.sum(F.when(valid, F.col("_gap"))), F.lit(0.0)).alias("_sum"), F.count_if(F.col("_gap").isNotNull() & ~valid).alias("n_imputed"),
        F.coalesce(F.percentile(F.when(valid, F.col("_gap")), 0.5), F.lit(0.0)).alias("_median"),
    )
    return g.select(*by, "n", (F.col("_sum") + F.col("n_imputed") * F.col("_median")).alias("span"), "n_imputed")


def nearest_budget(comp: DataFrame, a: str, b: str, cost: str = "cum_cost") -> DataFrame:
    """For each iteration of arm a the iteration of arm b whose total is nearest; ties go to the earlier one.

    Both arms have a row per iteration, so the theta join is between two short lists.
    """
    x = comp.where(F.col("arm") == a).select(F.col("iteration").alias("iter_a"), F.col(cost).alias("cost_a"))
    y = comp.where(F.col("arm") == b).select(F.col("iteration").alias("iter_b"), F.col(cost).alias("cost_b"))
    near = x.crossJoin(F.broadcast(y)).withColumn("gap", F.abs(F.col("cost_a") - F.col("cost_b")))
    order = Window.partitionBy("iter_a").orderBy("gap", "iter_b")
    return near.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def best_within(levels: DataFrame, budgets: DataFrame, by: list[str], cost: str = "cum_cost", value: str = "mean", lower_better: bool = False) -> DataFrame:
    """by, budget, best_iter, value, cost: the best level whose total does not exceed each budget; ties go to the earliest.

    levels has a row per state and budgets a row per budget; both are short lists of settings, not data.
    """
    met = levels.join(F.broadcast(budgets), F.col(cost) <= F.col("budget") + SLACK)
    order = Window.partitionBy(*by, "budget").orderBy(F.col(value).asc() if lower_better else F.col(value).desc(), "iteration")
    best = met.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return best.select(*by, "budget", F.col("iteration").alias("best_iter"), value, cost)


def cost_summary(comp: DataFrame) -> DataFrame:
    """arm, n_iterations, total, per_iteration, median_step and the share of all cost."""
    g = comp.groupBy("arm").agg(F.count(F.lit(1)).alias("n_iterations"), F.sum("cost").alias("total"), F.percentile("median_step", 0.5).alias("median_step"))
    return g.withColumns({"per_iteration": ratio("total", "n_iterations"), "share": ratio("total", F.sum("total").over(Window.partitionBy(F.lit(1))))})


def cost_ratios(summary: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (name, num, den) with the ratio of their totals and its arithmetic as text."""
    total = summary.select("arm", "total")
    out = pairs.join(total.select(F.col("arm").alias("num"), F.col("total").alias("num_total")), "num")
    out = out.join(total.select(F.col("arm").alias("den"), F.col("total").alias("den_total")), "den")
    whole = lambda c: F.round(c, 0).cast("long").cast("string")
    text = F.concat_ws(" / ", whole("num_total"), whole("den_total"))
    return out.select("name", "num", "den", "num_total", "den_total", ratio("num_total", "den_total").alias("ratio"), text.alias("arithmetic"))


def with_floor(comp: DataFrame, recorded: DataFrame, by: list[str]) -> DataFrame:
    """comp with the larger of measured and recorded cost and its own running total."""
    joined = comp.join(recorded, by, "left").withColumn("cost_floor", F.greatest(col("cost"), F.coalesce(col("recorded"), col("cost"))))
    return running_total(joined, by[:1], by[1], "cost_floor", "cum_cost_floor")


def priced(plan: DataFrame, chars: str, calls: str, chars_per_token: float, price_in: float, price_out: float, out_tokens: float, factor: float = 1.0) -> DataFrame:
    """plan with tokens and cost per million tokens, scaled by `factor` (a receipt, a batch discount)."""
    tokens = col(chars) / chars_per_token
    cost = (tokens * price_in + col(calls) * out_tokens * price_out) / 1e6 * factor
    return plan.withColumns({"tokens_in": tokens, "tokens_out": col(calls) * out_tokens, "cost": cost})


def pairs_at(scores: DataFrame, states: DataFrame, arm_a: str, arm_b: str, by: list[str], unit: str = "persona_id", value: str = "score", keep: list[str] | None = None) -> DataFrame:
    """iter_a, keep, by, unit, a, b, d for each row (iter_a, iter_b) of states: the same units in both arms at those iterations.

    states is a short list of settings; scores are joined to it by iteration and to each other by unit.
    """
    side = lambda arm, it, out: scores.where(F.col("arm") == arm).select(F.col("iteration").alias(it), *by, unit, F.col(value).alias(out))
    a = states.join(side(arm_a, "iter_a", "a"), "iter_a")
    both = a.join(side(arm_b, "iter_b", "b"), ["iter_b", *by, unit])
    return both.select("iter_a", *(keep or []), *by, unit, "a", "b", (F.col("a") - F.col("b")).alias("d"))


def with_receipt(plan: DataFrame, paid, calls) -> DataFrame:
    """basis, cost: the estimate of a plan, and what it costs at the price per call that a receipt shows."""
    rows = F.array(F.struct(F.lit("estimate").alias("basis"), F.col("cost").alias("cost")), F.struct(F.lit("receipt").alias("basis"), (ratio(paid, calls) * F.col("calls")).alias("cost")))
    return plan.select(F.inline(rows))


def shared_prefix(a, b):
    """Characters that two texts have in common from the start."""
    n = F.least(F.length(a), F.length(b))
    same = F.zip_with(F.split(F.substr(a, F.lit(1), n), ""), F.split(F.substr(b, F.lit(1), n), ""), lambda x, y: x == y)
    first = F.array_position(same, False)
    return F.when(n == 0, 0).when(first == 0, n).otherwise(first - 1).cast("int")
