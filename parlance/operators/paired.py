"""Paired contrasts: two sides of one unit are brought together by one grouping, never by a self-join."""

from __future__ import annotations

from functools import cache
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import average_rank, col, effect_label, ratio, two_sided_p
from . import ranking, resample

UNIT = "persona_id"


def means(df: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """by, value: mean of what repeats; null values are left out."""
    return df.where(col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias(value))


def means_in_order(df: DataFrame, by: list[str], order: str, *values: str) -> DataFrame:
    """by, the mean of each value, null values left out and added up row by row in the given order, and the least of that order.

    The last bit of a float sum hangs on its order. Here rows decide it, not the task or file that they lie in, so means can be compared for equality.
    """
    at = Window.partitionBy(*by).orderBy(order, *values)
    upto = at.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = df.select(*by, order, *values, F.row_number().over(at).alias("_at"), *(F.sum(v).over(upto).alias(f"_sum_{v}") for v in values))
    return summed.groupBy(*by).agg(*((F.max_by(f"_sum_{v}", "_at") / F.count(v)).alias(v) for v in values), F.min(order).alias(order))


def deltas(cells: DataFrame, by: list[str], first: Column, second: Column, unit: str = UNIT, value: str = "score", order: str | None = None) -> DataFrame:
    """by, unit, a, b, d = a - b of units with a value on both sides; repeats on a side are averaged, in the given order where signs of d are counted."""
    both = {"a": F.when(first, col(value)), "b": F.when(second, col(value))}
    if order:
        sides = means_in_order(cells.withColumns(both), [*by, unit], order, "a", "b")
    else:
        sides = cells.groupBy(*by, unit).agg(*(F.avg(c).alias(n) for n, c in both.items()))
    return sides.where("a IS NOT NULL AND b IS NOT NULL").withColumn("d", F.col("a") - F.col("b"))


def _moments() -> list[Column]:
    return [
        F.count("d").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("d").alias("mean_delta"),
        F.percentile("d", 0.5).alias("median_delta"), F.stddev_samp("d").alias("sd_delta"),
    ]


MOMENTS = ("mean_a", "mean_b", "mean_delta", "median_delta", "sd_delta", "dz")


def _enough(df: DataFrame, columns: tuple[str, ...], least: int = 3) -> DataFrame:
    return df.withColumns({c: F.when(F.col("n") >= least, F.col(c)) for c in columns})


def summary(pairs: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """by, n, mean_a, mean_b, mean_delta, median_delta, sd_delta, dz; statistics are null under `least` pairs, dz at sd 0."""
    return _enough(pairs.groupBy(*by).agg(*_moments()).withColumn("dz", ratio("mean_delta", "sd_delta")), MOMENTS, least)


#: Nonzero differences up to which the signed-rank p is exact: without ties and zeros, and with them.
EXACT, EXACT_TIES = 50, 13
#: Digits to which two sizes of differences tie.
TIE_DIGITS = 9


@cache
def _signed_rank_tails() -> list[tuple[int, list[float]]]:
    """(n, P(T <= 0), P(T <= 1), ...) up to half of the largest sum of ranks: each rank is in the sum or not, with equal odds."""
    out, odds = [], [1]
    for n in range(1, EXACT + 1):
        odds = [(odds[i] if i < len(odds) else 0) + (odds[i - n] if i >= n else 0) for i in range(len(odds) + n)]
        out.append((n, [t / 2**n for t in accumulate(odds[: len(odds) // 2 + 1])]))
    return out


def _tail_of(ranks: Column, w: Column) -> Column:
    """P(T <= w) for a short array of doubled ranks, by the recurrence over sums that a rank joins or not; w is doubled, too."""
    joined = lambda f, r: F.transform(F.sequence(F.lit(0), F.size(f) - 1 + r), lambda i: (F.coalesce(F.get(f, i), F.lit(0.0)) + F.coalesce(F.get(f, i - r), F.lit(0.0))) / 2)
    odds = F.aggregate(ranks, F.array(F.lit(1.0)), joined)
    return F.aggregate(F.slice(odds, 1, w + 1), F.lit(0.0), lambda s, x: s + x)


def signed_ranks(pairs: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """by, n_nonzero, t_plus, t_minus, w, z, p, p_normal and the aggregates `more`, in one grouping of ranked rows.

    Zero differences take no rank, ties the mean rank; both are told to nine digits, so the order of a float sum makes or breaks none. p is exact up to 50 differences if none is zero and no sizes tie, up to 13 nonzero
    ones otherwise, and the normal approximation, p_normal, beyond. Groups whose differences are all zero have n_nonzero 0, null statistics and p 1
    (the convention of the core contrast).
    """
    size = F.round(F.abs("d"), TIE_DIGITS)
    ranked = pairs.where("d IS NOT NULL").withColumns({"_size": size, "_zero": size == 0})
    ranked = ranked.withColumns({"_rank": average_rank([*by, "_zero"], "_size"), "_ties": F.count(F.lit(1)).over(Window.partitionBy(*by, "_size")).cast("double"), "_own": F.count(F.lit(1)).over(Window.partitionBy(*by, "_zero"))})
    n = F.count_if(~F.col("_zero")).cast("double")
    some = lambda c: F.sum(F.when(~F.col("_zero"), c))
    g = ranked.groupBy(*by).agg(
        F.count_if(~F.col("_zero")).alias("n_nonzero"), some(F.when(F.col("d") > 0, F.col("_rank")).otherwise(0.0)).alias("t_plus"),
        some(F.when(F.col("d") < 0, F.col("_rank")).otherwise(0.0)).alias("t_minus"), (n * (n + 1) / 4).alias("_mean"),
        (n * (n + 1) * (2 * n + 1) / 24 - some(F.col("_ties") * F.col("_ties") - 1) / 48).alias("_var"), *more,
        F.collect_list(F.when(~F.col("_zero") & (F.col("_own") <= EXACT_TIES), (2 * F.col("_rank")).cast("int"))).alias("_few"),
        (F.coalesce(F.max(F.col("_zero") | (F.col("_ties") > 1)), F.lit(False))).alias("_uneven"),
    )
    g = g.withColumns({"w": F.least("t_plus", "t_minus"), "z": (F.col("t_plus") - F.col("_mean")) / F.nullif(F.sqrt("_var"), F.lit(0.0))}).drop("_mean", "_var")
    tails = F.broadcast(pairs.sparkSession.createDataFrame(_signed_rank_tails(), "n_nonzero long, _tail array<double>"))
    g = g.join(tails, "n_nonzero", "left")
    both = lambda tail: F.least(F.lit(1.0), 2 * tail)
    p = F.when(F.col("n_nonzero") == 0, 1.0).when(F.col("n_nonzero") <= EXACT_TIES, both(_tail_of(F.col("_few"), (2 * F.col("w")).cast("int"))))
    p = p.when((F.col("n_nonzero") <= EXACT) & ~F.col("_uneven"), both(F.get("_tail", F.col("w").cast("int")))).otherwise(two_sided_p("z"))
    return g.withColumns({"p": p, "p_normal": F.when(F.col("n_nonzero") == 0, 1.0).otherwise(two_sided_p("z"))}).drop("_tail", "_few", "_uneven")


def wilcoxon(pairs: DataFrame, by: list[str], d: str = "d") -> DataFrame:
    """by, n_nonzero, t_plus, t_minus, w, z, p, p_normal of the differences in column d."""
    return signed_ranks(pairs.withColumn("d", col(d)), by)


def of_pairs(pairs: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """by, the summary of the paired differences and the signed-rank statistics; all but the counts are null under `least` pairs."""
    g = signed_ranks(pairs, by, *_moments())
    return _enough(g.withColumn("dz", ratio("mean_delta", "sd_delta")), (*MOMENTS, "w", "z", "p", "p_normal"), least)


def contrast(cells: DataFrame, by: list[str], first: Column, second: Column, unit: str = UNIT, value: str = "score") -> DataFrame:
    return of_pairs(deltas(cells, by, first, second, unit, value), by)


def with_interval(pairs: DataFrame, by: list[str], unit: str = UNIT) -> DataFrame:
    """of_pairs with lo, hi: the interval of the mean difference over hashed resamples of the units."""
    ends = resample.interval(resample.replicates(pairs, by, unit, ["d"]), by, F.col("d"))
    return _enough(of_pairs(pairs, by).join(ends, by, "left"), ("lo", "hi"))


def holm(df: DataFrame, family: list[str], p: str = "p", out: str = "p_holm", tiebreak: list[str] | None = None) -> DataFrame:
    """df with step-down adjusted p within a family: running maximum of (m - rank + 1) p, at most 1. Nulls stay and do not count."""
    order = Window.partitionBy(*family, col(p).isNull()).orderBy(col(p), *(tiebreak or []))
    m = F.count(col(p)).over(Window.partitionBy(*family))
    step = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * col(p))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = f"{out}_step"
    return df.withColumn(at, step).withColumn(out, F.when(col(p).isNotNull(), F.max(at).over(running))).drop(at)


def benjamini_hochberg(df: DataFrame, family: list[str], p: str = "p", out: str = "q", tiebreak: list[str] | None = None) -> DataFrame:
    """df with false-discovery q within a family: running minimum, from the largest p down, of p m / rank."""
    order = Window.partitionBy(*family, col(p).isNull()).orderBy(col(p), *(tiebreak or []))
    m = F.count(col(p)).over(Window.partitionBy(*family))
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    at = f"{out}_step"
    stepped = df.withColumn(at, F.least(F.lit(1.0), col(p) * m / F.row_number().over(order)))
    return stepped.withColumn(out, F.when(col(p).isNotNull(), F.min(at).over(rest))).drop(at)


def best_iteration(cells: DataFrame, by: list[str], value: str = "score", lower_better: bool = False) -> DataFrame:
    """by, iteration, mean: the iteration of the best mean; ties go to the earliest."""
    level = cells.groupBy(*by, "iteration").agg(F.avg(value).alias("mean"))
    order = Window.partitionBy(*by).orderBy(F.col("mean").asc() if lower_better else F.col("mean").desc(), "iteration")
    return level.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def final_iteration(df: DataFrame, by: list[str]) -> DataFrame:
    """by, iteration: the last one."""
    return df.groupBy(*by).agg(F.max("iteration").alias("iteration"))


def main_results(cells: DataFrame) -> DataFrame:
    """arm, questionnaire: base against final iteration, dz and its label, signed-rank z and p, Holm over the rubrics of an arm."""
    last = cells.groupBy("arm").agg(F.max("iteration").alias("_last"))
    marked = cells.join(last, "arm").where("iteration = 0 OR iteration = _last")
    by = ["arm", "questionnaire"]
    out = contrast(marked, by, (F.col("iteration") == F.col("_last")) & (F.col("_last") > 0), F.col("iteration") == 0)
    out = holm(out, ["arm"], tiebreak=["questionnaire"])
    return out.withColumn("effect", effect_label("dz"))


def did(cells: DataFrame, by: list[str], sides: tuple[Column, Column, Column, Column], unit: str = UNIT, value: str = "score") -> DataFrame:
    """by, n, gap_lo, gap_hi, did_mean, did_sd, did_dz of (s0 - s1) - (s2 - s3) over units that have all four."""
    g = cells.groupBy(*by, unit).agg(*(F.avg(F.when(s, col(value))).alias(f"s{i}") for i, s in enumerate(sides))).dropna(subset=["s0", "s1", "s2", "s3"])
    g = g.withColumns({"lo": F.expr("s0 - s1"), "hi": F.expr("s2 - s3")}).withColumn("d", F.expr("lo - hi"))
    out = g.groupBy(*by).agg(F.count("d").alias("n"), F.avg("lo").alias("gap_lo"), F.avg("hi").alias("gap_hi"), F.avg("d").alias("did_mean"), F.stddev_samp("d").alias("did_sd"))
    return out.withColumn("did_dz", ratio("did_mean", "did_sd"))


def trajectory(cells: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """by, n_iterations, rho, slope, peak_iteration, final_iteration: rank correlation and slope over rows; null under `least` iterations."""
    ranked = ranking.with_rank(ranking.with_rank(cells, by, "iteration", "_x"), by, "score", "_y")
    rows = ranked.groupBy(*by).agg(
        F.count_distinct("iteration").alias("n_iterations"), F.when(F.stddev_pop("_x") * F.stddev_pop("_y") > 0, F.corr("_x", "_y")).alias("rho"),
        F.when(F.stddev_pop("iteration") > 0, F.regr_slope(F.col("score"), F.col("iteration").cast("double"))).alias("slope"), F.max("iteration").alias("final_iteration"),
    )
    peak = best_iteration(cells, by).select(*by, F.col("iteration").alias("peak_iteration"))
    out = rows.join(peak, by)
    return out.withColumns({c: F.when(F.col("n_iterations") >= least, F.col(c)) for c in ("rho", "slope")})


def vs_base(cells: DataFrame, by: list[str], unit: str = UNIT, value: str = "score") -> DataFrame:
    """by, iteration: every later iteration against the same units' base, with signed ranks."""
    base = cells.where("iteration = 0").groupBy(*by, unit).agg(F.avg(value).alias("b"))
    later = means(cells.where("iteration > 0"), [*by, "iteration", unit], value).withColumnRenamed(value, "a")
    pairs = later.join(base, [*by, unit]).where("b IS NOT NULL").withColumn("d", F.col("a") - F.col("b"))
    keys = [*by, "iteration"]
    return of_pairs(pairs, keys)


def endpoint_deltas(rows: DataFrame, by: list[str], value: str = "score", target: DataFrame | None = None) -> DataFrame:
    """by, target_iter, base, target, delta: the means at iteration 0 and at an arm's target (arm, iteration), by default its last."""
    at = (final_iteration(rows, ["arm"]) if target is None else target).select("arm", F.col("iteration").alias("target_iter"))
    g = rows.join(at, "arm").groupBy(*by, "target_iter").agg(F.avg(F.when(F.col("iteration") == 0, col(value))).alias("base"), F.avg(F.when(F.col("iteration") == F.col("target_iter"), col(value))).alias("target"))
    return g.where("base IS NOT NULL AND target IS NOT NULL").withColumn("delta", F.col("target") - F.col("base"))
