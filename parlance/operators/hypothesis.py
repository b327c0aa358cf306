"""Tests of independent groups and of repeated measures, from ranks and moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions
from ..functions.expr import average_rank, col, ratio, two_sided_p
from . import ranking


def _ties(by: list[str], value: str) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(*by, value)).cast("double")


def mann_whitney(df: DataFrame, by: list[str], first: Column, value: str = "score") -> DataFrame:
    """by, n1, n2, u, z, p of the rows where `first` holds against the others; ties at mean ranks, tie-corrected variance.

    Rows are counted by value first, so ranks are taken over distinct values.
    """
    counts = df.where(col(value).isNotNull()).groupBy(*by, col(value).alias("_v")).agg(F.count_if(first).cast("double").alias("_a"), F.count_if(~first).cast("double").alias("_b"))
    t = F.col("_a") + F.col("_b")
    before = F.sum(t).over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    r = counts.withColumn("_rank", before - (t - 1) / 2)
    g = r.groupBy(*by).agg(F.sum("_a").alias("n1"), F.sum("_b").alias("n2"), F.sum(F.col("_a") * F.col("_rank")).alias("_r1"), F.sum(t * (t * t - 1)).alias("_ties"))
    n = F.col("n1") + F.col("n2")
    u = F.col("_r1") - F.col("n1") * (F.col("n1") + 1) / 2
    var = F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.col("_ties") / F.nullif(n * (n - 1), F.lit(0.0)))
    out = g.withColumn("u", u).withColumn("z", (F.col("u") - F.col("n1") * F.col("n2") / 2) / F.nullif(F.sqrt(var), F.lit(0.0)))
    return out.select(*by, F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"), "u", "z", two_sided_p("z").alias("p"))


def kruskal(df: DataFrame, by: list[str], group: str, value: str = "score") -> DataFrame:
    """by, n, k, h: tie-corrected Kruskal-Wallis statistic."""
    r = ranking.with_rank(df, by, value, "_rank", "_t").withColumn("_t", F.col("_t").cast("double"))
    g = r.groupBy(*by, group).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.sum("_rank").alias("_r"), F.sum(F.col("_t") * F.col("_t") - 1).alias("_ties"))
    g = g.groupBy(*by).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("_s"), F.sum("_ties").alias("_ties"))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)) / F.nullif(1 - F.col("_ties") / (n * n * n - n), F.lit(0.0))
    return g.select(*by, n.cast("long").alias("n"), "k", F.when(F.col("k") > 1, h).alias("h"))


def anova(df: DataFrame, by: list[str], group: str, value: str = "score") -> DataFrame:
    """by, n, k, f, eta2: one-way F and the share of variance between groups."""
    g = df.where(col(value).isNotNull()).groupBy(*by, group).agg(F.count(value).alias("_n"), F.avg(value).alias("_m"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("_v"))
    total = g.groupBy(*by).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("_n") * F.col("_v")).alias("_within"), ratio(F.sum(F.col("_n") * F.col("_m")), F.sum("_n")).alias("_grand"))
    joined = g.join(total, by) if by else g.crossJoin(F.broadcast(total))
    out = joined.groupBy(*by, "n", "k", "_within").agg(F.sum(F.col("_n") * (F.col("_m") - F.col("_grand")) * (F.col("_m") - F.col("_grand"))).alias("_between"))
    f = ratio(ratio("_between", F.col("k") - 1), ratio("_within", F.col("n") - F.col("k")))
    return out.select(*by, "n", "k", f.alias("f"), ratio("_between", F.col("_between") + F.col("_within")).alias("eta2"))


def levene(df: DataFrame, by: list[str], group: str, value: str = "score", center: str = "median") -> DataFrame:
    """One-way F of the distances from each group's median (Brown-Forsythe) or mean."""
    known, of = df.where(col(value).isNotNull()), [*by, group]
    middle = ranking.quantiles(known, of, value, {"_c": 0.5}) if center == "median" else known.groupBy(*of).agg(F.avg(value).alias("_c"))
    spread = known.join(middle, of).withColumn("_d", F.abs(col(value) - F.col("_c")))
    return anova(spread, by, group, "_d")


def friedman(cells: DataFrame, by: list[str], unit: str, treatment: str, value: str = "score") -> DataFrame:
    """by, n, k, chi2, kendall_w over units that have every treatment; ties at mean ranks; null statistics for n or k under 3."""
    kinds = cells.groupBy(*by).agg(F.count_distinct(treatment).cast("int").alias("_k"))
    whole = cells.join(kinds, by).withColumn("_own", F.count(F.lit(1)).over(Window.partitionBy(*by, unit))).where("_own = _k")
    r = whole.withColumns({"_rank": average_rank([*by, unit], value), "_t": _ties([*by, unit], value)})
    g = r.groupBy(*by, treatment, "_k").agg(F.sum("_rank").alias("_r"), F.count(F.lit(1)).alias("n"), F.sum(F.col("_t") * F.col("_t") - 1).alias("_ties"))
    g = g.groupBy(*by, "n", F.col("_k").alias("k")).agg(F.sum(F.col("_r") * F.col("_r")).alias("_s"), F.sum("_ties").alias("_ties"))
    n, m = F.col("n").cast("double"), F.col("k").cast("double")
    chi2 = (12 / (n * m * (m + 1)) * F.col("_s") - 3 * n * (m + 1)) / F.nullif(1 - F.col("_ties") / (n * (m * m * m - m)), F.lit(0.0))
    enough = (F.col("n") >= 3) & (F.col("k") >= 3)
    return g.select(*by, "n", "k", F.when(enough, chi2).alias("chi2"), F.when(enough, chi2 / (n * (m - 1))).alias("kendall_w"))


def cohens_d(df: DataFrame, by: list[str], first: Column, value: str = "score") -> DataFrame:
    """by, n1, n2, d: mean difference over the pooled deviation, population variances weighted by n - 1."""
    a, b = F.when(first, col(value)), F.when(~first, col(value))
    g = df.where(col(value).isNotNull()).groupBy(*by).agg(F.count(a).alias("n1"), F.count(b).alias("n2"), (F.avg(a) - F.avg(b)).alias("_diff"), F.var_pop(a).alias("_v1"), F.var_pop(b).alias("_v2"))
    pooled = F.sqrt(ratio((F.col("n1") - 1) * F.col("_v1") + (F.col("n2") - 1) * F.col("_v2"), F.col("n1") + F.col("n2") - 2))
    return g.select(*by, "n1", "n2", ratio("_diff", pooled).alias("d"))


def welch(df: DataFrame, by: list[str], first: Column, value: str = "score") -> DataFrame:
    """by, delta, t, df of two independent samples with unequal variances."""
    a, b = F.when(first, col(value)), F.when(~first, col(value))
    g = df.groupBy(*by).agg((F.avg(a) - F.avg(b)).alias("delta"), ratio(F.var_samp(a), F.count(a)).alias("_a"), ratio(F.var_samp(b), F.count(b)).alias("_b"), F.count(a).alias("_n"), F.count(b).alias("_m"))
    both = F.col("_a") + F.col("_b")
    dof = ratio(both * both, ratio(F.col("_a") * F.col("_a"), F.col("_n") - 1) + ratio(F.col("_b") * F.col("_b"), F.col("_m") - 1))
    return g.select(*by, "delta", ratio("delta", F.sqrt(both)).alias("t"), dof.alias("df"))


def pitman_morgan(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, n, r: correlation of sums and differences of (a, b), a paired test of equal variances; null where either is constant."""
    plus, minus = F.col("a") + F.col("b"), F.col("a") - F.col("b")
    r = F.when(F.stddev_pop(plus) * F.stddev_pop(minus) > 0, F.corr(plus, minus))
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), r.alias("r"), ratio(F.stddev_samp("a"), F.stddev_samp("b")).alias("sd_ratio"))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, n, rho of rows where both are known; null where either is constant."""
    known = df.where(col(x).isNotNull() & col(y).isNotNull())
    known = ranking.with_rank(ranking.with_rank(known, by, x, "_x"), by, y, "_y")
    return known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(F.stddev_pop("_x") * F.stddev_pop("_y") > 0, F.corr("_x", "_y")).alias("rho"))


def jarque_bera(df: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """by, n, skew, kurt (excess), jb, p: population moments about the mean; p of a chi-square with two degrees of freedom."""
    known = df.where(col(value).isNotNull())
    mean = known.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("_m"))
    off = col(value) - F.col("_m")
    g = known.join(mean, by).groupBy(*by, "n").agg(*(F.avg(F.pow(off, F.lit(k))).alias(f"_m{k}") for k in (2, 3, 4)))
    g = g.withColumns({"skew": ratio("_m3", F.pow("_m2", F.lit(1.5))), "kurt": ratio("_m4", F.col("_m2") * F.col("_m2")) - 3})
    half = F.col("n") / 12 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4)
    return g.select(*by, "n", "skew", "kurt", (2 * half).alias("jb"), F.exp(-half).alias("p"))


def shapiro_wilk(df: DataFrame, by: list[str], value: str = "score", chunk: int = 100_000) -> DataFrame:
    """by, n, w, p of groups with three values at least; null for constant ones. Scores follow global ranks, so no group is in one task.

    Equal values stand for a run of places; a run is dealt with in chunks.
    """
    known = df.where(col(value).isNotNull())
    size = known.groupBy(*by).agg(F.count(value).cast("double").alias("n"), F.avg(value).alias("_m"), (F.var_pop(value) * F.count(value)).alias("ss"))
    counts = ranking.ranked_counts(ranking.counted(known, by, value), by).join(size, by)
    first = (F.col("_rank") - (F.col("_n") - 1) / 2).cast("long")
    runs = counts.withColumns({"_x": F.col("_v") - F.col("_m"), "_last": first + F.col("_n") - 1, "_from": F.explode(F.sequence(first, first + F.col("_n") - 1, F.lit(chunk)))})
    places = runs.withColumn("i", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + chunk - 1, F.col("_last")))))
    score = F.expr(distributions.normal_quantile("((i-0.375D)/(n+0.25D))"))
    i, n = F.col("i"), F.col("n")
    end = (i == 1) | (i == n) | ((n > 5) & ((i == 2) | (i == n - 1)))
    at = lambda c, x: F.max(F.when(c, x))
    g = places.withColumn("_s", score).groupBy(*by, "n", "ss").agg(
        F.sum(F.col("_s") * F.col("_s")).alias("mm"), F.coalesce(F.sum(F.when(~end, F.col("_s") * F.col("_x"))), F.lit(0.0)).alias("mid"), at(i == 1, F.col("_s")).alias("m1"), at(i == 2, F.col("_s")).alias("m2"),
        at(i == 1, F.col("_x")).alias("x1"), at(i == 2, F.col("_x")).alias("x2"), at(i == n, F.col("_x")).alias("y1"), at(i == n - 1, F.col("_x")).alias("y2"),
    )
    g = g.where("n >= 3")
    for name, text in distributions.shapiro_w().items():
        g = g.withColumn(name, F.expr(text))
    return g.select(*by, n.cast("long").alias("n"), "w", F.expr(distributions.shapiro_p()).alias("p"))


def tukey_kramer(df: DataFrame, by: list[str], group: str, value: str = "score") -> DataFrame:
    """by, a < b, diff, q, k, df: mean differences of every two groups over their standard error; groups are settings, so pairs are few."""
    g = df.where(col(value).isNotNull()).groupBy(*by, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    error = g.groupBy(*by).agg(ratio(F.sum(F.col("n") * F.col("v")), F.sum("n") - F.count(F.lit(1))).alias("mse"), F.count(F.lit(1)).alias("k"), (F.sum("n") - F.count(F.lit(1))).alias("df"))
    side = lambda x: g.select(*by, F.col(group).alias(x), F.col("n").alias(f"n_{x}"), F.col("m").alias(f"m_{x}"))
    pairs = side("a").join(side("b"), by).where("a < b").join(error, by)
    diff = F.col("m_a") - F.col("m_b")
    return pairs.select(*by, "a", "b", diff.alias("diff"), ratio(F.abs(diff), F.sqrt(F.col("mse") / 2 * (1 / F.col("n_a") + 1 / F.col("n_b")))).alias("q"), "k", "df")


def pair_rows(df: DataFrame, group: str) -> DataFrame:
    """Every row once for each pair of groups (group_a < group_b) it belongs to, with side 1 for the first; groups are a short list."""
    kinds = df.select(group).distinct()
    pairs = kinds.select(F.col(group).alias(f"{group}_a")).join(kinds.select(F.col(group).alias(f"{group}_b"))).where(f"{group}_a < {group}_b")
    either = pairs.select(F.col(f"{group}_a").alias(group), f"{group}_a", f"{group}_b", F.lit(1).alias("side")).union(pairs.select(F.col(f"{group}_b").alias(group), f"{group}_a", f"{group}_b", F.lit(0).alias("side")))
    return df.join(either, group)
