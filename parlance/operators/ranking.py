"""Ranks and quantiles of groups of any size, without a group in one task.

Values are counted first, so copies cost nothing. A sketch of each group's distinct values, combined before its shuffle, gives cut points;
counts below a cut are added up over cuts, and values are put in order only between two of them. Cuts decide how even the parts are, never
the result: ranks and quantiles are exact.

A mean of floats may differ in its last bit each time Spark computes it, as its parts arrive in another order. So values that were computed twice
are never joined: cuts and counts of parts travel in one row, no value lies as near to a cut as that bit, and ranks are taken on the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import col

#: Parts that the distinct values of a group are cut into.
PARTS = 64
#: What cuts are moved up by, as a share of their size.
MARGIN = 7.318e-10


def _plan(counts: DataFrame, by: list[str], size: str, parts: int) -> DataFrame:
    """by, _plan: an array of (over, before, inside) in order, one per part that holds values: the cut that its values lie over (null: none),
    the rows of the group in the parts before it, and its own.

    Cuts are values moved up by MARGIN, so that none lies next to one.
    """
    share, v = [i / parts for i in range(1, parts)], F.col("_v").cast("double")
    cuts = counts.groupBy(*by).agg(F.percentile_approx("_v", share, 20 * parts).alias("_at"), F.max(F.when(F.abs(v) < F.lit(float("inf")), F.abs(v))).alias("_top"))
    moved = F.transform("_at", lambda c: c.cast("double") + F.abs(c.cast("double")) * MARGIN + F.coalesce("_top", F.lit(0.0)) * (MARGIN / 1000))
    over = F.array_max(F.filter("_cuts", lambda c: c < v))
    inside = _with(counts, cuts.select(*by, moved.alias("_cuts")), by).groupBy(*by, over.alias("over")).agg(F.sum(size).alias("inside"))
    plan = inside.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("over", "inside"))).alias("_parts"))  # as many as there are parts
    before = lambda i: F.aggregate(F.slice("_parts", 1, i), F.lit(0).cast("long"), lambda s, x: s + x["inside"])
    part = lambda x, i: F.struct(F.when(i > 0, x["over"]).alias("over"), before(i).alias("before"), x["inside"].alias("inside"))
    return plan.select(*by, F.transform("_parts", part).alias("_plan"))


def _with(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    return rows.join(groups, by) if by else rows.crossJoin(F.broadcast(groups))


def _between_cuts(rows: DataFrame, value: str, plan: DataFrame, by: list[str]) -> DataFrame:
    """rows with _bucket, the part of the group that their value lies in, _before: rows of the group in lower parts, and _in: rows of the part."""
    v = F.col(value).cast("double")
    cut = _with(rows, plan, by).withColumn("_bucket", F.size(F.filter("_plan", lambda p: p["over"].isNull() | (p["over"] < v))))
    own = F.get("_plan", F.col("_bucket") - 1)
    return cut.withColumns({"_before": own["before"], "_in": own["inside"]})


def ranked_counts(counts: DataFrame, by: list[str], size: str = "_n", parts: int = PARTS) -> DataFrame:
    """counts, a row per group and distinct value _v that stands for `size` rows, with _rank: the mean rank of those rows."""
    cut = _between_cuts(counts, "_v", _plan(counts, by, size, parts), by).drop("_plan")
    upto = F.sum(size).over(Window.partitionBy(*by, "_bucket").orderBy("_v"))
    return cut.withColumn("_rank", F.col("_before") + upto - (F.col(size) - 1) / F.lit(2.0)).drop("_bucket", "_before", "_in")


def counted(rows: DataFrame, by: list[str], value: Column | str) -> DataFrame:
    """by, _v, _n: distinct values that are not null, and the rows that have them."""
    return rows.where(col(value).isNotNull()).groupBy(*by, col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))


def with_rank(rows: DataFrame, by: list[str], value: str, name: str, ties: str | None = None, parts: int = PARTS) -> DataFrame:
    """rows whose value is known, with their rank among the group, ties at the mean, and on request the number that tie."""
    plan = _plan(counted(rows, by, value), by, "_n", parts)
    cut = _between_cuts(rows.where(col(value).isNotNull()), value, plan, by).drop("_plan")
    part = Window.partitionBy(*by, "_bucket")
    same = F.count(F.lit(1)).over(Window.partitionBy(*by, "_bucket", value))
    ranked = cut.withColumns({"_below": F.rank().over(part.orderBy(value)) - 1, "_same": same})
    out = ranked.withColumn(name, F.col("_before") + F.col("_below") + (F.col("_same") + 1) / F.lit(2.0))
    return (out.withColumn(ties, F.col("_same")) if ties else out).drop("_bucket", "_before", "_in", "_below", "_same")


def quantiles(rows: DataFrame, by: list[str], value: Column | str, shares: dict[str, float], parts: int = PARTS) -> DataFrame:
    """by and a column per named share: linear interpolation between the two values around share * (n - 1); groups without a value are absent."""
    counts = counted(rows, by, value)
    last = F.element_at("_plan", -1)
    near = _between_cuts(counts, "_v", _plan(counts, by, "_n", parts), by).withColumn("_all", last["before"] + last["inside"]).drop("_plan")
    place = {n: (F.col("_all") - 1) * F.lit(float(q)) for n, q in shares.items()}
    hit = F.lit(False)
    for p in place.values():
        hit = hit | ((F.col("_before") <= F.ceil(p)) & (F.col("_before") + F.col("_in") > F.floor(p)))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_bucket").orderBy("_v"))
    near = near.where(hit).withColumn("_upto", upto)  # only the parts that hold a wanted place are put in order
    at = lambda p: F.min(F.when(F.col("_upto") > p, F.col("_v").cast("double")))
    g = near.groupBy(*by, "_all").agg(*(c for n, p in place.items() for c in (at(F.floor(p)).alias(f"_lo_{n}"), at(F.ceil(p)).alias(f"_hi_{n}"))))
    part = {n: p - F.floor(p) for n, p in place.items()}
    return g.select(*by, *(((1 - part[n]) * F.col(f"_lo_{n}") + part[n] * F.col(f"_hi_{n}")).alias(n) for n in shares))
