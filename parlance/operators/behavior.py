"""Coded behaviour and its rates: ratios by conversation first, then means; rubric rows from item lists; thresholds as a dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import array_mean, array_total, ratio

#: (fair, good) bounds of the summary scores of the motivational-interviewing code, fixed values.
THRESHOLDS = {"r_to_q": (1.0, 2.0), "pct_cr": (0.4, 0.5), "technical": (3.0, 4.0), "relational": (3.5, 4.0)}


def summary_scores(coded: DataFrame) -> DataFrame:
    """coded (sr, cr, q, af, seek, persuade, g1..g4) with r_to_q, pct_cr, pct_mico, technical, relational; null at a zero denominator."""
    sr, cr, q, af, seek, persuade = (F.col(c) for c in ("sr", "cr", "q", "af", "seek", "persuade"))
    good = sr + cr + af + seek
    return coded.withColumns({
        "r_to_q": ratio(sr + cr, q), "pct_cr": ratio(cr, sr + cr), "pct_mico": ratio(good, good + persuade),
        "technical": (F.col("g1") + F.col("g2")) / 2, "relational": (F.col("g3") + F.col("g4")) / 2,
    })


def rates(coded: DataFrame, counts: list[str], per: str, suffix: str = "_rate") -> DataFrame:
    """coded with each count over `per`, null where that is zero or unknown."""
    return coded.withColumns({f"{c}{suffix}": ratio(c, per) for c in counts})


def means_by(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, n and the mean of each column over conversations that have it."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in columns))


def outer(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with one set of keys; sides tells which side a row comes from."""
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), keys, "full_outer")
    side = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left").otherwise("right")
    return both.withColumn("side", side).drop("_l", "_r")


def verdict(value: Column, fair: Column, good: Column) -> Column:
    return F.when(value.isNull(), "none").when(value >= good, "good").when(value >= fair, "fair").otherwise("below")


def with_verdicts(long: DataFrame, name: str = "score_name", value: str = "value") -> DataFrame:
    """Rows (name, value) judged by THRESHOLDS, a short literal dimension; names without a threshold leave."""
    bounds = F.create_map(*(x for n, (fair, good) in THRESHOLDS.items() for x in (F.lit(n), F.struct(F.lit(fair).alias("fair"), F.lit(good).alias("good")))))
    known = long.where(F.col(name).isin(list(THRESHOLDS))).withColumn("_b", bounds[F.col(name)])
    return known.withColumn("verdict", verdict(F.col(value), F.col("_b.fair"), F.col("_b.good"))).drop("_b")


def simple_row(scores: Column | str) -> list[Column]:
    """mean and total of an array of item scores, nulls left out."""
    return [array_mean(scores).alias("mean"), array_total(scores).alias("total")]


def part_mean(scores: Column | str, places: list[int]) -> Column:
    """Mean of the items at these places, counted from 1."""
    c = F.col(scores) if isinstance(scores, str) else scores
    return array_mean(F.array(*(F.get(c, F.lit(i - 1)) for i in places)))
