"""Reshaping and selection: wide and long, composites, coverage, best and final rows per group."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_wide(df: DataFrame, keys: list[str], name: str, values: list[str], value: str) -> DataFrame:
    """A row per keys, a column per listed name; repeats are averaged, absent names are null. The list makes the schema stable."""
    return df.groupBy(*keys).pivot(name, values).agg(F.avg(value))


def to_long(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """A row per keys and non-null column."""
    return df.unpivot(keys, columns, name, value).where(F.col(value).isNotNull())


def with_composite(df: DataFrame, keys: list[str], name: str, value: str, first: str, second: str, composite: str) -> DataFrame:
    """df plus a row named `composite` with the mean of both named values for keys that have both; made anew if there already."""
    base = df.where(F.col(name) != composite)
    both = to_wide(base.where(F.col(name).isin(first, second)), keys, name, [first, second], value).dropna(subset=[first, second])
    made = both.select(*keys, F.lit(composite).alias(name), ((F.col(first) + F.col(second)) / 2).alias(value))
    return base.select(*keys, name, value).unionByName(made)


def collapse_base(df: DataFrame, label: str, k: int = -1) -> DataFrame:
    """Base rows of all arms as one pseudo-arm."""
    return df.withColumns({"arm": F.when(F.col("is_base"), F.lit(label)).otherwise(F.col("arm")), "k": F.when(F.col("is_base"), F.lit(k)).otherwise(F.col("k"))})


def attach(df: DataFrame, dim: DataFrame, keys: list[str], missing: dict[str, str | int]) -> DataFrame:
    """df with the columns of a dimension table; keys that it lacks get the given values. The optimizer picks the join by size."""
    out = df.join(dim, keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in missing.items()})


def keep_base_and(df: DataFrame, chosen: DataFrame, keys: list[str], base: str = "iteration = 0") -> DataFrame:
    """Base rows, and rows whose keys are chosen."""
    return df.join(chosen.select(*keys).distinct().withColumn("_chosen", F.lit(True)), keys, "left").where(f"_chosen OR {base}").drop("_chosen")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows of each group; order has to break every tie. Spark limits groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def thin(df: DataFrame, by: list[str], what: str, least: int) -> DataFrame:
    """Groups with fewer than `least` distinct values."""
    return df.groupBy(*by).agg(F.count_distinct(what).alias(f"n_{what}s")).where(F.col(f"n_{what}s") < least)


def coverage(df: DataFrame, by: list[str], unit: str, expected: int, required: int) -> DataFrame:
    g = df.groupBy(*by).agg(F.count_distinct(unit).alias("n"))
    return g.withColumns({"pct": 100.0 * F.col("n") / expected, "complete": F.col("n") >= required})


def missing(df: DataFrame, keys: list[str], unit: str, grid: DataFrame | None = None) -> DataFrame:
    """Combinations of the keys' values that have no row, for every unit that has any.

    The other keys are settings: their combinations (all of their values' by default, or those of `grid`) are one short array. A unit's rows are
    gathered as the set of settings it has, and only what it lacks is expanded; no grid of units and settings is made.
    """
    settings = [k for k in keys if k != unit]
    if grid is None:
        grid = df.agg(*(F.collect_set(k).alias(k) for k in settings))
        for k in settings:
            grid = grid.withColumn(k, F.explode(k))
    every = grid.select(*settings).distinct().agg(F.collect_list(F.struct(*settings)).alias("_all"))
    has = df.groupBy(unit).agg(F.collect_set(F.struct(*settings)).alias("_has"))
    return has.crossJoin(F.broadcast(every)).select(unit, F.explode(F.array_except("_all", "_has")).alias("_x")).select(unit, "_x.*")


def rubric_pairs(cells: DataFrame, keys: tuple[str, ...] = ("arm", "iteration", "persona_id"), name: str = "questionnaire", value: str = "score") -> DataFrame:
    """q1 < q2 with the two scores s1, s2 of one unit: pairs of a unit's few rubrics, made inside its own group."""
    g = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("q"), F.col(value).alias("v")))).alias("z"))
    later = F.transform("z", lambda x, i: F.transform(F.slice("z", i + 2, F.size("z")), lambda y: F.struct(x["q"].alias("q1"), y["q"].alias("q2"), x["v"].alias("s1"), y["v"].alias("s2"))))
    return g.select(*keys, F.explode(F.flatten(later)).alias("p")).select(*keys, "p.*")


def largest_gap(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """n, largest_gap, equal: the largest difference of columns x and y over keys that both sides have."""
    gap = F.max(F.abs(F.col("x") - F.col("y")))
    return left.join(right, keys).agg(F.count(F.lit(1)).alias("n"), gap.alias("largest_gap"), (gap <= tolerance).alias("equal"))


def aligned(rows: DataFrame, unit: str, traits: list[str]) -> DataFrame:
    """n_personas, n_aligned: units for which every trait has at most one known value."""
    g = rows.groupBy(unit).agg(*(F.count_distinct(t).alias(t) for t in traits))
    one = F.lit(True)
    for t in traits:
        one = one & (F.col(t) <= 1)
    return g.agg(F.count(F.lit(1)).alias("n_personas"), F.count_if(one).alias("n_aligned"))
