"""Grader agreement, repeatability, variance components, retention and order preservation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio
from . import ranking, resample


def mean_squares(long: DataFrame, by: list[str], target: str, rater: str, value: str = "score") -> DataFrame:
    """by, n, k, msr, msc, mse of the two-way layout without repeats; targets that lack a rater are left out.

    Values are taken from the grand mean first, so large levels with little spread keep their digits. Raters are few: a target holds its
    ratings as one array, and two groupings of those give all sums of squares.
    """
    keyed = long.groupBy(*by, target, rater).agg(F.avg(value).alias("v"))
    rated = keyed.groupBy(*by, target).agg(F.sort_array(F.collect_list(F.struct(F.col(rater).alias("rater"), "v"))).alias("_x"))
    all_of = rated.groupBy(*by).agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("_x.rater")))).alias("k"), F.avg(F.aggregate("_x", F.lit(0.0), lambda s, x: s + x["v"]) / F.size("_x")).alias("_g"))
    whole = rated.join(all_of, by).where(F.size("_x") == F.col("k")).select(*by, "k", F.transform("_x", lambda x: x["v"] - F.col("_g")).alias("_u"))
    row = F.aggregate("_u", F.lit(0.0), lambda s, u: s + u)
    each = whole.select(*by, "k", row.alias("_row"), F.posexplode("_u").alias("_at", "_v"))
    cols = each.groupBy(*by, "k", "_at").agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("_c"), F.sum(F.col("_v") * F.col("_v")).alias("_q"), F.sum(F.when(F.col("_at") == 0, F.col("_row") * F.col("_row"))).alias("_r"))
    g = cols.groupBy(*by, "k", "n").agg(F.sum("_c").alias("_sum"), F.sum(F.col("_c") * F.col("_c")).alias("_cc"), F.sum("_q").alias("_qq"), F.sum("_r").alias("_rr"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    level = F.col("_sum") * F.col("_sum") / (n * k)
    up = lambda x: F.greatest(x, F.lit(0.0))
    between, across = up(F.col("_rr") / k - level), up(F.col("_cc") / n - level)
    rest = up(F.col("_qq") - F.col("_rr") / k - F.col("_cc") / n + level)
    return g.select(*by, F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k"), ratio(between, n - 1).alias("msr"), ratio(across, k - 1).alias("msc"), ratio(rest, (n - 1) * (k - 1)).alias("mse"))



def icc_2_1(long: DataFrame, by: list[str], target: str, rater: str, value: str = "score") -> DataFrame:
    """by, n, k, icc: single-rating absolute agreement; null for n under 3 or k under 2."""
    m = mean_squares(long, by, target, rater, value)
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    icc = ratio(F.col("msr") - F.col("mse"), F.col("msr") + (k - 1) * F.col("mse") + k * (F.col("msc") - F.col("mse")) / n)
    return m.select(*by, "n", "k", F.when((F.col("n") >= 3) & (F.col("k") >= 2), icc).alias("icc"))


def variance_components(long: DataFrame, by: list[str], target: str, rater: str, value: str = "score") -> DataFrame:
    """by, n, k, var_target, var_rater, var_resid, none below zero."""
    m = mean_squares(long, by, target, rater, value)
    up = lambda x: F.greatest(x, F.lit(0.0))
    return m.select(*by, "n", "k", up(ratio(F.col("msr") - F.col("mse"), "k")).alias("var_target"), up(ratio(F.col("msc") - F.col("mse"), "n")).alias("var_rater"), up(F.col("mse")).alias("var_resid"))


def agreement(pairs: DataFrame, by: list[str], x: str = "p", y: str = "h") -> DataFrame:
    """by, n, pearson, spearman, bias, mean_abs_diff of two graders on the same units."""
    r = ranking.with_rank(ranking.with_rank(pairs, by, x, "_x"), by, y, "_y")
    safe = lambda a, b: F.when(F.stddev_pop(a) * F.stddev_pop(b) > 0, F.corr(a, b))
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), safe(x, y).alias("pearson"), safe("_x", "_y").alias("spearman"), F.avg(F.col(y) - F.col(x)).alias("bias"), F.avg(F.abs(F.col(y) - F.col(x))).alias("mean_abs_diff"))


def attenuation_ceiling(icc_a: str, icc_b: str):
    """Largest correlation that two graders of these reliabilities can show."""
    up = lambda c: F.greatest(F.col(c), F.lit(0.0))
    return F.sqrt(up(icc_a) * up(icc_b))


def gain_retention(pairs: DataFrame, by: list[str], floor: float) -> DataFrame:
    """by, iteration, n, d_primary, d_judge, retention: gains over base on shared units under both graders.

    Units need both graders at both iterations. Retention is null where the primary gain is below the floor.
    """
    unit = [*by, "persona_id"]
    base = pairs.where("iteration = 0").groupBy(*unit).agg(F.avg("p").alias("p0"), F.avg("h").alias("h0"))
    g = pairs.where("iteration > 0").join(base, unit).groupBy(*by, "iteration").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("p") - F.col("p0")).alias("d_primary"), F.avg(F.col("h") - F.col("h0")).alias("d_judge"))
    return g.withColumn("retention", F.when(F.abs("d_primary") >= floor, ratio("d_judge", "d_primary")))


def state_contrasts(means: DataFrame, by: list[str], state: str = "state") -> DataFrame:
    """by, a < b, dp, dh of every two states' grader means. States are settings, so their pairs stay few."""
    a = means.select(*by, F.col(state).alias("a"), F.col("p").alias("pa"), F.col("h").alias("ha"))
    b = means.select(*by, F.col(state).alias("b"), F.col("p").alias("pb"), F.col("h").alias("hb"))
    return a.join(b, by).where("a < b").select(*by, "a", "b", (F.col("pa") - F.col("pb")).alias("dp"), (F.col("ha") - F.col("hb")).alias("dh"))


def sign_ladder(contrasts: DataFrame, rungs: list[float], by: list[str]) -> DataFrame:
    """by, rung, n, n_same, pct: share of contrasts of at least each size that keep their sign; ties on either side are left out."""
    steps = F.explode(F.array(*(F.lit(float(r)) for r in rungs)))
    c = contrasts.where("dp <> 0 AND dh <> 0").withColumn("rung", steps).where(F.abs("dp") >= F.col("rung"))
    same = F.signum("dp") == F.signum("dh")
    return c.groupBy(*by, "rung").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("n_same"), (100.0 * F.avg(same.cast("int"))).alias("pct"))


def concordance_bins(contrasts: DataFrame, bins: list[float], by: list[str]) -> DataFrame:
    """by, bin (its lower bound), n, agreement by size of the primary difference; primary ties are left out, judge ties disagree."""
    size, low = F.abs("dp"), F.lit(None).cast("double")
    for lo, hi in zip(bins[:-1], bins[1:], strict=True):
        low = F.when((size >= lo) & (size < hi), F.lit(float(lo))).otherwise(low)
    c = contrasts.where("dp <> 0").withColumn("bin", low).where("bin IS NOT NULL")
    return c.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg((F.signum("dp") == F.signum("dh")).cast("int")).alias("agreement"))


def rank_agreement(rows: DataFrame, by: list[str], proxy: str, outcome: str, unit: str, least: int, bits: int = 32) -> DataFrame:
    """by, n_pairs, agreement: share of unit pairs in a group whose proxy and outcome differ in the same direction; ties on either side are left out."""
    g = pair_counts(rows, by, proxy, outcome, bits)
    return g.where(F.col("n_pairs") >= least).select(*by, "n_pairs", ratio("n_same", "n_pairs").alias("agreement"))


def pair_counts(rows: DataFrame, by: list[str], x: str, y: str, bits: int = 32) -> DataFrame:
    """by, n_pairs, n_same: pairs of rows that differ in x and y, and those that differ in the same direction, for groups that have any.

    No pair is made. y is numbered within its group. Two numbers differ first at one bit: rows that agree above it are grouped, and walking a group by x
    with a running count of its zeros and ones gives the pairs that part there. Every row is in one group per bit.
    """
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = known.groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    numbered = cells.withColumn("_r", F.dense_rank().over(Window.partitionBy(*by).orderBy("_y")) - 1)
    top = numbered.groupBy(*by).agg(F.max("_r").alias("_top"))
    upto = F.sequence(F.lit(0), F.least(F.lit(bits - 1), F.ceil(F.log2(F.col("_top") + F.lit(2.0))).cast("int")))
    split = numbered.join(top, by).withColumn("_b", F.explode(upto))
    split = split.withColumns({"_p": F.expr("shiftright(_r, _b + 1)"), "_one": F.expr("shiftright(_r, _b) & 1")})
    at_x = split.groupBy(*by, "_b", "_p", "_x").agg(F.sum(F.when(F.col("_one") == 1, F.col("_n")).otherwise(0)).alias("_ones"), F.sum(F.when(F.col("_one") == 0, F.col("_n")).otherwise(0)).alias("_zeros"))
    below = Window.partitionBy(*by, "_b", "_p").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    seen = at_x.withColumns({"_ones_below": F.coalesce(F.sum("_ones").over(below), F.lit(0)), "_zeros_below": F.coalesce(F.sum("_zeros").over(below), F.lit(0))})
    same, other = F.col("_ones") * F.col("_zeros_below"), F.col("_zeros") * F.col("_ones_below")
    return seen.groupBy(*by).agg(F.sum(same + other).alias("n_pairs"), F.sum(same).alias("n_same")).where("n_pairs > 0")


#: Cuts of a group's values, its parts being a power of two below; rows that a part should have; replicates of one grid.
CUTS, PART_ROWS, GRID = 63, 1024, 250


def _squares(w: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Of each column of w: the squared sums of rows with equal keys, added up."""
    order = np.lexsort(keys)
    first = np.flatnonzero(np.append(True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)))
    sums = np.add.reduceat(w[order], first, dtype="float64")
    return np.einsum("ij,ij->j", sums, sums)


def _sides_of(x: np.ndarray, y: np.ndarray, w: np.ndarray, rows: int = PART_ROWS // 4) -> tuple[np.ndarray, np.ndarray]:
    """Of each column of w: weights of pairs with x and y both unlike, and of those in the same direction; `rows` rows against those below at a time."""
    order = np.argsort(x, kind="stable")
    x, y, w = np.unique(x[order], return_inverse=True)[1], np.unique(y[order], return_inverse=True)[1], w[order].astype("float32")
    total, net = w.sum(axis=0, dtype="float64"), np.zeros(w.shape[1])
    every = (total * total - _squares(w, x) - _squares(w, y) + _squares(w, x, y)) / 2
    for at in range(0, len(x), rows):
        own, below = slice(at, at + rows), slice(0, at + rows)
        way = np.where(x[own, None] > x[below], np.sign(y[own, None] - y[below]), 0).astype("float32")  # sums of small whole numbers: exact
        net += (w[own] * (way @ w[below])).sum(axis=0, dtype="float64")
    return every.astype("int64"), ((every + net) / 2).astype("int64")


def _grid_sides(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of pairs of cells in different rows and columns of a grid of weights (x, y, replicate)."""
    below, every, same = np.zeros(grid.shape[1:], "int64"), 0, 0
    for line in grid:
        upto = below.cumsum(axis=0)
        up = (line * (upto - below)).sum(axis=0)
        same, every = same + up, every + up + (line * (upto[-1] - upto)).sum(axis=0)
        below += line
    return every, same


def pair_replicates(rows: DataFrame, by: list[str], x: str, y: str, unit: Column, n: int = resample.REPLICATES, seed: int = resample.SEED, part: int = PART_ROWS) -> DataFrame:
    """by, b, n_pairs, n_same: pair_counts over hashed resamples, where two units drawn v and w times give v * w pairs.

    A unit is drawn as often in every group it is in, so groups with the same units are resampled jointly; a unit's pair with itself is a tie.
    A group is cut by x and by y, each cut value being a part of its own. Pairs within a part of x, and those within a part of y whose parts of x
    differ, are weighed in that part's task by a product of matrices; all others by the parts' sums of weights. Cuts never decide the result.
    Up to 64 parts a group the work grows with the rows, beyond that with the rows of a part.
    """
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), unit.cast("string").alias("_u"))
    share = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    cuts = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *(F.percentile_approx(v, share, 20 * CUTS).alias(f"{v}_cuts") for v in ("_x", "_y")))
    parts = F.least(F.lit(CUTS + 1), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("_n") / part, F.lit(1.0)))))).cast("int")
    step = ((CUTS + 1) / parts).cast("int")
    wanted = lambda v: F.filter(f"{v}_cuts", lambda c, i: (i + 1) % step == 0)
    cut = known.join(cuts.select(*by, (parts > 1).alias("_cut"), wanted("_x").alias("_xs"), wanted("_y").alias("_ys")), by)
    place = lambda v: (2 * F.size(F.filter(f"{v}s", lambda c: c < F.col(v))) + F.array_contains(f"{v}s", F.col(v)).cast("int")).cast("int")
    cut = cut.select(*by, "_x", "_y", "_u", "_cut", place("_x").alias("_xp"), place("_y").alias("_yp"))
    types = ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in by)
    out = f"{types}, _from int, _every array<bigint>, _same array<bigint>"
    width = len(by)
    tasks = 8 * rows.sparkSession.sparkContext.defaultParallelism  # few rows, much work: not by the bytes that are shuffled

    def within(key, g):
        every, same = _sides_of(g["_v"].to_numpy(), g["_y"].to_numpy(), resample.drawn(seed, g["_u"].tolist(), 0, n))
        return pd.DataFrame([(*key[:width], 0, every, same)], columns=[*by, "_from", "_every", "_same"])

    def sums(key, g):
        rows = []
        for at in range(0, n, GRID):
            w = resample.drawn(seed, g["_u"].tolist(), at, min(at + GRID, n)).astype("int32")
            for column, own in g.groupby("_yp", sort=False).indices.items():
                rows.append((*key[: width + 1], int(column), at, w[own].sum(axis=0, dtype="int32").tobytes()))
        return pd.DataFrame(rows, columns=[*by, "_xp", "_yp", "_from", "_w"])

    def across(key, g):
        lines, columns = (np.unique(g[c].to_numpy(), return_inverse=True) for c in ("_xp", "_yp"))
        w = np.stack([np.frombuffer(b, "int32") for b in g["_w"]])
        grid = np.zeros((len(lines[0]), len(columns[0]), w.shape[1]), "int64")
        np.add.at(grid, (lines[1], columns[1]), w)
        return pd.DataFrame([(*key, *_grid_sides(grid))], columns=[*by, "_from", "_every", "_same"])

    # a part that is one cut value has no pairs within; parts of x keep their values, parts of y the parts of x
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("_xp").alias("part"), F.col("_x").alias("v")), F.struct(F.lit(1).alias("kind"), F.col("_yp").alias("part"), F.col("_xp").cast("double").alias("v")))
    own = cut.withColumn("_k", F.explode(kinds)).where("_k.part % 2 = 0 AND (_k.kind = 0 OR _cut)").select(*by, "_k.kind", "_k.part", F.col("_k.v").alias("_v"), "_y", "_u")
    own = own.withColumnsRenamed({"kind": "_kind", "part": "_part"}).repartition(tasks, *by, "_kind", "_part").groupBy(*by, "_kind", "_part").applyInPandas(within, out)
    many = cut.where("_cut")
    deals = many.groupBy(*by, "_xp").agg(F.ceil(F.count(F.lit(1)) / (4 * part)).alias("_deals"))  # a value that very many rows have is summed in pieces
    dealt = many.join(deals, [*by, "_xp"]).withColumn("_deal", F.pmod(F.xxhash64("_u", "_y"), F.col("_deals"))).select(*by, "_xp", "_deal", "_yp", "_u")
    cells = dealt.repartition(tasks, *by, "_xp", "_deal").groupBy(*by, "_xp", "_deal").applyInPandas(sums, f"{types}, _xp int, _yp int, _from int, _w binary")
    far = cells.groupBy(*by, "_from").applyInPandas(across, out)
    each = own.unionByName(far).select(*by, "_from", F.posexplode(F.arrays_zip("_every", "_same")).alias("_at", "_e"))
    return each.groupBy(*by, (F.col("_from") + F.col("_at")).cast("bigint").alias("b")).agg(F.sum("_e._every").alias("n_pairs"), F.sum("_e._same").alias("n_same"))


def components_of(wide: DataFrame, names: list[str]) -> DataFrame:
    """component, explained, loadings of the principal components of standardised columns, over rows that have all of them.

    One aggregation gives the correlations; their matrix has a row per column, so its eigenvectors are a matter of the driver.
    """
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    known = wide.dropna(subset=names)
    r = known.agg(F.count(F.lit(1)), *(F.corr(a, b) for a, b in pairs)).first()
    matrix = np.eye(len(names))
    for (a, b), v in zip(pairs, r[1:], strict=True):
        i, j = names.index(a), names.index(b)
        matrix[i, j] = matrix[j, i] = v if v is not None and v == v else 0.0
    values, vectors = np.linalg.eigh(matrix)
    rows = []
    for at, i in enumerate(np.argsort(-values), 1):
        v = vectors[:, i] * np.sign(vectors[np.abs(vectors[:, i]).argmax(), i])
        rows.append((at, float(values[i] / len(names)), {n: float(x) for n, x in zip(names, v, strict=True)}))
    return wide.sparkSession.createDataFrame(rows, "component int, explained double, loadings map<string,double>")
