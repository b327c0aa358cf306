"""Column expressions: ratios, labels, p-values and text helpers. All of them stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Abramowitz and Stegun 7.1.26, fixed values: error below 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
#: Bounds of the effect labels.
EFFECT_BOUNDS = ((0.2, "negligible"), (0.5, "small"), (0.8, "medium"))
STAR_BOUNDS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b in doubles; null where b is zero or null."""
    return col(a).cast("double") / F.nullif(col(b).cast("double"), F.lit(0.0))


def not_nan(x: Column | str) -> Column:
    """Null for NaN, as missing values arrive from files."""
    return F.when(F.isnan(col(x).cast("double")), None).otherwise(col(x))


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Rounded half up; null for NaN; minus zero becomes zero."""
    return F.round(not_nan(x), digits) + F.lit(0.0)


def erfc(x: Column) -> Column:
    """1 - erf(x) for x >= 0."""
    t = 1.0 / (1.0 + ERF_P * x)
    a1, a2, a3, a4, a5 = ERF_A
    return ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t * F.exp(-x * x)


def two_sided_p(z: Column | str) -> Column:
    """P(|Z| >= |z|) of a standard normal."""
    return F.least(F.lit(1.0), erfc(F.abs(col(z)) / F.sqrt(F.lit(2.0))))


def effect_label(d: Column | str) -> Column:
    """Bucket of |d|: negligible below 0.2, small below 0.5, medium below 0.8, else large; null stays null."""
    size, out = F.abs(col(d)), F.when(col(d).isNull(), None)
    for bound, name in EFFECT_BOUNDS:
        out = out.when(size < bound, name)
    return out.otherwise("large")


def stars(p: Column | str) -> Column:
    out = F.when(col(p).isNull(), "")
    for bound, mark in STAR_BOUNDS:
        out = out.when(col(p) < bound, mark)
    return out.otherwise("")


def favours(delta: Column | str, lower_better: Column | bool, plus: str, minus: str) -> Column:
    """Name of the side that a difference speaks for; 'tie' at zero, null for null."""
    d = col(delta)
    flipped = lower_better if isinstance(lower_better, Column) else F.lit(bool(lower_better))
    return F.when(d.isNull(), None).when(d == 0, "tie").when((d > 0) != flipped, plus).otherwise(minus)


def array_mean(x: Column | str) -> Column:
    """Mean of the non-null items of an array; null if there are none."""
    kept = F.filter(col(x), lambda v: v.isNotNull())
    return ratio(F.aggregate(kept, F.lit(0.0), lambda s, v: s + v), F.size(kept))


def array_total(x: Column | str) -> Column:
    return F.aggregate(F.filter(col(x), lambda v: v.isNotNull()), F.lit(0.0), lambda s, v: s + v)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays of numbers, summed from the left in doubles."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: Column | str) -> Column:
    """Array over its length; null for a zero vector."""
    return F.transform(col(a), lambda x: x.cast("double") / F.nullif(norm(a), F.lit(0.0)))


def spearman_brown(r: Column | str) -> Column:
    """Reliability of the whole from the correlation of its halves."""
    return 2.0 * col(r) / F.nullif(1.0 + col(r), F.lit(0.0))


def partial_correlation(xy: Column | str, xz: Column | str, yz: Column | str) -> Column:
    """Correlation of x and y without what z explains, from the three pairwise ones."""
    left = F.nullif((1.0 - col(xz) * col(xz)) * (1.0 - col(yz) * col(yz)), F.lit(0.0))
    return (col(xy) - col(xz) * col(yz)) / F.sqrt(left)


def average_rank(by: list[str], value: Column | str, name: str = "_") -> Column:
    """Rank within `by` with ties at their mean."""
    order = Window.partitionBy(*by).orderBy(col(value))
    same = Window.partitionBy(*by, col(value))
    return F.rank().over(order).cast("double") + (F.count(F.lit(1)).over(same) - 1) / F.lit(2.0)


def end_reason(realized: Column | str, tail: Column | str, k: int) -> Column:
    """Why a simulated tail ended: its number of turns against k, its parity and trailing blanks."""
    rt, blank = col(realized), F.coalesce(col(tail), F.lit("")).rlike(r"\s$")
    return (
        F.when(rt.isNull(), "not_simulated").when(rt >= k, "full").when(rt == 0, "no_tail")
        .when((rt % 2 == 1) & blank, "patient_closed").when(rt % 2 == 1, "therapist_stalled").otherwise("after_therapist")
    )


def clean_completion(text: Column | str, markers: tuple[str, str] = ("<|im_end|>", "<|im_start|>")) -> Column:
    """Text before the first control marker, trimmed of blanks; null becomes empty."""
    either = "|".join("".join("\\" + c if not c.isalnum() and c != "_" else c for c in m) for m in markers)
    return F.regexp_replace(F.regexp_replace(F.coalesce(col(text), F.lit("")), f"(?s)(?:{either}).*$", ""), r"^\s+|\s+$", "")


def session_end(text: Column | str, marker: str = "SESSION ENDED") -> Column:
    """struct(said, explanation, ended): text before and after the first marker, whatever its case."""
    at = F.locate(marker.upper(), F.upper(col(text)))
    cut = lambda x: F.trim(x)
    return F.struct(
        F.when(at > 0, cut(F.substring(col(text), F.lit(1), at - 1))).otherwise(col(text)).alias("said"),
        F.when(at > 0, cut(F.substring(col(text), at + len(marker), F.length(col(text))))).alias("explanation"), (at > 0).alias("ended"),
    )


def label_count(text: Column | str, label: str) -> Column:
    """Lines that begin with [label]."""
    return F.regexp_count(col(text), F.lit(rf"(?m)^\s*\[{label}\]"))


def experiment_parts(name: Column | str) -> Column:
    """struct(method, oracle, k, mcl, mode) of a run folder such as PTO_LA5_MCL40_full_gpt; null fields where it does not match."""
    pattern = r"^(PTO|GRPO)_LA(\d+)(?:_MCL(\d+))?(?:_(full|reduced))?(?:_([A-Za-z0-9.-]+))?$"
    part = lambda i: F.nullif(F.regexp_extract(col(name), pattern, i), F.lit(""))
    return F.struct(part(1).alias("method"), part(5).alias("oracle"), part(2).cast("int").alias("k"), part(3).cast("int").alias("mcl"), part(4).alias("mode"))


def model_iteration(model: Column | str) -> Column:
    """Iteration in a model key: 0 for ..._Base, n for ..._In, -1 otherwise."""
    found = F.regexp_extract(col(model), r"_I(\d+)$", 1)
    return F.when(col(model).rlike("_Base$"), 0).when(found != "", found.cast("int")).otherwise(-1)


def model_name(method: Column | str, k: Column | str, iteration: Column | str) -> Column:
    last = F.when(col(iteration) == 0, F.lit("Base")).otherwise(F.concat(F.lit("I"), col(iteration).cast("string")))
    return F.concat(col(method), F.lit("Exp3_LA"), col(k).cast("string"), F.lit("_"), last)
