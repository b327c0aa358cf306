"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Tokens are summed by (source, language, topic) cell; the cells' weights are raked to the marginals, never above what a cell has, until
each one fits; a document is kept with the probability that brings its cell to its weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK_WORD, scratch, stored, unused

DIMS = ("source", "lang", "topic")
#: Marginal targets are tokens to this power, normalised; 1 leaves a marginal as it is, 0 makes it even.
TEMPERATURE = {"source": 0.5, "lang": 0.7, "topic": 0.8}
KEPT_SHARE, SEED = 0.5, 17
_NONE = "\u0000"
#: Cells of a task that rakes.
CELLS_PER_TASK = 100_000
#: Strings that tell topics apart: the first topic of which a text holds any counts; texts with none are prose.
TOPICS = {
    "legal": ("icense", "opyright", "arranty", "LICENSE", "COPYRIGHT"), "web": ("://", "</", "&nbsp;"), "contact": ("@",),
    "code": ("();", "{\n", "==", "#include"), "data": ("|", "\t"), "dialogue": ("? ", "?\n"),
}


def topic_of(text: Column) -> Column:
    """Topic by the first of TOPICS of whose strings a text holds one, else 'prose'. Null and empty texts are 'empty'."""
    whole = F.coalesce(text, F.lit(""))
    out = F.when(whole == "", "empty")
    for name, marks in TOPICS.items():
        some = F.lit(False)
        for m in marks:
            some = some | F.contains(whole, F.lit(m))
        out = out.when(some, name)
    return out.otherwise("prose")


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(BLANK_WORD)).cast("long")


def _keyed(docs: DataFrame, topic: Column | None, names: list[str]) -> DataFrame:
    """docs with the keys of each document's cell and its tokens, under these names."""
    topic = topic_of(F.col("text")) if topic is None else topic
    values = [*(F.col(d).cast("string") for d in DIMS[:2]), topic]
    return docs.withColumns({n: F.coalesce(v, F.lit(_NONE)) for n, v in zip(names, values, strict=False)} | {names[3]: n_tokens(F.col("text"))})


def _dealt(cells: DataFrame, rows: int) -> DataFrame:
    return cells.coalesce(-(-max(rows, 1) // CELLS_PER_TASK))


def default_targets(cells: DataFrame) -> dict[str, DataFrame]:
    """Per dimension (value, target): the share of tokens to the power TEMPERATURE, normalised."""
    out = {}
    for d in DIMS:
        sums = cells.groupBy(d).agg(F.sum("tokens").alias("t")).where("t > 0").withColumn("p", F.pow("t", F.lit(TEMPERATURE[d])))
        total = sums.agg(F.sum("p")).first()[0] or 1.0
        out[d] = sums.select(d, (F.col("p") / total).alias("target"))
    return out


def reachable(cells: DataFrame, dim: str, targets: DataFrame, share: float) -> DataFrame:
    """(value, goal): targets as tokens of a sample of `share` of all, none above what its value has; what is cut goes to the others.

    A value without a target keeps its share of tokens.
    """
    have = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("have"))
    total = have.agg(F.sum("have")).first()[0] or 0.0
    both = stored(have.join(targets, dim, "left").select(dim, "have", F.coalesce("target", F.col("have") / F.lit(total or 1.0)).alias("target")), "targets")
    scale, capped = share, -1
    while True:  # values that reach what they have stay there, the others share the rest; the set of the former only grows
        full = F.col("target") * F.lit(scale * total) >= F.col("have") * (1 - 1e-12)
        n, fixed, free = both.agg(F.count_if(full), F.sum(F.when(full, F.col("have"))), F.sum(F.when(~full, F.col("target")))).first()
        if n == capped or not free:
            break
        capped, scale = n, (share * total - (fixed or 0.0)) / (total * free)
    return both.select(dim, F.least("have", F.col("target") * F.lit(scale * total)).alias(f"goal_{dim}"))


def rake(cells: DataFrame, goals: dict[str, DataFrame], share: float, tolerance: float = 1e-6, max_rounds: int = 120, per_job: int = 3) -> DataFrame:
    """cells (keys, tokens) with `weight`, tokens to keep of each: at most what it has, and by each dimension the goals in sum.

    A round multiplies the weights by goal over sum and cuts them at what a cell has, dimension after dimension; what is cut is
    made up by the others in the rounds that follow. Stops when no sum is off by more than `tolerance` of all tokens, or after
    `max_rounds`, as happens with goals that contradict each other; `off` says by how much of all tokens the worst sum is off.
    """
    w = cells.where("tokens > 0").withColumn("weight", F.col("tokens") * F.lit(float(share)))
    total = float(w.agg(F.sum("tokens")).first()[0] or 1)
    for d in DIMS:
        w = w.join(goals[d], d)
    w = stored(w, "cells")
    rows, off = w.count(), None
    have = {d: F.sum("weight").over(Window.partitionBy(d)) for d in DIMS}  # cells, not documents; a join with sums would run the plan twice a step
    for _ in range(0, max_rounds, per_job):
        w = _dealt(w, rows)
        for _ in range(per_job):
            for d in DIMS:
                w = w.withColumn("weight", F.least(F.col("tokens").cast("double"), F.col("weight") * F.col(f"goal_{d}") / have[d]))
        w = stored(w, "raked")
        worst = [_dealt(w, rows).groupBy(d).agg((F.abs(F.sum("weight") - F.first(f"goal_{d}")) / total).alias("off")) for d in DIMS]
        off = worst[0].union(worst[1]).union(worst[2]).agg(F.max("off")).first()[0] or 0.0
        if off <= tolerance:
            break
    return w.select(*DIMS, "tokens", "n_docs", "weight", F.lit(off or 0.0).alias("off"))


def cell_probabilities(cells: DataFrame, share: float, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(source, lang, topic, tokens, n_docs, weight, off, probability) of cells (source, lang, topic, tokens, n_docs)."""
    targets = targets or default_targets(cells)
    goals = {d: reachable(cells, d, targets[d], share) for d in DIMS}
    raked = rake(cells, goals, share)
    return raked.withColumn("probability", F.round(F.least(F.lit(1.0), F.col("weight") / F.col("tokens")), 9))


def mix(docs: DataFrame, share: float = KEPT_SHARE, seed: int = SEED, topic: Column | None = None, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """docs with topic, n_tokens, probability, sample_weight (1 / probability) and kept.

    `targets` holds (value, target) by dimension, shares that add up to one. Marginal values that are null form a value of their
    own. A document without tokens is kept with probability `share`. The draw is a hash of seed, doc_id and text: repeats of a row
    share its fate, and a rerun draws alike. An empty table gives an empty one; columns of the five names are replaced, all others pass
    through.
    """
    names = unused(docs, *(f"cell_{d}" for d in DIMS), "cell_tokens", "cell_p")
    keyed = _keyed(docs, topic, names)
    with scratch(docs.sparkSession):
        cells = keyed.groupBy(*(F.col(n).alias(d) for n, d in zip(names, DIMS, strict=False))).agg(F.sum(names[3]).alias("tokens"), F.count("*").alias("n_docs"))
        cells = stored(cells, "token-cells")
        cells = _dealt(cells, cells.count())
        probs = stored(cell_probabilities(cells, share, targets).select(*(F.col(d).alias(n) for n, d in zip(names, DIMS, strict=False)), F.col("probability").alias(names[4])), "probabilities", result=True)
    p = F.coalesce(names[4], F.lit(float(share)))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    out = keyed.join(probs, names[:3], "left").withColumns({
        "topic": F.nullif(F.col(names[2]), F.lit(_NONE)), "n_tokens": F.col(names[3]), "probability": p, "sample_weight": F.round(1 / F.nullif(p, F.lit(0.0)), 9), "kept": draw < p,
    })
    return out.select(*(c for c in out.columns if c not in names))


def digest(docs: DataFrame) -> DataFrame:
    """mix() of all rows without their texts; null languages and sources are values of their own, an empty table gives an empty one."""
    return mix(docs.select("doc_id", "text", "lang", "source")).drop("text")
