"""Groups of scored candidates: dispersion, weights, pair emission, degenerate cases, tails and their calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio
from . import ranking

GROUP = ["arm", "train_iter", "group_id"]
#: A pair is emitted only above this difference.
TAU = 0.1
CANDIDATE = "struct<idx:int,completion:string,score:double,sub_scores:map<string,double>,role:string,oracle:struct<success:boolean,retries:int>,lookahead:struct<k:int,realized_turns:int,ended_early:boolean,tail:string>>"
BRANCH = f"method string, iteration int, phase string, conversation_id int, branch_id int, epoch double, prefix string, group_mean double, group_std double, chosen_idx int, candidates array<{CANDIDATE}>"
#: Of these, what scores of a record and what tails of its candidates take: fields that aren't named are skipped by the parser.
BRANCH_SCORES = "method string, iteration int, branch_id int, prefix string, chosen_idx int, candidates array<struct<idx:int,score:double>>"
BRANCH_TAILS = "method string, iteration int, branch_id int, candidates array<struct<score:double,lookahead:struct<realized_turns:int,tail:string>>>"


def flatten(branches: DataFrame) -> DataFrame:
    """Branch records to one row per candidate; eval_iter is the iteration of the sampled policy, a missing epoch is -1."""
    rows = branches.select("*", F.explode("candidates").alias("c"))
    return rows.select(
        "method", F.col("iteration").alias("train_iter"), (F.col("iteration") - 1).alias("eval_iter"), "phase", "conversation_id", "branch_id", F.coalesce("epoch", F.lit(-1.0)).alias("epoch"), "group_mean", "group_std", "chosen_idx",
        F.col("c.idx").alias("cand_idx"), "c.role", "c.score", F.col("c.sub_scores")["Q1"].alias("q1"), F.col("c.sub_scores")["Q2"].alias("q2"), "c.lookahead.realized_turns", "c.lookahead.ended_early", F.length("c.completion").alias("len_chars"),
        F.coalesce(F.col("c.idx") == F.col("chosen_idx"), F.lit(False)).alias("is_chosen"), (F.coalesce(F.trim("c.completion"), F.lit("")) == "").alias("empty"), F.col("c.completion").alias("completion"), F.col("c.lookahead.tail").alias("tail"),
    )


def trained(gens: DataFrame) -> DataFrame:
    """Rows that carry a gradient: the eval phase is left out."""
    return gens.where("phase <> 'eval'")


def group_frame(gens: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """A row per group: n, n_scored, sd0, sd1, lo, hi, mean, margin, winner_z; winner_z is null where sd0 is zero."""
    g = gens.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count("score").alias("n_scored"), F.stddev_pop("score").alias("sd0"), F.stddev_samp("score").alias("sd1"),
        F.min("score").alias("lo"), F.max("score").alias("hi"), F.avg("score").alias("mean"),
    )
    return g.withColumns({"margin": F.col("hi") - F.col("lo"), "winner_z": ratio(F.col("hi") - F.col("mean"), "sd0")})


def dispersion(groups: DataFrame, by: list[str], tau: float = TAU) -> DataFrame:
    """by: summaries over groups with at least two scores."""
    g = groups.where("n_scored >= 2")
    sums = g.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_groups"), F.avg("sd0").alias("sd_mean"), F.avg("margin").alias("margin_mean"),
        F.avg("winner_z").alias("winner_z"), F.avg((F.col("sd0") < 1e-6).cast("int")).alias("frac_sd_zero"), F.avg((F.col("n_scored") < F.col("n")).cast("int")).alias("frac_unscored"),
        F.avg((F.col("margin") > tau).cast("int")).alias("yield_tau"),
    )
    long = g.select(*by, F.explode(F.create_map(*(x for n in ("sd0", "margin", "mean") for x in (F.lit(n), F.col(n).cast("double"))))).alias("of", "value"))
    q = ranking.quantiles(long, [*by, "of"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    part = lambda n, c: F.max(F.when(F.col("of") == n, F.col(c)))
    middle = q.groupBy(*by).agg(part("sd0", "q2").alias("sd_median"), part("margin", "q2").alias("margin_median"), (part("mean", "q3") - part("mean", "q1")).alias("reward_iqr"))
    return sums.join(middle, by)


def tau_yield(groups: DataFrame, by: list[str], taus: list[float]) -> DataFrame:
    """by, tau: share of groups whose margin is above each threshold."""
    steps = groups.where("n_scored >= 2").withColumn("tau", F.explode(F.array(*(F.lit(float(t)) for t in taus))))
    return steps.groupBy(*by, "tau").agg(F.count(F.lit(1)).alias("n_groups"), F.avg((F.col("margin") > F.col("tau")).cast("int")).alias("share"))


def standardised_weights(gens: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """Candidates with weight (score - mean) / sd of the group (n - 1), rescaled so that absolute weights add up to two."""
    w = Window.partitionBy(*by)
    known = gens.where("score IS NOT NULL")
    raw = known.withColumn("raw", F.coalesce(ratio(F.col("score") - F.avg("score").over(w), F.stddev_samp("score").over(w)), F.lit(0.0)))
    return rescaled(raw, by)


def rescaled(df: DataFrame, by: list[str], raw: str = "raw") -> DataFrame:
    """weight = raw * 2 / sum of |raw| in the group; groups that add up to zero leave."""
    return df.withColumn("weight", 2 * F.col(raw) / F.nullif(F.sum(F.abs(raw)).over(Window.partitionBy(*by)), F.lit(0.0))).where("weight IS NOT NULL")


def best_and_worst(gens: DataFrame, by: list[str] = GROUP, tau: float = TAU) -> DataFrame:
    """A pair per group with two scores and a difference above tau: on ties best has the highest index, worst the lowest."""
    g = gens.where("score IS NOT NULL").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("score", "cand_idx")).alias("best"), F.min(F.struct("score", "cand_idx")).alias("worst"))
    margin = F.col("best.score") - F.col("worst.score")
    out = g.where((F.col("n") >= 2) & (margin > tau))
    return out.select(*by, "n", F.col("best.cand_idx").alias("chosen_idx"), F.col("worst.cand_idx").alias("rejected_idx"), margin.alias("margin"))


def pair_weights(gens: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """+1 for the best and -1 for the worst of each group, first occurrence on ties; groups without two different scores leave."""
    w = Window.partitionBy(*by)
    known = gens.where("score IS NOT NULL").withColumns({
        "_top": F.row_number().over(w.orderBy(F.col("score").desc(), "cand_idx")), "_low": F.row_number().over(w.orderBy("score", "cand_idx")), "_hi": F.max("score").over(w), "_lo": F.min("score").over(w)})
    out = known.where("_hi <> _lo").withColumn("raw", F.when(F.col("_top") == 1, 1.0).when(F.col("_low") == 1, -1.0).otherwise(0.0))
    return rescaled(out.drop("_top", "_low", "_hi", "_lo"), by)


def feature_push(weighted: DataFrame, feature: Column, by: list[str], group: list[str] = GROUP) -> DataFrame:
    """by, n_groups, push, push_se: what the weights move a feature by, summed in a group and averaged over groups."""
    g = weighted.groupBy(*group).agg(F.sum(F.col("weight") * feature).alias("v"))
    return g.groupBy(*by).agg(F.count(F.lit(1)).alias("n_groups"), F.avg("v").alias("push"), (F.stddev_samp("v") / F.sqrt(F.count("v").cast("double"))).alias("push_se"))


def grouped_split(rows: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """rows with split 'eval' or 'train' by whole groups: the first max(1, share n) groups by hash, never all of them.

    Distinct ids are counted by the first three digits of their hash; only those that share the digits of the last chosen one are ordered.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string")))
    start = F.substring(key, 1, 3)
    ids = rows.select(group).distinct()
    counts = sorted(ids.groupBy(start.alias("start")).count().collect())  # 4,096 rows at most
    n = sum(c for _, c in counts)
    left = 0 if n < 2 else min(max(1, int(n * share)), n - 1)
    edge = ""
    for edge, c in counts:
        if c > left:
            break
        left -= c
    at_edge = ids.where(start == edge).orderBy(key, group).limit(left).withColumn("split_eval", F.lit(True))
    chosen = (F.col(group).isNotNull() & (start < edge)) | F.col("split_eval")
    return rows.join(at_edge, group, "left").withColumn("split", F.when(chosen, "eval").otherwise("train")).drop("split_eval")


def call_counts(gens: DataFrame, by: list[str]) -> DataFrame:
    """by: candidates, scoring calls and simulated-turn calls, half of the realized turns rounded up."""
    turns = F.coalesce("realized_turns", F.lit(0))
    return gens.groupBy(*by).agg(F.count(F.lit(1)).alias("n_candidates"), F.count("score").alias("scored"), F.sum(F.ceil(turns / 2)).cast("long").alias("tail_calls"))
